"""Declared column types, table schemas, states and errors.

Type names follow the SQL dialect in which tables are declared; an unknown name is refused when a table
is declared, not when it is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class EngineError(Exception):
    """Base of the engine's errors; ``code`` is the business code."""

    code = 1


class TableExists(EngineError):
    code = 100


class TableNotFound(EngineError):
    code = 101


class RegionNotFound(EngineError):
    code = 102


class RegionNotAvailable(EngineError):
    code = 103


class KeyNotFound(EngineError):
    code = 104


class DuplicateKey(EngineError):
    code = 105


class InvalidSchema(EngineError):
    code = 106


class InvalidRequest(EngineError):
    code = 3


class IllegalTransition(EngineError):
    code = 9


class ServerState(str, Enum):
    ONLINE = "ONLINE"
    OFFLINE = "OFFLINE"
    DEAD = "DEAD"


class RegionState(str, Enum):
    OFFLINE = "OFFLINE"
    OPENING = "OPENING"
    ONLINE = "ONLINE"
    SPLITTING = "SPLITTING"
    SPLIT = "SPLIT"
    MIGRATING = "MIGRATING"
    CLOSED = "CLOSED"


_PLAIN = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "TINYINT": T.ByteType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "TEXT": T.StringType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampType(),
    "BOOLEAN": T.BooleanType(),
    "BLOB": T.BinaryType(),
}


def parse_type(name: str) -> T.DataType:
    """The Spark type of a declared type name, such as BIGINT, VARCHAR(50) or DECIMAL(10,2)."""
    text = re.sub(r"\s+", " ", name.strip().upper())
    if text in _PLAIN:
        return _PLAIN[text]
    if m := re.fullmatch(r"(?:VARCHAR|CHAR) ?\( ?(\d+) ?\)", text):
        if int(m[1]) < 1:
            raise InvalidSchema(f"length of {name!r}")
        return T.StringType()
    if m := re.fullmatch(r"DECIMAL ?\( ?(\d+) ?(?:, ?(\d+) ?)?\)", text):
        precision, scale = int(m[1]), int(m[2] or 0)
        if not 1 <= precision <= 38 or scale > precision:
            raise InvalidSchema(f"precision of {name!r}")
        return T.DecimalType(precision, scale)
    raise InvalidSchema(f"unknown type {name!r}")


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    comment: str = ""

    def to_field(self) -> T.StructField:
        notes = {"type": self.type, "comment": self.comment} | ({"default": self.default} if self.default is not None else {})
        return T.StructField(self.name, parse_type(self.type), self.nullable, notes)

    @property
    def length(self) -> int | None:
        m = re.search(r"CHAR ?\( ?(\d+)", self.type.upper())
        return int(m[1]) if m else None


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...]
    primary_key: str
    version: int = 1
    notes: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not re.fullmatch(r"[A-Za-z_]\w*", self.name):
            raise InvalidSchema(f"table name {self.name!r}")
        if len({n.lower() for n in names}) != len(names):
            raise InvalidSchema("column names repeat")
        if self.primary_key not in names:
            raise InvalidSchema(f"primary key {self.primary_key!r} is not a column")
        key = parse_type(self.column(self.primary_key).type)
        if not isinstance(key, (T.IntegralType, T.StringType)):
            raise InvalidSchema(f"a primary key can't be {self.column(self.primary_key).type}")
        for c in self.columns:
            parse_type(c.type)

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def to_struct(self) -> T.StructType:
        return T.StructType([c.to_field() for c in self.columns])

    @property
    def key_type(self) -> T.DataType:
        return parse_type(self.column(self.primary_key).type)


def _split_top(body: str) -> list[str]:
    parts, depth, start, quote = [], 0, 0, ""
    for k, ch in enumerate(body):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and depth == 0:
            parts.append(body[start:k])
            start = k + 1
    return [p.strip() for p in [*parts, body[start:]] if p.strip()]


def parse_create_table(sql: str) -> TableSchema:
    """The schema of ``CREATE TABLE name (column type [NOT NULL] [DEFAULT x] [COMMENT 'c'] [PRIMARY KEY], ...)``."""
    m = re.fullmatch(r"\s*CREATE\s+TABLE\s+`?(\w+)`?\s*\((.*)\)\s*;?\s*", sql, re.I | re.S)
    if not m:
        raise InvalidSchema("not a CREATE TABLE statement")
    columns: list[Column] = []
    key: str | None = None
    for part in _split_top(m[2]):
        if k := re.fullmatch(r"(?:CONSTRAINT\s+\w+\s+)?PRIMARY\s+KEY\s*\(\s*`?(\w+)`?\s*\)", part, re.I):
            key = k[1]
            continue
        c = re.fullmatch(r"`?(\w+)`?\s+(\w+(?:\s*\([^)]*\))?)(.*)", part, re.S)
        if not c:
            raise InvalidSchema(f"column {part!r}")
        rest = c[3]
        default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\S+)", rest, re.I)
        comment = re.search(r"\bCOMMENT\s+'((?:[^']|'')*)'", rest, re.I)
        own_key = re.search(r"\bPRIMARY\s+KEY\b", rest, re.I)
        if own_key:
            key = c[1]
        nullable = not own_key and not re.search(r"\bNOT\s+NULL\b", rest, re.I)
        columns.append(Column(c[1], c[2], nullable, default[1].strip("'") if default else None, comment[1] if comment else ""))
    if key is None:
        raise InvalidSchema("no primary key")
    return TableSchema(m[1], tuple(columns), key)
