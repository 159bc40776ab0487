"""Routing keys: byte strings whose unsigned order is the order of the typed keys.

A 64-bit integer is 8 big-endian bytes with the sign bit flipped; a string is its UTF-8 bytes. The empty
byte string bounds nothing: as a region's start or end it means that the side is open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN = b""


def encode(value: int | str | bytes | None) -> bytes:
    """The routing key of a value on the driver; None is the open bound."""
    if value is None:
        return OPEN
    if isinstance(value, bytes):
        return value
    if isinstance(value, str):
        return value.encode()
    return (value + (1 << 63)).to_bytes(8, "big")


def decode(key: bytes, kind: T.DataType) -> int | str | None:
    """The typed value of a routing key; None for the open bound."""
    if key == OPEN:
        return None
    return key.decode() if isinstance(kind, T.StringType) else int.from_bytes(key, "big") - (1 << 63)


def after(key: bytes) -> bytes:
    """The smallest routing key that is larger than ``key``."""
    return key + b"\x00"


def typed_bound(bound: bytes, kind: T.DataType) -> int | str | None:
    """A range's bound as a typed value that compares alike; None for an open side, or one past the largest value."""
    if bound == OPEN or isinstance(kind, T.StringType):
        return bound.decode() if bound else None
    value = int.from_bytes(bound[:8], "big") - (1 << 63) + (len(bound) > 8)
    return value if value < 1 << 63 else None


# Sets of keys: sorted, disjoint, half-open ranges of routing keys; an empty bound is open.

Ranges = list[tuple[bytes, bytes]]
EVERYTHING: Ranges = [(OPEN, OPEN)]


def _last(end: bytes) -> tuple[bool, bytes]:
    return end == OPEN, end


def points(keys: list) -> Ranges:
    """The ranges that hold these values and nothing else."""
    return [(k, after(k)) for k in sorted({encode(v) for v in keys if v is not None})]


def intersect(a: Ranges, b: Ranges) -> Ranges:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        low, high = max(a[i][0], b[j][0]), min(a[i][1], b[j][1], key=_last)
        if high == OPEN or low < high:
            out.append((low, high))
        if _last(a[i][1]) <= _last(b[j][1]):
            i += 1
        else:
            j += 1
    return out


def unite(a: Ranges, b: Ranges) -> Ranges:
    out: Ranges = []
    for low, high in sorted([*a, *b], key=lambda r: (r[0], _last(r[1]))):
        if out and (out[-1][1] == OPEN or low <= out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], high, key=_last))
        else:
            out.append((low, high))
    return out


def key_column(col: Column | str, kind: T.DataType) -> Column:
    """The routing key of a typed column, as an expression that stays in the JVM."""
    col = F.col(col) if isinstance(col, str) else col
    if isinstance(kind, T.StringType):
        return col.cast("binary")
    if isinstance(kind, T.BinaryType):
        return col
    flipped = col.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def contains(key: Column, start: Column, end: Column) -> Column:
    """Whether the half-open region [start, end) holds a key; empty bounds are open."""
    empty = F.lit(b"")
    return ((start == empty) | (key >= start)) & ((end == empty) | (key < end))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether the region [start, end) meets the range [low, high); empty bounds are open.

    A range of no width meets a region that holds its point inside: that region is looked at, no row is found.
    """
    empty = F.lit(b"")
    before = (end != empty) & (low != empty) & (end <= low)
    after = (start != empty) & (high != empty) & (start >= high)
    return ~before & ~after


def range_condition(pk: str, start: object | None, end: object | None) -> Column | None:
    """start <= pk < end on the typed column, which reaches the Parquet scan; None if both are open."""
    parts = []
    if start is not None:
        parts.append(F.col(pk) >= F.lit(start))
    if end is not None:
        parts.append(F.col(pk) < F.lit(end))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]
