"""Tables of a relational database as a source: one read task for each region's key range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rangeframe.functions.keys import typed_bound
from rangeframe.functions.types import TableSchema
from rangeframe.operators.routing import Bounds


def predicates(schema: TableSchema, bounds: Bounds) -> list[str]:
    """A condition of the database's SQL for each key range."""

    def literal(bound: bytes) -> str | None:
        value = typed_bound(bound, schema.key_type)
        if value is None:
            return None
        return "'" + value.replace("'", "''") + "'" if isinstance(schema.key_type, T.StringType) else str(value)

    out = []
    for start, end, _ in bounds:
        parts = [f"{schema.primary_key} {op} {v}" for op, v in ((">=", literal(start)), ("<", literal(end))) if v is not None]
        out.append(" AND ".join(parts) or "1 = 1")
    return out


def read_jdbc(spark: SparkSession, url: str, schema: TableSchema, bounds: Bounds, table: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """The rows of a database's table, a partition for each region, typed as the schema declares."""
    rows = spark.read.jdbc(url, table or schema.name, predicates=predicates(schema, bounds), properties=properties or {})
    names = {c.lower(): c for c in rows.columns}
    return rows.select(*[rows[names[f.name.lower()]].cast(f.dataType).alias(f.name) for f in schema.to_struct()])
