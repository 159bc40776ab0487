"""Reading operators over a table with a primary key: lookups, scans, counts and aggregates.

Each takes a DataFrame and the name of its key and returns a DataFrame. Key bounds are compared on the
typed column, so that they reach the Parquet scan and its min/max statistics; what a request doesn't ask
for is never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeframe.functions.keys import range_condition
from rangeframe.functions.types import InvalidRequest

#: Aggregate functions of a query, over one column.
AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
#: Keys of one request up to which they stand in the scan's condition, and up to which they are broadcast; more
#: are joined by shuffling.
CONDITION_KEYS, BROADCAST_KEYS = 1000, 100_000


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The asked-for columns; none or an empty list means all."""
    if not columns:
        return df
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise InvalidRequest(f"unknown columns {unknown}")
    return df.select(*columns)


def condition(df: DataFrame, text: str | None) -> Column | None:
    """A filter string as a boolean column: a Spark SQL expression over the table's columns."""
    if not text or not text.strip():
        return None
    try:
        kind = df.select(F.expr(text).alias("c")).schema["c"].dataType
    except (AnalysisException, ParseException) as e:
        raise InvalidRequest(f"filter {text!r}: {str(e).splitlines()[0]}") from e
    if not isinstance(kind, T.BooleanType):
        raise InvalidRequest(f"filter {text!r} is not a condition")
    return F.expr(text)


def within(df: DataFrame, pk: str, start: Any = None, end: Any = None, filter: str | None = None) -> DataFrame:
    """Rows with start <= key < end that satisfy the filter."""
    for c in (range_condition(pk, start, end), condition(df, filter)):
        if c is not None:
            df = df.where(c)
    return df


def get(df: DataFrame, pk: str, key: Any, columns: list[str] | None = None) -> DataFrame:
    """The row of a key, if there is one."""
    return project(df.where(F.col(pk) == F.lit(key)), columns).limit(1)


def key_frame(df: DataFrame, pk: str, keys: list[Any]) -> DataFrame:
    """(pos, key) in the order of a request."""
    schema = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("key", df.schema[pk].dataType)])
    return df.sparkSession.createDataFrame(list(enumerate(keys)), schema)


def _listed(df: DataFrame, pk: str, keys: list[Any]) -> DataFrame:
    """The rows of a short list of keys, which stands in the scan's condition: at most as many rows as keys."""
    return df.where(F.col(pk).isin([k for k in dict.fromkeys(keys) if k is not None]))


def exists(df: DataFrame, pk: str, keys: list[Any] | DataFrame) -> DataFrame:
    """(pos, key, found) for each key asked for; ``keys`` may be a DataFrame with pos and key."""
    if isinstance(keys, list) and len(keys) <= CONDITION_KEYS:
        asked, there = key_frame(df, pk, keys), _listed(df, pk, keys).select(F.col(pk).alias("key")).distinct()
        return asked.join(F.broadcast(there.withColumn("found", F.lit(True))), "key", "left").select("pos", "key", F.coalesce("found", F.lit(False)).alias("found"))
    asked, n = (key_frame(df, pk, keys), len(keys)) if isinstance(keys, list) else (keys, None)
    wanted = asked.select("key").distinct()
    # Only the table's rows with asked-for keys leave the scan, without an aggregate over the table.
    there = df.select(F.col(pk).alias("key")).join(F.broadcast(wanted) if n is not None and n <= BROADCAST_KEYS else wanted, "key", "left_semi").distinct()
    return asked.join(there.withColumn("found", F.lit(True)), "key", "left").select("pos", "key", F.coalesce("found", F.lit(False)).alias("found"))


def batch_get(df: DataFrame, pk: str, keys: list[Any] | DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per asked-for key, in order: pos, key, found and the columns (null where not found)."""
    wanted = columns or df.columns
    project(df, wanted)
    shown = [F.col(f"__of_{k}").alias(c) for k, c in enumerate(wanted)]
    found = lambda rows: rows.select(F.col(pk).alias("__pk"), *[F.col(f"`{c}`").alias(f"__of_{k}") for k, c in enumerate(wanted)])
    if isinstance(keys, list) and len(keys) <= CONDITION_KEYS:
        asked = key_frame(df, pk, keys).coalesce(1)
        joined = asked.join(F.broadcast(found(_listed(df, pk, keys))), F.col("key") == F.col("__pk"), "left")
        return joined.sortWithinPartitions("pos").select("pos", "key", F.col("__pk").isNotNull().alias("found"), *shown)
    asked, n = (key_frame(df, pk, keys), len(keys)) if isinstance(keys, list) else (keys, None)
    listed = asked.select(F.col("key").alias("__key")).distinct()
    hit = df.join(F.broadcast(listed) if n is not None and n <= BROADCAST_KEYS else listed, F.col(pk) == F.col("__key"), "left_semi")
    joined = asked.join(found(hit), F.col("key") == F.col("__pk"), "left")
    return joined.select("pos", "key", F.col("__pk").isNotNull().alias("found"), *shown).orderBy("pos")


def scan(
    df: DataFrame,
    pk: str,
    start: Any = None,
    end: Any = None,
    columns: list[str] | None = None,
    filter: str | None = None,
    limit: int = 0,
    reverse: bool = False,
) -> DataFrame:
    """Rows of [start, end) in key order, backwards if ``reverse``; limit 0 means all."""
    if limit < 0:
        raise InvalidRequest("a limit can't be negative")
    order = F.col(pk).desc() if reverse else F.col(pk).asc()
    rows = within(df, pk, start, end, filter).orderBy(order)
    return project(rows.limit(limit) if limit else rows, columns)


def count(df: DataFrame, pk: str, start: Any = None, end: Any = None, filter: str | None = None) -> DataFrame:
    """One row: the number of rows in the range."""
    return within(df, pk, start, end, filter).agg(F.count(F.lit(1)).alias("count"))


def aggregate(df: DataFrame, pk: str, function: str, column: str, start: Any = None, end: Any = None, filter: str | None = None) -> DataFrame:
    """One row: value (double, null if no row took part) and the count of rows that took part."""
    name = function.upper()
    if name not in AGGREGATES:
        raise InvalidRequest(f"unknown aggregate {function!r}")
    project(df, [column])
    return within(df, pk, start, end, filter).agg(AGGREGATES[name](column).cast("double").alias("value"), F.count(column).alias("count"))


def filter_rows(
    df: DataFrame, pk: str, filter: str, start: Any = None, end: Any = None, columns: list[str] | None = None, limit: int = 0
) -> DataFrame:
    """Rows that satisfy a condition, in key order, so that a limit is deterministic."""
    return scan(df, pk, start, end, columns, filter, limit)


@dataclass(frozen=True)
class Query:
    """A request of one of three kinds: ``count``, ``aggregate`` or ``filter``."""

    kind: str
    start: Any = None
    end: Any = None
    filter: str | None = None
    function: str | None = None
    column: str | None = None
    columns: tuple[str, ...] = ()
    limit: int = 0


def query(df: DataFrame, pk: str, request: Query) -> DataFrame:
    """Run a request."""
    if request.kind == "count":
        return count(df, pk, request.start, request.end, request.filter)
    if request.kind == "aggregate":
        if not request.function or not request.column:
            raise InvalidRequest("an aggregate needs a function and a column")
        return aggregate(df, pk, request.function, request.column, request.start, request.end, request.filter)
    if request.kind == "filter":
        return filter_rows(df, pk, request.filter or "true", request.start, request.end, list(request.columns), request.limit)
    raise InvalidRequest(f"unknown query {request.kind!r}")


def partial_aggregates(df: DataFrame, region: Column | str, column: str) -> DataFrame:
    """Partials of each region: n, total, least, most. They combine to the table's aggregates."""
    c = F.col(column)
    return df.groupBy(region).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("least"), F.max(c).alias("most"))


def combine_partials(partials: DataFrame) -> DataFrame:
    """One row from partials: count, sum, avg, min, max."""
    n, total = F.sum("n"), F.sum("total")
    return partials.agg(
        F.coalesce(n, F.lit(0)).alias("count"), total.alias("sum"), (total / F.when(n > 0, n)).alias("avg"), F.min("least").alias("min"), F.max("most").alias("max")
    )
