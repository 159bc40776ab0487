"""Joins: inner, left and right equi-joins, co-located joins, and key-list reduction.

Which side is broadcast is left to Catalyst and adaptive execution, which know sizes; nothing is hinted
without a check. Tables that are laid out by one key with the same number of buckets join without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeframe.functions.types import InvalidRequest

KINDS = ("inner", "left", "right")
#: Keys up to which the key list of a semi-join is broadcast.
BROADCAST_KEYS = 1_000_000


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], kind: str = "inner") -> DataFrame:
    """Join on pairs of columns. Names on both sides must differ, except for a shared key name."""
    if kind not in KINDS:
        raise InvalidRequest(f"unknown join {kind!r}")
    shared = {a for a, b in on if a == b}
    clash = (set(left.columns) & set(right.columns)) - shared
    if clash:
        raise InvalidRequest(f"columns on both sides: {sorted(clash)}")
    if all(a == b for a, b in on):
        return left.join(right, [a for a, _ in on], kind)
    matches = None
    for a, b in on:
        c = left[a] == right[b]
        matches = c if matches is None else matches & c
    return left.join(right, matches, kind)


def write_colocated(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a table in buckets of its key, sorted: joins of tables with equal buckets don't shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def colocated_join(spark, left: str, right: str, left_key: str, right_key: str, kind: str = "inner") -> DataFrame:
    """Join two bucketed tables by their bucket keys."""
    a, b = spark.table(left), spark.table(right)
    # A merge join reads the buckets as they are, however small a side looks.
    return equi_join(a.hint("merge"), b, [(left_key, right_key)], kind)


def reduced_join(small: DataFrame, large: DataFrame, small_key: str, large_key: str, kind: str = "inner") -> DataFrame:
    """Join after the large side is reduced to the keys of the (filtered) small side.

    The key list is broadcast only if it is within BROADCAST_KEYS, so that the large side is filtered
    where it is scanned; otherwise the plain join shuffles both sides anyway and a reduction adds nothing.
    """
    keys = small.select(F.col(small_key).alias("__key")).distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        large = large.join(F.broadcast(keys), F.col(large_key) == F.col("__key"), "left_semi")
    return equi_join(small, large, [(small_key, large_key)], kind)
