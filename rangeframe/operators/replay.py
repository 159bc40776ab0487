"""The write log: entries, checksums, tails, replay and lag.

An entry is (sequence_id, op PUT or DELETE, key columns, value columns, present): ``present`` names the
value columns that a PUT carries; null means all. Replay merges by column: the last PUT of a column wins,
and a DELETE sets all columns to nothing, so columns of before a DELETE never come back. One aggregation
by key does it, with partials before the shuffle, so a hot key is merged where its entries lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT = (
    "sequence_id long, region_id string, ts long, op string, key binary, columns map<string,binary>, checksum binary"
)


def checksum(sequence: Column, op: Column, key: Column, columns: Column) -> Column:
    """SHA-256 over an entry's parts; map entries in the order of their names."""
    pairs = F.transform(F.array_sort(F.map_entries(columns)), lambda e: F.concat_ws("=", e["key"], F.coalesce(F.hex(e["value"]), F.lit("-"))))
    return F.unhex(F.sha2(F.concat_ws("|", sequence.cast("string"), op, F.hex(key), F.array_join(pairs, ",")).cast("binary"), 256))


def with_checksum(log: DataFrame) -> DataFrame:
    return log.withColumn("checksum", checksum(F.col("sequence_id"), F.col("op"), F.col("key"), F.col("columns")))


def corrupt(log: DataFrame) -> DataFrame:
    """Entries whose checksum doesn't fit."""
    fits = F.col("checksum").eqNullSafe(checksum(F.col("sequence_id"), F.col("op"), F.col("key"), F.col("columns")))
    return log.where(~fits)


def tail(log: DataFrame, start_sequence: int, end_sequence: int = 0, region_id: str | None = None, batch_size: int = 0) -> DataFrame:
    """Entries with start <= sequence_id <= end in order; end 0 means the latest; batch_size 0 means all."""
    rows = log.where(F.col("sequence_id") >= start_sequence)
    if end_sequence:
        rows = rows.where(F.col("sequence_id") <= end_sequence)
    if region_id is not None:
        rows = rows.where(F.col("region_id") == region_id)
    rows = rows.orderBy("sequence_id")
    return rows.limit(batch_size) if batch_size else rows


def _states(log: DataFrame, keys: list[str], values: list[str], sequence: str, op: str, present: str | None) -> DataFrame:
    """By key: a struct (v) for each value, null where no entry wrote the column, ``__deleted`` and ``__sequence``."""
    gone = F.col(op) == "DELETE"

    def latest(name: str) -> Column:
        written = gone if present is None else gone | F.col(present).isNull() | F.array_contains(F.col(present), name)
        order = F.col(sequence) if present is None else F.when(written, F.col(sequence))
        # A struct keeps nulls that were written: max_by skips rows without an order, not without a value.
        return F.max_by(F.struct(F.when(~gone, F.col(name)).alias("v")), order).alias(name)

    last = F.max_by(gone, F.col(sequence)).alias("__deleted")
    return log.groupBy(*keys).agg(*[latest(v) for v in values], last, F.max(sequence).alias("__sequence"))


def replay(log: DataFrame, keys: list[str], values: list[str], sequence: str = "sequence_id", op: str = "op", present: str | None = None) -> DataFrame:
    """The last state by key: keys, values, ``__deleted`` and ``__sequence``."""
    states = _states(log, keys, values, sequence, op, present)
    return states.select(*keys, *[F.col(v)["v"].alias(v) for v in values], "__deleted", "__sequence")


def live(state: DataFrame) -> DataFrame:
    """Rows of a replayed state that aren't deleted."""
    return state.where(~F.col("__deleted")).drop("__deleted", "__sequence")


def merge_on_read(base: DataFrame, log: DataFrame, pk: str, sequence: str = "sequence_id", op: str = "op", present: str = "present") -> DataFrame:
    """The table of a base snapshot and the log that stands after it.

    The log is replayed once and joined once with the base, which is read once; columns that the log didn't
    write keep the base's values. Callers give the regions that the log touches as ``base``; others need no join.
    """
    values = [c for c in base.columns if c != pk]
    states = _states(log, [pk], values, sequence, op, present)
    new = states.select(F.col(pk).alias("__pk"), "__deleted", *[F.col(v).alias(f"__new_{k}") for k, v in enumerate(values)])
    joined = base.join(new, F.col(pk) == F.col("__pk"), "full_outer").where(F.col("__deleted").isNull() | ~F.col("__deleted"))
    merged = {v: F.when(F.col(f"__new_{k}").isNotNull(), F.col(f"__new_{k}")["v"]).otherwise(F.col(f"`{v}`")).alias(v) for k, v in enumerate(values)}
    return joined.select(*[F.coalesce(pk, "__pk").alias(c) if c == pk else merged[c] for c in base.columns])


def apply_summary(log: DataFrame, last_applied: int) -> DataFrame:
    """One row: applied_count and last_applied_sequence of entries after ``last_applied``."""
    fresh = log.where(F.col("sequence_id") > last_applied)
    return fresh.agg(F.count(F.lit(1)).alias("applied_count"), F.coalesce(F.max("sequence_id"), F.lit(last_applied)).alias("last_applied_sequence"))


def lag(source: DataFrame, target: DataFrame, limit: int = 100) -> DataFrame:
    """One row by region: how far the target's log is behind, and whether that is under ``limit``."""
    a = source.groupBy("region_id").agg(F.max("sequence_id").alias("source_sequence"))
    b = target.groupBy("region_id").agg(F.max("sequence_id").alias("target_sequence"))
    behind = F.col("source_sequence") - F.coalesce("target_sequence", F.lit(0))
    return a.join(b, "region_id", "left").select("region_id", behind.alias("lag"), (behind < limit).alias("caught_up"))
