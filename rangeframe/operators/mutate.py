"""Upserts and deletes over a table with a primary key, with a report for each row.

These are snapshot transforms: they return the table after the change. The engine doesn't rewrite
tables for each change but appends to a log (``operators.replay``); these run where a snapshot is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeframe.functions.types import InvalidRequest, TableSchema


def last_by_key(rows: DataFrame, pk: str, order: Column) -> DataFrame:
    """Of rows with one key, the one that comes last by ``order``."""
    rank = F.row_number().over(Window.partitionBy(pk).orderBy(order.desc()))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def put(df: DataFrame, pk: str, rows: DataFrame) -> DataFrame:
    """The table with rows inserted, or replaced where their key is there; ``rows`` has distinct keys.

    Columns that ``rows`` lacks keep their old values (null for new keys). One outer join: the table is read once.
    """
    given = [c for c in df.columns if c in rows.columns and c != pk]
    new = rows.select(F.col(pk).alias("__pk"), *[F.col(f"`{c}`").alias(f"__new_{k}") for k, c in enumerate(given)])
    changed = {c: F.when(F.col("__pk").isNotNull(), F.col(f"__new_{k}")).otherwise(F.col(f"`{c}`")).alias(c) for k, c in enumerate(given)}
    joined = df.join(new, F.col(pk) == F.col("__pk"), "full_outer")
    return joined.select(*[F.coalesce(pk, "__pk").alias(c) if c == pk else changed.get(c, F.col(f"`{c}`")) for c in df.columns])


def delete(df: DataFrame, pk: str, keys: DataFrame) -> DataFrame:
    """The table without the rows whose key is in column ``pk`` of ``keys``."""
    return df.join(keys.select(pk).distinct(), pk, "left_anti").select(*df.columns)


def delete_report(df: DataFrame, pk: str, keys: DataFrame, base_sequence: int = 0) -> DataFrame:
    """(pos, key, existed, sequence_id) for each key of ``keys`` (pos, key).

    A key that is asked for twice existed only the first time.
    """
    wanted = keys.select("pos", "key")
    there = df.select(F.col(pk).alias("key")).join(wanted.select("key").distinct(), "key", "left_semi").distinct().withColumn("there", F.lit(True))
    first = F.row_number().over(Window.partitionBy("key").orderBy("pos")) == 1
    joined = wanted.join(there, "key", "left").select("pos", "key", (F.coalesce("there", F.lit(False)) & first).alias("existed"))
    return joined.withColumn("sequence_id", F.lit(base_sequence) + F.col("pos") + 1)


def default_of(schema: TableSchema, name: str) -> Column:
    """A column's DEFAULT as a typed literal; null where it has none."""
    c = schema.column(name)
    return F.lit(c.default).cast(c.to_field().dataType)


def filled(schema: TableSchema, rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows`` with all columns of the table, ``is_new`` and ``present`` (the columns that a row changes; null: all).

    A row whose key is not among ``existing`` (column pk) is new: it takes the DEFAULTs of the columns that ``rows`` lacks.
    """
    pk = schema.primary_key
    if pk not in rows.columns:
        raise InvalidRequest(f"column {pk} is missing")
    given = [n for n in schema.names if n in rows.columns]
    absent = [n for n in schema.names if n not in given]
    if not absent:
        return rows.withColumns({"is_new": F.lit(None).cast("boolean"), "present": F.lit(None).cast("array<string>")})
    kind = schema.column(pk).to_field().dataType
    known = existing.select(F.col(pk).alias("__pk")).distinct().withColumn("__known", F.lit(True))
    told = rows.join(known, F.expr(f"try_cast(`{pk}` AS {kind.simpleString()})") == F.col("__pk"), "left").withColumn("is_new", F.col("__known").isNull()).drop("__pk", "__known")
    more = {n: F.when(F.col("is_new"), default_of(schema, n)) for n in absent}
    return told.withColumns(more | {"present": F.when(~F.col("is_new"), F.array(*[F.lit(n) for n in given]))})


def problems(schema: TableSchema, rows: DataFrame, given: list[str] | None = None) -> Column:
    """The first reason why a row can't be stored, or null. ``given`` are the columns that a request names; without
    ``is_new`` (see ``filled``) every row counts as a new one."""
    given = [n for n in schema.names if n in rows.columns] if given is None else given
    new = F.col("is_new") if "is_new" in rows.columns else F.lit(True)
    found = []
    for c in schema.columns:
        if c.name not in given:
            if c.name == schema.primary_key:
                found.append(F.lit(f"column {c.name} is missing"))
            elif not c.nullable and c.default is None:
                found.append(F.when(new, F.lit(f"column {c.name} is missing")))
            continue
        if not c.nullable or c.name == schema.primary_key:
            found.append(F.when(F.col(c.name).isNull(), F.lit(f"column {c.name} is null")))
        if c.length:
            found.append(F.when(F.length(F.col(c.name).cast("string")) > c.length, F.lit(f"column {c.name} is longer than {c.length}")))
        kind = c.to_field().dataType
        if not isinstance(kind, (T.StringType, T.BinaryType)) and rows.schema[c.name].dataType != kind:
            broken = F.col(c.name).isNotNull() & F.expr(f"try_cast(`{c.name}` AS {kind.simpleString()})").isNull()
            found.append(F.when(broken, F.lit(f"column {c.name} is not a {c.type}")))
    return F.coalesce(*found, F.lit(None).cast("string"))


def batch_put(df: DataFrame, schema: TableSchema, rows: DataFrame, base_sequence: int = 0) -> tuple[DataFrame, DataFrame]:
    """(table, report) after storing ``rows`` (pos and columns); of rows with one key the last wins.

    The report has pos, ok, error and sequence_id (null for refused rows) for each row.
    """
    pk = schema.primary_key
    given = [n for n in schema.names if n in rows.columns]
    checked = filled(schema, rows, df.select(pk))
    checked = checked.withColumn("error", problems(schema, checked, given))
    report = checked.select("pos", F.col("error").isNull().alias("ok"), "error", F.when(F.col("error").isNull(), F.lit(base_sequence) + F.col("pos") + 1).alias("sequence_id"))
    good = last_by_key(checked.where(F.col("error").isNull()), pk, F.col("pos"))
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.to_struct()]
    if len(given) == len(schema.names):
        return put(df, pk, good.select(*typed)), report
    fresh = good.where("is_new").select(*typed)
    changed = good.where("not is_new").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.to_struct() if f.name in given])
    return put(df, pk, changed).unionByName(fresh.select(*df.columns)), report


def batch_summary(report: DataFrame) -> DataFrame:
    """One row: success_count, failed_count, failed_indices (in order)."""
    return report.agg(
        F.count_if("ok").alias("success_count"),
        F.count_if(~F.col("ok")).alias("failed_count"),
        F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("pos")))).alias("failed_indices"),
    )
