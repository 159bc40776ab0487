"""Shared pieces of the training-data operators.

Nothing here holds corpus data on the driver: tables that cut lineage are
written to the folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that one Arrow batch of a text operator may hold before it is cut.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Read from the session; where it is unset a temporary one is set for a local
    master, and on a cluster, whose machines don't share one, that is an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="rangeframe-shared-")
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more: what came of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table that the JVM reads itself: createDataFrame of a list sends them through Python
    workers of their own kind, which stay on every executor for a minute beside those of the operators."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields))


def release() -> None:
    """Give memory that nothing uses back to the system: workers are reused, and allocators keep what they freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def apart(names: list[str], *wanted: str) -> list[str]:
    """For each wanted working name, one that no column of ``names`` has (whatever its case)."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


#: Keys that may count as hot, and rows that one has at least.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key`` and the number of rows that have it in ``count``.

    Keys of more than max(HOT_ROWS, total / HOT_KEYS) rows, of which there are at most HOT_KEYS, are looked up by a
    broadcast where their rows lie; only the others are shuffled.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(count) > most).drop(count))
    cold = table.where(F.col(count) <= most).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod ``folds`` is ``fold``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)) == F.lit(fold)


def order_of(doc_id: str) -> Column:
    """A fixed order of documents that has nothing to do with their content."""
    return F.xxhash64(F.col(doc_id).cast("string"))


def unit_hash(*cols: Column) -> Column:
    """A reproducible 52-bit integer from md5 of the columns as text (nulls: empty)."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8_batches(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of an Arrow string column as UTF-8 bytes (null: empty), cut into runs of ``most`` bytes."""
    values = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    run: list[bytes] = []
    start, size = 0, 0
    for k, value in enumerate(values):
        b = value.as_py() or b""
        if run and size + len(b) > most:
            yield start, run
            run, start, size = [], k, 0
        run.append(b)
        size += len(b)
    if run:
        yield start, run


def map_text(
    df: DataFrame,
    keep: list[str],
    text: str,
    schema: str,
    make: Callable[[], Callable[[list[bytes]], dict[str, list | np.ndarray]]],
    most: int = BATCH_BYTES,
) -> DataFrame:
    """Apply ``make()(texts as bytes) -> columns`` batch by batch; ``keep`` columns pass through.

    ``make`` is called once per task and may load models; batches are cut at ``most`` bytes so that
    one run of very long texts doesn't grow a worker. What a task remembered goes with it, before the next task of
    whatever operator runs in its worker.
    """
    quoted = [F.col(f"`{k}`") for k in keep]
    source = df.select(*quoted, F.col(f"`{text}`").alias(apart(keep, "__text")[0]))
    out = df.select(*quoted).schema
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out]
    full = ", ".join([*fields, schema])
    target = to_arrow_schema(StructType.fromDDL(full))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, run_of in utf8_batches(texts, most):
                made = work(run_of)
                kept = [batch.column(k).slice(start, len(run_of)) for k in range(len(keep))]
                arrays = kept + [made[f.name] for f in list(target)[len(keep):]]
                yield pa.RecordBatch.from_arrays(
                    [a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, target)],
                    schema=target,
                )
                del made, kept, arrays
            del batch, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return source.mapInArrow(run, full)
