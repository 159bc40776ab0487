"""The replication log as a stream: tailing a log folder and applying it to a replica.

Applying is idempotent and doesn't depend on order: the newest entry of a key counts, so a micro-batch that runs
twice after a failure changes nothing, and entries that come late are taken in.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rangeframe.operators.replay import replay
from rangeframe.sources.files import Files


def tail_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of log entries from Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class Replica:
    """The replayed state of a log under ``path``.

    Each batch is replayed on its own and written as a part, so applying costs what the batch is, not what the
    replica holds; the newest of a key's rows over all parts counts, whatever the order in which they came. A
    numbered file names the parts, the last sequence and the last batch. Beyond COMPACT parts they are
    merged into one. Tombstones are kept with their sequence, so that late entries can't bring back what is gone.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str]):
        self.spark, self.path, self.keys, self.values = spark, path.rstrip("/"), keys, values
        self.files = Files(spark)

    def _meta(self) -> dict:
        names = [n for n in self.files.names(self.path) if n.endswith(".meta")]
        if not names:
            return {"number": 0, "parts": [], "last": -1, "batch": -1}
        return json.loads(self.files.read(f"{self.path}/{names[-1]}"))

    def _merged(self, parts: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])
        rest = [*self.values, "__deleted", "__sequence"]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col("__sequence")).alias("s"))
        return newest.select(*self.keys, *[F.col("s")[c].alias(c) for c in rest])

    def state(self) -> DataFrame | None:
        """Keys, values, __deleted and __sequence; None before the first batch."""
        parts = self._meta()["parts"]
        return self._merged(parts) if parts else None

    def last_applied(self) -> int:
        return self._meta()["last"]

    def live(self) -> DataFrame:
        return self.state().where(~F.col("__deleted")).select(*self.keys, *self.values)

    def apply(self, entries: DataFrame, batch: int | None = None) -> tuple[int, int]:
        """Apply entries (sequence_id, op, keys, values); returns (applied_count, last_applied_sequence), where
        entries count that are newer than all before. A numbered ``batch`` that was applied already changes nothing."""
        meta = self._meta()
        if batch is not None and batch <= meta["batch"]:
            return 0, meta["last"]
        log = entries.select("sequence_id", "op", *self.keys, *self.values)
        found = log.agg(F.count_if(F.col("sequence_id") > meta["last"]).alias("fresh"), F.count("*").alias("n"), F.max("sequence_id").alias("last")).first()
        if not found.n:
            return 0, meta["last"]
        part = f"part-{uuid.uuid4().hex}"
        replay(log, self.keys, self.values).write.parquet(f"{self.path}/{part}")
        parts = [*meta["parts"], part]
        if len(parts) > self.COMPACT:
            whole = f"part-{uuid.uuid4().hex}"
            self._merged(parts).write.parquet(f"{self.path}/{whole}")
            parts, gone = [whole], parts
        else:
            gone = []
        new = {"number": meta["number"] + 1, "parts": parts, "last": max(meta["last"], found.last), "batch": meta["batch"] if batch is None else batch}
        self.files.write(f"{self.path}/{new['number']:012d}.meta", json.dumps(new))
        for p in gone:
            self.files.delete(f"{self.path}/{p}")
        return found.fresh, new["last"]

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Apply a stream of entries batch by batch."""
        writer = stream.writeStream.foreachBatch(lambda rows, number: self.apply(rows, number) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
