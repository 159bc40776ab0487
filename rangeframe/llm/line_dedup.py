"""Line dedup: range-partitioned line hashes, streamed in order, give keep bitmaps for each document.

1. Every document gives one row per line key of at least MIN_CHARS code points: a 128-bit hash, the
   document and the line's positions in it. These are range-partitioned by (hash, document), so a line
   that stands in a third of all documents is spread over many tasks, and sorted by (hash, document
   from the largest, position).
2. Each task streams its rows in batches. A run of one hash that lies inside a batch is decided at once:
   with at least MIN_DOCS documents, all but the first occurrence (the largest document) drop it. A
   batch's first and last run may go on in its neighbours: their rows go out undecided, with one summary
   for each. Summaries are added up and joined back, by broadcast within MAX_TOTALS and salted beyond.
3. Positions to drop are gathered for each document into a zlib-compressed bitmap of kept lines.

Texts never travel with the hashes; the operator's result is bitmaps. ``apply_keep`` joins them with texts.

Cases: a null or empty text is one empty line; a null doc_id is the smallest document (``dedup_lines`` leaves a null
text null); doc_ids of any type that has an order will do; rows that share a doc_id are one document for the counts,
each row having its own bitmap, and equal rows equal bitmaps; texts of any length and number of lines are read
whole; an empty table gives an empty result; further columns are ignored, or pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rangeframe.llm.common import apart, discard, materialize

MIN_CHARS, MIN_DOCS = 20, 3
#: Summaries (24 bytes each) up to which they are broadcast; the salt beyond that.
MAX_TOTALS, SALTS = 200_000, 64
#: The white space that is stripped from a key, and the letters that are lower-cased.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALLEST = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def document(docs: DataFrame, doc_id: str) -> Column:
    """The document of a row: integers as longs with the smallest one for null; other ids as they are, null first."""
    integral = isinstance(docs.select(F.col(doc_id)).schema[0].dataType, T.IntegralType)
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(SMALLEST)) if integral else F.col(doc_id)


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (null: smallest), row_hash (tells rows apart that share a doc_id) and body."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(document(docs, doc_id).alias("doc"), F.xxhash64(body).alias("row_hash"), body.alias("body"))


def line_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc, row_hash, pos: lines with keys of at least ``min_chars`` code points."""
    lines = rows.select("doc", "row_hash", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "row_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "row_hash", "pos")


def _stream(min_docs: int, doc_type: T.DataType):
    ids = to_arrow_type(doc_type)
    kinds = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", ids), ("row_hash", pa.int64()), ("pos", pa.int32()), ("n_docs", pa.int64()), ("last_doc", ids)])

    def emit(kind: int, cols: list[np.ndarray], n_docs: int = 0, last=None) -> pa.RecordBatch:
        n = len(cols[0])
        full = lambda v, t: np.full(n, v, t)
        arrays = [full(kind, np.int32), *cols[:4], cols[4].astype(np.int32), full(n_docs, np.int64), [last] * n if kind == 1 else pa.nulls(n, ids)]
        return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, kinds)], schema=kinds)

    def summary(h1: int, h2: int, docs: int, last) -> pa.RecordBatch:
        zero = np.zeros(1, np.int64)
        return emit(1, [np.array([h1]), np.array([h2]), pa.nulls(1, ids), zero, zero], docs, last)

    def column(batch: pa.RecordBatch, k: int) -> np.ndarray:
        values = batch.column(k).to_numpy(zero_copy_only=False)
        return values if values.dtype == object or values.dtype.kind not in "iu" else values.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: to drop; 1: summary of an open run; 2: row of an open run. A run that spans batches of
        the task is carried as counts; its rows go out undecided, like those at the task's ends."""
        carry: tuple[int, int] | None = None  # hash of the run that is open at the end of what was read
        docs_of, last_of, seen = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [column(batch, k) for k in range(5)]
            h1, h2, doc = cols[0], cols[1], cols[2]
            new_run = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            starts = np.flatnonzero(new_run)
            ends = np.concatenate([starts[1:], [len(h1)]])
            new_doc = new_run | np.concatenate([[True], doc[1:] != doc[:-1]])
            n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            first_run, last_run = slice(starts[0], ends[0]), slice(starts[-1], ends[-1])
            cut = lambda s: [c[s] for c in cols]
            # The run that is open from before.
            if carry == (int(h1[0]), int(h2[0])):
                more = int(n_docs[0]) - int(doc[0] == seen)
                docs_of, seen = docs_of + more, doc[ends[0] - 1]
                yield emit(2, cut(first_run))
            else:
                if carry is not None:
                    yield summary(*carry, docs_of, last_of)
                carry, docs_of, last_of, seen = (int(h1[0]), int(h2[0])), int(n_docs[0]), doc[0], doc[ends[0] - 1]
                yield emit(2, cut(first_run))
            if len(starts) > 1:
                yield summary(*carry, docs_of, last_of)
                inner = np.repeat(n_docs[1:-1] >= min_docs, (ends - starts)[1:-1])
                largest = np.repeat(doc[starts[1:-1]], (ends - starts)[1:-1])
                middle = slice(ends[0], starts[-1])
                drop = np.flatnonzero(inner & (doc[middle] != largest)) + ends[0]
                if len(drop):
                    yield emit(0, cut(drop))
                yield emit(2, cut(last_run))
                k = starts[-1]
                carry, docs_of, last_of, seen = (int(h1[k]), int(h2[k])), int(n_docs[-1]), doc[k], doc[-1]
        if carry is not None:
            yield summary(*carry, docs_of, last_of)

    kind = doc_type.simpleString()
    return run, f"kind int, h1 long, h2 long, doc {kind}, row_hash long, pos int, n_docs long, last_doc {kind}"


def drops(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row_hash, pos of every line that its document loses."""
    # Written once: range partitioning reads its input twice, and these rows are small next to the texts.
    lines = materialize(line_rows(rows, min_chars), "line-keys")
    down = F.col("doc").desc_nulls_last()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(parts, "h1", "h2", down).sortWithinPartitions("h1", "h2", down, "pos")
    run, schema = _stream(min_docs, rows.schema["doc"].dataType)
    streamed = materialize(ordered.mapInArrow(run, schema), "line-runs")
    totals = streamed.where("kind = 1").groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.max("last_doc").alias("largest"))
    totals = materialize(totals.where(F.col("n") >= min_docs).select("h1", "h2", "largest"), "line-totals")
    undecided = streamed.where("kind = 2").select("h1", "h2", "doc", "row_hash", "pos")
    if totals.count() <= MAX_TOTALS:
        late = undecided.join(F.broadcast(totals), ["h1", "h2"])
    else:  # salted: a line of very many documents doesn't meet in one task
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = undecided.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        late = salted.join(totals.select("*", salts), ["h1", "h2", "salt"])
    late = late.where(~F.col("doc").eqNullSafe(F.col("largest"))).select("doc", "row_hash", "pos")
    discard(lines)
    return streamed.where("kind = 0").select("doc", "row_hash", "pos").unionByName(late)


def pack(positions: list[int], n_lines: int) -> bytes:
    """A compressed bitmap with a 1 for each line that stays."""
    keep = np.ones(n_lines, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the documents that lose lines: doc, row_hash, covered, keep_bitmap.

    Documents without a row here keep every line; a bitmap covers lines up to the last dropped one.
    """
    rows = identified(docs, doc_id, text)
    lost = drops(rows, min_chars, min_docs).groupBy("doc", "row_hash").agg(F.collect_set("pos").alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x.as_py() for x in batch.column(2)]
            sizes = [max(x) + 1 for x in lists]
            maps = [pack(x, n) for x, n in zip(lists, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], ["doc", "row_hash", "covered", "keep_bitmap"])

    return lost.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, row_hash long, covered int, keep_bitmap binary")


def kept_lines(text: str, bitmap: bytes | None, covered: int | None) -> tuple[str, int, int]:
    """The text of kept lines, the number of lines, and how many were dropped."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = unpack(bitmap, covered)
    kept = [line for line, k in zip(lines, keep) if k] + lines[covered:]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def apply_keep(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and, last, a document's bitmap and the lines it covers; null where all lines stay. The two
    are named keep_bitmap and covered, with underscores before them where ``docs`` has such columns."""
    bitmap, covered, d, r, of, row = apart(docs.columns, "keep_bitmap", "covered", "doc_key", "row_key", "of_doc", "of_row")
    found = bitmaps.select(F.col("doc").alias(of), F.col("row_hash").alias(row), F.col("keep_bitmap").alias(bitmap), F.col("covered").alias(covered))
    keyed = docs.withColumns({d: document(docs, doc_id), r: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    joined = keyed.join(found, F.col(d).eqNullSafe(F.col(of)) & (F.col(r) == F.col(row)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in (*docs.columns, bitmap, covered)])


def line_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = apply_keep(rows, line_dedup(rows, "doc_id", "text", min_chars, min_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kept_lines(t.as_py() or "", b.as_py(), c.as_py()) for t, b, c in zip(*batch.columns[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n, _ in made], pa.int64()), pa.array([d for *_, d in made], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t, *_ in made], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return joined.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with texts of kept lines; all columns pass through."""
    joined = apply_keep(docs, line_dedup(docs, doc_id, text, min_chars, min_docs), doc_id, text)
    return joined.mapInArrow(_kept(joined.columns.index(text), docs.columns), docs.schema)


def _kept(at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else kept_lines(t.as_py(), b.as_py(), c.as_py())[0] for t, b, c in zip(batch.column(at), *batch.columns[-2:])]
            columns = list(batch.columns[:-2])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return run

