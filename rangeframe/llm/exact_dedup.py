"""Exact deduplication through an extendible-hash index, in DataFrame operations only.

1. *Hashes*: a narrow table (doc_id, hash, SHA-256, bytes) is written once; counts by hash come from it.
2. *Directory*: pointers from hash prefixes of ``depth`` bits (those that occur) to buckets. A bucket that holds more than ``capacity``
   distinct hashes is split by its next hash bit, which doubles the directory where the bucket already used every bit
   of it; doubling goes on until no bucket is overfull or all 64 bits are used (only then does one hash overflow).
   Counts only shrink downwards, so all doublings up to a depth come from one aggregation: a prefix's bucket is the
   first on its way down that isn't overfull.
3. *Owners*: buckets are cut into contiguous key ranges of about equal bytes. Every text goes through the directory
   to the task that owns its bucket, which chains the texts of a hash and compares their bytes: equal bytes
   are one entry with the largest doc_id and the number of rows, others are links of a chain. Owners write
   the index: one row (hash, SHA-256, keep_id, group_size, chain) for each distinct text.
4. *Lookup*: rows go through the directory to their bucket and find their entry by hash and SHA-256.

Hot groups: a hash of very many rows or bytes (of which there can be HOT_HASHES at most) is combined before it goes
to its owner, in SALTS parts, and rows find its entry by a broadcast, so neither owners nor lookups see the group.

Cases: a null text is the empty text; rows with a null doc_id are grouped like any other and never beat a non-null
doc_id (a group of nulls only has keep_id null and keeps its rows); repeated rows with one doc_id are all marked as
their group's kept row; texts of any length are hashed and compared whole; an empty table gives an empty result;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeframe.llm.common import discard, materialize

#: Distinct hashes that a bucket holds before it is split; a larger table has larger buckets, at most MOST_BUCKETS or so.
CAPACITY, MOST_BUCKETS = 8192, 1 << 18
#: Depth at which the directory starts, and pointers (16 bytes each) up to which it is broadcast.
START_DEPTH, BROADCAST_CELLS = 2, 1 << 21
#: Hashes that may count as hot, rows or bytes of repeated text that they have at least, and parts in which a hot
#: group is combined.
HOT_HASHES, HOT_ROWS, HOT_BYTES, SALTS = 10_000, 1000, 8 << 20, 16
#: Bytes of text that an owner gets.
OWNED = 64 << 20


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("h"))


def cell_of(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def split(hashes: DataFrame, capacity: int, depth: int) -> DataFrame:
    """Pointers (cell, depth, bucket, held, final) of a directory that has doubled up to ``depth``; cells that hold
    nothing have none."""
    cells = hashes.groupBy(cell_of(F.col("h"), depth).alias("cell")).agg(F.count("*").alias("n"))
    depths = F.explode(F.sequence(F.lit(min(START_DEPTH, depth)), F.lit(depth))).alias("depth")
    levels = cells.select("cell", "n", depths).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    counts = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    # A cell's bucket is the first on its way down that isn't overfull.
    fits = (F.col("held") <= capacity) | (F.col("depth") == depth)
    first = F.min(F.struct("depth", "prefix", "held")).alias("b")
    leaves = levels.join(counts.where(fits), ["depth", "prefix"]).groupBy("cell").agg(first)
    bucket = F.expr(f"shiftleft(b.prefix, {depth} - b.depth)").alias("bucket")
    return leaves.select("cell", F.col("b.depth").cast("int").alias("depth"), bucket, F.col("b.held").alias("held"), (F.col("b.held") <= capacity).alias("final"))


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(pointers, depth): each of the ``2**depth`` cells that holds something points to its final bucket.

    ``hashes`` has one row per distinct hash in column ``h``. The depth follows from their number; where hashes crowd
    together it grows until no bucket is overfull.
    """
    n = hashes.count()
    depth = max(START_DEPTH, (n // capacity).bit_length() + 2)
    while True:
        pointers = materialize(split(hashes, capacity, depth), "exthash-directory")
        if depth >= 62 or pointers.where("NOT final").isEmpty():
            return pointers, depth
        discard(pointers)
        depth += 2


def owners(pointers: DataFrame, hashes: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """(bucket, owner) and the number of owners: contiguous ranges of buckets with about OWNED bytes each."""
    cells = hashes.groupBy(cell_of(F.col("h"), depth).alias("cell")).agg(F.sum("weight").alias("weight"))
    weights = cells.join(pointers, "cell").groupBy("bucket").agg(F.sum("weight").alias("weight"))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    n = max(1, -(-int(total) // OWNED))
    # A row per bucket, of which there are some MOST_BUCKETS: running sums need one order over them.
    before = F.sum("weight").over(Window.orderBy("bucket")) - F.col("weight")
    return weights.select("bucket", F.least(F.floor(before / F.lit(max(1.0, total / n))), F.lit(n - 1)).cast("int").alias("owner")), n


def build_index(rows: DataFrame, hashes: DataFrame, hot: DataFrame, pointers: DataFrame, depth: int) -> DataFrame:
    """The index as its owners write it: bucket, h, sha, keep_id, group_size, chain (0 for the first text of a hash).

    ``rows``: doc_id, body, h; ``hashes``: h and weight; ``hot``: h of at most HOT_HASHES hashes.
    """
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    few = F.broadcast(hot)
    combined = rows.join(few, "h", "left_semi").groupBy("h", "body", spread.alias("part")).agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    single = rows.join(few, "h", "left_anti").withColumn("n", F.lit(1).cast("long"))
    ranges, n = owners(pointers, hashes, depth)
    places = materialize(pointers.join(ranges, "bucket").select("cell", "bucket", "owner"), "exthash-places")
    texts = single.select("h", "body", "doc_id", "n").unionByName(combined.select("h", "body", "doc_id", "n"))
    dealt = texts.withColumn("cell", cell_of(F.col("h"), depth)).join(sized(places), "cell").drop("cell")
    owned = dealt.repartitionById(n, F.col("owner"))
    # In the owner's task: equal hashes chain, and the grouping by body compares their bytes.
    entries = owned.groupBy("owner", "bucket", "h", "body").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    entries = entries.withColumn("sha", F.unhex(F.sha2(F.col("body").cast("binary"), 256))).drop("body")
    chain = F.row_number().over(Window.partitionBy("owner", "bucket", "h").orderBy("sha")) - 1
    index = materialize(entries.withColumn("chain", chain).drop("owner"), "exthash-index")
    discard(places)
    return index


def sized(pointers: DataFrame) -> DataFrame:
    """Pointers as a join's side: broadcast only where their number is within BROADCAST_CELLS."""
    return F.broadcast(pointers) if pointers.count() <= BROADCAST_CELLS else pointers


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    rows = keyed(docs, doc_id, text)
    sha = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
    narrow = materialize(rows.select("doc_id", "h", sha.alias("sha"), F.octet_length("body").alias("size")), "exthash-rows")
    counts = narrow.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.col("size") + 32).alias("bytes"), F.max("size").alias("size"))
    n, total = narrow.agg(F.count("*"), F.coalesce(F.sum(F.col("size") + 32), F.lit(0))).first()
    most, heavy = max(hot_rows, 2 * n // HOT_HASHES), max(HOT_BYTES, 2 * total // HOT_HASHES)  # at most half of HOT_HASHES exceed either
    hot = (F.col("n") > most) | ((F.col("n") > 1) & (F.col("bytes") > heavy))
    weight = F.when(hot, (F.col("size") + 32) * F.least(F.col("n"), F.lit(SALTS))).otherwise(F.col("bytes"))
    hashes = materialize(counts.select("h", weight.alias("weight"), hot.alias("hot")), "exthash-hashes")
    hot = hashes.where("hot").select("h")
    pointers, depth = directory(hashes, capacity or max(CAPACITY, hashes.count() // MOST_BUCKETS))
    index = build_index(rows, hashes, hot, pointers, depth)

    # Each row's bucket, by the directory; then its entry there.
    found = narrow.withColumn("cell", cell_of(F.col("h"), depth)).join(sized(pointers.select("cell", "bucket")), "cell").drop("cell", "size")
    few = F.broadcast(hot)
    chains = index.join(few, "h", "left_semi")  # distinct texts of hot hashes: a chain is as long as hashes collide
    chains = F.broadcast(chains) if chains.limit(2 * HOT_HASHES + 1).count() <= 2 * HOT_HASHES else chains
    keys = ["bucket", "h", "sha"]
    looked = found.join(few, "h", "left_anti").join(index.join(few, "h", "left_anti"), keys)
    looked = looked.unionByName(found.join(few, "h", "left_semi").join(chains, keys))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return looked.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain")
