"""SimHash near-dedup through vantage-point trees.

``near_duplicates`` links 64-bit fingerprints at up to three differing bits, exactly. Of three bits, one half
of the fingerprint holds at most one: each half has a vantage-point tree with radius 1, and pairs that meet
in a shard are compared over all 64 bits.

A tree splits codes by their Hamming distance to a vantage code: up to mu to the left, more to the right.
By the triangle inequality a pair within radius r can only be torn where one distance is in (mu - r, mu]
and the other in (mu, mu + r]; such codes also visit the other side. A code has one home shard and is
compared there with homes and visitors, so every pair within the radius meets, and a code away from the
boundaries is pruned from the other branch. Trees are fitted on the driver to a bounded sample of codes
(SAMPLE); the sample shapes the shards only, all codes are routed by executors. A shard that holds more than its
bound gets a tree of its own, as deep as its rows ask for, whose vantage codes come from its number, so that
executors need nothing but that depth; codes that no tree tells apart (equal ones) are cut into blocks, and each
pair of blocks is a group of its own.

Inside a group, codes are sorted by distance to one more vantage code, compared with their neighbours
within the radius, and joined in a union-find: at most one link per code leaves a group, never all pairs.
Links are contracted by alternating large and small stars over written tables.

``similar_documents`` is for whole documents at a Jaccard similarity of five-word shingles. Candidates are
found by a 512-bit SimHash: shingles fall into CLASSES hash classes, the LEAST smallest hashes of a class have
a 32-bit SimHash of their own, and documents that are near in one class's tree (radius 1) are compared by
their 512 bits, with a bound that short texts of the similarity pass too. At a similarity of 0.8 one class
agrees with probability 0.8**3, one of eight with 0.997. Inside a component of candidates every pair is
judged by the exact Jaccard similarity of its sets of shingle hashes. A component beyond a block's bound is
cut: each block is compared with itself and the component's hub, and only what isn't joined to the hub
afterwards is compared with the other blocks.

Cases: null texts are empty (null and empty texts are one text); texts without words have fingerprint zero and link like any other; fewer words
than a shingle make one shingle; texts of any length are read whole; a component whose doc_ids are all null
has component_id null; rows with equal doc_id and text are one document; an empty table gives an empty
result; further columns are ignored, or pass through ``drop_similar``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeframe.llm.common import apart, discard, join_counted, local_table, map_text, materialize

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Codes of a tree that shape it, codes that a shard is meant to hold, and rows beyond which it is cut.
SAMPLE, SHARD, SHARD_MOST = 100_000, 4096, 65_536
#: Words of the wide fingerprint, hash classes, and hashes of a class that make its code.
WIDE, CLASSES, LEAST = 8, 8, 3
#: Texts and shingles of a block in which candidates are compared exactly.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 500_000


# Fingerprints


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of all shingles of ``size`` words; A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1]
    parts = map(joined.__getitem__, map(slice, starts.tolist(), (ends[size - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Words whose bits are set in over half of the rows of (rows, words) hashes."""
    n, words = hashes.shape
    total = np.zeros(64 * words, np.int64)
    for k in range(0, n, 4080):
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + 4080]).view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            total += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little").view(np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    h = shingle_hashes(text, size)
    return int(majority(h[:, None])[0]) if len(h) else 0


def mixed(h: np.ndarray) -> np.ndarray:
    """Eight independent 64-bit hashes of each hash (the finaliser of a counter-based generator)."""
    with np.errstate(over="ignore"):
        z = h[:, None] + (np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signature(text: bytes, size: int) -> tuple[bytes, list[int | None]]:
    """The wide fingerprint of a text's distinct shingles and the code of each class (None: no shingle)."""
    h = np.unique(shingle_hashes(text, size))
    if not len(h):
        return bytes(8 * WIDE), [0] + [None] * (CLASSES - 1)
    spread = mixed(h)
    classes = (spread[:, 0] % np.uint64(CLASSES)).astype(np.int64)
    codes: list[int | None] = []
    for c in range(CLASSES):
        least = spread[classes == c][:LEAST]  # np.unique has sorted h
        codes.append(int(majority(least[:, 1:2])[0]) & 0xFFFFFFFF if len(least) else None)
    return majority(spread).tobytes(), codes


def candidate_bits(similarity: float, bits: int = 64 * WIDE) -> int:
    """Differing bits up to which a pair is a candidate: five standard errors over what is expected of any
    two sets with at least this Jaccard similarity. Small sets, whose majorities are narrow, decide."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    flips = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    for x in range(1, 33):
        for y in range(x, 33):
            common = math.ceil(similarity * (x + y) / (1 + similarity) - 1e-9)
            if common <= x:
                c, a, b = (np.arange(k + 1) for k in (common, x - common, y - common))
                one = np.array([flips(len(a) - 1)[2 * (k + a) > x].sum() for k in c])
                two = np.array([flips(len(b) - 1)[2 * (k + b) > y].sum() for k in c])
                p = max(p, float((flips(common) * (one + two - 2 * one * two)).sum()))
    return math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


# Trees


@dataclass
class Tree:
    """Nodes by number: vantage code, mu and the two children; leaves have left -1 and a shard number."""

    radius: int
    vantage: list[int] = field(default_factory=list)
    mu: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    shard: list[int] = field(default_factory=list)
    shards: int = 0

    def add(self, vantage: int = 0, mu: int = 0) -> int:
        for values, v in ((self.vantage, vantage), (self.mu, mu), (self.left, -1), (self.right, -1), (self.shard, -1)):
            values.append(v)
        return len(self.mu) - 1

    def leaf(self) -> int:
        k = self.add()
        self.shard[k] = self.shards
        self.shards += 1
        return k


def fit_tree(codes: np.ndarray, scale: float, radius: int, shard: int = SHARD, seed: int = 1) -> Tree:
    """A tree over a sample of distinct codes, each standing for ``scale`` codes."""
    rng = np.random.default_rng(seed)
    tree = Tree(radius)

    def grow(part: np.ndarray) -> int:
        if len(part) * scale <= shard or len(part) < 4:
            return tree.leaf()
        best = None
        for v in rng.choice(part, min(6, len(part)), replace=False).tolist() + rng.integers(0, 1 << 32, 4).tolist():
            d = np.bitwise_count(part ^ np.uint64(v)).astype(np.int64)
            for mu in {int(np.median(d)) - 1, int(np.median(d))}:
                low, edge = (d <= mu).mean(), ((d > mu) & (d <= mu + radius)).mean()
                cost = max(low, 1 - low) + edge
                if 0 < low < 1 and (best is None or cost < best[0]):
                    best = (cost, v, mu, d <= mu)
        if best is None:
            return tree.leaf()
        k = tree.add(best[1], best[2])
        tree.left[k] = grow(part[best[3]])
        tree.right[k] = grow(part[~best[3]])
        return k

    grow(np.unique(codes))
    return tree


def inner_tree(shard: int, depth: int, radius: int) -> Tree:
    """A tree for an overfull shard, ``depth`` levels deep: vantage codes are drawn from the shard's number, one for a
    level, and parted at the usual distance of codes that have nothing to do with each other."""
    rng = np.random.default_rng([shard, depth])
    vantage = rng.integers(0, 1 << 32, depth).tolist()
    tree = Tree(radius)

    def grow(level: int) -> int:
        if level == depth:
            return tree.leaf()
        k = tree.add(vantage[level], 15)
        tree.left[k] = grow(level + 1)
        tree.right[k] = grow(level + 1)
        return k

    grow(0)
    return tree


def route(tree: Tree, codes: np.ndarray, at_home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) for each shard that a code lives in or visits; codes that aren't ``at_home`` only visit."""
    vantage, mu = np.array(tree.vantage, np.uint64), np.array(tree.mu)
    left, right, shard = np.array(tree.left), np.array(tree.right), np.array(tree.shard)
    row, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    home = np.ones(len(codes), bool) if at_home is None else at_home.copy()
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        leaf = left[node] < 0
        done.append((row[leaf], shard[node[leaf]], home[leaf]))
        row, node, home = row[~leaf], node[~leaf], home[~leaf]
        d = np.bitwise_count(codes[row] ^ vantage[node]).astype(np.int64)
        low = d <= mu[node]
        goes_left = low | (d <= mu[node] + tree.radius)
        goes_right = ~low | (~home & (d > mu[node] - tree.radius))  # a home on the left waits for visitors
        row, node, home = (
            np.concatenate([row[goes_left], row[goes_right]]),
            np.concatenate([left[node[goes_left]], right[node[goes_right]]]),
            np.concatenate([(home & low)[goes_left], (home & ~low)[goes_right]]),
        )
    return tuple(np.concatenate(x) for x in zip(*done))


# Links


def roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def connect(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union-find array after joining pairs (a, b); roots are the smallest of their sets."""
    while len(a):
        parent = roots(parent)
        x, y = parent[a], parent[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return parent


def links(codes: np.ndarray, sigs: np.ndarray, home: np.ndarray, block: np.ndarray, crossing: bool, radius: int, most: int) -> np.ndarray:
    """The set of each row, as the number of its first row: rows are joined if their codes differ in up to
    ``radius`` bits and their signatures in up to ``most``, and one of them is at home."""
    d = np.bitwise_count(codes ^ codes[0])
    order = np.argsort(d, kind="stable")
    codes, sigs, home, block, d = codes[order], sigs[order], home[order], block[order], d[order].astype(np.int64)
    n = len(codes)
    parent = np.arange(n)
    upto = np.searchsorted(d, d + radius, side="right")
    step = max(16, min(512, (1 << 22) // max(1, n)))
    for k in range(0, n, step):
        end = int(upto[min(n, k + step) - 1])
        near = np.bitwise_count(codes[k : k + step, None] ^ codes[None, k:end]) <= radius
        i, j = np.nonzero(near)
        ok = j > i
        i, j = i[ok] + k, j[ok] + k
        for at in range(0, len(i), 1 << 20):
            a, b = i[at : at + (1 << 20)], j[at : at + (1 << 20)]
            ok = home[a] | home[b]
            if crossing:
                ok &= block[a] != block[b]
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(sigs[a] ^ sigs[b]).sum(axis=1) <= most
            parent = connect(parent, a[ok], b[ok])
    out = np.empty(n, np.int64)
    out[order] = order[roots(parent)]
    return out


def find_links(points: DataFrame, radius: int, most: int, shard: int = SHARD, sample: int = SAMPLE, shard_most: int = SHARD_MOST) -> DataFrame:
    """Links (a, b) of ids that join everything which has codes within ``radius`` in one tree and signatures
    within ``most`` bits.

    ``points``: tree int, code long (32 bits), id long, sig binary (whole 64-bit words), distinct by (tree, id).
    """
    sizes = {r.tree: r.n for r in points.groupBy("tree").agg(F.count("*").alias("n")).collect()}  # a row per tree
    if not sizes:
        return points.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    trees: dict[int, Tree] = {}
    for t, n in sorted(sizes.items()):
        part = points.where(F.col("tree") == t)
        chosen = part.orderBy(F.xxhash64("id"), "id").select("code").limit(sample) if n > shard else None
        codes = np.array([r.code for r in chosen.collect()] if chosen is not None else [], np.int64).astype(np.uint64)
        trees[t] = fit_tree(codes, n / max(1, len(codes)), radius, shard, seed=t + 1)
    first = dict(zip(trees, np.cumsum([0, *(x.shards for x in trees.values())])))
    shared = points.sparkSession.sparkContext.broadcast((trees, {k: int(v) for k, v in first.items()}))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, first = shared.value
        for batch in batches:
            tree, code = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for t in np.unique(tree).tolist():
                at = np.flatnonzero(tree == t)
                row, shard, home = route(trees[t], code[at].astype(np.uint64))
                take = pa.array(at[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard + first[t], pa.int64()), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(home)],
                    ["shard", "code", "id", "sig", "home"],
                )

    dealt = points.select("tree", "code", "id", "sig").mapInArrow(deal, "shard long, code long, id long, sig binary, home boolean")
    counts = lambda rows: rows.groupBy("shard").agg(F.count("*").alias("rows")).where(F.col("rows") > shard_most).collect()
    # Overfull shards only, of which there are rows / shard_most at most, and a depth for each.
    depths = {r.shard: max(1, math.ceil(math.log2(2 * r.rows / shard_most))) for r in counts(dealt)}
    cut: dict[int, int] = {}
    if depths:
        shared_depths = points.sparkSession.sparkContext.broadcast(depths)

        def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            depths = shared_depths.value
            trees: dict[int, Tree] = {}
            for batch in batches:
                shard, code, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4))
                over = np.isin(shard, list(depths))
                same = np.flatnonzero(~over)
                takes, shards, homes = [same], [shard[same] << 20], [home[same].astype(bool)]
                for s in np.unique(shard[over]).tolist():
                    if s not in trees:
                        trees[s] = inner_tree(s, min(depths[s], 18), radius)
                    at = np.flatnonzero(shard == s)
                    row, leaf, stays = route(trees[s], code[at].astype(np.uint64), home[at].astype(bool))
                    takes.append(at[row])
                    shards.append((s << 20) + 1 + leaf)
                    homes.append(stays)
                take = pa.array(np.concatenate(takes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shards), pa.int64()), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(np.concatenate(homes))],
                    ["shard", "code", "id", "sig", "home"],
                )

        dealt = dealt.mapInArrow(deal_again, dealt.schema)
        cut = {r.shard: math.ceil(r.rows / (shard_most // 2)) for r in counts(dealt.where(F.shiftright("shard", 20).isin(list(depths)) if len(depths) < 1000 else F.lit(True)))}
    blocks = F.lit(1)
    if cut:
        table = local_table(points.sparkSession, sorted(cut.items()), "shard long, blocks int")
        dealt = dealt.join(F.broadcast(table), "shard", "left")
        blocks = F.coalesce(F.col("blocks"), F.lit(1))
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    grouped = dealt.select("shard", "code", "id", "sig", "home", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    grouped = grouped.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "code", "id", "sig", "home", "block")

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint64).reshape(len(pdf), -1)
        root = links(pdf["code"].to_numpy().astype(np.uint64), sigs, pdf["home"].to_numpy(bool), pdf["block"].to_numpy(), key[1] != key[2], radius, most)
        joined = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[joined], "b": ids[root[joined]]})

    return grouped.groupBy("shard", "i", "j").applyInPandas(link, "a long, b long")


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round is a large star and a small star, written, and the round before is deleted; rounds go on until a
    round changes nothing, which they do after some log(nodes) squared.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "stars")
    mark = lambda t: tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before, now = None, mark(e)
    while now != before and now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), "least")
        # A hub of very many edges is looked up where its edges lie.
        large = join_counted(both, least, "a", 2 * now[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-stars")
        discard(least)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = join_counted(large, least, "a", now[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        discard(least)
        discard(e, large)
        e, before, now = new, now, mark(new)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


# Exact similarity of candidates


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The component of each set, as the number of its first set: sets are linked if their Jaccard
    similarity is ``similarity`` or more. Two empty sets are alike."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(n)), n)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(flat, minlength=len(names))[flat] > 1
    row, flat = row[shared], flat[shared]
    ends = np.cumsum(np.bincount(row, minlength=len(n)))
    starts = np.concatenate([[0], ends[:-1]])
    label, mark = np.full(len(n), -1), np.zeros(len(names), bool)
    left_row, left = row, flat  # of sets that have no label
    for first in range(len(n)):
        if label[first] >= 0:
            continue
        label[first] = first
        at = np.searchsorted(left_row, first, side="right")
        left_row, left = left_row[at:], left[at:]
        front = [first]
        while front:
            k = front.pop()
            own = flat[starts[k] : ends[k]]
            mark[own] = True
            common = np.bincount(left_row[mark[left]], minlength=len(n))
            mark[own] = False
            near = np.flatnonzero((label < 0) & (common >= similarity * (n[k] + n - common) - 1e-9))
            if len(near):
                label[near] = first
                front.extend(near.tolist())
                open_ = label[left_row] < 0
                left_row, left = left_row[open_], left[open_]
    return label


def confirmed(members: DataFrame, similarity: float, rows: int = BLOCK_ROWS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) that join exactly what is joined by pairs of one ``root`` with the similarity.

    ``members``: id, root, shingles (binary, distinct 64-bit hashes); distinct by id, the hub of a root has it as id.
    """
    spark = members.sparkSession
    blocks = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(F.length("shingles")) / (8 * shingles)), F.lit(1)).cast("int")
    sizes = materialize(members.groupBy("root").agg(F.count("*").alias("rows"), blocks.alias("blocks")), "candidate-sizes")
    buckets = max(64, (sizes.agg(F.sum("rows")).first()[0] or 0) // 256)
    cut = sizes.where("blocks > 1").select("root", "blocks").collect()  # overfull components only
    table = local_table(spark, [tuple(r) for r in cut], "root long, blocks int")
    dealt = members.join(F.broadcast(table), "root", "left")
    own = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    slot = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root"))
    dealt = dealt.select("root", "id", "shingles", "blocks", slot.alias("slot"), own.alias("own"))

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("root", kind="stable")
        root, ids = pdf["root"].to_numpy(), pdf["id"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        cuts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])).tolist()
        label = np.empty(len(ids), np.int64)
        for k, end in zip(cuts, [*cuts[1:], len(ids)]):
            found = ids[k:end][alike(sets[k:end], similarity)]
            hub = np.flatnonzero(ids[k:end] == root[k])
            label[k:end] = np.where(found == found[hub[0]], root[k], found) if len(hub) else found
        return pd.DataFrame({"id": ids, "root": root, "label": label})

    made = "id long, root long, label long"
    everywhere = F.when((F.col("id") == F.col("root")) & F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    inner = dealt.select("root", "id", "shingles", "slot", F.explode(everywhere).alias("block"))
    found = materialize(inner.groupBy("slot", "block").applyInPandas(confirm, made), "confirmed")
    links = found.select(F.col("id").alias("a"), F.col("label").alias("b"))
    apart = found.where("label <> root").join(F.broadcast(table), "root")  # of overfull components
    counts = apart.groupBy("root", "blocks").agg(F.ceil(F.count("*") / rows).cast("int").alias("others")).collect() if cut else []
    if not counts:
        return links
    several = F.broadcast(local_table(spark, [(r.root, r.others) for r in counts], "root long, others int"))
    rest = dealt.join(several, "root")
    lone = rest.join(apart.select("id"), "id", "left_semi")
    other = F.pmod(F.xxhash64("id", F.lit(1)), F.col("others")).cast("int")
    crossed = rest.select("root", "id", "shingles", F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    crossed = crossed.unionByName(lone.select("root", "id", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), other.alias("other")))
    across = crossed.groupBy("root", "block", "other").applyInPandas(confirm, made)
    return links.unionByName(across.select(F.col("id").alias("a"), F.col("label").alias("b")))


# Operators


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a long)."""

    def make():
        def work(texts: list[bytes]) -> dict:
            return {"fp": np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)}

        return work

    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", "fp long", make)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: components of fingerprints within ``radius`` (up to 3) bits."""
    prints = materialize(fingerprints(docs, doc_id, text, size), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "classes")
    half = F.explode(F.array(F.struct(F.lit(0).alias("tree"), F.expr("fp & 4294967295L").alias("code")), F.struct(F.lit(1).alias("tree"), F.expr("shiftrightunsigned(fp, 32)").alias("code"))))
    points = classes.select("fp", half.alias("h")).select("h.tree", "h.code", F.col("fp").alias("id"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("sig"))
    root_of = contract(find_links(points, radius // 2, radius))
    rooted = classes.join(root_of, classes["fp"] == root_of["node"], "left").select("fp", "first_doc", "n", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("n_prints"))
    total = rooted.agg(F.count("*"), F.sum("n")).first()  # one row
    named = join_counted(rooted, smallest, "root", total[0], "n_prints").select("fp", "n", "component_id")
    named = materialize(named, "components")
    discard(classes, rooted)
    return join_counted(prints, named, "fp", total[1] or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, group_key: text_key is a 64-bit hash of the text, group_key one of its group's."""

    def make():
        def work(texts: list[bytes]) -> dict:
            made = [signature(t, size) for t in texts]
            return {"sig": [s for s, _ in made], "codes": [c for _, c in made]}

        return work

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    signed = materialize(map_text(keyed, ["doc_id", "text_key"], "text", "sig binary, codes array<long>", make), "signatures")
    one_doc = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).getField("doc_id")
    per_text = signed.groupBy("text_key").agg(F.first("sig").alias("sig"), F.first("codes").alias("codes"), one_doc.alias("one_doc"), F.count("*").alias("n"))
    distinct = materialize(per_text, "distinct-texts")
    points = distinct.select("text_key", "sig", F.posexplode("codes").alias("tree", "code")).where("code is not null")
    points = materialize(points.select("tree", "code", F.col("text_key").alias("id"), "sig"), "points")
    near = contract(find_links(points, 1, candidate_bits(similarity)))
    hubs = near.select(F.col("root").alias("id"), "root").distinct()
    members = near.select(F.col("node").alias("id"), "root").unionByName(hubs)
    members = materialize(members.join(distinct.select(F.col("text_key").alias("id"), "one_doc"), "id"), "candidates")
    discard(points)
    first = F.row_number().over(Window.partitionBy("id").orderBy("doc_id"))
    texts = keyed.join(members, (F.col("text_key") == F.col("id")) & F.col("doc_id").eqNullSafe(F.col("one_doc"))).withColumn("n", first).where("n = 1")

    def shingles():
        return lambda texts: {"shingles": [np.unique(shingle_hashes(t, size)).tobytes() for t in texts]}

    held = materialize(map_text(texts, ["id", "root"], "text", "shingles binary", shingles), "shingles")
    root_of = contract(confirmed(held, similarity))
    grouped = distinct.join(root_of, distinct["text_key"] == root_of["node"], "left").select("text_key", "n", F.coalesce("root", "text_key").alias("group_key"))
    grouped = materialize(grouped, "grouped")
    total = grouped.agg(F.sum("n")).first()[0] or 0  # one row
    discard(members, held, distinct)
    return join_counted(signed.select("doc_id", "text_key"), grouped, "text_key", total).select("doc_id", "text_key", "group_key")


def drop_similar(docs: DataFrame, similarity: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar documents: the smallest doc_id (null ids come last); columns pass
    through, whatever their names. Of rows with that doc_id and text, the first by all their other columns stays."""
    groups = materialize(similar_documents(docs, similarity, size, doc_id, text), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    kept = groups.groupBy("group_key").agg(F.min(order).alias("kept")).select("kept.doc_id", "kept.text_key")
    of, key, row, text_key = apart(docs.columns, "kept_doc", "kept_key", "row_number", "text_key")
    kept = materialize(kept.select(F.col("doc_id").alias(of), F.col("text_key").alias(key)), "kept")
    discard(groups)
    keyed = docs.withColumn(text_key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = F.col(doc_id).eqNullSafe(F.col(of)) & (F.col(text_key) == F.col(key))
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)])) if len(docs.columns) > 2 else F.lit(0)
    one = Window.partitionBy(key, of).orderBy(rest)
    found = keyed.join(kept, same).withColumn(row, F.row_number().over(one)).where(F.col(row) == 1)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
