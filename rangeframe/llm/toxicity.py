"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A document's vector is the mean of the embeddings of the hashed character n-grams and words of its distinct
words, with PADDING zero vectors so that a few words weigh little; a softmax over two classes stands on it.
Embeddings and output weights are trained together (Adagrad over minibatches, balanced classes), so a misspelling
that no document of the sample held still has most of its n-grams' vectors; n-grams of fewer than SEEN documents
of the sample are zero. For scoring, embeddings times weights collapse to one number for each n-gram, which keeps
the broadcast at one fixed-size vector.

Cases: null and empty texts get the score of a document without words (the bias); labels without a
document and documents without a label never train, nor do labels with a null; a null doc_id counts
as empty text when folds are made and never matches a label; repeated labels of one document count
once (the largest), and equal rows (doc_id, text) train once; without labelled rows of both classes every score is
under 1e-20; texts are read whole at any length; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeframe.llm.common import discard, held_out, map_text, materialize, order_of
from rangeframe.llm.subwords import WordSums, gram_counts, grams

#: Bound on the labelled documents of each class that train the model.
TRAIN_DOCS = 2000
#: Hashed n-grams, their lengths, and the width of their vectors.
BUCKETS, LEAST, MOST, WIDTH = 1 << 17, 3, 5, 8
EPOCHS, BATCH, RATE, SEED = 15, 64, 0.5, 7
#: Updates that training makes at least: a small sample is read more often.
STEPS = 600
#: Zero vectors in each mean, and documents of the sample that an n-gram needs to have a vector.
PADDING, SEEN = 200, 3


def split(word: str) -> list[int]:
    return grams(word, LEAST, MOST, BUCKETS, whole=True)


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag for the way to the driver: steps between sorted ids and their counts, compressed."""
    order = np.argsort(ids)
    return zlib.compress(np.diff(ids[order], prepend=0).astype("<u4").tobytes() + counts[order].astype("<u4").tobytes(), 1)


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.frombuffer(zlib.decompress(bag), "<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), counts.astype(np.int32)


@dataclass
class Model:
    table: np.ndarray  # for each n-gram, its embedding times the difference of the output weights
    bias: float


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train embeddings and softmax jointly on bags (ids, counts) with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate([i for i, _ in bags]), minlength=BUCKETS) >= SEEN
    E = (rng.normal(0, 0.01, (BUCKETS, WIDTH)) * seen[:, None]).astype(np.float32)
    W = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    gE, gW, gb = np.full(BUCKETS, 1e-4, np.float32), np.full_like(W, 1e-4), np.full_like(b, 1e-4)
    share = [(n[seen[i]] / (n.sum() + PADDING)).astype(np.float32) for i, n in bags]
    bags = [i[seen[i]] for i, _ in bags]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    for _ in range(max(epochs, -(-STEPS * BATCH // len(bags)))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            sizes = np.array([len(bags[r]) for r in rows])
            ids = np.concatenate([bags[r] for r in rows])
            part = np.concatenate([share[r] for r in rows])
            doc = np.repeat(np.arange(len(rows)), sizes)
            X = np.zeros((len(rows), WIDTH), np.float32)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            weighted = E[ids] * part[:, None]
            for r in range(len(rows)):
                X[r] = weighted[ends[r] : ends[r + 1]].sum(axis=0)
            logits = X @ W + b
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weight[rows][:, None] / len(rows)
            dX, dW, db = p @ W.T, X.T @ p, p.sum(axis=0)
            gW += dW**2
            gb += db**2
            W -= RATE * dW / np.sqrt(gW)
            b -= RATE * db / np.sqrt(gb)
            rows_of = dX[doc] * part[:, None]
            g = np.stack([np.bincount(ids, rows_of[:, k], BUCKETS) for k in range(WIDTH)], axis=1).astype(np.float32)
            gE += (g**2).mean(axis=1)
            E -= RATE * g / np.sqrt(gE)[:, None]
    return Model((E @ (W[:, 1] - W[:, 0])).astype(np.float32)[:, None], float(b[1] - b[0]))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model from at most ``most`` documents of each class, those that come first by a hash of their id.

    ``docs`` has doc_id and text, ``labels`` has one row (doc_id, y) per document. Only keys of documents that have a
    label are ordered and broadcast (twice ``most`` at most); executors turn the sample's whole texts into bags of
    distinct n-grams, and those come to the driver.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    marks = labels.select("doc_id", F.col("y").cast("int").alias("y"))
    known = rows.select("doc_id", "h").join(marks, "doc_id").distinct()
    known = materialize(known, "labelled-keys")
    classes = [known.where(F.col("y") == k).orderBy(order_of("doc_id"), "doc_id", "h").limit(most) for k in (0, 1)]
    chosen = classes[0].unionByName(classes[1])
    sample = rows.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("text", "y", order_of("doc_id").alias("o"))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [packed(*gram_counts(x.as_py() or "", split, distinct=True)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(made, pa.binary())], ["y", "o", "bag"])

    rows = sample.repartition(8).mapInArrow(bag, "y int, o long, bag binary").collect()  # at most 2 x ``most`` rows
    rows.sort(key=lambda r: (r.o, r.y, r.bag))
    discard(known)
    labels = np.array([r.y for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros((BUCKETS, 1), np.float32), -50.0)
    bags = [unpacked(r.bag) for r in rows]
    del rows
    return fit(bags, labels)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.sums = model, WordSums(model.table, split)

    def score(self, texts: list[str]) -> np.ndarray:
        sums = self.sums.of_texts(texts, distinct=True)
        return 1 / (1 + np.exp(-np.clip(self.model.bias + sums[:, 0] / (sums[:, 1] + PADDING), -500, 500)))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with score (0 to 1) and predicted (1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def make():
        scorer = Scorer(Model(*shared.value))

        def work(texts: list[bytes]) -> dict:
            s = scorer.score([t.decode("utf-8", "replace") for t in texts])
            return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return work

    return map_text(docs, keep, text, "score double, predicted int", make)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted; trained on labelled rows outside the fold."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id, folds, fold).alias("held_out"))
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("y"))
    model = train(rows, known.where(~held_out("doc_id", folds, fold)))
    return score(rows, model, ["doc_id", "held_out"], "text")
