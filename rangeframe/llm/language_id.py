"""Language ID: multinomial naive Bayes over hashed character n-grams.

Executors count n-grams by language over a bounded sample of labelled documents; the log-probability
matrix (languages x buckets, at most CELLS numbers) is broadcast. A batch is scored as one sparse product in numpy:
texts by words, words by n-grams, n-grams by the matrix. The language is the one of the largest posterior; its score
is tempered, as n-grams that overlap aren't independent evidence.

Cases: null texts and texts without a letter are ``und`` with score 0; rows without a language label
never train; equal rows (doc_id, text, language) train once, others of one doc_id each; a null doc_id counts as empty
text when folds are made and never trains; texts are read whole at any length; ties go to the language that
comes first by name; without any labelled row all are ``und``; an empty table gives an empty result; further
columns are ignored, or pass through if they are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeframe.llm.common import held_out, map_text, order_of
from rangeframe.llm.subwords import WordSums, gram_counts, grams

#: Bound on labelled documents that train the model.
TRAIN_DOCS = 8000
#: Buckets of hashed n-grams, the lengths of the n-grams, and numbers in the matrix: over CELLS / BUCKETS languages
#: share fewer buckets.
BUCKETS, LEAST, MOST, CELLS = 1 << 15, 1, 3, 1 << 25
#: Scores are of a text's mean n-gram, repeated this often at most: long texts aren't all certain.
EVIDENCE = 60.0
#: Bytes of text that are scored at once, and numbers that a step of the product holds: a few languages make wide steps
#: of words and n-grams, whose Python objects are many times their numbers.
RUN_BYTES, STEP = 1 << 19, 1 << 20


def splitter(buckets: int):
    return lambda word: grams(word, LEAST, MOST, buckets, whole=False)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: log probabilities
    prior: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most: int = TRAIN_DOCS) -> Model:
    """A model from at most ``most`` labelled documents, those that come first by a hash of their id.

    What comes to the driver is one row per language: its n-gram counts, of fixed size.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull()).withColumn("h", F.xxhash64("text"))
    chosen = rows.select("id", "h", "lang").distinct().orderBy(order_of("id"), "id", "h", "lang").limit(most)
    sample = rows.join(F.broadcast(chosen), ["id", "h", "lang"], "left_semi").dropDuplicates(["id", "h", "lang"]).select("lang", "text")  # ``most`` rows
    buckets = max(64, min(BUCKETS, CELLS // max(1, chosen.select("lang").distinct().count())))
    split = splitter(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, n = gram_counts(value.as_py() or "", split)
                if name not in totals:
                    totals[name], docs_of[name] = np.zeros(buckets, np.int64), 0
                totals[name][ids] += n
                docs_of[name] += 1
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"lang": [name], "docs": [docs_of[name]], "ids": [at.astype(np.int32)], "n": [total[at]]},
                schema=pa.schema([("lang", pa.string()), ("docs", pa.int64()), ("ids", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]),
            )

    counted = sample.repartition(8).mapInArrow(count, "lang string, docs long, ids array<int>, n array<long>")
    found = counted.collect()  # at most 8 rows of bounded size for each language, of which there are ``most`` at most
    languages = sorted({r.lang for r in found})
    counts = np.zeros((buckets, len(languages)), np.float32 if len(languages) > 1000 else np.float64)
    prior = np.zeros(len(languages))
    place = {name: k for k, name in enumerate(languages)}
    for r in found:
        counts[r.ids, place[r.lang]] += r.n
        prior[place[r.lang]] += r.docs
    counts += 0.5
    table = np.log(counts / counts.sum(axis=0)) if languages else counts
    return Model(languages, table.astype(np.float32), np.log(prior / prior.sum()) if languages else prior)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.sums = model, WordSums(model.table, splitter(len(model.table)), step=STEP)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of the largest posterior and its tempered probability, for each text."""
        names = self.model.languages
        if not names:
            return [("und", 0.0)] * len(texts)
        sums = self.sums.of_texts(texts)
        logs, n = sums[:, :-1], sums[:, -1:]
        best = np.argmax(self.model.prior + logs, axis=1)
        soft = self.model.prior + logs * np.minimum(1.0, EVIDENCE / np.maximum(n, 1.0))
        p = np.exp(soft - soft.max(axis=1, keepdims=True))
        score = p[np.arange(len(texts)), best] / p.sum(axis=1)
        letters = [any(map(str.isalpha, t)) for t in texts]
        return [(names[k], s) if has else ("und", 0.0) for k, s, has in zip(best.tolist(), score.tolist(), letters)]


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with the predicted language and its score, under ``names``."""
    pred, score = names
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.prior))

    def make():
        scorer = Scorer(Model(*shared.value))

        def work(texts: list[bytes]) -> dict:
            found = scorer.predict([t.decode("utf-8", "replace") for t in texts])
            return {pred: [x for x, _ in found], score: [s for _, s in found]}

        return work

    return map_text(docs, keep, text, f"{pred} string, {score} double", make, RUN_BYTES)


def language_id(docs: DataFrame, folds: int = 4, fold: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; trained on labelled rows outside the fold."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(doc_id, folds, fold).alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    return identify(rows, model, ["doc_id", "held_out"])
