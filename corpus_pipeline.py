"""A training-data pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as Parquet and
reads it back as the next stage's input. Stages run over all that their predecessor kept:

1. language ID: a model is trained on the input's labelled rows; documents without a letter, or whose
   best language has a posterior under MIN_POSTERIOR, go.
2. line dedup: repeated lines go, except in the largest document that holds them; a document of which
   nothing is left but white space goes too.
3. near-dedup: of each group of documents with a similarity of 0.8 or more one stays.
4. mixing: documents are replicated towards square-root weights of their sources and shuffled; copies of a document
   are equal rows, as stages return the columns of documents.
5. BPE: every document as token ids, with the digest of the text that they decode to.

All stages take nulls in any column, empty and very long texts, repeated rows, an empty table and further columns
of any name, which pass through (the last stage returns columns of its own). What each does is stated with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeframe.llm.bpe import bpe_encode_decode
from rangeframe.llm.common import apart, materialize
from rangeframe.llm.language_id import identify, train
from rangeframe.llm.line_dedup import dedup_lines
from rangeframe.llm.mixing import mix
from rangeframe.llm.simhash import drop_similar

MIN_POSTERIOR = 0.5
SEED = 42
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; all rows go if none has a language to learn from. Rows without a
    language, source or doc_id are judged by their text like any other; equal rows are judged alike."""
    lang, score = apart(docs.columns, "found_lang", "found_score")
    found = identify(docs, train(docs), docs.columns, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= MIN_POSTERIOR)).select(*columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null doc_id is the smallest document; null texts and texts without anything but white space go. Rows of one
    doc_id count as one document, and each loses its lines."""
    kept = dedup_lines(docs)
    left = kept.where(F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the smallest doc_id stays, a null one only if there is no other; null and empty texts are one
    text, texts without words are one group. Of rows that share it and its text one stays, by all their columns."""
    return drop_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is a source of its own; rows of one doc_id, and of a null one, have one number of copies."""
    names = [c if c in ("doc_id", "source") else f"of_{c}" for c in docs.columns]  # columns that mix adds may be here too
    return mix(docs.toDF(*names), seed=SEED).select(*[F.col(f"`{n}`") for n in names]).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of ``docs``; a null text is empty, has no tokens and decodes to the empty text."""
    return bpe_encode_decode(docs, VOCABULARY, ["doc_id", "lang", "source"])


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: A trained classifier, 64-bit XXH64 fingerprints and BPE merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
