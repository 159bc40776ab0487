"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeframe.llm.bpe import bpe_round_trip
from rangeframe.llm.common import documents
from rangeframe.llm.exact_dedup import exact_dedup
from rangeframe.llm.language_id import language_id
from rangeframe.llm.license_scan import license_scan
from rangeframe.llm.line_dedup import line_digest
from rangeframe.llm.media import media_digest
from rangeframe.llm.mixing import mix
from rangeframe.llm.simhash import near_duplicates
from rangeframe.llm.token_counts import token_counts
from rangeframe.llm.toxicity import toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SEED = 42


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), VOCABULARY)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), seed=SEED)
    return mixed.select("doc_id", "source", "text", F.round("rate", 6).alias("rate"), "n_copies", "copy", "mix_key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), VOCABULARY)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_toxicity, op2_exact_dedup, op3_language_id, op4_media, op5_token_counts,
        op6_mixing, op7_simhash, op8_license_scan, op9_line_dedup, op10_bpe, pipeline,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op6_mixing": f"""
            WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
            r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
            k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM r),
            p AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM k),
            c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
            u AS (SELECT doc_id, source, text,
                         (('0x' || substr(md5('{SEED}|count|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5)
                         / 4503599627370496.0::DOUBLE AS u FROM documents),
            d AS (SELECT u.doc_id, u.source, u.text, u.u, c.rate, count(*) FILTER (c.cdf < u.u) AS n_copies
                  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
            SELECT doc_id, source, text, round(rate, 6) AS rate, CAST(n_copies AS INTEGER) AS n_copies,
                   CAST(copy AS INTEGER) AS copy,
                   md5('{SEED}|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)) AS mix_key
            FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM d WHERE n_copies > 0)""",
        "op9_line_dedup": r"""
            WITH l AS (SELECT doc_id, md5(coalesce(text, '')) AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
            k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            h AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            f AS (SELECT k.doc_id, k.t, k.line, k.pos, h.key IS NOT NULL AND k.doc_id <> h.last_doc AS dropped
                  FROM k LEFT JOIN h USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
            FROM f GROUP BY doc_id, t""",
    }
