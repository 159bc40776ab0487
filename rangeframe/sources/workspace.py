"""Where an engine without a given root keeps its tables: the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rangeframe.functions.types import InvalidRequest


def new_root(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see. Where that is unset a temporary folder does
    for a local master; on a cluster, whose machines don't share one, it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidRequest("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rangeframe-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
