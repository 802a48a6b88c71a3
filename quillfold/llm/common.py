"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import stored as materialise

__all__ = ["NON_SPACES", "SPACES", "buckets_for", "fold_of", "materialise", "n_shuffle", "reachable", "table"]

#: White space that separates words, as a character class for Java and RE2 alike.
SPACES = r"[\x20\x09-\x0D]"
NON_SPACES = r"[^\x20\x09-\x0D]"


def reachable(spark: SparkSession) -> None:
    """Python workers find this package where it lies on their machine; on a cluster, ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """How many buckets hold rows at per_bucket each."""
    return max(least, -(-rows // per_bucket))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
