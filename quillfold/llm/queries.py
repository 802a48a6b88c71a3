"""Registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, collocations_sql, decontaminate, decontaminate_sql, dedup_sql, divergence, divergence_sql, jaccard_join, mixing, packing, periodic, quality, runs_sql, secret_scan, substring, suffix_index, topk, toxicity
from .common import table


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20; candidates are all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.filter(F.col("vec_id") % 20 == 0), rows)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_rules(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), jaccard_join.JaccardParams(n=3, percent=90))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner is the source; a repository is one language part of a source."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), repo_cols=("source", "lang")))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def planted(ids: list, first: np.ndarray) -> np.ndarray:
    """Every tenth document (by crc32 of its id) turns periodic from one of its words on: which word each word is read as."""
    source = np.arange(first[-1])
    for k, i in enumerate(ids):
        h, n = zlib.crc32(str(i).encode()), int(first[k + 1] - first[k])
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            source[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return source


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_temperature_mixing,
        op2_exact_top_k,
        op3_toxicity,
        op4_quality_classifier,
        op5_substring_dedup,
        op6_distribution_divergence,
        op7_suffix_array_dedup,
        op8_packing,
        op9_jaccard_join,
        op10_secret_scan,
        op11_benchmark_decontamination,
        op12_phrase_collocations,
        op13_periodic_runs,
    )
}

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS f FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.f, c.f)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op2_exact_top_k": TOP_K_SQL,
    "op5_substring_dedup": dedup_sql.substring(),
    "op6_distribution_divergence": divergence_sql.oracle(),
    "op7_suffix_array_dedup": dedup_sql.suffix(),
    "op9_jaccard_join": dedup_sql.jaccard(),
    "op11_benchmark_decontamination": decontaminate_sql.oracle(),
    "op12_phrase_collocations": collocations_sql.oracle(),
    "op13_periodic_runs": runs_sql.oracle(),
}
