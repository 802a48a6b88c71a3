"""Keyed three-way merges, differences and approvals bound to hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def operations(current: DataFrame, submitted: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, both sides' fields, multiplicities and the operation of every key.

    A key that is there several times on either side is a conflict without an
    operation; live rows that nobody submits are preserved; nothing is deleted.
    Counts come before the join, so a hot key meets as one row on each side.
    """
    side = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), *[F.min(f).alias(f"{name}_{f}") for f in fields])
    both = side(current, "current").join(side(submitted, "submitted"), keys, "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"current_{f}").eqNullSafe(F.col(f"submitted_{f}"))
    conflict = (F.coalesce("n_current", F.lit(0)) > 1) | (F.coalesce("n_submitted", F.lit(0)) > 1)
    op = F.when(conflict, "conflict").when(F.col("n_submitted").isNull(), "preserve").when(F.col("n_current").isNull(), "create").when(same, "no_change").otherwise("update")
    return both.withColumn("operation", op)


def merged(ops: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The state after the operations: a submitted value wins where there is one; conflicting keys keep what is live."""
    live = F.col("operation") == "conflict"
    return ops.filter(~live | F.col("n_current").isNotNull()).select(*keys, "operation", *[F.when(live, F.col(f"current_{f}")).otherwise(F.coalesce(f"submitted_{f}", f"current_{f}")).alias(f) for f in fields])


def overlay(current: Column, submitted: Column, fallback: Column | None = None, clear: Column | None = None) -> Column:
    """A leaf after a merge: explicit clears give null, submitted wins over live, and a fallback yields to live."""
    out = F.coalesce(submitted, current) if fallback is None else F.coalesce(submitted, current, fallback)
    return out if clear is None else F.when(~clear, out)


def path_differences(current: DataFrame, proposed: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, before and after of every leaf that differs; both sides are unpivoted and joined once on the key."""
    text = lambda df, name: df.select(*keys, *[F.col(f).cast("string").alias(f"{name}_{f}") for f in fields])
    both = text(current, "a").join(text(proposed, "b"), keys, "inner")
    leaf = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("before"), F.col(f"b_{f}").alias("after")) for f in fields]))
    return both.select(*keys, leaf.alias("d")).select(*keys, "d.*").filter(~F.col("before").eqNullSafe(F.col("after")))


def valid_approvals(comparisons: DataFrame, approvals: DataFrame) -> DataFrame:
    """comparisons with approved: an approval holds only while both hashes are still those it was given for."""
    a = approvals.select("change_id", "current_hash", "proposed_hash").distinct().withColumn("_ok", F.lit(True))
    return comparisons.join(a, ["change_id", "current_hash", "proposed_hash"], "left").withColumn("approved", F.coalesce("_ok", F.lit(False))).drop("_ok")


def coalesce_complementary(items: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Items of one key become one where no field has two different non-empty values; others are marked as conflicts."""
    filled = lambda f: F.when(F.col(f) != "", F.col(f))
    folded = items.groupBy(*keys).agg(F.count("*").alias("items"), *[F.count_distinct(filled(f)).alias(f"_d_{f}") for f in fields], *[F.min(filled(f)).alias(f) for f in fields])
    clash = F.lit(False)
    for f in fields:
        clash = clash | (F.col(f"_d_{f}") > 1)
    return folded.withColumn("conflict", clash).drop(*[f"_d_{f}" for f in fields])
