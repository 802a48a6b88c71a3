"""Duplicate groups and the authoritative row of each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order; rows with a null key are each their own.

    One shuffle on the key; ranks are limited before it, so a hot key sends few rows.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    first = df.filter(known).withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")
    return first.unionByName(df.filter(~known))


def with_selection(df: DataFrame, keys: list[str], order: list[Column], row: str) -> DataFrame:
    """df with selection_status (authoritative or superseded) and the row that supersedes it; ``row`` names a row once.

    The first row of each key is found by a rank that is limited before the shuffle, and joined back: a hot key is neither sorted in one task nor gathered, and an adaptive plan can split its join.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    first = df.filter(known).withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").select(*keys, F.col(row).alias("_first"))
    out = df.join(first, keys, "left").select(*df.columns, "_first")
    kept = F.col("_first").isNull() | (F.col(row) == F.col("_first"))
    return out.withColumn("selection_status", F.when(kept, "authoritative").otherwise("superseded")).withColumn("superseded_by", F.when(~kept, F.col("_first"))).drop("_first")


def selection_counts(selected: DataFrame, by: list[str]) -> DataFrame:
    return selected.groupBy(*by).agg(F.count_if(F.col("selection_status") == "authoritative").alias("kept"), F.count_if(F.col("selection_status") == "superseded").alias("superseded"))


def duplicate_groups(df: DataFrame, key: Column, row: str) -> DataFrame:
    """key, members, first and last row of every key that has several rows."""
    return df.filter(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("members"), F.min(row).alias("first_row"), F.max(row).alias("last_row")).filter("members > 1")


def with_group_size(df: DataFrame, key: str) -> DataFrame:
    """df with the size of each row's group, by a join on pre-aggregated counts instead of a window, so a hot key is not one task."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("group_size"))
    return df.join(sizes, key, "left").withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))


def first_per_key(df: DataFrame, key: Column, position: Column) -> DataFrame:
    """Rows left when later ones of a key go, in stable order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(position))).filter("_n = 1").drop("_n")


def chunked(df: DataFrame, keys: list[str], value: str, order: list[Column], per_chunk: int = 1000) -> DataFrame:
    """keys, chunk (from 0) and values: each key's whole list in order, cut into rows of at most per_chunk values.

    A hot key is no long row and no single task: values are counted in ranges of the
    order first, a range's offset is the sum of those before it, and places within a range are numbered there.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = df.select(*keys, F.col(value).alias("_v"), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col(value).alias("v")).alias("_o")).repartitionByRange(n, *keys, "_o").withColumn("_part", F.spark_partition_id())
    rows = stored(placed, "ordered")
    same = W.partitionBy(*keys)
    before = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(same.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    named = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_part"]]
    within = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_o")) - 1)
    at = within.alias("r").join(before.alias("b"), named).select(*[F.col(f"r.{k}") for k in keys], "_v", (F.col("_k") + F.coalesce("_before", F.lit(0))).alias("_at"))
    lists = at.groupBy(*keys, F.floor(F.col("_at") / per_chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_l"))
    return lists.select(*keys, "chunk", F.transform("_l", lambda x: x["_v"]).alias("values"))
