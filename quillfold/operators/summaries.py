"""Grouped summaries, readiness, holds and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ["blocked", "failed", "unknown", "running", "succeeded"]


def column_profile(df: DataFrame, empty: callable, columns: list[str] | None = None) -> DataFrame:
    """column, non_empty and empty counts of every column, in one pass over the table."""
    names = columns or df.columns
    row = df.agg(*[F.count_if(~empty(F.col(c))).alias(f"f{k}") for k, c in enumerate(names)], F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{k}").alias("non_empty"), (F.col("n") - F.col(f"f{k}")).alias("empty")) for k, c in enumerate(names)]))
    return row.select(each.alias("p")).select("p.*")


def column_samples(df: DataFrame, empty: callable, row: str, columns: list[str] | None = None, n: int = 10) -> DataFrame:
    """column and its first n values that aren't empty, in row order; ranks are limited before the shuffle, so no column is gathered."""
    from pyspark.sql import Window as W

    names = columns or [c for c in df.columns if c != row]
    each = df.select(F.col(row).alias("_row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("v")).select("_row", "v.*").filter(~empty(F.col("value")))
    first = each.withColumn("_k", F.row_number().over(W.partitionBy("column").orderBy("_row"))).filter(F.col("_k") <= n)
    return first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "value"))), lambda x: x["value"]).alias("samples"))


def readiness(total: Column, ready: Column) -> Column:
    """ready, partially_ready, pending or not_applicable from counts."""
    return F.when(total == 0, "not_applicable").when(ready == total, "ready").when(ready > 0, "partially_ready").otherwise("pending")


def effective_status(status: Column, *holds: Column) -> Column:
    """A status that is not final waits while something holds it, and is planned again when nothing does."""
    held = F.lit(False)
    for h in holds:
        held = held | F.coalesce(h, F.lit(False))
    s = F.coalesce(status, F.lit("planned"))
    return F.when(s.isin(TERMINAL), s).when(held, "awaiting_approval").when(s == "awaiting_approval", "planned").otherwise(s)


def group_status(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Status of a group of actions: completed, attention_required, awaiting_approval, in_progress or not_started."""
    s = F.col(status)
    got = df.groupBy(*keys).agg(F.count("*").alias("actions"), F.bool_and(s == "succeeded").alias("_all"), F.bool_or(s.isin("blocked", "failed", "unknown")).alias("_bad"), F.bool_or(s == "awaiting_approval").alias("_wait"), F.bool_or(s != "planned").alias("_some"))
    out = F.when(F.col("_all"), "completed").when(F.col("_bad"), "attention_required").when(F.col("_wait"), "awaiting_approval").when(F.col("_some"), "in_progress").otherwise("not_started")
    return got.select(*keys, "actions", out.alias("group_status"))


def first_distinct(c: Column, n: int) -> Column:
    """First n distinct values in ascending order, joined."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, n), ",")


def nested_groups(df: DataFrame, outer: list[str], inner: list[str], example: str, n: int = 5) -> DataFrame:
    """Counts per outer and inner group with the first n examples; examples are made distinct before they are ranked, so no group is gathered."""
    from pyspark.sql import Window as W

    counts = df.groupBy(*outer, *inner).agg(F.count("*").alias("n"), F.count_distinct(example).alias("examples_total"))
    distinct = df.select(*outer, *inner, example).distinct()
    first = distinct.withColumn("_k", F.row_number().over(W.partitionBy(*outer, *inner).orderBy(example))).filter(F.col("_k") <= n)
    listed = first.groupBy(*outer, *inner).agg(F.array_join(F.transform(F.array_sort(F.collect_list(example)), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(listed, [*outer, *inner])


def first_theme(text: Column, themes: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Name of the first theme one of whose words is in the text; order decides."""
    out = None
    for name, marks in themes:
        hit = F.lit(False)
        for m in marks:
            hit = hit | text.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts by value for a fixed list of values, 0 where there are none."""
    got = df.groupBy(column).agg(F.count("*").alias("n"))
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string").join(got, column, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
