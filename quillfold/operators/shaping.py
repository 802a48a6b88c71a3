"""From wide rows to nested records and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_groups(groups: list[dict[str, Column]], has_data: list[str], each: Callable[[Column], Column] | None = None) -> Column:
    """Array of the groups in which some of the named fields are set; each keeps its original index from 1. With each, a group is what that makes of it."""
    made = [F.struct(F.lit(k).alias("index"), *[c.alias(n) for n, c in g.items()]) for k, g in enumerate(groups, 1)]

    def some(g: Column) -> Column:
        out = F.lit(False)
        for f in has_data:
            out = out | g[f].isNotNull()
        return out

    return F.filter(F.transform(F.array(*made), each) if each else F.array(*made), some)


def day_rows(df: DataFrame, keys: list[str], days: dict[str, str], name: str = "day", value: str = "value") -> DataFrame:
    """One row per key and named column that holds a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias(name), F.col(c).alias(value)) for d, c in days.items()]))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.*").filter(F.col(value).isNotNull())


def regroup(df: DataFrame, keys: list[str], order: str, text: str, separator: str, chunk: int = 256) -> DataFrame:
    """Texts of each key joined by a whole-number order: first within runs of that order, then the runs, so that the parts of a hot key are joined by many tasks and only its joined text is one value."""
    listed = lambda o, t: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), t.alias("t")))), lambda x: x["t"]), separator)
    runs = df.groupBy(*keys, F.floor(F.col(order) / chunk).alias("_run")).agg(listed(F.col(order), F.coalesce(F.col(text), F.lit(""))).alias("_t"), F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(F.sum("_n").alias("parts"), listed(F.col("_run"), F.col("_t")).alias("joined"))


def indexed_item(items: Column, index: int, field: str) -> Column:
    """Field of the item whose index is asked for, which need not be its position."""
    return F.get(F.filter(items, lambda x: x["index"] == index), F.lit(0))[field]
