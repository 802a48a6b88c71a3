"""Pages of a sorted table without sorting it for each page.

The table is stored once in ranges of its order, each range a folder, with the number of
rows of every range. Page N then reads the one or two ranges that hold its rows, and only
these are sorted. The order must be total (end it with a unique column): then a value that
a third of all rows share is split over ranges like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored

ROWS_PER_RANGE = 200_000


@dataclass(frozen=True)
class Pages:
    rows: DataFrame  # with _range
    order: list[Column]
    counts: list[int]  # rows of each range, in order

    @property
    def total(self) -> int:
        return sum(self.counts)

    def covering(self, offset: int, size: int) -> tuple[list[int], int]:
        """(ranges that hold rows offset to offset + size, rows of the first of them that come before)."""
        ends = list(accumulate(self.counts))
        hit = [k for k, end in enumerate(ends) if end > offset and end - self.counts[k] < offset + size]
        return hit, offset - (ends[hit[0]] - self.counts[hit[0]]) if hit else 0

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of page `number` (from 1) in order; a page beyond the last is empty, one below 1 or a size below 1 an error."""
        if number < 1 or size < 1:
            raise ValueError(f"no page {number} of {size} rows")
        hit, before = self.covering((number - 1) * size, size)
        return self.rows.filter(F.col("_range").isin(hit)).orderBy(*self.order).offset(before).limit(size).drop("_range")


def paged(df: DataFrame, order: list[Column], rows_per_range: int = ROWS_PER_RANGE) -> Pages:
    """Store a table in ranges of an order. The driver keeps one number a range."""
    n = max(1, -(-df.count() // rows_per_range))
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *order)
    rows = stored(ranged, "pages", ["_range"])
    counts = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}
    return Pages(rows, order, [counts.get(k, 0) for k in range(n)])


def numbered(df: DataFrame, order: list[Column], name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with the place of every row in a total order, from 1: rows are counted inside their range, what comes before is known."""
    got = paged(df, order, rows_per_range)
    before = F.array(*[F.lit(n).cast("long") for n in [0, *accumulate(got.counts)]])
    return got.rows.withColumn(name, F.get(before, F.col("_range")) + F.row_number().over(W.partitionBy("_range").orderBy(*order))).drop("_range")
