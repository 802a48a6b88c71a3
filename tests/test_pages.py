import pytest
from pyspark.sql import functions as F

from quillfold.operators import pages
from quillfold.sources import archive


def keys(df):
    return [tuple(r) for r in df.collect()]


def test_every_page_is_that_of_the_sorted_table(spark):
    """A third of the rows share one value, and some have none."""
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).alias("v"), "id")
    order = [F.desc_nulls_last("v"), F.asc("id")]
    got = pages.paged(df, order, 60)
    want = keys(df.orderBy(*order))
    assert got.total == 1000 and len(got.counts) == 17 and max(got.counts) < 200
    for size in (7, 64, 333, 2000):
        for n in {1, 2, 1000 // size, 1000 // size + 1, 1000 // size + 2} - {0}:
            assert keys(got.page(n, size)) == want[(n - 1) * size : n * size], (n, size)


def test_a_deep_page_reads_one_range(spark):
    got = pages.paged(spark.range(5000).select(F.col("id").alias("k")), [F.asc("k")], 500)
    page = got.page(40, 50)
    hit, before = got.covering(39 * 50, 50)
    assert len(hit) <= 2 and 0 <= before < max(got.counts)
    plan = page._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = got.rows.filter(F.col("_range").isin(hit)).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 2 and keys(page) == [(k,) for k in range(1950, 2000)]


def test_empty_tables_and_bad_pages(spark):
    got = pages.paged(spark.range(0), [F.asc("id")])
    assert got.total == 0 and keys(got.page(1, 10)) == []
    with pytest.raises(ValueError):
        got.page(0, 10)
    with pytest.raises(ValueError):
        got.page(1, 0)


def test_numbers_of_rows(spark):
    df = spark.range(700).select((F.col("id") % 9).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    got = {(r["v"], r["id"]): r["place"] for r in pages.numbered(df, order, "place", 100).collect()}
    assert got == {tuple(r): k for k, r in enumerate(df.orderBy(*order).collect(), 1)}
    assert pages.numbered(df.limit(0), order, "place").count() == 0


def test_files_are_hashed_in_blocks_like_whole_ones(spark, tmp_path):
    spark.range(5000).repartition(3).write.parquet(str(tmp_path / "t"))
    whole, blocks = (sorted(map(tuple, archive.manifest(spark, str(tmp_path / "t"), limit).collect())) for limit in (1 << 30, 100))
    assert whole == blocks and len(whole) == 3
