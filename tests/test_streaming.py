import datetime

from quillfold.streaming import latest

SCHEMA = "k int, at timestamp, v string"


def at(h):
    return datetime.datetime(2024, 1, 1, h)


def test_latest_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, at(1), "a"), (2, at(1), "b")], SCHEMA).coalesce(1).write.parquet(src)
    q = latest.keep_latest(latest.read_changes(spark, src, SCHEMA), ["k"], ["at", "v"], out, str(tmp_path / "cp"))
    q.awaitTermination()
    spark.createDataFrame([(1, at(3), "new"), (2, at(0), "late"), (3, at(2), "c")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    latest.keep_latest(latest.read_changes(spark, src, SCHEMA), ["k"], ["at", "v"], out, str(tmp_path / "cp")).awaitTermination()
    schema = spark.createDataFrame([], SCHEMA).schema
    assert {r["k"]: r["v"] for r in latest.current(spark, out, schema).collect()} == {1: "new", 2: "b", 3: "c"}
    assert latest.current(spark, str(tmp_path / "none"), schema).count() == 0


def test_lost_state_is_an_error(spark, tmp_path):
    """A version that is gone is never taken for an empty table; buckets that a batch doesn't touch stay where they are."""
    import shutil

    import pytest

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    run = lambda: latest.keep_latest(latest.read_changes(spark, src, SCHEMA), ["k"], ["at", "v"], out, cp).awaitTermination()
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    add([(k, at(1), "a") for k in range(40)])
    run()
    add([(7, at(2), "b")])
    run()
    assert len(list((tmp_path / "out" / "version=1").glob("bucket=*"))) == 1
    add([(7, at(3), "c"), (41, at(1), "d")])
    run()
    got = {r["k"]: r["v"] for r in latest.current(spark, out, spark.createDataFrame([], SCHEMA).schema).collect()}
    assert len(got) == 41 and got[7] == "c" and got[41] == "d" and got[3] == "a"
    shutil.rmtree(tmp_path / "out" / "_versions" / "2")
    add([(1, at(4), "e")])
    with pytest.raises(Exception, match="is missing"):
        run()


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, at(1), "a"), (1, at(1), "a"), (2, at(2), "b")], SCHEMA).coalesce(1).write.parquet(src)
    q = latest.counts_by_window(latest.read_changes(spark, src, SCHEMA), "at", "v").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["start"].hour, r["v"]): r["n"] for r in spark.table("counts").collect()} == {(1, "a"): 2, (2, "b"): 1}
