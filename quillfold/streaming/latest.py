"""Latest state of every key from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_changes(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_by_window(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind; what is later than the watermark is dropped, and state older than it is freed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _buckets(spark: SparkSession, target: str, n: int) -> dict[int, int] | None:
    """The version that holds each bucket after batch n; None if there is no such version."""
    p, fs = _path(spark, f"{target}/_versions/{n}")
    if not fs.exists(p):
        return None
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").json(f"{target}/_versions/{n}").collect()}


def _table(spark: SparkSession, target: str, at: dict[int, int], schema) -> DataFrame:
    paths = [f"{target}/version={v}/bucket={b}" for b, v in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table as its last whole version has it."""
    p, fs = _path(spark, f"{target}/_versions")
    found = [int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()] if fs.exists(p) else []
    return _table(spark, target, _buckets(spark, target, max(found)) if found else {}, schema)


def keep_latest(changes: DataFrame, keys: list[str], at: list[str], target: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Upsert every batch into a table of the latest row per key.

    Keys are dealt into buckets; a batch rewrites only the buckets that it touches,
    under version=N/bucket=B, and a small file of versions says where each bucket is.
    A batch that is replayed writes its own version again, so a restart changes
    nothing. A missing predecessor is an error: state is never taken as empty.
    What neither this version nor the one before it needs is removed.
    """
    schema = changes.schema

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in schema.names if c not in keys]
        before = _buckets(spark, target, n - 1) if n else {}
        if before is None:
            raise RuntimeError(f"version {n - 1} of {target} is missing")
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]
        old = _table(spark, target, {b: v for b, v in before.items() if b in touched}, schema)
        both = old.unionByName(dealt.drop("bucket"))
        latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("s")).select(*keys, "s.*").select(*schema.names)
        latest.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={n}")
        dealt.unpersist()
        now = before | dict.fromkeys(touched, n)
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{target}/_versions/{n}")
        for b in touched:
            older = (_buckets(spark, target, n - 2) or {}).get(b) if n > 1 else None
            if older is not None and older not in (before.get(b), now[b]):
                p, fs = _path(spark, f"{target}/version={older}/bucket={b}")
                fs.delete(p, True)

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
