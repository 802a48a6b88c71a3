"""Intermediate tables: written once where driver and executors both see them, and read back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, else one in the warehouse; never a machine's own folder on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if own_disk(warehouse, spark.sparkContext.master):
        raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir: the warehouse lies on each machine's own disk")
    return f"{warehouse}/_intermediate"


def own_disk(folder: str, master: str) -> bool:
    """Whether executors on other machines would each see another folder of this name."""
    return not re.match(r"local(\[|$)", master) and re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", folder) is None


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return path


def stored(df: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """df as a stored table, by folders of some columns if asked for: a wide plan is planned once, and a lost executor costs nothing. It goes when the session ends."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
