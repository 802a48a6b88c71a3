"""Sinks: immutable run archives and report renderings."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(tables: dict[str, DataFrame], root: str, run_id: str, source_name: str = "") -> DataFrame:
    """Write every table beside its place, with a manifest of their files, and then rename the whole into place: the run's folder, which must be new, is complete or isn't there.

    A pointer to the latest run follows. Returns path, bytes and sha256 of each file.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    final, staged = f"{root}/run_id={run_id}", f"{root}/_staging/run_id={run_id}-{uuid.uuid4().hex}"
    fs = place(root).getFileSystem(conf)
    if fs.exists(place(final)):
        raise FileExistsError(final)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{staged}/{name}")
    files = manifest(spark, f"{staged}/*")
    listed = files.withColumn("path", F.regexp_extract("path", r"run_id=[^/]*/(.*)$", 1))
    listed.coalesce(1).write.json(f"{staged}/_manifest")
    if fs.exists(place(final)) or not fs.rename(place(staged), place(final)):
        raise FileExistsError(final)
    spark.createDataFrame([(run_id, source_name)], "run_id string, source_name string").withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{root}/_latest")
    return spark.read.schema("path string, bytes long, sha256 string").json(f"{final}/_manifest")


def manifest(spark: SparkSession, path: str, whole_bytes: int = 256 << 20) -> DataFrame:
    """path, bytes and sha256 of every Parquet file. Bigger files than whole_bytes are hashed block by block, so that none is a value in memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    small = files.filter(F.col("length") <= whole_bytes).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return small.unionByName(files.filter(F.col("length") > whole_bytes).select("path", F.col("length").alias("bytes")).mapInPandas(_hashed, "path string, bytes long, sha256 string"))


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files with their hashes, read in blocks."""
    from .sheet_source import blocks_of

    def digest(path: str, size: int) -> str:
        h = hashlib.sha256()
        for block in blocks_of(path, 0, size):
            h.update(block)
        return h.hexdigest()

    for frame in frames:
        yield frame.assign(sha256=[digest(p, n) for p, n in zip(frame["path"], frame["bytes"], strict=True)])


def record_exports(records: DataFrame) -> dict[str, DataFrame]:
    """Failed records and those for a human, with their issues, in row order."""
    shown = lambda s: records.filter(F.col("status") == s).select("source_row_number", "court_slug", "status", "issues").orderBy("source_row_number")
    return {"failed": shown("failed"), "human_review": shown("needs_human_review")}


def processing_outputs(records: DataFrame, body: list[str]) -> dict[str, DataFrame]:
    """The five tables of a run: payload, failed, human_review, issues and summary."""
    from ..operators import issues as I
    from ..plans.records import summary

    return {"payload": payload(records, body), **record_exports(records), "issues": I.report(records, "source_row_number", "court_slug"), "summary": summary(records)}


def review_sheets(records: DataFrame, verifications: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the review workbook by sheet: records, addresses, contacts, opening hours, issues, and verifications where there are any."""
    from ..operators import issues as I

    each = lambda c: records.select("source_row_number", "court_slug", F.explode(c).alias("x")).select("source_row_number", "court_slug", "x.*")
    out = {
        "Records": records.select("source_row_number", "court_slug", "status", F.size("issues").alias("issues"), F.array_join(F.array_distinct(F.transform("issues", lambda i: i["code"])), ", ").alias("codes")),
        "Addresses": each("addresses"), "Contacts": each("contacts"), "Opening hours": each("opening_hours"), "Issues": I.report(records, "source_row_number", "court_slug"),
    }
    return out if verifications is None else out | {"Address verification": verifications}


def duplicate_sheets(records: DataFrame) -> dict[str, DataFrame]:
    """Tables of the duplicate review: groups numbered by key, and their rows with the one that was chosen. records: source_row_number, court_slug, selection_status, superseded_by."""
    from ..operators.pages import numbered as in_order

    groups = records.filter("court_slug is not null").groupBy("court_slug").agg(F.count("*").alias("rows"), F.max(F.when(F.col("selection_status") == "authoritative", F.col("source_row_number"))).alias("chosen_row")).filter("rows > 1")
    # Groups alone are numbered, not their rows.
    numbered = in_order(groups, [F.asc("court_slug")], "_place").withColumn("group_id", F.format_string("D%03d", "_place"))
    return {"Overview": numbered.select("group_id", "court_slug", "rows", "chosen_row"), "Rows": numbered.select("group_id", "court_slug").join(records, "court_slug")}


def approval_users(users: DataFrame, exclusions: DataFrame) -> dict[str, DataFrame]:
    return {"users": users.join(exclusions, "email", "left_anti"), "excluded": users.join(exclusions, "email", "left_semi")}


def profile_json(profile: DataFrame) -> DataFrame:
    """Each column's profile as one JSON text."""
    return profile.select("column", F.to_json(F.struct("*")).alias("profile"))


def as_markdown(df: DataFrame, order: list) -> DataFrame:
    """Rows of a report as lines of a Markdown table, with their position."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return df.orderBy(*order).select(line.alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def payload(records: DataFrame, body: list[str]) -> DataFrame:
    """Importable records as JSON: a good status and no error; null leaves are left out."""
    good = F.col("status").isin("processed", "processed_with_warnings") & ~F.exists("issues", lambda i: i["severity"] == "error")
    return records.filter(good).select("source_row_number", F.to_json(F.struct(*body)).alias("payload"))
