"""The sheet's layout as configuration, and how the headers of a sheet drift from it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sheets import column_index
from .layout import LAYOUT
from .mapping import fields_of

MAPPING = "column string, section string, field string, expected_header string"


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """Column letters with section, field and expected header from a JSON file of nested objects: an object with a column is a field, others are sections."""
    first = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(fields_of(json.loads(first[0]) if first else {}), MAPPING)


def duplicate_columns(expected: DataFrame) -> DataFrame:
    """Warnings for columns that several fields claim."""
    got = expected.groupBy("column").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("fields")).filter("n > 1")
    return got.select(F.lit("duplicate_mapping_column").alias("code"), "column", "fields")


# Sections of a mapping file that the layout names otherwise.
SECTIONS = {"scalars": "scalar", "address_groups": "address", "contact_detail_groups": "contact", "opening_hours_groups": "opening_hours"}


def arranged(sheet: DataFrame, body: object) -> DataFrame:
    """A sheet whose cells stand where a mapping says, with every cell moved to where the layout has it.

    A field that the mapping doesn't name is null, a mapped field that the layout doesn't know is left out,
    of several columns for one field the first counts.
    """
    at: dict[tuple[str, int, str], int] = {}
    for column, path, field, _ in fields_of(body):
        section, *rest = path.split(".")
        index = next((int(x) for x in rest if x.isdigit()), 0)
        at.setdefault((SECTIONS.get(section, section), index, field), column_index(column))
    places = [at.get((f.section, f.index, f.name), -1) for f in LAYOUT]
    cells = F.transform(F.array(*[F.lit(p) for p in places]), lambda p: F.when(p >= 0, F.get("cells", p)))
    return sheet.withColumn("cells", cells)


def plain(c: Column) -> Column:
    """A header in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit(" "), F.lit(" "))), r"\s+", " "))


def broadly_alike(actual: Column, expected: Column) -> Column:
    """Whether a header is the expected one, but for numbers and remarks that form tools append."""
    a, e = plain(actual), plain(expected)
    bare = lambda x: F.trim(F.regexp_replace(x, r"(?<![0-9])[0-9]+$", ""))
    rest = F.trim(F.substr(a, F.length(e) + 1))
    more = (rest == "") | rest.rlike(r"^[0-9]+$") | rest.rlike(r"^(\(|\.|for example|if so)")
    return F.when(a.startswith(e), more).otherwise((a == bare(e)) | (bare(a) == e))


def drift(headers: DataFrame, expected: DataFrame) -> DataFrame:
    """code, column, expected and actual header of every column that is missing, differs or isn't expected. headers: column, actual_header."""
    got = expected.select("column", "expected_header", F.lit(True).alias("_e")).join(headers.select(F.upper("column").alias("column"), "actual_header", F.lit(True).alias("_h")), "column", "full_outer")
    differs = F.col("expected_header").isNotNull() & (F.col("expected_header") != "") & ~F.coalesce(broadly_alike(F.coalesce("actual_header", F.lit("")), F.col("expected_header")), F.lit(False))
    code = F.when(F.col("_e").isNull(), "unexpected_column").when(F.col("_h").isNull() | F.col("actual_header").isNull(), "missing_column").when(differs, "header_mismatch")
    return got.withColumn("code", code).filter("code is not null").select("code", "column", "expected_header", "actual_header")
