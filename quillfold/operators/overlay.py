"""A plan derived anew over the plan that was archived: stable ids, protected sections, retained records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stable_ids(derived: DataFrame, original: DataFrame, keys: list[str], id_col: str = "action_id") -> DataFrame:
    """derived with the original id wherever the original has exactly one action of the keys; others keep their own."""
    once = original.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(id_col).alias("_id")).filter("_n = 1").drop("_n")
    return derived.join(once, keys, "left").withColumn(id_col, F.coalesce("_id", id_col)).drop("_id")


def protected(derived: DataFrame, original: DataFrame, succeeded: DataFrame, section: list[str], id_col: str = "action_id") -> DataFrame:
    """Sections with an action that succeeded stay as the original has them; all others are derived."""
    done = original.join(succeeded.select(id_col).distinct(), id_col, "left_semi").select(*section).distinct()
    return derived.join(done, section, "left_anti").unionByName(original.join(done, section, "left_semi"), allowMissingColumns=True)


def retained(derived: DataFrame, original: DataFrame, record: str, rows: str) -> DataFrame:
    """Derived records, and the original ones none of whose source rows was derived again."""
    again = derived.select(F.explode(rows).alias("_r")).distinct()
    met = original.select(record, F.explode_outer(rows).alias("_r")).join(again, "_r", "left_semi").select(record).distinct()
    return derived.withColumn("retained", F.lit(False)).unionByName(original.join(met, record, "left_anti").withColumn("retained", F.lit(True)), allowMissingColumns=True)


def stitched(original: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """original with the chosen version of a row in place of its own, where there is one."""
    fields = [c for c in original.columns if c != key]
    new = chosen.select(key, F.struct(*fields).alias("_new"))
    both = original.join(new, key, "left")
    return both.select(key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def target_conflicts(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """wanted (row, target) with taken: another row has the target already."""
    others = records.select("row", F.col("slug").alias("target")).filter("target is not null").distinct()
    counts = others.groupBy("target").agg(F.count("*").alias("_n"))
    own = others.withColumn("_own", F.lit(1))
    got = wanted.join(counts, "target", "left").join(own, ["row", "target"], "left")
    return got.withColumn("taken", F.coalesce(F.col("_n"), F.lit(0)) - F.coalesce("_own", F.lit(0)) > 0).drop("_n", "_own")


def vocabulary_from_ids(records: DataFrame, names: str, ids: str, order: str) -> DataFrame:
    """name, api_id as archived records pair them up; of different ids of a name the last record's counts."""
    pairs = records.select(order, F.posexplode(F.arrays_zip(F.col(names).alias("name"), F.col(ids).alias("api_id"))).alias("_p", "z")).filter("z.name is not null and z.api_id is not null")
    return pairs.groupBy(F.col("z.name").alias("name")).agg(F.max_by("z.api_id", F.struct(order, "_p")).alias("api_id"))


def newest_record(records: DataFrame, key: str, row: str) -> DataFrame:
    """The record of the greatest source row of each key."""
    rest = [c for c in records.columns if c not in (key, row)]
    return records.groupBy(key).agg(F.max_by(F.struct(row, *rest), F.struct(row, *rest)).alias("_r")).select(key, "_r.*")
