"""Small configuration sources: vocabularies, exclusions, archives, state shards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "vocabulary string, position int, code string, name string, api_id string, aliases array<string>"


def vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """The lists of a JSON file, with or without a wrapper; blank codes or names and empty lists are errors."""
    text = spark.read.text(path, wholetext=True).first()
    body = json.loads(text[0]) if text else {}
    lists = body.get("vocabularies", {k: v for k, v in body.items() if isinstance(v, list)})
    rows = []
    for name, entries in lists.items():
        if not entries:
            raise ValueError(f"vocabulary {name} is empty")
        for k, e in enumerate(entries):
            if not str(e.get("code") or "").strip() or not str(e.get("name") or "").strip():
                raise ValueError(f"vocabulary {name} has a blank entry at {k}")
            rows.append((name, k, e["code"], e["name"], e.get("api_id"), list(e.get("aliases") or [])))
    return spark.createDataFrame(rows, VOCABULARY)


def owned_lists(items: DataFrame) -> DataFrame:
    """Entries of lists that a service owns, with a code made of the name. items: vocabulary, position, id, name."""
    code = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "[^a-z0-9]+", "_"), "^_|_$", "")
    return items.filter(F.coalesce(F.trim("name"), F.lit("")) != "").select("vocabulary", "position", code.alias("code"), F.trim("name").alias("name"), F.col("id").cast("string").alias("api_id"), F.array().cast("array<string>").alias("aliases"))


def over_fallback(fallback: DataFrame, owned: DataFrame) -> DataFrame:
    """Whole lists of the owner replace those of the fallback by name."""
    return fallback.join(owned.select("vocabulary").distinct(), "vocabulary", "left_anti").unionByName(owned)


def run_archives(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of finished runs, newest first; a manifest that names another run than its folder doesn't count."""
    found = spark.read.option("multiLine", True).schema("run_id string, completed_at string, source_name string").json(f"{root}/*/run_manifest.json")
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return found.withColumn("folder", folder).filter(F.col("run_id") == F.col("folder")).drop("folder").orderBy(F.desc("completed_at"), "run_id")


def state_with_shards(base: DataFrame, shards: DataFrame, keys: list[str]) -> DataFrame:
    """Merge on read: of the consolidated state and the shards, the one saved last; a shard wins a tie."""
    both = base.withColumn("_shard", F.lit(0)).unionByName(shards.withColumn("_shard", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("saved_at", "_shard")).alias("s")).select(*keys, "s.*")


def tolerant_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several copies of a state file that parses as a whole, else the longest leading object of one that is cut or followed by rubbish; nothing if all are broken.

    State files are small: each is read as one text.
    """
    texts = []
    for p in paths:
        try:
            first = spark.read.text(p, wholetext=True).first()
        except Exception as e:  # noqa: BLE001  a copy that is missing is passed over like a broken one
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        texts.append(first[0] if first else "")
    found = next((t for t in texts if _leading_json(t, True) is not None), None)
    if found is None:
        found = next((json.dumps(v) for t in texts if (v := _leading_json(t, False)) is not None), None)
    if found is None:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(found,)], "t string").select(F.from_json("t", schema).alias("s")).select("s.*")


def _leading_json(text: str, whole: bool) -> object | None:
    """The JSON value that a text is, or begins with."""
    try:
        value, end = json.JSONDecoder().raw_decode(text.lstrip("\ufeff \n\t"))
    except json.JSONDecodeError:
        return None
    return None if whole and text.lstrip("\ufeff \n\t")[end:].strip() else value


RULES = "rule string, enabled boolean, purpose string, use_only_when string, rules array<string>"


def field_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules by field name; only what concerns the model decides anything. A rule that isn't an object, or enables the model without a purpose, is an error."""
    first = spark.read.text(path, wholetext=True).first()
    body = json.loads(first[0]) if first else {}
    rows = []
    for name, rule in body.get("fields", body).items():
        if not isinstance(rule, dict):
            if "fields" in body:
                raise ValueError(f"rule {name} is not an object")
            continue
        m = rule.get("llm") or {}
        if m.get("enabled") and not str(m.get("purpose") or "").strip():
            raise ValueError(f"rule {name} has no purpose")
        rows.append((name, bool(m.get("enabled", False)), m.get("purpose"), m.get("use_only_when"), list(m.get("rules") or [])))
    return spark.createDataFrame(rows, RULES)


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """E-mail addresses to leave out, one a line or as a JSON list; a missing file excludes nobody."""
    try:
        lines = spark.read.text(path)
    except Exception as e:  # noqa: BLE001  only a missing file is no error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "email string")
    word = F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"[^\s\[\]\{\}\",:]+@[^\s\[\]\{\}\",:]+"), 0))
    return lines.filter(~F.col("value").startswith("#")).select(word.alias("email")).distinct()


def run_archive(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The manifest of one run; an error if there is none."""
    got = run_archives(spark, root).filter(F.col("run_id") == run_id)
    if got.isEmpty():
        raise KeyError(run_id)
    return got


def type_options(vocabularies: DataFrame, name: str) -> DataFrame:
    """Entries of a list that have an id, in order."""
    return vocabularies.filter((F.col("vocabulary") == name) & (F.coalesce(F.trim("api_id"), F.lit("")) != "")).select("position", "api_id", "name").orderBy("position")
