"""The best known name for one that isn't known: query variants, similarity, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.issues import issue, rules
from .matching import letter_counts, ratio_bounds, sequence_ratio

# Words that don't tell one name from another, variants asked, the least length of a variant, and the confidence of a repair.
COMMON_WORDS = "county family crown magistrates court courts law civil justice centre tribunal combined social security child support employment appeal england wales and of the chamber".split()
VARIANTS, LEAST, REPAIR = 6, 3, 0.95


def variants(slug: Column, raw: Column) -> Column:
    """What to ask for: each of both values made readable, without a short prefix, and without common words; in order, each once."""

    def of(value: Column) -> list[Column]:
        plain = T.humanise(value)
        short = F.regexp_replace(plain, r"(?i)^[a-z]{2}\s+([a-z].*)$", "$1")
        place = F.trim(F.regexp_replace(F.regexp_replace(plain, rf"(?i)\b({'|'.join(COMMON_WORDS)})\b", " "), r"\s+", " "))
        return [plain, short, place]

    every = F.array_distinct(F.filter(F.array(*of(slug), *of(raw)), lambda v: F.length(v) >= LEAST))
    return F.slice(every, 1, VARIANTS)


def scored_names(asked: DataFrame, known: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, score of every asked name and every known one that shares two neighbouring letters with it; others can't be alike. An equi-join in place of all pairs."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda k: F.substring(c, k, F.lit(2))))
    met = asked.select(left, F.explode(grams(F.col(left))).alias("_g")).join(known.select(right, F.explode(grams(F.col(right))).alias("_g")), "_g").select(left, right).distinct()
    return met.withColumn("score", sequence_ratio(left, right))


def likeliest_names(asked: DataFrame, known: DataFrame, left: str, right: str) -> DataFrame:
    """As scored_names, but of each asked name only pairs that may be its best: those whose greatest possible score reaches the best of the least ones. Texts are compared for them alone."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda k: F.substring(c, k, F.lit(2))))
    a = asked.select(left, letter_counts(F.col(left)).alias("_ca"), F.explode(grams(F.col(left))).alias("_g"))
    b = known.select(right, letter_counts(F.col(right)).alias("_cb"), F.explode(grams(F.col(right))).alias("_g"))
    low, high = ratio_bounds(F.col(left), F.col(right), F.col("_ca"), F.col("_cb"))
    met = a.join(b, "_g").groupBy(left, right).agg(F.first("_ca").alias("_ca"), F.first("_cb").alias("_cb")).select(left, right, low.alias("_low"), high.alias("_high"))
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), left)
    kept = met.withColumn("_floor", F.max("_low").over(W.partitionBy(left))).filter("_high >= _floor").select(left, right)
    return kept.withColumn("score", sequence_ratio(left, right))


def best_names(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, suggested slug and name, confidence and query of the best known entry of each asked one.

    asked: key, slug, raw; known: slug, name. Distinct variants are scored once, however many rows ask for them.
    """
    each = asked.select(key, F.explode(variants(F.col("slug"), F.col("raw"))).alias("query"))
    queries = each.select("query").distinct().withColumn("_q", T.slugify(F.col("query")))
    names = known.select("slug", "name", F.explode(F.array(T.slugify(F.col("slug")), T.slugify(F.col("name")))).alias("_n")).distinct()
    met = likeliest_names(queries.select("_q").distinct(), names.select("_n").distinct(), "_q", "_n")
    scored = queries.join(met, "_q").join(names, "_n").groupBy("query", "slug", "name").agg(F.max("score").alias("confidence"))
    top = scored.groupBy("query").agg(F.max_by(F.struct("slug", "name", "confidence"), F.struct("confidence", "slug")).alias("s"))
    return each.join(top, "query").groupBy(key).agg(F.max_by(F.struct("s.*", "query"), F.struct("s.confidence", "query")).alias("b")).select(key, F.col("b.slug").alias("suggested_slug"), F.col("b.name").alias("suggested_name"), "b.confidence", "b.query")


def repaired(records: DataFrame, suggestions: DataFrame, key: str) -> DataFrame:
    """records (key, court_slug, found, issues): a sure suggestion replaces an unknown slug, a lesser one is told beside the missing slug."""
    got = records.join(suggestions, key, "left")
    missing = F.col("court_slug").isNotNull() & ~F.col("found")
    sure = missing & F.coalesce(F.col("confidence") >= REPAIR, F.lit(False))
    told = lambda c: F.to_json(F.struct("suggested_slug", "suggested_name", "confidence")) if c else F.col("court_slug")
    new = rules(
        (sure, issue("court_slug", "COURT_SLUG_AUTO_REPAIRED", "warning", "the slug was repaired by a sure match", F.col("court_slug"), told(True))),
        (missing & ~sure & F.col("suggested_slug").isNotNull(), issue("court_slug", "COURT_SLUG_SUGGESTED", "warning", "a similar slug is known", F.col("court_slug"), told(True))),
        (missing & ~sure, issue("court_slug", "COURT_SLUG_NOT_FOUND", "warning", "no such court", F.col("court_slug"), told(False))),
    )
    return got.withColumn("issues", F.concat("issues", new)).withColumn("court_slug", F.when(sure, F.col("suggested_slug")).otherwise(F.col("court_slug"))).drop("suggested_slug", "suggested_name", "confidence", "query")
