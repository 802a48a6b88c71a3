"""Ordered vocabularies: first entry with a matching code, name or alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_form

#: Vocabularies above this many terms are joined by a shuffle.
BROADCAST_TERMS = 100_000


def terms(vocabulary: DataFrame) -> DataFrame:
    """vocabulary, term, code, name, api_id: each term once per vocabulary, for the entry that comes first.

    vocabulary: columns vocabulary, position, code, name, api_id, aliases.
    """
    each = vocabulary.select("vocabulary", "position", "code", "name", "api_id", F.explode(F.concat(F.array("code", "name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t"))
    entry = F.struct("position", "code", "name", "api_id")
    best = each.select("vocabulary", match_form(F.col("t")).alias("term"), entry.alias("e")).filter("term is not null").groupBy("vocabulary", "term").agg(F.min("e").alias("e"))
    return best.select("vocabulary", "term", "e.code", "e.name", "e.api_id")


def match(df: DataFrame, value: Column, vocabulary: DataFrame, name: str) -> DataFrame:
    """df with code, name and api_id of the value's entry, null where none matches; blank values match nothing."""
    t = terms(vocabulary).filter(F.col("vocabulary") == name).select(F.col("term").alias("_term"), "code", "name", "api_id")
    # The size is checked: the limit stops counting just beyond what may be broadcast.
    if t.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        t = F.broadcast(t)
    return df.withColumn("_form", match_form(value)).join(t, F.col("_form") == F.col("_term"), "left").drop("_form", "_term")


def unmatched(df: DataFrame, value: Column, vocabulary: DataFrame, name: str) -> DataFrame:
    """Rows with a value that is in no entry."""
    return match(df, value, vocabulary, name).filter(F.col("code").isNull() & match_form(value).isNotNull())


def ids_of(df: DataFrame, key: str, values: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """key, ids in order, and a reason where a value is unknown or has no id."""
    each = df.select(key, F.posexplode(values).alias("pos", "value"))
    found = match(each, F.col("value"), vocabulary, name)
    reason = F.when(F.col("code").isNull(), F.concat(F.lit("not in vocabulary: "), "value")).when(F.col("api_id").isNull(), F.concat(F.lit("no id: "), "value"))
    folded = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "api_id"))).alias("f"), F.min_by(reason, F.when(reason.isNotNull(), F.col("pos"))).alias("reason"))
    return folded.select(key, F.transform("f", lambda x: x["api_id"]).alias("ids"), "reason")
