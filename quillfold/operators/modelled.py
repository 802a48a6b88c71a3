"""Fields for a model and what is accepted of its answers.

Candidates: row, rule, field, value (array of text; one entry for a plain field).
Answers: row, field, operation, value (array of text), confidence, needs_review.
Nothing is sent from here: answers are a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import vocabulary

# Rules that have a vocabulary, and parts of rule names that keep a field away from the model.
VOCABULARY_OF = {
    "facilities.hearing_enhancement_equipment": "hearing_enhancement_options", "facilities.food_and_drink": "food_and_drink_options", "address.address_type": "address_types", "address.areas_of_law": "areas_of_law",
    "address.court_types": "court_types", "counter_service.assists_with": "counter_service_assistance", "contact.description": "contact_description_types", "opening_hours.type": "opening_hour_types",
}
KEPT_AWAY = ["email", "phone", "postcode", "slug", "same_monday_to_friday", "time"]


def sensitive(c: Column) -> Column:
    """Whether a text holds an e-mail address or is a phone number or a postcode as a whole."""
    postcode = T.uk_postcode(c)
    phone = T.uk_phone(c)
    return F.coalesce(c.rlike(r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"), F.lit(False)) | F.coalesce(phone["code"].isNull() & phone["value"].isNotNull(), F.lit(False)) | F.coalesce(postcode["code"].isNull() & postcode["value"].isNotNull(), F.lit(False))


def _filled(values: Column) -> Column:
    return F.filter(values, lambda v: F.trim(v) != "")


def vocabulary_of(rule: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in VOCABULARY_OF.items() for x in pair]), rule)


def in_vocabulary(df: DataFrame, terms: DataFrame) -> DataFrame:
    """df (row, field, rule, value) with known: every filled entry of the value is in the rule's vocabulary, each matched once."""
    each = df.select("row", "field", vocabulary_of(F.col("rule")).alias("vocabulary"), F.explode(_filled(F.col("value"))).alias("_v")).withColumn("term", T.match_form(F.col("_v")))
    bad = each.join(terms.select("vocabulary", "term"), ["vocabulary", "term"], "left_anti").select("row", "field").distinct().withColumn("_bad", F.lit(True))
    return df.join(bad, ["row", "field"], "left").withColumn("known", F.col("_bad").isNull()).drop("_bad")


def select_fields(candidates: DataFrame, rules: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """Candidates that may go to the model: an enabled rule, not kept away by name, filled, nothing sensitive, and, where a vocabulary decides, not in it.

    rules: rule, enabled, use_only_when.
    """
    away = F.lit(False)
    for part in KEPT_AWAY:
        away = away | F.col("rule").contains(part)
    enabled = rules.filter("enabled")
    # The size is checked: the limit stops counting just beyond what may be broadcast.
    if enabled.limit(vocabulary.BROADCAST_TERMS + 1).count() <= vocabulary.BROADCAST_TERMS:
        enabled = F.broadcast(enabled)
    some = candidates.join(enabled, "rule").filter(~away & (F.size(_filled(F.col("value"))) > 0) & ~F.exists("value", sensitive))
    known = in_vocabulary(some, vocabulary.terms(vocabularies))
    listed = vocabulary_of(F.col("rule"))
    by_list = F.coalesce(F.col("use_only_when") == "not_exact_vocab_match", F.lit(False)) | listed.isNotNull()
    return known.filter(~by_list | (listed.isNotNull() & ~F.col("known"))).select(*candidates.columns)


def accept(answers: DataFrame, selected: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """answers with outcome, accepted_value (canonical names where a vocabulary decides) and the issue codes they raise.

    Outcomes: unexpected_field, no_value, rejected, accepted. An answer on a field
    that was not asked for, a clear outside of contact explanations, a value that is
    sensitive or in no vocabulary, and a set without a value are never applied.
    """
    asked = selected.select("row", "field", "rule", F.lit(True).alias("_asked"))
    got = answers.join(asked, ["row", "field"], "left").withColumn("_listed", vocabulary_of(F.col("rule")))
    terms = vocabulary.terms(vocabularies).select(F.col("vocabulary").alias("_listed"), "term", F.col("name").alias("_name"))
    each = got.filter("_listed is not null").select("row", "field", "_listed", F.posexplode("value").alias("_p", "_v")).withColumn("term", T.match_form(F.col("_v"))).join(terms, ["_listed", "term"], "left")
    named = each.groupBy("row", "field").agg(F.bool_and(F.col("_name").isNotNull()).alias("_all"), F.transform(F.array_sort(F.collect_list(F.struct("_p", "_name"))), lambda x: x["_name"]).alias("_names"))
    both = got.join(named, ["row", "field"], "left")
    filled = F.coalesce(F.size(F.col("value")) > 0, F.lit(False))
    leak = F.coalesce(F.exists("value", sensitive), F.lit(False))
    clearable = F.col("field").rlike(r"^contacts\[[0-9]+\]\.explanation$")
    flagged = F.coalesce("needs_review", F.lit(False))
    op = F.col("operation")
    unlisted = F.col("_listed").isNotNull() & ~F.coalesce("_all", F.lit(False))
    wrong = F.when((op == "unresolved") & filled, "LLM_RETURNED_INVALID_VALUE").when((op == "clear") & (~clearable | filled | flagged), "LLM_RETURNED_INVALID_VALUE").when((op == "set") & ~filled, "LLM_RETURNED_INVALID_VALUE").when((op == "set") & leak, "LLM_RETURNED_SENSITIVE_VALUE").when((op == "set") & unlisted, "LLM_RETURNED_INVALID_VOCAB_VALUE").when(~op.isin("set", "clear", "unresolved"), "LLM_RETURNED_INVALID_VALUE")
    judged = both.withColumn("_wrong", F.when(F.col("_asked").isNull(), "LLM_RETURNED_UNEXPECTED_FIELD").otherwise(wrong))
    outcome = F.when(F.col("_asked").isNull(), "unexpected_field").when(F.col("_wrong").isNotNull(), "rejected").when(op == "unresolved", "no_value").otherwise("accepted")
    fine = F.col("_wrong").isNull()
    codes = F.array_compact(F.array(
        F.col("_wrong"), F.when(fine & op.isin("set", "clear"), "LLM_FIELD_NORMALISED"),
        F.when(fine & (op == "set") & F.col("confidence").isin("medium", "low"), "LLM_LOW_CONFIDENCE"), F.when(fine & op.isin("set", "unresolved") & flagged, "LLM_REVIEW_REQUIRED"),
    ))
    value = F.when(fine & (op == "set"), F.when(F.col("_listed").isNotNull(), F.array_distinct("_names")).otherwise(F.col("value")))
    return judged.select(*answers.columns, outcome.alias("outcome"), value.alias("accepted_value"), codes.alias("codes"))


def allowed_values(selected: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """Names that each selected field may take, in list order. Lists are configuration: their size doesn't grow with the rows."""
    lists = vocabularies.groupBy(F.col("vocabulary").alias("_listed")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("allowed"))
    return selected.withColumn("_listed", vocabulary_of(F.col("rule"))).join(lists, "_listed").select("row", "field", "allowed")


def usage(calls: DataFrame) -> DataFrame:
    """Calls, retries, failures and tokens of a model stage. calls: attempts, parsed, input_tokens, output_tokens."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).alias("retries"), F.count_if(~F.col("parsed")).alias("failed"), n("input_tokens"), n("output_tokens"))
