"""Issue lists and the status lattice over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

ISSUE = "struct<field:string,code:string,severity:string,message:string,raw_value:string,cleaned_value:string>"
NO_ISSUES = f"array<{ISSUE}>"

# Codes that decide a record's status, in order of precedence, and those that validation owns.
FAILED_CODES = ["MISSING_COURT_IDENTIFIER"]
REVIEW_CODES = [
    "COURT_SLUG_NOT_FOUND", "DUPLICATE_COURT_SLUG", "INVALID_POSTCODE", "INVALID_TIME", "VOCAB_NO_MATCH", "OPENING_HOURS_AMBIGUOUS",
    "LLM_NORMALISATION_FAILED", "LLM_LOW_CONFIDENCE", "LLM_REVIEW_REQUIRED", "LLM_RETURNED_INVALID_VOCAB_VALUE", "LLM_RETURNED_INVALID_VALUE", "LLM_RETURNED_UNEXPECTED_FIELD", "LLM_RETURNED_SENSITIVE_VALUE",
]
WARNING_CODES = ["COURT_SLUG_NORMALISED", "COURT_SLUG_AUTO_REPAIRED", "COURT_SLUG_SUGGESTED", "INVALID_EMAIL", "INVALID_PHONE"]
VALIDATION_CODES = [
    "MISSING_COURT_IDENTIFIER", "COURT_SLUG_NORMALISED", "COURT_SLUG_NOT_FOUND", "COURT_SLUG_SUGGESTED", "COURT_SLUG_AUTO_REPAIRED", "DUPLICATE_COURT_SLUG",
    "INVALID_EMAIL", "INVALID_PHONE", "INVALID_POSTCODE", "INVALID_TIME", "VOCAB_NO_MATCH", "OPENING_HOURS_AMBIGUOUS",
]


def issue(field: str | Column, code: str | Column, severity: str | Column, message: str | Column, raw: Column | None = None, cleaned: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    blank = F.lit(None).cast("string")
    parts = {"field": text(field), "code": text(code), "severity": text(severity), "message": text(message), "raw_value": raw if raw is not None else blank, "cleaned_value": cleaned if cleaned is not None else blank}
    return F.struct(*[v.cast("string").alias(k) for k, v in parts.items()])


def rules(*found: tuple[Column, Column]) -> Column:
    """Issue list of (condition, issue) pairs, in order."""
    return F.array_compact(F.array(*[F.when(c, i) for c, i in found])) if found else F.array().cast(NO_ISSUES)


def add_once(old: Column, new: Column) -> Column:
    """old and new issues; of those with the same field, code and raw value the first stays."""
    key = lambda i: F.struct(i["field"], i["code"], i["raw_value"])
    first = lambda both: F.filter(both["every"], lambda i, k: F.array_position(both["keys"], key(i)) == k + 1)
    return let(let(F.concat(old, new), lambda every: F.struct(every.alias("every"), F.transform(every, key).alias("keys"))), first)


def without_codes(issues: Column, codes: list[str] = VALIDATION_CODES) -> Column:
    return F.filter(issues, lambda i: ~i["code"].isin(codes))


def status(issues: Column, code_warnings: bool = True) -> Column:
    """Worst status of a record: failed, needs_human_review, processed_with_warnings or processed."""
    has = lambda test: F.exists(issues, test)
    out = (
        F.when(has(lambda i: i["severity"] == "error") | has(lambda i: i["code"].isin(FAILED_CODES)), "failed")
        .when(has(lambda i: i["code"].isin(REVIEW_CODES)), "needs_human_review")
        .when(has(lambda i: i["severity"] == "warning"), "processed_with_warnings")
    )
    if code_warnings:
        out = out.when(has(lambda i: i["code"].isin(WARNING_CODES)), "processed_with_warnings")
    return out.otherwise("processed")


def report(df: DataFrame, *keys: str, issues: str = "issues") -> DataFrame:
    """One row per issue; records without issues give none."""
    return df.select(*keys, F.explode(issues).alias("i")).select(*keys, "i.*")


def counts_by_code(df: DataFrame, issues: str = "issues") -> DataFrame:
    return df.select(F.explode(issues).alias("i")).groupBy(F.col("i.code").alias("code"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))
