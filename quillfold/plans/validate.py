"""Validation of nested records: issues are derived anew from cleaned values, with full paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import issues as I
from ..operators.selection import chunked
from ..operators import vocabulary

# Vocabularies by field, and the form of a time.
VOCABULARY_FIELDS = {
    "facilities.hearing_enhancement_equipment": "hearing_enhancement_options", "facilities.food_and_drink": "food_and_drink_options", "addresses.address_type": "address_types", "addresses.areas_of_law": "areas_of_law",
    "addresses.court_types": "court_types", "counter_service.assists_with": "counter_service_assistance", "contacts.description": "contact_description_types", "opening_hours.type": "opening_hour_types",
}
TIME = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"
TYPED = {"phone": T.uk_phone, "email": T.email, "postcode": T.uk_postcode}
SAID = {"phone": "phone could not be normalised", "email": "e-mail could not be normalised", "postcode": "postcode could not be normalised"}


def _some(c: Column) -> Column:
    return T.null_if_empty_like(c.cast("string"))


def typed_issues(kind: str, field: Column | str, value: Column) -> Column:
    """Issues of a cleaned value that doesn't pass its own cleaner; blank values have none."""

    def told(seen: Column) -> Column:
        wrong = _some(value).isNotNull() & seen["code"].isNotNull()
        return I.rules((wrong, I.issue(field, seen["code"], "warning", SAID[kind], value.cast("string"), seen["value"].cast("string"))))

    return T.let(TYPED[kind](value), told)


def terms_of(vocabularies: DataFrame | None) -> dict[str, list[str]]:
    """Normalised terms by vocabulary: configuration, whose size is checked and doesn't grow with the records."""
    if vocabularies is None:
        return {}
    t = vocabulary.terms(vocabularies).select("vocabulary", "term").limit(vocabulary.BROADCAST_TERMS + 1).collect()
    if len(t) > vocabulary.BROADCAST_TERMS:
        raise ValueError("vocabularies are too large to be configuration")
    out: dict[str, list[str]] = {}
    for r in t:
        out.setdefault(r["vocabulary"], []).append(r["term"])
    return out


def ids_of(vocabularies: DataFrame | None):
    """A function of (vocabulary, array of values) that gives the ids, in order, and what is wrong with the values; without vocabularies the values themselves."""
    if vocabularies is None:
        return lambda name, values: (values, F.lit(None).cast("string"))
    rows = vocabulary.terms(vocabularies).select("vocabulary", "term", "api_id").limit(vocabulary.BROADCAST_TERMS + 1).collect()
    if len(rows) > vocabulary.BROADCAST_TERMS:
        raise ValueError("vocabularies are too large to be configuration")

    def of(name: str, values: Column) -> tuple[Column, Column]:
        own = [(r["term"], r["api_id"]) for r in rows if r["vocabulary"] == name]
        known = F.create_map(*[F.lit(x) for t, i in own for x in (t, i or "")]) if own else F.create_map().cast("map<string,string>")
        filled = F.filter(values, lambda v: _some(v).isNotNull())
        found = F.transform(filled, lambda v: F.try_element_at(known, T.match_form(v)))
        wrong = F.zip_with(filled, found, lambda v, i: F.when(i.isNull(), F.concat(F.lit("not in vocabulary: "), v)).when(i == "", F.concat(F.lit("no id: "), v)))
        return F.filter(found, lambda i: F.coalesce(i, F.lit("")) != ""), F.array_join(F.array_compact(wrong), "; ")

    return of


def vocabulary_issues(field: Column | str, values: Column, terms: list[str] | None) -> Column:
    """Issues of the filled values that are in no entry; no terms at all (None) check nothing, an absent list knows nothing."""
    if terms is None:
        return F.array().cast(I.NO_ISSUES)
    known = F.array(*[F.lit(t) for t in sorted(terms)]) if terms else F.array().cast("array<string>")
    wrong = F.filter(values, lambda v: _some(v).isNotNull() & ~F.array_contains(known, T.match_form(v)))
    return F.coalesce(F.transform(wrong, lambda v: I.issue(field, "VOCAB_NO_MATCH", "warning", "value is not in the vocabulary", v)), F.array().cast(I.NO_ISSUES))


def time_issues(field: Column, value: Column) -> Column:
    """Issues of one pair of times: an unreadable or textual one is ambiguous, others must look like times."""
    unclear = value["status"].isin("invalid", "invalid_time", "known_text_status")
    bad = lambda end: ~unclear & F.coalesce(~value[end].rlike(TIME), F.lit(False))
    path = lambda end: F.concat(field, F.lit(f".{end}"))
    found = I.rules(
        (F.coalesce(unclear, F.lit(False)), I.issue(field, "OPENING_HOURS_AMBIGUOUS", "warning", "hours need a review", F.to_json(value))),
        *[(F.coalesce(bad(end), F.lit(False)), I.issue(path(end), "INVALID_TIME", "warning", "a time is not HH:MM", value[end])) for end in ("open", "close")],
    )
    return F.when(value.isNull(), F.array().cast(I.NO_ISSUES)).otherwise(found)


def _flat(parts: Column) -> Column:
    return F.coalesce(F.flatten(parts), F.array().cast(I.NO_ISSUES))


def address_issues(a: Column, terms: dict[str, list[str]], checked: bool) -> Column:
    at = lambda name: F.concat(F.lit("addresses["), a["index"].cast("string"), F.lit(f"].{name}"))
    of = lambda f: terms.get(VOCABULARY_FIELDS[f"addresses.{f}"], []) if checked else None
    return F.concat(vocabulary_issues(at("address_type"), F.array(a["address_type"]), of("address_type")), vocabulary_issues(at("areas_of_law"), a["areas_of_law"], of("areas_of_law")), vocabulary_issues(at("court_types"), a["court_types"], of("court_types")), typed_issues("postcode", at("postcode"), a["postcode"]))


def contact_issues(c: Column, terms: dict[str, list[str]], checked: bool) -> Column:
    at = lambda name: F.concat(F.lit("contacts["), c["index"].cast("string"), F.lit(f"].{name}"))
    listed = terms.get(VOCABULARY_FIELDS["contacts.description"], []) if checked else None
    return F.concat(vocabulary_issues(at("description"), F.array(c["description"]), listed), typed_issues("phone", at("phone"), c["phone"]), typed_issues("email", at("email"), c["email"]))


def hours_issues(h: Column, days: list[str], terms: dict[str, list[str]], checked: bool) -> Column:
    at = lambda name: F.concat(F.lit("opening_hours["), h["index"].cast("string"), F.lit(f"].{name}"))
    listed = terms.get(VOCABULARY_FIELDS["opening_hours.type"], []) if checked else None
    return F.concat(vocabulary_issues(at("type"), F.array(h["type"]), listed), *[time_issues(at(d), h[d]) for d in days])


def key_issues(slug: str = "court_slug", raw: str = "court_slug_raw") -> Column:
    s, r = F.col(slug), F.col(raw)
    return I.rules(
        (_some(s).isNull(), I.issue(slug, "MISSING_COURT_IDENTIFIER", "error", "there is no key", r)),
        (_some(s).isNotNull() & r.isNotNull() & (s != r), I.issue(slug, "COURT_SLUG_NORMALISED", "info", "the key was normalised", r, s)),
    )


def revalidated(records: DataFrame, vocabularies: DataFrame | None, days: list[str]) -> DataFrame:
    """records with issues and status derived anew; issues of other owners stay, and each field, code and value is told once."""
    terms, checked = terms_of(vocabularies), vocabularies is not None
    f, counter = F.col("facilities"), F.col("counter_service")
    listed = lambda name: terms.get(VOCABULARY_FIELDS[name], []) if checked else None
    new = F.concat(
        key_issues(),
        typed_issues("phone", "facilities.accessible_parking_phone", f["accessible_parking_phone"]), typed_issues("phone", "facilities.accessible_entrance_support_phone", f["accessible_entrance_support_phone"]),
        vocabulary_issues("facilities.hearing_enhancement_equipment", F.array(f["hearing_enhancement_equipment"]), listed("facilities.hearing_enhancement_equipment")), vocabulary_issues("facilities.food_and_drink", f["food_and_drink"], listed("facilities.food_and_drink")),
        typed_issues("phone", "translation_phone", F.col("translation_phone")), typed_issues("email", "translation_email", F.col("translation_email")),
        _flat(F.transform("addresses", lambda a: address_issues(a, terms, checked))),
        vocabulary_issues("counter_service.assists_with", counter["assists_with"], listed("counter_service.assists_with")), *[time_issues(F.lit(f"counter_service.{d}"), counter[d]) for d in days],
        _flat(F.transform("contacts", lambda c: contact_issues(c, terms, checked))),
        _flat(F.transform("opening_hours", lambda h: hours_issues(h, days, terms, checked))),
    )
    kept = records.withColumn("issues", I.add_once(I.without_codes(F.col("issues")), new))
    return kept.withColumn("status", I.status(F.col("issues")))


def with_duplicate_issues(records: DataFrame, key: str = "court_slug", row: str = "source_row_number") -> DataFrame:
    """records with a DUPLICATE_COURT_SLUG issue where several share a key, told once, with all rows of the group in order and their number.

    A group's text is made once and joined to its members. Told to each of them, it grows
    with the square of the group; the same rows in chunks are ``duplicate_rows``.
    """
    known = records.filter(F.col(key).isNotNull())
    groups = known.groupBy(key).agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(row)).alias("source_row_numbers")).filter("rows > 1")
    told = groups.select(key, F.to_json(F.struct("source_row_numbers", "rows")).alias("_told"))
    got = records.join(told, key, "left")
    new = I.rules((F.col("_told").isNotNull() & ~F.exists("issues", lambda i: i["code"] == "DUPLICATE_COURT_SLUG"), I.issue(key, "DUPLICATE_COURT_SLUG", "warning", "several records have this key", F.col(key), F.col("_told"))))
    return got.withColumn("issues", F.concat("issues", new)).drop("_told")


def duplicate_rows(records: DataFrame, key: str = "court_slug", row: str = "source_row_number", per_chunk: int = 1000) -> DataFrame:
    """key, chunk and values: all rows of every group of several records, in order."""
    known = records.filter(F.col(key).isNotNull()).select(key, row)
    many = known.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    return chunked(known.join(many, key, "left_semi"), [key], row, [F.col(row)], per_chunk)


def ingest_status(issues: Column) -> Column:
    """Status by severity alone, before validation."""
    has = lambda s: F.exists(issues, lambda i: i["severity"] == s)
    return F.when(has("error"), "failed").when(has("warning"), "processed_with_warnings").otherwise("processed")


def ingest_summary(records: DataFrame) -> DataFrame:
    """Rows read, by status, and their issues by severity."""
    n = lambda s: F.coalesce(F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s))), F.lit(0)).alias(f"{s}_issues")
    return records.agg(F.count("*").alias("rows"), *[F.count_if(ingest_status(F.col("issues")) == s).alias(s) for s in ("processed", "processed_with_warnings", "failed")], *[n(s) for s in ("info", "warning", "error")])


def users(records: DataFrame, email: Column, name: Column, row: str, per_chunk: int = 1000) -> DataFrame:
    """email, the first name given, the number of rows and all of them, in chunks of rows, of everybody who submitted; blank e-mails are nobody."""
    each = records.select(F.lower(F.trim(email)).alias("email"), T.null_if_empty_like(name).alias("name"), F.col(row).alias("row")).filter("email <> ''")
    got = each.groupBy("email").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("row"))).alias("name"), F.count_distinct("row").alias("rows"))
    lists = chunked(each.select("email", "row").distinct(), ["email"], "row", [F.col("row")], per_chunk)
    return got.join(lists, "email").withColumnRenamed("values", "source_rows")
