"""What a reviewer is shown of a record: raw cells, readable sections, keys, messages, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .issues import REVIEW_CODES

# Categories by root of the field path, codes that only inform, and codes that the source must correct.
CATEGORIES = {"court_slug": "court_identity_duplicates", "addresses": "addresses", "contacts": "contacts", "facilities": "facilities_accessibility", "counter_service": "counter_service", "opening_hours": "opening_hours"}
INFORMATION_CODES = ["LLM_FIELD_NORMALISED", "LLM_MODEL_NOTE", "LLM_RESPONSE_REVIEW_ADVISORY"]
SOURCE_CODES = ["COURT_SLUG_NOT_FOUND", "COURT_SLUG_SUGGESTED", "MISSING_COURT_IDENTIFIER", "INVALID_POSTCODE", "INVALID_TIME", "OPENING_HOURS_AMBIGUOUS", "VOCAB_NO_MATCH", "ADDRESS_OS_REVIEW_REQUIRED", "ADDRESS_OS_LOOKUP_UNAVAILABLE"]
MOST_MESSAGES, MOST_CHARACTERS = 3, 300


def court_key(slug: Column, row: Column) -> Column:
    """The slug, or a key made of the source row where there is none."""
    return F.coalesce(F.nullif(F.trim(slug), F.lit("")), F.concat(F.lit("source-row-"), row.cast("string")))


def item_id(row: Column, resource: Column, fields: Column) -> Column:
    """The id of a proposed item: its row, resource and source fields, in letters, digits and dashes."""
    source = F.coalesce(F.nullif(F.array_join(F.array_sort(fields), ","), F.lit("")), resource)
    return F.concat(F.lit("row-"), row.cast("string"), F.lit("-"), resource, F.lit("-"), F.regexp_replace(F.regexp_replace(F.lower(source), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def category(field: Column, code: Column) -> Column:
    root = F.substring_index(F.substring_index(F.coalesce(field, F.lit("")), "[", 1), ".", 1)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]), root)
    return F.when(F.coalesce(code.contains("DUPLICATE") | (code == "COURT_SLUG_NOT_FOUND"), F.lit(False)), "court_identity_duplicates").otherwise(F.coalesce(known, F.lit("other")))


def needs_correction(code: Column, severity: Column) -> Column:
    """Whether an issue asks for a change at the source."""
    return ~code.isin(INFORMATION_CODES) & (code.isin(SOURCE_CODES) | code.isin(REVIEW_CODES) | (severity == "error"))


def guidance(code: Column, severity: Column, pending: Column, complete: Column) -> Column:
    """What an issue asks of a reviewer: review while an item of it waits, complete when all are decided, source, or information."""
    unresolved = code.startswith("LLM_") & ~code.isin(INFORMATION_CODES)
    return F.when(pending, "review").when(complete, "complete").when(code.isin(SOURCE_CODES) | unresolved | (severity == "error") | code.isin(REVIEW_CODES), "source").otherwise("information")


def has_category(issues: Column, wanted: str) -> Column:
    """Whether an issue that holds a record up belongs to a category."""
    return F.exists(issues, lambda i: (category(i["field"], i["code"]) == wanted) & (i["code"].isin(REVIEW_CODES) | (i["severity"] == "error")))


def explanations(issues: Column, texts: dict[str, str]) -> Column:
    """A sentence for each code that occurs, in order of codes, with the values concerned."""
    said = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]) if texts else F.create_map().cast("map<string,string>")
    codes = F.array_sort(F.array_distinct(F.transform(issues, lambda i: i["code"])))

    def one(c: Column) -> Column:
        own = F.filter(issues, lambda i: i["code"] == c)
        values = F.array_join(F.transform(F.filter(own, lambda i: i["raw_value"].isNotNull()), lambda i: F.concat(i["field"], F.lit(" '"), i["raw_value"], F.lit("'"))), "; ")
        return F.concat(c, F.lit(": "), F.coalesce(F.try_element_at(said, c), F.lit("no explanation is given for this code")), F.when(values != "", F.concat(F.lit(": "), values)).otherwise(""))

    return F.when(F.size(codes) == 0, "no issues").otherwise(F.array_join(F.transform(codes, one), ". "))


def raw_cells(raw: Column, columns: DataFrame | dict[str, list[str]], fields: Column) -> Column:
    """Raw cells behind field paths: raw is a map from column letters to text, columns a small map from fields to letters."""
    letters = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    wanted = F.array_distinct(F.flatten(F.transform(fields, lambda f: F.coalesce(F.try_element_at(letters, f), F.array().cast("array<string>")))))
    return F.map_filter(raw, lambda k, v: F.array_contains(wanted, k) & v.isNotNull())


def labelled(pairs: list[tuple[str, Column]]) -> Column:
    """Lines of label and value, for the values that are there."""
    return F.concat_ws("\n", *[F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in pairs])


def listed_items(items: Column, line) -> Column:
    """One line for each item of an array."""
    return F.array_join(F.filter(F.transform(items, line), lambda x: x != ""), "\n")


def response_messages(body: Column) -> Column:
    """At most three short messages of a JSON error body: its message, then its errors by field, as text or as objects."""
    cut = lambda c: F.substring(F.trim(c), 1, MOST_CHARACTERS)
    head = F.get_json_object(body, "$.message")
    by_field = F.from_json(F.get_json_object(body, "$.errors"), "map<string,string>")
    objects = F.from_json(F.get_json_object(body, "$.errors"), "array<struct<field:string,path:string,message:string>>")
    is_list = F.coalesce(F.ltrim(F.get_json_object(body, "$.errors")).startswith("["), F.lit(False))
    none = F.array().cast("array<string>")
    from_map = F.transform(F.map_entries(by_field), lambda e: F.when(F.trim(e["value"]) != "", F.concat(e["key"], F.lit(": "), cut(e["value"]))))
    from_list = F.transform(objects, lambda o: F.when(F.trim(o["message"]) != "", F.concat(F.coalesce(o["field"], o["path"], F.lit("error")), F.lit(": "), cut(o["message"]))))
    first = F.array(F.when(F.coalesce(F.trim(head), F.lit("")) != "", cut(head)))
    every = F.concat(first, F.when(is_list, F.coalesce(from_list, none)).otherwise(F.coalesce(from_map, none)))
    return F.slice(F.array_compact(every), 1, MOST_MESSAGES)


def rejection(status: Column, body: Column) -> Column:
    """Why a write was refused, with what the service says of fields only for a bad request."""
    told = F.array_join(response_messages(body), "; ")
    prefix = F.format_string("the write was refused (HTTP %d)", status)
    return F.when((status == 400) & (F.coalesce(told, F.lit("")) != ""), F.concat(prefix, F.lit(": "), told)).otherwise(prefix)


def resolution(issues: Column) -> Column:
    """The first missing-target issue of a record, with the suggestion that came with it."""
    first = F.get(F.filter(issues, lambda i: i["code"] == "COURT_SLUG_NOT_FOUND"), F.lit(0))
    hint = F.get(F.filter(issues, lambda i: i["code"].isin("COURT_SLUG_SUGGESTED", "COURT_SLUG_AUTO_REPAIRED")), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["raw_value"].alias("submitted"), F.get_json_object(F.coalesce(hint["cleaned_value"], first["cleaned_value"]), "$.suggested_slug").alias("suggested")))


def run_id(at: Column, name: Column) -> Column:
    """The time of a run to the second, and a short hash of what it read."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.sha2(name, 256), 1, 8))
