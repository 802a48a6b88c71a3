"""Wide rows to nested records with issues, status and selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import issues as I
from ..operators import selection
from ..operators.shaping import fold_groups
from ..sources.sheets import cell
from . import layout as L

# Severity of each issue that cleaning can raise.
SEVERITY = {"UNKNOWN_BOOLEAN": "warning", "INVALID_EMAIL": "warning", "INVALID_PHONE": "warning", "POSTCODE_TYPO_REPAIRED": "warning", "INVALID_POSTCODE": "warning", "TIME_FORMAT_RECOVERED": "warning", "INVALID_TIME": "warning"}


def _cleaner(f: L.Field) -> str:
    if f.name in L.BOOLEANS or f.name in ("same_monday_to_friday", "has_interview_rooms"):
        return "yes_no"
    if f.name in L.PHONES or f.name in ("phone", "booking_phone", "translation_phone"):
        return "phone"
    if f.name in ("email", "translation_email"):
        return "email"
    if f.name == "postcode":
        return "postcode"
    if f.name in ("food_and_drink", "areas_of_law", "court_types", "assists_with", "specific_courts"):
        return "multiselect"
    return "text"


CLEAN = {"yes_no": T.yes_no, "phone": T.uk_phone, "email": T.email, "postcode": T.uk_postcode}


def path_of(f: L.Field) -> str:
    group = {"address": "addresses", "contact": "contacts", "opening_hours": "opening_hours"}.get(f.section)
    if group:
        return f"{group}[{f.index}].{f.name}"
    return f.name if f.section == "scalar" else f"{f.section}.{f.name}"


def _id(f: L.Field) -> str:
    return f"{f.section}_{f.index}_{f.name}"


def _is_time(f: L.Field) -> bool:
    return any(f.name.endswith(t) for t in L.TIMES)


def _pairs(section: str, index: int) -> list[tuple[str, str, str, str]]:
    """(day, edge, hour field, minute field) of every time of a section."""
    return [(d, e, f"{p}{e}_hour", f"{p}{e}_minute") for d, p in [("monday_to_friday", ""), *[(d, f"{d}_") for d in L.DAYS]] for e in ("opening", "closing")]


SETS = [("counter_service", 0), *[("opening_hours", k) for k in range(1, L.HOURS_GROUPS + 1)]]


def spread(sheet: DataFrame) -> DataFrame:
    """sheet over a few tasks per core: cleaning a row takes long beside reading it, and a small file or a single row group is read by one task."""
    return sheet.repartition(4 * sheet.sparkSession.sparkContext.defaultParallelism, "row")


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _result_of_nothing(value: str) -> Column:
    none = F.lit(None)
    return T.result(none.cast(value), F.lit("empty"), none.cast("string"))


# Cleaner of each kind of cell, and what it makes of a cell in which nothing is typed, which most are.
KINDS = {**CLEAN, "multiselect": T.multiselect, "text": T.null_if_empty_like}
NOTHING = {**dict.fromkeys(CLEAN, lambda: _result_of_nothing("string")), "yes_no": lambda: _result_of_nothing("boolean"), "multiselect": lambda: F.array().cast("array<string>"), "text": lambda: F.lit(None).cast("string")}


def _cleaned(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.when(_some(c), KINDS[kind](c)).otherwise(NOTHING[kind]())


def clean_cells(sheet: DataFrame) -> DataFrame:
    """One cleaned column per field of every data row that answers anything; the header and rows with metadata only are left out.

    Cells of one kind are cleaned as one array, so that a cleaner is written once and not once a field.
    """
    asked = F.exists(F.array(*[cell(f.column) for f in L.BUSINESS]), lambda c: _some(c) & T.null_if_empty_like(c).isNotNull())
    rows = spread(sheet.filter("row > 1")).filter(asked)
    fields = [(f, "text" if f.section == "metadata" else _cleaner(f)) for f in L.LAYOUT if not f.name.startswith("add_another") and not _is_time(f)]
    of = {kind: [f for f, k in fields if k == kind] for kind in KINDS}
    cleaned = [F.transform(F.array(*[cell(f.column) for f in of[kind]]), _cleaned(kind)).alias(f"_{kind}") for kind in KINDS]
    pairs = [(f"{section}_{k}_{day}_{edge}", L.column_of(section, h, k), L.column_of(section, m, k)) for section, k in SETS for day, edge, h, m in _pairs(section, k)]
    times = F.transform(F.array(*[F.struct(cell(h).alias("h"), cell(m).alias("m")) for _, h, m in pairs]), lambda t: F.when(_some(t["h"]) | _some(t["m"]), T.time_parts(t["h"], t["m"])).otherwise(_result_of_nothing("string")))
    slug = T.slug(cell(L.column_of("scalar", "court_slug_raw")))
    once = T.computed(rows, "row", "cells", *cleaned, times.alias("_times"), slug.alias("court_slug"))
    out = [F.col("row").alias("source_row_number")]
    for f, kind in fields:
        out.append(F.get(f"_{kind}", F.lit(of[kind].index(f))).alias(_id(f)))
        if kind in CLEAN:
            out.append(cell(f.column).alias(f"raw_{_id(f)}"))
    for i, (name, h, m) in enumerate(pairs):
        out += [F.get("_times", F.lit(i)).alias(f"time_{name}"), F.concat_ws(":", cell(h), cell(m)).alias(f"raw_time_{name}")]
    return once.select(*out, "court_slug")


def _field(section: str, name: str, k: int = 0) -> Column:
    f = next(f for f in L.LAYOUT if (f.section, f.index, f.name) == (section, k, name))
    c = F.col(_id(f))
    return c["value"] if _cleaner(f) in CLEAN and section != "metadata" else c


def _times(section: str, k: int) -> list[Column]:
    """A struct per day: both ends, and a status that an invalid end decides before a known text and a valid time."""
    out = []
    for day in ["monday_to_friday", *L.DAYS]:
        o, c = F.col(f"time_{section}_{k}_{day}_opening"), F.col(f"time_{section}_{k}_{day}_closing")
        has = lambda s, o=o, c=c: (o["status"] == s) | (c["status"] == s)
        state = F.when(has("invalid_time"), "invalid_time").when(has("known_text_status"), "known_text_status").otherwise("valid_time")
        nothing = (o["status"] == "empty") & (c["status"] == "empty")
        if section == "counter_service":
            nothing = nothing | F.coalesce((o["value"] == "00:00") & (c["value"] == "00:00"), F.lit(False))
        out.append(F.when(~nothing, F.struct(o["value"].alias("open"), c["value"].alias("close"), state.alias("status"))).alias(day))
    return out


def ingest_issues() -> Column:
    """Issues that cleaning raised, in column order, then those of times, then of the key."""
    found = lambda path, c, raw: F.when(c["code"].isNotNull(), F.struct(F.lit(path).alias("path"), c["code"].alias("code"), raw.alias("raw"), c["value"].cast("string").alias("value")))
    told = lambda what, each: F.transform(F.array_compact(F.array(*each)), lambda x: I.issue(x["path"], x["code"], "warning", F.concat(F.lit(f"{what} could not be read as typed: "), x["code"]), x["raw"], x["value"]))
    typed = [f for f in L.LAYOUT if f.section != "metadata" and not f.name.startswith("add_another") and not _is_time(f) and _cleaner(f) in CLEAN]
    cells = [found(path_of(f), F.col(_id(f)), F.col(f"raw_{_id(f)}")) for f in typed]
    times = [found(f"opening_hours[{k}].{day}.{edge}" if k else f"{section}.{day}.{edge}", F.col(f"time_{section}_{k}_{day}_{edge}"), F.col(f"raw_time_{section}_{k}_{day}_{edge}")) for section, k in SETS for day, edge, _, _ in _pairs(section, k)]
    raw = F.col("scalar_0_court_slug_raw")
    key = I.rules(
        (raw.isNotNull() & F.col("court_slug").isNull(), I.issue("court_slug_raw", "INVALID_COURT_IDENTIFIER", "error", "nothing of the key is left", raw)),
        (raw.isNull(), I.issue("court_slug_raw", "MISSING_COURT_IDENTIFIER", "error", "there is no key")),
        (raw.isNotNull() & (F.col("court_slug") != raw), I.issue("court_slug_raw", "COURT_SLUG_NORMALISED", "info", "the key was normalised", raw, F.col("court_slug"))),
    )
    return F.concat(told("cell", cells), told("time", times), key)


def build_records(sheet: DataFrame) -> DataFrame:
    """Nested records: source, key, facilities, addresses, counter service, rooms, contacts, hours, issues and status."""
    c = clean_cells(sheet)
    facilities = [_field("scalar", f).alias(f) for f in L.SCALARS if f not in ("court_slug_raw", "translation_phone", "translation_email")]
    addresses = [{f: _field("address", f, k) if f not in ("areas_of_law", "court_types") else _field("address", f, k) for f in L.ADDRESS[:-1]} for k in range(1, L.ADDRESS_GROUPS + 1)]

    def moved(g: Column) -> Column:
        """An e-mail typed as a phone goes where it belongs if that cell is empty, and the other way round."""
        as_email = F.when((g["email"]["status"] == "empty") & (g["phone"]["code"] == "INVALID_PHONE"), T.email(g["raw_phone"]))
        as_phone = F.when((g["phone"]["status"] == "empty") & (g["email"]["code"] == "INVALID_EMAIL"), T.uk_phone(g["raw_email"]))

        def chosen(p: Column) -> Column:
            to_email, to_phone = (F.coalesce(p[x]["status"] == "valid", F.lit(False)) for x in ("as_email", "as_phone"))
            phone = F.when(to_phone, p["as_phone"]["value"]).when(~to_email, g["phone"]["value"])
            email = F.when(to_email, p["as_email"]["value"]).when(~to_phone, g["email"]["value"])
            return F.struct(g["index"].alias("index"), g["description"].alias("description"), g["explanation"].alias("explanation"), phone.alias("phone"), email.alias("email"))

        return T.let(F.struct(as_email.alias("as_email"), as_phone.alias("as_phone")), chosen)

    contacts = [{"description": _field("contact", "description", k), "explanation": _field("contact", "explanation", k), **{f"{raw}{f}": F.col(f"{raw}contact_{k}_{f}") for f in ("phone", "email") for raw in ("", "raw_")}} for k in range(1, L.CONTACT_GROUPS + 1)]
    hours = [{"type": _field("opening_hours", "type", k), "same_monday_to_friday": _field("opening_hours", "same_monday_to_friday", k), **{d: x for d, x in zip(["monday_to_friday", *L.DAYS], _times("opening_hours", k), strict=True)}} for k in range(1, L.HOURS_GROUPS + 1)]
    out = c.select(
        "source_row_number",
        F.struct("source_row_number", *[F.col(f"metadata_0_{f}").alias(f) for f in L.METADATA]).alias("source"),
        F.col("scalar_0_court_slug_raw").alias("court_slug_raw"), "court_slug",
        F.struct(*facilities).alias("facilities"),
        _field("scalar", "translation_phone").alias("translation_phone"), _field("scalar", "translation_email").alias("translation_email"),
        fold_groups(addresses, [f for f in L.ADDRESS[:-1] if f not in ("areas_of_law", "court_types")]).alias("addresses"),
        F.struct(*[_field("counter_service", f).alias(f) for f in L.COUNTER], *_times("counter_service", 0)).alias("counter_service"),
        F.struct(*[_field("interview_rooms", f).alias(f) for f in L.ROOMS]).alias("interview_rooms"),
        fold_groups(contacts, ["description", "explanation", "phone", "email"], moved).alias("contacts"),
        fold_groups(hours, ["type", "same_monday_to_friday", "monday_to_friday", *L.DAYS]).alias("opening_hours"),
        ingest_issues().alias("issues"),
    )
    return out.withColumn("status", I.status(F.col("issues")))


def submitted_at() -> list[Column]:
    """Order of a key's records, newest first: by the first time that is given, then by row."""
    first = F.coalesce(*[F.nullif(F.col(f"source.{f}"), F.lit("")) for f in ("completion_time", "last_modified_time", "start_time")])
    key = T.sort_instant(first)
    return [key["rank"].desc(), key["at"].desc(), key["text"].desc(), F.desc("source_row_number")]


def select_authoritative(records: DataFrame) -> DataFrame:
    """Records with their selection; superseded ones are skipped and keep only issues that validation doesn't own."""
    out = selection.with_selection(records, ["court_slug"], submitted_at(), "source_row_number")
    old = F.col("selection_status") == "superseded"
    return out.withColumn("status", F.when(old, "skipped").otherwise(F.col("status"))).withColumn("issues", F.when(old, I.without_codes(F.col("issues"))).otherwise(F.col("issues")))


def check_existence(records: DataFrame, courts: DataFrame) -> DataFrame:
    """Issue COURT_SLUG_NOT_FOUND for keys that the dimension doesn't have; each key is looked up once, and one that has several ids there gets the least, so that no record is multiplied."""
    known = courts.groupBy(F.col("slug").alias("_slug")).agg(F.min("id").alias("court_id"))
    out = records.join(known, F.col("court_slug") == F.col("_slug"), "left")
    missing = F.col("court_slug").isNotNull() & F.col("_slug").isNull() & (F.col("status") != "skipped")
    new = I.rules((missing, I.issue("court_slug", "COURT_SLUG_NOT_FOUND", "warning", "no such court", F.col("court_slug"))))
    out = out.withColumn("issues", I.add_once(F.col("issues"), new)).drop("_slug")
    return out.withColumn("status", F.when(F.col("status") == "skipped", "skipped").otherwise(I.status(F.col("issues"))))


def summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("records"), F.count_distinct("court_slug").alias("courts"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "processed_with_warnings", "needs_human_review", "failed", "skipped")],
        F.sum(F.size("issues")).alias("issues"),
    )
