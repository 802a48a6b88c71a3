"""Text cleaning as column expressions; everything stays inside the JVM.

White space means Unicode white space unless a function says otherwise. A
null input gives a null output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as no answer, in lower case.
EMPTY_LIKE = ["", "n/a", "na", "-", "."]
# Answers read as true and as false.
YES = ["yes", "y", "true", "t", "1"]
NO = ["no", "n", "false", "f", "0"]
# Texts in a time cell that say that there is no time.
KNOWN_TIME_TEXTS = ["appointment only", "appointments only", "by appointment only", "no counter service", "no counter service available", "counter service not available", "closed"]
# Patterns of e-mail addresses, UK postcodes and API phones.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EMAIL_INSIDE = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
POSTCODE = r"^(GIR0AA|[A-Z]{1,2}[0-9][A-Z0-9]?[0-9][A-Z]{2})$"
API_PHONE = r"^(?:\+44)?[0-9 ]{10,20}$"
ADDRESS_ALIASES = {"st": "street", "rd": "road", "ave": "avenue", "ct": "court"}

SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """df.select(*columns), each computed once a row: through a generator, as the optimiser would write a column's whole expression wherever a later step takes a field of it."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def collapse(c: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.regexp_replace(F.regexp_replace(c, SPACE, " "), "^ | $", "")


def null_if_empty_like(c: Column) -> Column:
    """Collapsed text, or null where it says nothing."""
    return let(collapse(c.cast("string")), lambda x: F.when(~F.lower(x).isin(EMPTY_LIKE), x))


def is_empty_like(c: Column) -> Column:
    """The profiler's test: trimmed only, not collapsed."""
    x = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.lower(x).isin(EMPTY_LIKE), F.lit(True))


def result(value: Column, status: Column, code: Column) -> Column:
    return F.struct(value.alias("value"), status.alias("status"), code.alias("code"))


def yes_no(c: Column) -> Column:
    """struct(value boolean, status, code): UNKNOWN_BOOLEAN for other answers."""

    def judged(x: Column) -> Column:
        bad = x.isNotNull() & ~x.isin(YES + NO)
        return result(F.when(x.isin(YES), True).when(x.isin(NO), False), F.when(x.isNull(), "empty").when(bad, "invalid").otherwise("valid"), F.when(bad, "UNKNOWN_BOOLEAN"))

    return let(F.lower(null_if_empty_like(c)), judged)


def multiselect(c: Column) -> Column:
    """Parts of a multiple choice in order: by semicolons if there are any, else by lines; empty answers go, repeats stay."""
    parts = F.when(c.contains(";"), F.split(c, ";")).otherwise(F.split(c, "[\r\n]+"))
    return F.coalesce(F.filter(F.transform(parts, null_if_empty_like), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def email(c: Column) -> Column:
    """struct(value, status, code): the address itself, else the first one inside the text, else INVALID_EMAIL."""

    def judged(x: Column) -> Column:
        inside = F.regexp_replace(F.get(F.regexp_extract_all(x, F.lit(EMAIL_INSIDE), 0), F.lit(0)), "[.,;:]+$", "")
        value = F.when(x.rlike(EMAIL), x).otherwise(inside)
        return let(value, lambda v: result(F.coalesce(v, x), F.when(x.isNull(), "empty").when(v.isNull(), "invalid").otherwise("valid"), F.when(x.isNotNull() & v.isNull(), "INVALID_EMAIL")))

    return let(F.lower(F.regexp_replace(null_if_empty_like(c), "[\u200b\ufeff]", "")), judged)


def emails_inside(c: Column) -> Column:
    """All addresses inside a text, in order, lower case."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(EMAIL_INSIDE), 0), lambda x: F.regexp_replace(x, "[.,;:]+$", ""))


def uk_phone(c: Column) -> Column:
    """struct(value, status, code): national format, or the typed text with INVALID_PHONE."""

    def judged(p: Column) -> Column:
        x, digits = p["x"], p["digits"]
        home = F.regexp_replace(digits, "^44([0-9]{10})$", "0$1")
        shown = F.regexp_replace(F.regexp_replace(home, "^(020)([0-9]{4})([0-9]{4})$", "$1 $2 $3"), "^(0[0-9]{4})([0-9]{6})$", "$1 $2")
        bad = x.isNotNull() & ~digits.rlike("^(0[0-9]{9,10}|44[0-9]{10})$")
        return result(F.when(digits.rlike("^(0[0-9]{10}|44[0-9]{10})$"), shown).otherwise(x), F.when(x.isNull(), "empty").when(bad, "invalid").otherwise("valid"), F.when(bad, "INVALID_PHONE"))

    return let(let(null_if_empty_like(c), lambda x: F.struct(x.alias("x"), F.regexp_replace(x, "[^0-9]", "").alias("digits"))), judged)


def uk_postcode(c: Column) -> Column:
    """struct(value, status, code): outward and inward part; a letter O in a digit's place is repaired and reported."""

    def repaired(p: Column) -> Column:
        # The inward part starts with a digit; the outward part has its first digit after one or two letters.
        x = p["x"]
        inward = F.regexp_replace(x, "^(.*)O([A-Z]{2})$", "$1\\0$2")
        tries = F.array(inward, F.regexp_replace(inward, "^([A-Z])O", "$1\\0"), F.regexp_replace(inward, "^([A-Z]{2})O", "$1\\0"), F.regexp_replace(x, "^([A-Z])O", "$1\\0"), F.regexp_replace(x, "^([A-Z]{2})O", "$1\\0"))
        return F.struct(p["text"].alias("text"), x.alias("x"), F.when(x.rlike(POSTCODE), x).alias("good"), F.get(F.filter(tries, lambda t: (t != x) & t.rlike(POSTCODE)), F.lit(0)).alias("repaired"))

    def judged(p: Column) -> Column:
        some = F.coalesce(p["good"], p["repaired"])
        value = F.coalesce(F.regexp_replace(some, "^(.*)(.{3})$", "$1 $2"), F.upper(p["text"]))
        code = F.when(p["x"].isNull() | p["good"].isNotNull(), None).when(p["repaired"].isNotNull(), "POSTCODE_TYPO_REPAIRED").otherwise("INVALID_POSTCODE")
        return result(value, F.when(p["x"].isNull(), "empty").when(some.isNotNull(), "valid").otherwise("invalid"), code)

    text = let(null_if_empty_like(c), lambda t: F.struct(t.alias("text"), F.upper(F.regexp_replace(t, SPACE, "")).alias("x")))
    return let(let(text, repaired), judged)


def slug(c: Column) -> Column:
    """Key of an entity from a name, a path or an address on the web; null if nothing is left."""

    def of_url(x: Column) -> Column:
        host = F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1)
        path = F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)

        def chosen(u: Column) -> Column:
            path, host = u["path"], u["host"]
            after = F.regexp_extract(path, "/courts/+([^/]+)", 1)
            last = F.regexp_extract(path, "([^/]+)/*$", 1)
            whole = path.rlike("/courts/*$") & (after == "")
            return F.when((host == "") | whole, x).when(after != "", after).when(last != "", last).when(~host.contains("."), host).otherwise(x)

        return let(F.struct(host.alias("host"), path.alias("path")), chosen)

    x = let(F.regexp_replace(null_if_empty_like(c), "^(?i)ttps://", "https://"), of_url)
    x = F.regexp_replace(x, r"^[./\\]+", "")
    x = F.regexp_replace(x, "^(?i)courts/", "")
    x = F.regexp_replace(x, "[?#].*$", "")
    x = F.lower(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1-$2"))
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)[\s_]+", "-"), "[^a-z0-9-]", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", ""), F.lit(""))


def _two_digits(hour: Column, minute: Column) -> Column:
    return F.format_string("%02d:%02d", hour, minute)


def _clock(text: Column) -> Column:
    """HH:MM of a whole time such as 9, 9.30, 0930, 9:30 pm; null if it isn't one."""
    pattern = r"^([0-9]{1,2})(?::?([0-9]{2}))?\s*((?i:am|pm))?$"

    def parts(t: Column) -> Column:
        hour, minute, half = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3))
        return F.struct(hour.try_cast("int").alias("h"), F.coalesce(minute.try_cast("int"), F.lit(0)).alias("m"), F.lower(half).alias("half"))

    def at(p: Column) -> Column:
        h = F.when((p["half"] == "pm") & (p["h"] < 12), p["h"] + 12).when((p["half"] == "am") & (p["h"] == 12), 0).otherwise(p["h"])
        return F.when((h <= 23) & (p["m"] <= 59), _two_digits(h, p["m"]))

    return let(let(F.regexp_replace(text, r"\.", ":"), parts), at)


def _punctuation(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(null_if_empty_like(c), ";", ":"), r"^[\s.:]+|[\s.:]+$", "")
    return F.nullif(x, F.lit(""))


def time_cell(c: Column) -> Column:
    """struct(value HH:MM, status, code) of a time typed in one cell."""

    def found(x: Column) -> Column:
        noisy = F.regexp_extract(x, r"(?i)^([0-9]{1,2}:[0-9]{2}\s*(?:am|pm)?)\s*(?::\s*(?:\?|[0-9]+\s*minutes?)|\?)$", 1)
        return F.struct(_clock(F.nullif(F.trim(noisy), F.lit(""))).alias("recovered"), _clock(x).alias("plain"))

    def judged(f: Column) -> Column:
        value = F.coalesce(f["recovered"], f["plain"])
        known, text = f["known"], f["text"]
        return result(
            F.when(~known, value),
            F.when(text.isNull(), "empty").when(known, "known_text_status").when(value.isNull(), "invalid_time").otherwise("valid_time"),
            F.when(text.isNull() | known, None).when(f["recovered"].isNotNull(), "TIME_FORMAT_RECOVERED").when(value.isNull(), "INVALID_TIME"),
        )

    text = null_if_empty_like(c)
    f = let(_punctuation(c), found)
    return let(let(f, lambda f: F.struct(f["recovered"].alias("recovered"), f["plain"].alias("plain"), text.alias("text"), F.lower(text).isin(KNOWN_TIME_TEXTS).alias("known"))), judged)


def time_parts(hour: Column, minute: Column) -> Column:
    """struct(value HH:MM, status, code) of a time typed as hour and minute."""

    def found(p: Column) -> Column:
        h, m = p["h"], p["m"]
        noise = F.coalesce(m.rlike(r"(?i)^(\?|[0-9]+\s*minutes?)$"), F.lit(False))
        digits = h.rlike("^[0-9]{1,2}$") & m.rlike("^[0-9]{1,2}$") & (h.try_cast("int") <= 23) & (m.try_cast("int") <= 59)
        return F.struct(
            h.alias("h"), m.alias("m"), noise.alias("noise"), _clock(h).alias("clock"), _clock(m).alias("other"),
            F.when(digits, _two_digits(h.try_cast("int"), m.try_cast("int"))).alias("plain"),
        )

    def judged(f: Column) -> Column:
        h, m = f["h"], f["m"]
        empty = h.isNull() & m.isNull()
        known = F.coalesce((F.lower(h) == F.lower(m)) & F.lower(h).isin(KNOWN_TIME_TEXTS), F.lit(False))
        in_hour = F.when(h.contains(":"), f["clock"])
        recovered = F.when(f["noise"], f["clock"])
        fits = m.isNull() | (F.lower(m) == F.lower(h)) | (f["other"] == in_hour) | m.isin("0", "00", "00:00") | (F.lpad(m, 2, "0") == F.substring(in_hour, 4, 2))
        value = F.coalesce(recovered, F.when(fits, in_hour), f["plain"])
        return result(
            F.when(~known, value),
            F.when(empty, "empty").when(known, "known_text_status").when(value.isNull(), "invalid_time").otherwise("valid_time"),
            F.when(empty | known, None).when(recovered.isNotNull(), "TIME_FORMAT_RECOVERED").when(value.isNull(), "INVALID_TIME"),
        )

    return let(let(F.struct(_punctuation(hour).alias("h"), _punctuation(minute).alias("m")), found), judged)


def header(c: Column) -> Column:
    """Header for broad comparison: collapsed, lower case, without the number that marks a repeat."""
    return F.regexp_replace(F.lower(collapse(c)), r"(?<!\d)\d+$", "")


def match_form(c: Column) -> Column:
    """Form under which terms of a vocabulary are compared."""
    x = F.lower(F.translate(collapse(c), "’", "'"))
    return F.when(x != "", x)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")


def humanise(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "[-_]+", " "))


def sort_instant(c: Column) -> Column:
    """struct(rank int, at timestamp, text): spreadsheet serials and ISO times rank over other text, which ranks over nothing."""
    x = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    serial = x.try_cast("double")
    at = F.coalesce(F.when(serial.between(-700000, 2900000), F.timestamp_seconds(((serial - 25569) * 86400).cast("decimal(30,6)"))), F.when(serial.isNull(), x.try_cast("timestamp")))
    some = x.isNotNull() & (x != "")
    return F.struct(
        F.when(at.isNotNull(), 2).when(some, 1).otherwise(0).alias("rank"),
        F.coalesce(at, F.timestamp_seconds(F.lit(0))).alias("at"),
        F.when(some & at.isNull(), F.lower(x)).otherwise("").alias("text"),
    )


# Units of length in centimetres and of mass in kilograms.
WIDTH_UNITS = {
    "mm": "0.1", "millimetre": "0.1", "millimetres": "0.1", "millimeter": "0.1", "millimeters": "0.1",
    "cm": "1", "cms": "1", "centimetre": "1", "centimetres": "1", "centimeter": "1", "centimeters": "1",
    "metre": "100", "metres": "100", "meter": "100", "meters": "100",
    "in": "2.54", "inch": "2.54", "inches": "2.54", "ft": "30.48", "foot": "30.48", "feet": "30.48", "m": "100",
}
WEIGHT_UNITS = {"kg": "1", "kgs": "1", "kilogram": "1", "kilograms": "1", "lb": "0.45359237", "lbs": "0.45359237", "pound": "0.45359237", "pounds": "0.45359237"}


def measurement(c: Column, units: dict[str, str], default: Column | None = None) -> Column:
    """Smallest of the measures in a text, in base units, rounded down; plain positive whole numbers stand for themselves."""
    x = F.lower(null_if_empty_like(c))
    pattern = rf"([0-9]+(?:\.[0-9]+)?)\s*({'|'.join(sorted(units, key=len, reverse=True))})(?![a-z])"
    numbers = F.regexp_extract_all(x, F.lit(pattern), 1)
    names = F.regexp_extract_all(x, F.lit(pattern), 2)
    factor = F.create_map(*[F.lit(v) for k, f in units.items() for v in (k, f)])
    values = F.zip_with(numbers, names, lambda n, u: n.cast("decimal(18,6)") * F.element_at(factor, u).cast("decimal(18,8)"))
    least = F.array_min(F.filter(values, lambda v: v >= 1))
    plain = F.when(x.rlike(r"^0*[1-9][0-9]{0,8}(\.0+)?$"), F.floor(x.cast("decimal(18,6)")))
    return F.coalesce(plain.cast("int"), F.floor(least).cast("int"), default if default is not None else F.lit(None).cast("int"))


# Number words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20}


def room_count(c: Column, has_rooms: Column) -> Column:
    """Number of rooms in an answer: 0 without rooms, a number or word, the sum of those said of rooms, 1 where nothing says."""
    x = F.lower(null_if_empty_like(c))
    words = F.create_map(*[F.lit(v) for k, n in NUMBER_WORDS.items() for v in (k, str(n))])
    token = "|".join(["[0-9]{1,3}", *sorted(NUMBER_WORDS, key=len, reverse=True)])
    value = lambda t: F.coalesce(F.try_element_at(words, t), t).cast("int")
    near = F.regexp_extract_all(x, F.lit(rf"\b({token})\b(?=[^.;]{{0,30}}?rooms?\b)"), 1)
    total = F.aggregate(near, F.lit(0), lambda s, t: s + value(t))
    lead = F.regexp_extract(x, rf"^({token})\b", 1)
    found = F.when(x.rlike("^[0-9]{1,3}$"), x.try_cast("int")).when(F.size(near) > 0, total).when(lead != "", value(lead))
    return F.when(~has_rooms, 0).when(found.between(1, 150), found).when(has_rooms, 1)


def rule_name(path: Column) -> Column:
    """Name of the rule of a field path: the ordinal goes and the group is singular."""
    return F.regexp_replace(F.regexp_replace(path, r"^addresses\[\d+\]\.", "address."), r"^contacts\[\d+\]\.", "contact.")


def paths_overlap(a: Column, b: Column) -> Column:
    """Whether two field paths are equal or one lies within the other."""
    inside = lambda x, y: F.startswith(x, F.concat(y, F.lit("."))) | F.startswith(x, F.concat(y, F.lit("[")))
    return (a == b) | inside(a, b) | inside(b, a)


def api_text(c: Column) -> Column:
    """Typographic signs, care-of, not-applicable, bars and ampersands as plain text; compatibility forms are left to the caller."""
    x = F.translate(c, "‘’“”–— ", "''''-- ")
    x = F.regexp_replace(x, r"(?i)\bc\s*/\s*o\b", "care of")
    x = F.regexp_replace(x, r"(?i)\bn\s*/\s*a\b", "Not applicable")
    return F.replace(F.replace(x, F.lit("|"), F.lit(" - ")), F.lit("&"), F.lit(" and "))


def percentage(n: Column, d: Column) -> Column:
    """Percentage with one decimal, 0 where there is nothing to divide by."""
    return F.coalesce(F.round(100 * n / F.nullif(d, F.lit(0)), 1), F.lit(0.0))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 16 digits of the hash of the parts."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16))


def canonical_json(c: Column) -> Column:
    """JSON text of a struct or map with sorted keys."""
    return F.to_json(F.parse_json(F.to_json(c, {"ignoreNullFields": "false"})))


def canonical_hash(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)
