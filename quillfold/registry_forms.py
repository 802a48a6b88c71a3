"""Queries of contract checks, nested values, validation, model answers and address verification, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import addresses as A
from .operators import compare
from .operators import issues as I
from .operators import modelled as M
from .operators import nested as N
from .operators import suggest, summaries
from .operators.matching import canonical_address
from .plans import actions, contract, headers, layout, records, validate
from .registry import _sheet, query, read
from .sources import sheet_source
from .sources.stored import scratch, shared_folder, stored
from .streaming import latest

# --- contract -----------------------------------------------------------------------


def _messages(*pairs: tuple[str, str]) -> str:
    """SQL of the joined messages of (test, message) pairs."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{m}' END" for t, m in pairs) + "], lambda x: x IS NOT NULL), '; ')"


@query(f"""SELECT c_custkey, {_messages(("addressType IS NULL", "addressType is required"), ("NOT regexp_full_match(addressLine1, '[A-Za-z0-9 ()'':,.-]+')", "addressLine1 has characters that are rejected"),
("length(townCity) > 100", "townCity is too long"), ("starts_with(upper(replace(postcode, ' ', '')), 'BT')", "postcode is in Northern Ireland, which is not served"), ("starts_with(upper(replace(postcode, ' ', '')), 'JE')", "postcode is in Jersey, which is not served"),
("NOT contains(trim(postcode), ' ') AND NOT starts_with(upper(postcode), 'BT') AND NOT starts_with(upper(postcode), 'JE')", "postcode has no space"))} AS reason
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE replace(c_name, '#', ' ') END AS addressLine1, CASE WHEN c_custkey % 9 = 0 THEN repeat('ab', 51) ELSE c_mktsegment END AS townCity,
  ['AB1 2CD', 'BT1 1AA', 'je23xx', 'AB12CD', 'GL1 1AA'][c_custkey % 5 + 1] AS postcode, CASE WHEN c_custkey % 6 > 0 THEN 'VISIT_US' END AS addressType FROM customer)""")
def contract_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = F.get(F.array(*[F.lit(x) for x in ("AB1 2CD", "BT1 1AA", "je23xx", "AB12CD", "GL1 1AA")]), (k % 5).cast("int"))
    body = {
        "courtId": F.lit("c"), "addressLine1": F.when(k % 4 == 0, F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit(" "))), "townCity": F.when(k % 9 == 0, F.lit("ab" * 51)).otherwise(F.col("c_mktsegment")),
        "postcode": pick, "addressType": F.when(k % 6 > 0, "VISIT_US"),
    }
    return read(spark, sf_dir, "customer").select("c_custkey", contract.reason("address", body).alias("reason"))


@query(f"""SELECT p_partkey, {_messages(("NOT regexp_full_match(phone, '(\\+44)?[0-9 ]{{10,20}}')", "phoneNumber is not a phone number"), ("NOT contains(email, '@')", "email is not an e-mail address"), ("length(explanation) > 255", "explanation is too long"),
("length(explanation) > 250", "explanation is too long for a contact"), ("contains(explanation, '!')", "explanation has characters that are rejected"))} AS reason, phone IS NULL AND email IS NULL AND explanation IS NULL AS left_out
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '+44 ' || p_partkey ELSE NULL END AS phone, CASE WHEN p_partkey % 4 = 1 THEN 'a' || p_partkey || '@b.org' WHEN p_partkey % 4 = 2 THEN p_brand END AS email,
  CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' WHEN p_partkey % 7 = 1 THEN repeat('abc', 84) WHEN p_partkey % 7 = 2 THEN repeat('abc', 90) WHEN p_partkey % 7 = 3 THEN p_name END AS explanation FROM part)""")
def contract_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    body = {
        "courtId": F.lit("c"), "courtContactDescriptionId": F.lit("d"), "phoneNumber": F.when(k % 3 == 0, F.concat(F.lit("+44 "), k.cast("string"))), "email": F.when(k % 4 == 1, F.concat(F.lit("a"), k.cast("string"), F.lit("@b.org"))).when(k % 4 == 2, F.col("p_brand")),
        "explanation": F.when(k % 7 == 0, F.concat("p_name", F.lit("!"))).when(k % 7 == 1, F.lit("abc" * 84)).when(k % 7 == 2, F.lit("abc" * 90)).when(k % 7 == 3, F.col("p_name")),
    }
    return read(spark, sf_dir, "part").select("p_partkey", contract.reason("contact_detail", body).alias("reason"), contract.empty_contact(body, F.lit(False)).alias("left_out"))


@query("""WITH d AS (SELECT o_orderkey, [CASE WHEN o_orderkey % 5 = 0 THEN 'SUNDAY' ELSE 'MONDAY' END, CASE WHEN o_orderkey % 3 = 0 THEN 'MONDAY' WHEN o_orderkey % 3 = 1 THEN 'EVERYDAY' ELSE 'FRIDAY' END] AS day,
 ['09:00', CASE WHEN o_orderkey % 7 = 0 THEN '9am' ELSE '10:00' END] AS o, [CASE WHEN o_orderkey % 11 = 0 THEN '08:00' ELSE '17:00' END, '24:00'] AS c FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN day[1] = 'SUNDAY' THEN 'openingTimesDetails has an unknown day' END, CASE WHEN c[1] = '08:00' THEN 'openingTimesDetails closes before it opens' END,
CASE WHEN day[1] = day[2] THEN 'openingTimesDetails has a day twice' END, CASE WHEN o[2] = '9am' THEN 'openingTimesDetails has an invalid opening time' END, 'openingTimesDetails has an invalid closing time', CASE WHEN day[2] = 'EVERYDAY' THEN 'openingTimesDetails has other days beside EVERYDAY' END], lambda x: x IS NOT NULL), '; ') AS reason FROM d""")
def contract_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    one = F.struct(F.when(k % 5 == 0, "SUNDAY").otherwise("MONDAY").alias("dayOfWeek"), F.lit("09:00").alias("openingTime"), F.when(k % 11 == 0, "08:00").otherwise("17:00").alias("closingTime"))
    two = F.struct(F.when(k % 3 == 0, "MONDAY").when(k % 3 == 1, "EVERYDAY").otherwise("FRIDAY").alias("dayOfWeek"), F.when(k % 7 == 0, "9am").otherwise("10:00").alias("openingTime"), F.lit("24:00").alias("closingTime"))
    return read(spark, sf_dir, "orders").select("o_orderkey", contract.reason("court_opening_hours", {"courtId": F.lit("c"), "openingHourTypeId": F.lit("t"), "openingTimesDetails": F.array(one, two)}).alias("reason"))


@query(f"""SELECT s_suppkey, {_messages(("s_suppkey % 4 = 3", "accessScheme is required"), ("s_suppkey % 2 = 0 AND coalesce(rooms NOT BETWEEN 1 AND 150, true)", "interviewRoomCount must be 1 to 150 when interviewRooms is true"), ("s_suppkey % 2 = 1 AND rooms <> 0", "interviewRoomCount must be left out or 0 when interviewRooms is false"))} AS reason
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 * 100 - 100 END AS rooms FROM supplier)""")
def contract_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = {"interviewRooms": k % 2 == 0, "interviewRoomCount": F.when(k % 3 > 0, k % 3 * 100 - 100), "videoHearings": F.lit(True), "commonPlatform": F.lit(True), "accessScheme": F.when(k % 4 < 3, True)}
    return read(spark, sf_dir, "supplier").select("s_suppkey", contract.reason("professional_information", body).alias("reason"))


# --- nested values -------------------------------------------------------------------


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested bodies: a live one and a submitted one that changes some leaves."""
    k = F.col("o_orderkey")
    body = lambda status, day: F.struct(k.alias("id"), status.alias("status"), F.struct(F.col("o_orderpriority").alias("level"), day.alias("day")).alias("detail"), F.array(F.struct(F.lit(1).alias("index"), status.alias("code"), k.alias("id"))).alias("items"))
    live = body(F.col("o_orderstatus"), F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")))
    new = body(F.when(k % 3 == 0, "X").when(k % 3 == 1, F.col("o_orderstatus")), F.when(k % 4 == 0, "2001-01-01"))
    return read(spark, sf_dir, "orders").select("o_orderkey", live.alias("live"), new.alias("new"))


_NESTED_SQL = """n AS (SELECT o_orderkey, o_orderstatus AS ls, o_orderpriority AS lv, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS ld, CASE WHEN o_orderkey % 3 = 0 THEN 'X' WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS ns, CASE WHEN o_orderkey % 4 = 0 THEN '2001-01-01' END AS nd FROM orders)"""


@query(f"""WITH {_NESTED_SQL} SELECT o_orderkey, field, before, after FROM (SELECT o_orderkey, 'status' AS field, ls AS before, ns AS after FROM n UNION ALL SELECT o_orderkey, 'detail.day', ld, nd FROM n UNION ALL SELECT o_orderkey, 'items[0].code', ls, ns FROM n) WHERE before IS DISTINCT FROM after""")
def nested_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    return df.select("o_orderkey", F.explode(N.differences(F.col("live"), F.col("new"), df.schema["live"].dataType)).alias("d")).select("o_orderkey", "d.*")


@query(f"""WITH {_NESTED_SQL} SELECT o_orderkey, coalesce(ns, ls) AS status, coalesce(ld, nd) AS day, NULL::VARCHAR AS level, coalesce(ns, ls) IS NOT DISTINCT FROM ls AND coalesce(ld, nd) IS NOT DISTINCT FROM ld AND ns IS NOT DISTINCT FROM ls AS no_change FROM n""")
def nested_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    kind = df.schema["live"].dataType
    merged = df.withColumn("m", N.deep_merge(F.col("live"), F.col("new"), kind, fallbacks=("detail.day",), clears=("detail.level",)))
    plain = lambda c: F.to_json(N.without_keys(F.col(c), kind).dropFields("detail.level"))
    return merged.select("o_orderkey", F.col("m.status").alias("status"), F.col("m.detail.day").alias("day"), F.col("m.detail.level").alias("level"), (plain("m") == plain("live")).alias("no_change"))


@query("""SELECT o_orderkey, '{"status":"' || o_orderstatus || '","items":[{"index":1,"code":"' || o_orderstatus || '"}]}' AS body FROM orders""")
def nested_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    kind = df.schema["live"].dataType
    some = df.select("o_orderkey", N.allowed(F.col("live"), kind, ["status", "items", "id"]).alias("b"))
    return some.select("o_orderkey", F.to_json(N.without_keys(F.col("b"), some.schema["b"].dataType)).alias("body"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'B' || c_name END AS second, CASE WHEN c_custkey % 3 = 1 THEN 'new' END AS replaced FROM customer""")
def keyed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    item = lambda i, v: F.struct(F.lit(i).alias("index"), v.alias("v"))
    items = F.when(k % 3 == 1, F.array(item(3, F.col("c_name")), item(2, F.concat(F.lit("B"), "c_name")))).otherwise(F.array(item(1, F.col("c_name"))))
    df = read(spark, sf_dir, "customer").select("c_custkey", items.alias("items"))
    return df.select("c_custkey", N.keyed(F.col("items"), F.lit(2))["v"].alias("second"), N.keyed(N.with_keyed(F.col("items"), F.lit(3), "v", F.lit("new")), F.lit(3))["v"].alias("replaced"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS even, p_brand || '; ' || p_type AS listed, coalesce(CASE WHEN p_size > 25 THEN p_size::VARCHAR END, '') AS size FROM part""")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("even"), F.array("p_brand", "p_type").alias("listed"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    return df.select("p_partkey", *[N.cell_text(F.col(c), df.schema[c].dataType).alias(c) for c in ("even", "listed", "size")])


@query()
def word_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed and added between each benchmark item and the next; tested against difflib."""
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after"))
    return items.join(after, "item_id").select("item_id", N.word_diff("text", "after").alias("diff"))


# --- validation ----------------------------------------------------------------------

_DAYS = ["monday_to_friday", *layout.DAYS]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nested records with typed leaves, some of them wrong."""
    k = F.col("c_custkey")
    time = lambda o, c, s: F.struct(o.alias("open"), c.alias("close"), s.alias("status"))
    blank = F.lit(None).cast("struct<open:string,close:string,status:string>")
    hours = F.struct(F.lit(1).alias("index"), F.col("c_mktsegment").alias("type"), *[(time(F.when(k % 6 == 0, "9:00").otherwise("09:00"), F.lit("17:00"), F.when(k % 10 == 0, "known_text_status").otherwise("valid_time")) if d == "monday" else blank).alias(d) for d in _DAYS])
    address = F.struct((k % 3 + 1).cast("int").alias("index"), F.lit("VISIT US").alias("address_type"), F.array(F.lit("Crime"), F.when(k % 4 == 0, "Magic").otherwise("Money")).alias("areas_of_law"), F.array().cast("array<string>").alias("court_types"), F.when(k % 5 == 0, "nonsense").when(k % 5 == 1, "AB1 2CD").alias("postcode"))
    contact = F.struct(F.lit(2).alias("index"), F.lit("Enquiries").alias("description"), F.when(k % 7 == 0, "12").otherwise("020 7946 0018").alias("phone"), F.when(k % 8 == 0, "no mail").alias("email"))
    empty = F.lit(None).cast("string")
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("source_row_number"), F.when(k % 20 > 0, F.concat(F.lit("c"), k.cast("string"))).alias("court_slug"), F.when(k % 20 > 0, F.concat(F.lit("C"), k.cast("string"))).alias("court_slug_raw"),
        F.struct(empty.alias("accessible_parking_phone"), empty.alias("accessible_entrance_support_phone"), empty.alias("hearing_enhancement_equipment"), F.array().cast("array<string>").alias("food_and_drink")).alias("facilities"),
        empty.alias("translation_phone"), empty.alias("translation_email"), F.array(address).alias("addresses"), F.struct(F.array().cast("array<string>").alias("assists_with"), *[blank.alias(d) for d in _DAYS]).alias("counter_service"),
        F.array(contact).alias("contacts"), F.array(hours).alias("opening_hours"), F.array(I.issue("x", "ADDRESS_NOTE", "info", "kept"), I.issue("postcode", "INVALID_POSTCODE", "warning", "old")).alias("issues"),
    )


def _lists(spark: SparkSession) -> DataFrame:
    rows = [("address_types", 0, "VISIT_US", "Visit us", "a1", []), ("areas_of_law", 0, "CRIME", "Crime", "l1", []), ("areas_of_law", 1, "MONEY", "Money claims", "l2", ["money"]), ("contact_description_types", 0, "ENQ", "Enquiries", "d1", []), ("opening_hour_types", 0, "AUTO", "AUTOMOBILE", "o1", []), ("opening_hour_types", 1, "BUILD", "building", None, [])]
    return spark.createDataFrame(rows, "vocabulary string, position int, code string, name string, api_id string, aliases array<string>")


_RECORD_ISSUES_SQL = """i AS (
SELECT c_custkey AS k, 'x' AS field, 'ADDRESS_NOTE' AS code, 'info' AS severity FROM customer UNION ALL
SELECT c_custkey, 'court_slug', 'MISSING_COURT_IDENTIFIER', 'error' FROM customer WHERE c_custkey % 20 = 0 UNION ALL
SELECT c_custkey, 'court_slug', 'COURT_SLUG_NORMALISED', 'info' FROM customer WHERE c_custkey % 20 > 0 UNION ALL
SELECT c_custkey, 'addresses[' || (c_custkey % 3 + 1) || '].areas_of_law', 'VOCAB_NO_MATCH', 'warning' FROM customer WHERE c_custkey % 4 = 0 UNION ALL
SELECT c_custkey, 'addresses[' || (c_custkey % 3 + 1) || '].postcode', 'INVALID_POSTCODE', 'warning' FROM customer WHERE c_custkey % 5 = 0 UNION ALL
SELECT c_custkey, 'contacts[2].phone', 'INVALID_PHONE', 'warning' FROM customer WHERE c_custkey % 7 = 0 UNION ALL
SELECT c_custkey, 'contacts[2].email', 'INVALID_EMAIL', 'warning' FROM customer WHERE c_custkey % 8 = 0 UNION ALL
SELECT c_custkey, 'opening_hours[1].type', 'VOCAB_NO_MATCH', 'warning' FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING') UNION ALL
SELECT c_custkey, 'opening_hours[1].monday', 'OPENING_HOURS_AMBIGUOUS', 'warning' FROM customer WHERE c_custkey % 10 = 0 UNION ALL
SELECT c_custkey, 'opening_hours[1].monday.open', 'INVALID_TIME', 'warning' FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 10 > 0)"""


@query(f"WITH {_RECORD_ISSUES_SQL} SELECT k AS source_row_number, field, code, severity FROM i")
def revalidated_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.report(validate.revalidated(_records(spark, sf_dir), _lists(spark), _DAYS), "source_row_number").select("source_row_number", "field", "code", "severity")


@query(f"""WITH {_RECORD_ISSUES_SQL} SELECT status, count(*) AS n FROM (SELECT k, CASE WHEN bool_or(severity = 'error') THEN 'failed' WHEN bool_or(code IN ('INVALID_POSTCODE', 'INVALID_TIME', 'VOCAB_NO_MATCH', 'OPENING_HOURS_AMBIGUOUS')) THEN 'needs_human_review' ELSE 'processed_with_warnings' END AS status FROM i GROUP BY 1) GROUP BY 1""")
def revalidated_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.revalidated(_records(spark, sf_dir), _lists(spark), _DAYS).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_RECORD_ISSUES_SQL}, s AS (SELECT k, bool_or(severity = 'error') AS e, bool_or(severity = 'warning') AS w FROM i GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS "rows", (SELECT count(*) FROM s WHERE NOT e AND NOT w) AS processed, (SELECT count(*) FROM s WHERE NOT e AND w) AS processed_with_warnings, (SELECT count(*) FROM s WHERE e) AS failed, count(*) FILTER (severity = 'info') AS info_issues, count(*) FILTER (severity = 'warning') AS warning_issues, count(*) FILTER (severity = 'error') AS error_issues FROM i""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.ingest_summary(validate.revalidated(_records(spark, sf_dir), _lists(spark), _DAYS))


@query("""WITH g AS (SELECT o_custkey AS k, count(*) AS n, list(o_orderkey ORDER BY o_orderkey) AS r FROM orders GROUP BY 1 HAVING count(*) > 1)
SELECT o_orderkey, '{"source_row_numbers":[' || array_to_string(r, ',') || '],"rows":' || n || '}' AS told FROM orders JOIN g ON k = o_custkey""")
def duplicate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array().cast(I.NO_ISSUES).alias("issues"))
    twice = validate.with_duplicate_issues(validate.with_duplicate_issues(o, "o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return twice.select("o_orderkey", F.explode("issues").alias("i")).select("o_orderkey", F.col("i.cleaned_value").alias("told"))


@query("""WITH k AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS chunk, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, chunk, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS listed FROM k WHERE n > 1 GROUP BY 1, 2""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = validate.duplicate_rows(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 8)
    return got.select("o_custkey", "chunk", F.array_join(F.transform("values", lambda r: r.cast("string")), ",").alias("listed"))


@query("""WITH u AS (SELECT 'u' || (user_id % 60) || '@x.org' AS email, CASE WHEN event_id % 4 > 0 THEN 'name ' || event_type END AS name, event_id AS r FROM events WHERE user_id % 7 > 0),
n AS (SELECT email, arg_min(name, r) FILTER (name IS NOT NULL) AS name, count(DISTINCT r) AS rows FROM u GROUP BY 1),
k AS (SELECT email, r, (row_number() OVER (PARTITION BY email ORDER BY r) - 1) // 50 AS chunk FROM (SELECT DISTINCT email, r FROM u))
SELECT email, name, rows, chunk, string_agg(r::VARCHAR, ',' ORDER BY r) AS source_rows FROM n JOIN k USING (email) GROUP BY ALL""")
def users_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    email = F.when(u % 7 > 0, F.concat(F.lit(" U"), (u % 60).cast("string"), F.lit("@x.org "))).otherwise(" ")
    name = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("name  "), "event_type")).otherwise("n/a")
    got = validate.users(read(spark, sf_dir, "events"), email, name, "event_id", 50)
    return got.select("email", "name", "rows", "chunk", F.array_join(F.transform("source_rows", lambda r: r.cast("string")), ",").alias("source_rows"))


@query("""SELECT code, "column", actual_header FROM (SELECT CASE n_nationkey % 5 WHEN 1 THEN 'header_mismatch' WHEN 3 THEN 'missing_column' END AS code, 'C' || n_nationkey AS "column", CASE n_nationkey % 5 WHEN 1 THEN 'other ' || n_name END AS actual_header FROM nation UNION ALL SELECT 'unexpected_column', 'R' || r_regionkey, r_name FROM region) WHERE code IS NOT NULL""")
def header_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    expected = n.select(F.concat(F.lit("C"), k.cast("string")).alias("column"), F.concat("n_name", F.lit(" header")).alias("expected_header"))
    seen = F.when(k % 5 == 0, F.concat("n_name", F.lit(" header"))).when(k % 5 == 1, F.concat(F.lit("other "), "n_name")).when(k % 5 == 2, F.concat(F.lit(" "), F.lower("n_name"), F.lit("   HEADER12"))).when(k % 5 == 4, F.concat("n_name", F.lit(" header (if any)")))
    actual = n.select(F.concat(F.lit("c"), k.cast("string")).alias("column"), seen.alias("actual_header")).filter(k % 5 != 3).unionByName(read(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("column"), F.col("r_name").alias("actual_header")))
    return headers.drift(actual, expected).select("code", "column", "actual_header")


@query("""SELECT doc_id, coalesce(lang, '') AS lang, length(text) AS chars, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL""")
def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV files, line breaks and quotes included, and read back as sheets in ranges of bytes."""
    path = scratch(spark, "sheets")
    docs = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang", "text")
    docs.write.options(quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    text = F.col("C")
    return sheet_source.read(spark, path, "A string, B string, C string").select(F.col("A").cast("long").alias("doc_id"), F.col("B").alias("lang"), F.length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("text_sha256"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", array_to_string(list(v ORDER BY c_custkey)[1:10], '|') AS samples FROM (SELECT c_custkey, {c}::VARCHAR AS v FROM customer WHERE {c} IS NOT NULL)" for c in ("c_name", "c_nationkey", "c_mktsegment")))
def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = summaries.column_samples(read(spark, sf_dir, "customer"), T.is_empty_like, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])
    return got.select("column", F.array_join("samples", "|").alias("samples"))


# --- model answers -------------------------------------------------------------------

_ASKED = ["address.areas_of_law", "contact.explanation", "contact.phone", "facilities.accessible_toilet_description", "opening_hours.type", "facilities.hearing_enhancement_equipment"]


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rule = F.get(F.array(*[F.lit(x) for x in _ASKED]), (k % 6).cast("int"))
    value = F.when(k % 6 == 0, F.array(F.lit("crime"), F.when(k % 4 == 0, "Money Claims").otherwise("Wills"))).when(k % 6 == 4, F.array(F.when(k % 8 == 0, "building").otherwise(F.col("p_name"))))
    text = F.when(k % 5 == 0, "write to a.b@c.org please").when(k % 5 == 1, "020 7946 0018").when(k % 5 == 2, " ab1 2cd ").when(k % 5 == 3, F.col("p_name")).otherwise(" ")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), rule.alias("rule"), F.concat(F.lit("f"), (k % 6).cast("string")).alias("field"), F.coalesce(value, F.array(text)).alias("value"))


def _model_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, r != _ASKED[5], None) for r in _ASKED], "rule string, enabled boolean, use_only_when string")


_SELECTED_SQL = """SELECT p_partkey AS "row" FROM part WHERE (p_partkey % 6 = 0 AND p_partkey % 4 > 0) OR (p_partkey % 6 IN (1, 3) AND p_partkey % 5 = 3) OR (p_partkey % 6 = 4 AND p_partkey % 8 > 0)"""


@query(_SELECTED_SQL)
def model_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select_fields(_candidates(spark, sf_dir), _model_rules(spark), _lists(spark)).select("row")


@query(f"""WITH sel AS ({_SELECTED_SQL}), a AS (SELECT p_partkey AS r, p_partkey % 6 AS f, ['set', 'clear', 'unresolved', 'set'][p_partkey % 7 % 4 + 1] AS op, p_partkey % 9 AS v, ['high', 'low'][p_partkey % 2 + 1] AS conf, p_partkey % 11 = 0 AS flag, p_partkey IN (SELECT "row" FROM sel) AS sel FROM part),
j AS (SELECT *, op <> 'set' AS nov, CASE WHEN NOT sel THEN 'LLM_RETURNED_UNEXPECTED_FIELD' WHEN op = 'clear' THEN 'LLM_RETURNED_INVALID_VALUE' WHEN op = 'set' AND v = 0 THEN 'LLM_RETURNED_INVALID_VALUE' WHEN op = 'set' AND v = 1 THEN 'LLM_RETURNED_SENSITIVE_VALUE' WHEN op = 'set' AND f = 0 AND v <> 2 THEN 'LLM_RETURNED_INVALID_VOCAB_VALUE' WHEN op = 'set' AND f = 4 THEN 'LLM_RETURNED_INVALID_VOCAB_VALUE' END AS bad FROM a)
SELECT r AS "row", CASE WHEN NOT sel THEN 'unexpected_field' WHEN bad IS NOT NULL THEN 'rejected' WHEN op = 'unresolved' THEN 'no_value' ELSE 'accepted' END AS outcome, CASE WHEN bad IS NULL AND op = 'set' THEN CASE WHEN f = 0 THEN 'Crime' ELSE CASE WHEN v = 2 THEN ' CRIME' ELSE 'plain words' END END END AS value,
array_to_string(list_filter([bad, CASE WHEN bad IS NULL AND op = 'set' THEN 'LLM_FIELD_NORMALISED' END, CASE WHEN bad IS NULL AND op = 'set' AND conf = 'low' THEN 'LLM_LOW_CONFIDENCE' END, CASE WHEN bad IS NULL AND flag THEN 'LLM_REVIEW_REQUIRED' END], lambda x: x IS NOT NULL), ',') AS codes FROM j""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    op = F.get(F.array(*[F.lit(x) for x in ("set", "clear", "unresolved", "set")]), (k % 7 % 4).cast("int"))
    v = k % 9
    value = F.when((op != "set") | (v == 0), F.array().cast("array<string>")).when(v == 1, F.array(F.lit("x a@b.org"))).when(v == 2, F.array(F.lit(" CRIME"))).otherwise(F.array(F.lit("plain words")))
    answers = read(spark, sf_dir, "part").select(k.alias("row"), F.concat(F.lit("f"), (k % 6).cast("string")).alias("field"), op.alias("operation"), value.alias("value"), F.when(k % 2 == 0, "high").otherwise("low").alias("confidence"), (k % 11 == 0).alias("needs_review"))
    lists = _lists(spark)
    got = M.accept(answers, M.select_fields(_candidates(spark, sf_dir), _model_rules(spark), lists), lists)
    return got.select("row", "outcome", F.array_join("accepted_value", ",").alias("value"), F.array_join("codes", ",").alias("codes"))


@query("""SELECT p_partkey AS "row", CASE p_partkey % 6 WHEN 0 THEN 'Crime,Money claims' ELSE 'AUTOMOBILE,building' END AS allowed FROM part WHERE p_partkey % 6 IN (0, 4)""")
def model_allowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.allowed_values(_candidates(spark, sf_dir), _lists(spark)).select("row", F.array_join("allowed", ",").alias("allowed"))


@query("""SELECT count(*) AS calls, sum(event_id % 3)::BIGINT AS retries, count(*) FILTER (event_id % 10 = 0) AS failed, sum(user_id)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS output_tokens FROM events""")
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return M.usage(read(spark, sf_dir, "events").select((e % 3 + 1).alias("attempts"), (e % 10 != 0).alias("parsed"), F.col("user_id").alias("input_tokens"), (e % 100).alias("output_tokens")))


# --- addresses and suggestions ---------------------------------------------------------


def _addresses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers' addresses; a candidate table that has their building, a rival of the same name, or nothing; lookups with failures."""
    k = F.col("c_custkey")
    area = F.concat(F.lit("A"), F.char((66 + F.floor(k / 630) % 20).cast("long")))  # postcodes grow with the table
    post = lambda c: F.concat(area, (c % 90 + 10).cast("string"), F.lit(" "), (c % 9).cast("string"), F.lit("XY"))
    house = F.concat((k % 977).cast("string"), F.lit(" King St"))
    code = F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, "nonsense").when(k % 10 == 2, "BT1 1AA").otherwise(F.concat(post(k), k.cast("string")))
    clean = F.when(k % 10 > 2, post(k)).otherwise(code)
    a = read(spark, sf_dir, "customer").select(k.alias("row"), F.lit(1).alias("index"), house.alias("line_1"), F.lit(None).cast("string").alias("line_2"), F.lit("Leeds").alias("town"), F.lit(None).cast("string").alias("county"), clean.alias("postcode"))
    one = a.filter("postcode like 'A%'").select("postcode", (F.col("row") % 977).alias("n")).distinct()
    no = F.lit(None).cast("string")
    numbered = F.col("n").cast("string")
    c = one.filter("n % 4 > 0").select("postcode", F.col("n").alias("position"), F.concat(F.lit("u"), numbered).alias("uprn"), no.alias("organisation"), numbered.alias("number"), no.alias("name"), F.lit("King Street").alias("street"), F.lit("Leeds").alias("town"), no.alias("county"), F.concat(numbered, F.lit(" KING STREET, LEEDS")).alias("address"), F.when(F.col("n") % 4 != 3, F.col("postcode")).alias("found_postcode"))
    lookups = one.select("postcode").distinct().select("postcode", F.when(F.ascii(F.substring("postcode", 6, 1)) - 48 == 8, F.lit(None)).otherwise(200).cast("int").alias("http_status"))
    return a, c, lookups


@query("""SELECT c_custkey AS "row", CASE WHEN c_custkey % 10 = 0 THEN 'missing_postcode' WHEN c_custkey % 10 = 1 THEN 'invalid_postcode' WHEN c_custkey % 10 = 2 THEN 'unsupported' WHEN c_custkey % 9 = 8 THEN 'unavailable'
WHEN c_custkey % 977 % 4 = 0 THEN 'other' WHEN c_custkey % 977 % 4 = 3 THEN 'review_required' ELSE 'auto_normalised' END AS status FROM customer""")
def address_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the building itself is no candidate, others decide by similarity, which SQL can't say: these are one class here."""
    got = A.verified(*_addresses(spark, sf_dir))
    own = (F.col("row") % 10 > 2) & (F.col("row") % 9 != 8) & (F.col("row") % 977 % 4 == 0)
    return got.select("row", F.when(own, "other").otherwise(F.col("status")).alias("status"))


@query()
def address_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(A.verified(*_addresses(spark, sf_dir)))


@query()
def address_candidates_for_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c, lookups = _addresses(spark, sf_dir)
    return A.for_model(A.verified(a, c, lookups), c)


@query()
def slug_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's misspelt name against the names there are; tested against difflib."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    wrong = F.when(k % 3 == 0, F.concat(F.lit("x"), F.substr("p_name", F.lit(2)))).when(k % 3 == 1, F.replace("p_name", F.lit("i"), F.lit("ii"))).otherwise(F.concat(F.col("p_name"), F.lit("s")))
    known = p.select(T.slugify(F.col("p_name")).alias("slug"), F.col("p_name").alias("name")).distinct()
    asked = p.select("p_partkey", T.slugify(wrong).alias("slug"), wrong.alias("raw"))
    return suggest.best_names(asked, known, "p_partkey").select("p_partkey", "suggested_slug", F.round("confidence", 6).alias("confidence"))


# --- from sheets to plans ----------------------------------------------------------------


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of a court, with completion times as ISO text or as spreadsheet serials."""
    k = F.col("o_orderkey")
    serial = F.concat((F.date_diff("o_orderdate", F.lit("1899-12-30").cast("date"))).cast("string"), F.lit(".0"))
    when = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(serial)
    source = F.struct(k.alias("source_row_number"), when.alias("completion_time"), F.lit(None).cast("string").alias("last_modified_time"), F.lit("2999-01-01").alias("start_time"))
    found = I.rules((k % 3 == 0, I.issue("x", "INVALID_POSTCODE", "warning", "wrong")), (k % 3 == 1, I.issue("x", "ADDRESS_NOTE", "info", "note")))
    got = read(spark, sf_dir, "orders").select(k.alias("source_row_number"), F.when(F.col("o_custkey") % 10 > 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("court_slug"), source.alias("source"), found.alias("issues"))
    return got.withColumn("status", I.status(F.col("issues")))


_DATED_SQL = """r AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 10 > 0 THEN 'c' || o_custkey END AS slug, CASE WHEN o_custkey % 10 > 0 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) ELSE 1 END AS n,
first(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS top, o_custkey FROM orders)"""


@query(f"WITH {_DATED_SQL} SELECT k AS source_row_number, CASE WHEN n > 1 THEN 'skipped' WHEN k % 3 = 0 THEN 'needs_human_review' ELSE 'processed' END AS status, CASE WHEN n > 1 THEN top END AS superseded_by, (k % 3 = 1 OR (k % 3 = 0 AND n = 1))::INTEGER AS issues FROM r")
def authoritative_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.select_authoritative(_dated(spark, sf_dir))
    return got.select("source_row_number", "status", "superseded_by", F.size("issues").alias("issues"))


@query(f"""WITH {_DATED_SQL}, s AS (SELECT *, CASE WHEN n > 1 THEN 'skipped' WHEN k % 3 = 0 OR (slug IS NOT NULL AND o_custkey % 4 = 0) THEN 'needs_human_review' ELSE 'processed' END AS status, CASE WHEN k % 3 = 1 OR (k % 3 = 0 AND n = 1) THEN 1 ELSE 0 END + CASE WHEN n = 1 AND slug IS NOT NULL AND o_custkey % 4 = 0 THEN 1 ELSE 0 END AS i FROM r)
SELECT count(*) AS records, count(DISTINCT slug) AS courts, count(*) FILTER (status = 'processed') AS processed, 0::BIGINT AS processed_with_warnings, count(*) FILTER (status = 'needs_human_review') AS needs_human_review, 0::BIGINT AS failed, count(*) FILTER (status = 'skipped') AS skipped, sum(i)::BIGINT AS issues FROM s""")
def existence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    courts = read(spark, sf_dir, "customer").filter("c_custkey % 4 > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_custkey").cast("string").alias("id"))
    return records.summary(records.check_existence(records.select_authoritative(_dated(spark, sf_dir)), courts))


@query("""WITH p AS (SELECT c_custkey, ['building_facilities', 'address', 'contact_detail', 'court_opening_hours'] AS r FROM customer WHERE c_custkey > 0 AND c_custkey % 6 > 0), a AS (SELECT c_custkey, unnest(r) AS resource FROM p)
SELECT resource, CASE WHEN resource IN ('building_facilities', 'address') THEN 'pending' ELSE 'ready' END AS readiness, count(*) AS n FROM a WHERE NOT (resource = 'building_facilities' AND c_custkey % 3 = 2) GROUP BY ALL""")
def action_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of the sheet of customers; the nested records are stored first, so that each wide plan is planned once."""
    built = stored(records.build_records(_sheet(spark, sf_dir)), "records")
    key = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    courts = read(spark, sf_dir, "customer").filter("c_custkey % 6 > 0").select(key.alias("slug"), F.col("c_custkey").cast("string").alias("id"))
    lists = _lists(spark).unionByName(spark.createDataFrame([("opening_hour_types", 2, "OPEN", "Court open", "o3", [])], _lists(spark).schema))
    plan = actions.plan(records.check_existence(built, courts), lists)
    return plan.groupBy("resource", "readiness").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN p_size WHEN p_partkey % 5 = 2 THEN 3 WHEN p_partkey % 5 = 3 THEN p_size + 2 ELSE 1 END::INTEGER AS rooms FROM part""")
def room_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    said = F.when(k % 5 == 1, n).when(k % 5 == 2, "Three").when(k % 5 == 3, F.concat(n, F.lit(" small rooms and two large rooms"))).otherwise(F.lit("see the desk"))
    return read(spark, sf_dir, "part").select("p_partkey", T.room_count(said, k % 5 > 0).alias("rooms"))


@query("""SELECT c_custkey, regexp_replace(replace(replace(replace(c_name, '#', ' | '), '|', ' - '), '&', ' and '), '^', 'care of ') || ' ''' || c_mktsegment || '''' AS shown FROM customer""")
def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.concat(F.lit("C / o "), F.replace("c_name", F.lit("#"), F.lit(" | ")), F.lit(" ‘"), "c_mktsegment", F.lit("’"))
    return read(spark, sf_dir, "customer").select("c_custkey", T.api_text(typed).alias("shown"))


@query("""SELECT s_suppkey, 'care of ' || lower(replace(s_name, '#', ' ')) || ' and sons ' || s_suppkey || ' high street' AS canonical FROM supplier""")
def canonical_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.concat(F.lit("c/o "), "s_name", F.lit(" & Sons, "), F.col("s_suppkey").cast("string"), F.lit(" Hígh  St."))
    return read(spark, sf_dir, "supplier").select("s_suppkey", canonical_address(typed).alias("canonical"))


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of changes, upserted batch by batch into a table of the latest one per user."""
    schema = "user_id long, ts timestamp, event_id long, event_type string"
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type").repartition(3).write.parquet(f"{at}/changes")
    latest.keep_latest(latest.read_changes(spark, f"{at}/changes", schema), ["user_id"], ["ts", "event_id"], f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return latest.current(spark, f"{at}/table", spark.createDataFrame([], schema).schema).select("user_id", "event_type", "event_id")


# --- planned against live sections -----------------------------------------------------


@query("""WITH n AS (SELECT o_orderkey AS k, o_orderkey % 6 > 0 AS live, o_orderstatus AS ls, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS lp, CASE WHEN o_orderkey % 3 = 0 THEN 'X' WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS ns, CASE WHEN o_orderkey % 2 = 0 THEN 'P' END AS np FROM orders),
m AS (SELECT *, coalesce(ns, CASE WHEN live THEN ls END) AS status, coalesce(CASE WHEN live THEN lp END, np, 'none') AS priority FROM n)
SELECT k AS o_orderkey, live AS has_existing, live AND status IS NOT DISTINCT FROM ls AND priority IS NOT DISTINCT FROM lp AS no_change, CASE WHEN live THEN 'update' ELSE 'create' END AS purpose,
'{' || CASE WHEN status IS NULL THEN '' ELSE '"status":"' || status || '",' END || '"priority":"' || priority || '"}' AS operation_body FROM m""")
def section_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = lambda s, p: F.struct(k.cast("string").alias("id"), s.alias("status"), p.alias("priority"))
    live = F.when(k % 6 > 0, body(F.col("o_orderstatus"), F.when(k % 4 > 0, F.col("o_orderpriority"))))
    new = F.struct(F.lit(None).cast("string").alias("id"), F.when(k % 3 == 0, "X").when(k % 3 == 1, F.col("o_orderstatus")).alias("status"), F.when(k % 2 == 0, "P").alias("priority"))
    df = read(spark, sf_dir, "orders").select("o_orderkey", live.alias("live"), new.alias("new"))
    return compare.sections(df, "live", "new", fallbacks=("priority",), defaults={"priority": F.lit("none")}).select("o_orderkey", "has_existing", "no_change", "purpose", "operation_body")


_ITEMS_SQL = """live AS (SELECT o_custkey AS court, coalesce(nullif(CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE '' END, ''), 'untyped-' || o_orderkey) AS key, o_orderkey::VARCHAR AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 > 0),
new AS (SELECT o_custkey AS court, o_orderpriority AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 = 0),
a AS (SELECT court, key, count(*) AS n, min(id) AS id, min(s) AS s FROM live GROUP BY 1, 2), b AS (SELECT court, key, count(*) AS n, min(s) AS s FROM new GROUP BY 1, 2),
ops AS (SELECT coalesce(a.court, b.court) AS court, coalesce(a.key, b.key) AS key, CASE WHEN coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1 THEN 'conflict' WHEN b.n IS NULL THEN 'preserve' WHEN a.n IS NULL THEN 'create' WHEN a.s = b.s THEN 'no_change' ELSE 'update' END AS operation, a.id, coalesce(b.s, a.s) AS s FROM a FULL JOIN b ON a.court = b.court AND a.key = b.key)"""


def _item_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of a court by type: live ones, some without a type, and submitted ones."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("court", F.col("o_custkey"))
    item = lambda i, s: F.struct(i.alias("id"), s.alias("status")).alias("body")
    live = o.filter(k % 3 > 0).select("court", N.business_key(F.when(k % 4 > 0, F.col("o_orderpriority")), k).alias("key"), item(k.cast("string"), F.col("o_orderstatus")))
    new = o.filter(k % 7 == 0).select("court", N.business_key(F.col("o_orderpriority"), k).alias("key"), item(F.lit(None).cast("string"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return compare.collections(live, new, ["court"], live.schema["body"].dataType)


@query(f"WITH {_ITEMS_SQL} SELECT court, key, operation, CASE operation WHEN 'create' THEN 'POST' WHEN 'update' THEN 'PUT' END AS method, CASE operation WHEN 'update' THEN id END AS item_id, CASE WHEN operation <> 'conflict' THEN s END AS status FROM ops")
def collection_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_operations(spark, sf_dir).select("court", "key", "operation", "method", "item_id", F.col("body.status").alias("status"))


@query(f"""WITH {_ITEMS_SQL}, g AS (SELECT court, count(*) FILTER (operation = 'create') AS creates, count(*) FILTER (operation = 'update') AS updates, count(*) FILTER (operation = 'preserve') AS preserved, count(*) FILTER (operation = 'conflict') AS conflicts, count(*) FILTER (operation = 'no_change') AS unchanged FROM ops GROUP BY 1)
SELECT *, updates + preserved + unchanged + conflicts > 0 AS has_existing, creates + updates + conflicts = 0 AND preserved + unchanged > 0 AS no_change FROM g""")
def collection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.section_state(_item_operations(spark, sf_dir), ["court"])


@query(f"WITH {_ITEMS_SQL} SELECT court, key, s <> 'X' AS valid FROM ops WHERE operation IN ('create', 'update')")
def merged_operation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = {"courtId": F.col("court").cast("string"), "courtContactDescriptionId": F.col("key"), "explanation": F.when(F.col("body.status") == "X", "no <tags>")}
    return compare.checked(_item_operations(spark, sf_dir), contract.reason("contact_detail", body)).select("court", "key", "valid")
