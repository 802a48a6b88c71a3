"""Queries of the queues and the evidence that reviewers see, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evidence as E
from .operators import issues as I
from .operators import pages
from .operators import queues as Q
from .registry import query, read
from .registry_review import _plan, planned

# --- evidence ------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN lower(c_mktsegment) ELSE 'source-row-' || c_custkey END AS key, 'row-' || c_custkey || '-address-' || CASE WHEN c_custkey % 2 = 0 THEN 'addresses-1-line-1-x' ELSE 'address' END AS item FROM customer""")
def court_and_item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    fields = F.when(k % 2 == 0, F.array(F.lit("x"), F.lit("addresses[1].line_1"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "customer").select("c_custkey", E.court_key(F.when(k % 3 > 0, F.lower("c_mktsegment")).otherwise(" "), k).alias("key"), E.item_id(k, F.lit("address"), fields).alias("item"))


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records with issues of several owners."""
    e = F.col("event_id")
    found = I.rules(
        (e % 2 == 0, I.issue("addresses[1].postcode", "INVALID_POSTCODE", "warning", "m", F.col("event_type"))), (e % 3 == 0, I.issue("contacts[2].phone", "INVALID_PHONE", "warning", "m")),
        (e % 5 == 0, I.issue("opening_hours[1].type", "LLM_LOW_CONFIDENCE", "warning", "m")), (e % 7 == 0, I.issue("facilities.x", "LLM_FIELD_NORMALISED", "info", "m")), (e % 11 == 0, I.issue("court_slug", "DUPLICATE_COURT_SLUG", "warning", "m")),
    )
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("court_slug"), F.when(e % 4 == 0, "superseded").otherwise("authoritative").alias("selection_status"), found.alias("issues")).withColumn("status", I.status(F.col("issues")))


_NOTED_SQL = """i AS (SELECT event_id, 'addresses' AS root, 'INVALID_POSTCODE' AS code, true AS review, false AS info FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'contacts', 'INVALID_PHONE', false, false FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'opening_hours', 'LLM_LOW_CONFIDENCE', true, false FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'facilities_accessibility', 'LLM_FIELD_NORMALISED', false, true FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'court_identity_duplicates', 'DUPLICATE_COURT_SLUG', true, false FROM events WHERE event_id % 11 = 0)"""


@query(f"WITH {_NOTED_SQL} SELECT root AS category, code, review AS correct, CASE WHEN review THEN 'source' WHEN code = 'INVALID_PHONE' THEN 'information' ELSE 'information' END AS state, count(*) AS n FROM i GROUP BY ALL")
def issue_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = I.report(_noted(spark, sf_dir), "event_id")
    no = F.lit(False)
    return each.select(E.category(F.col("field"), F.col("code")).alias("category"), "code", E.needs_correction(F.col("code"), F.col("severity")).alias("correct"), E.guidance(F.col("code"), F.col("severity"), no, no).alias("state")).groupBy("category", "code", "correct", "state").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 2 > 0 AND event_id % 3 > 0 AND event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0 THEN 'no issues' ELSE array_to_string(list_filter([CASE WHEN event_id % 11 = 0 THEN 'DUPLICATE_COURT_SLUG: no explanation is given for this code' END,
CASE WHEN event_id % 3 = 0 THEN 'INVALID_PHONE: the phone is wrong' END, CASE WHEN event_id % 2 = 0 THEN 'INVALID_POSTCODE: the postcode is wrong: addresses[1].postcode ''' || event_type || '''' END, CASE WHEN event_id % 7 = 0 THEN 'LLM_FIELD_NORMALISED: no explanation is given for this code' END, CASE WHEN event_id % 5 = 0 THEN 'LLM_LOW_CONFIDENCE: no explanation is given for this code' END], lambda x: x IS NOT NULL), '. ') END AS said FROM events""")
def issue_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"INVALID_PHONE": "the phone is wrong", "INVALID_POSTCODE": "the postcode is wrong"}
    return _noted(spark, sf_dir).select("event_id", E.explanations(F.col("issues"), texts).alias("said"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS b, CASE WHEN p_partkey % 3 = 0 OR p_size <= 20 THEN '' ELSE 'C' || p_size END AS c FROM part""")
def raw_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.create_map(F.lit("A"), F.col("p_name"), F.lit("B"), F.col("p_brand"), F.lit("C"), F.when(F.col("p_size") > 20, F.concat(F.lit("C"), F.col("p_size").cast("string"))))
    fields = F.when(k % 3 == 0, F.array(F.lit("brand"))).otherwise(F.array(F.lit("size"), F.lit("unknown")))
    got = E.raw_cells(raw, {"brand": ["B"], "size": ["C", "Z"]}, fields)
    return read(spark, sf_dir, "part").select("p_partkey", got.alias("m")).select("p_partkey", F.coalesce(F.try_element_at("m", F.lit("B")), F.lit("")).alias("b"), F.coalesce(F.try_element_at("m", F.lit("C")), F.lit("")).alias("c"))


@query("""SELECT s_suppkey, 'Name: ' || s_name || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'Nation: ' || s_nationkey || chr(10) ELSE '' END || 'Lines: 1 a' || chr(10) || '2 b' AS shown FROM supplier""")
def readable_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(t).alias("text")) for i, t in ((1, "a"), (2, "b"))])
    lines = E.listed_items(items, lambda x: F.concat_ws(" ", x["index"].cast("string"), x["text"]))
    return read(spark, sf_dir, "supplier").select("s_suppkey", E.labelled([("Name", F.col("s_name")), ("Nation", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string"))), ("Blank", F.lit(" ")), ("Lines", lines)]).alias("shown"))


@query("""SELECT o_orderkey, 'the write was refused (HTTP ' || CASE WHEN o_orderkey % 4 = 3 THEN 500 ELSE 400 END || ')' || CASE o_orderkey % 4 WHEN 0 THEN ': bad ' || o_orderkey || '; name: too long; code: missing' WHEN 1 THEN ': line: is ' || o_orderstatus || '; error: odd' ELSE '' END AS reason FROM orders""")
def write_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.when(k % 4 == 0, F.format_string('{"message": " bad %d ", "errors": {"name": "too long", "code": "missing", "more": "left out"}}', k)).when(k % 4 == 1, F.format_string('{"errors": [{"field": "line", "message": "is %s"}, {"message": "odd"}]}', "o_orderstatus")).when(k % 4 == 2, "no json").otherwise('{"message": "secret"}')
    return read(spark, sf_dir, "orders").select("o_orderkey", E.rejection(F.when(k % 4 == 3, 500).otherwise(400), body).alias("reason"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS submitted, CASE WHEN c_custkey % 4 = 0 THEN 'near-' || c_custkey END AS suggested FROM customer""")
def missing_target_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    hint = F.format_string('{"suggested_slug": "near-%d"}', k)
    found = I.rules((k % 4 == 0, I.issue("court_slug", "COURT_SLUG_SUGGESTED", "warning", "m", F.col("c_name"), hint)), (k % 2 == 0, I.issue("court_slug", "COURT_SLUG_NOT_FOUND", "warning", "m", F.col("c_name"), F.lit("plain"))))
    return read(spark, sf_dir, "customer").select("c_custkey", E.resolution(found).alias("r")).select("c_custkey", F.col("r.submitted").alias("submitted"), F.col("r.suggested").alias("suggested"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(o_orderpriority), 1, 8) AS run_id FROM orders""")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", E.run_id(F.col("o_orderdate"), F.col("o_orderpriority")).alias("run_id"))


# --- queues ---------------------------------------------------------------------------


@query(f"""WITH {_NOTED_SQL}, s AS (SELECT e.event_id, CASE WHEN coalesce(bool_or(review), false) THEN 'needs_human_review' WHEN coalesce(bool_or(code = 'INVALID_PHONE'), false) THEN 'processed_with_warnings' ELSE 'processed' END AS status FROM events e LEFT JOIN i ON i.event_id = e.event_id AND code <> 'DUPLICATE_COURT_SLUG' WHERE e.event_id % 4 > 0 GROUP BY 1)
SELECT status, count(*) AS n FROM s GROUP BY 1""")
def operational_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.operational(_noted(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT event_id FROM events WHERE event_id % 4 > 0 AND event_id % 5 = 0""")
def records_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filtered(Q.operational(_noted(spark, sf_dir)), "needs_human_review", True, "opening_hours").select("event_id")


@query("""SELECT event_id, 'contacts[2].phone' AS field FROM events WHERE event_id % 3 = 0""")
def issues_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_code(_noted(spark, sf_dir), "INVALID_PHONE", "event_id").select("event_id", "field")


@query("""SELECT event_id, 'LLM_LOW_CONFIDENCE' AS code FROM events WHERE event_id % 5 = 0 AND event_id % 4 > 0""")
def model_review_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.model_factors(Q.operational(_noted(spark, sf_dir)), "event_id").select("event_id", "code")


@query("""SELECT count(DISTINCT user_id) FILTER (event_id % 4 > 0) AS courts, count(*) FILTER (event_id % 4 > 0 AND event_id % 5 = 0) AS model_rows, count(*) FILTER (event_id % 4 > 0 AND event_id % 5 = 0) AS model_issues, count(*) FILTER (event_id % 6 = 0) AS blocked_rows, 2 * count(*) FILTER (event_id % 6 = 0) AS blocked_addresses FROM events""")
def factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = read(spark, sf_dir, "events").filter("event_id % 6 = 0").select("event_id")
    return Q.factor_summary(Q.operational(_noted(spark, sf_dir)), bad.unionByName(bad), "event_id")


@query("""SELECT DISTINCT (o_custkey % 100)::BIGINT AS "row", o_orderstatus AS state, o_orderpriority AS label FROM orders""")
def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tasks(read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("row"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("label")))


@planned("""SELECT count(*) AS records, count(*) FILTER (r = n) AS ready_records, count(*) FILTER (r > 0 AND r < n) AS partially_ready_records, count(*) FILTER (r = 0) AS pending_records, sum(n)::BIGINT AS actions, sum(r)::BIGINT AS ready_actions, sum(n - r)::BIGINT AS pending_actions, sum(a)::BIGINT AS assumed_actions
FROM (SELECT court_slug, count(*) AS n, count(*) FILTER (readiness = 'ready') AS r, count(*) FILTER (needs_source) AS a FROM actions GROUP BY 1)""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return Q.plan_summary(_plan(spark, sf_dir)["actions"].withColumn("assumptions", F.when(F.col("needs_source"), F.array(F.lit("assumed"))).otherwise(none)))


@query("""WITH s AS (SELECT CASE WHEN user_id % 5 > 0 THEN event_type END AS email, CASE WHEN user_id % 3 > 0 THEN 'n' || (user_id % 3) END AS name, event_id FROM events), k AS (SELECT *, (row_number() OVER (PARTITION BY email, name ORDER BY event_id) - 1) // 100 AS chunk, count(*) OVER (PARTITION BY email, name) AS rows FROM s)
SELECT email, name, rows, chunk, string_agg(event_id::VARCHAR, ', ' ORDER BY event_id) AS listed FROM k GROUP BY 1, 2, 3, 4""")
def submitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return Q.submitters(read(spark, sf_dir, "events"), F.when(u % 5 > 0, F.col("event_type")), F.when(u % 3 > 0, F.concat(F.lit("n"), (u % 3).cast("string"))), "event_id", 100)


@query("""WITH g AS (SELECT o_custkey, count(*) AS rows, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row FROM orders GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT o_custkey, c AS "column", CASE c WHEN 'o_orderpriority' THEN o_orderpriority ELSE o_orderstatus END AS v, min(o_orderkey) AS t FROM orders, (VALUES ('o_orderpriority'), ('o_orderstatus')) AS x(c) GROUP BY 1, 2, 3),
k AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey, "column" ORDER BY t, v) - 1) // 3 AS chunk FROM m)
SELECT o_custkey, rows, first_row, last_row, "column", chunk, string_agg(v, '; ' ORDER BY t, v) AS listed FROM g JOIN k USING (o_custkey) GROUP BY ALL""")
def duplicate_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_sheet(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_custkey", "o_orderkey", ["o_orderpriority", "o_orderstatus"], 3)


@query("""SELECT user_id, CASE WHEN a > 5 THEN 'values' WHEN b > 60 THEN 'changes' ELSE 'courts' END AS step FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS a, count(*) AS b FROM events GROUP BY 1)""")
def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("a"), F.count("*").alias("b"))
    return got.select("user_id", Q.workflow(F.greatest(F.col("a") - 5, F.lit(0)), F.greatest(F.col("b") - 60, F.lit(0)), F.lit(0), F.lit(0)).alias("step"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.one(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 7)


@query("""SELECT o_orderkey AS action_id, 'contacts[' || (o_orderkey % 3) || '].explanation' AS field FROM orders WHERE EXISTS (SELECT 1 FROM events WHERE event_id % 400 = o_custkey % 400 AND event_id % 3 = o_orderkey % 3 AND event_id % 5 = 0)""")
def explicit_clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda k: F.concat(F.lit("contacts["), (k % 3).cast("string"), F.lit("]"))
    e = F.col("event_id")
    items = read(spark, sf_dir, "events").select((e % 400).alias("row"), F.concat(path(e), F.lit(".explanation")).alias("field"), F.when(e % 5 == 0, "clear").otherwise("set").alias("operation"), F.lit("accepted").alias("outcome"))
    return Q.clears(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("action_id"), (F.col("o_custkey") % 400).alias("row"), path(F.col("o_orderkey")).alias("section")), items)


@planned("""SELECT review_id, EXISTS (SELECT 1 FROM linked l LEFT JOIN states s USING (action_id) WHERE l.review_id = items.review_id AND coalesce(s.status, '') <> 'succeeded') AND (outcome = 'accepted' OR (kind = 'address' AND review_id % 8 > 0)) AS actionable FROM items""")
def actionable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    items = t["items"].withColumn("operation", F.lit("set")).withColumn("candidates", F.col("review_id") % 8)
    return Q.manual_selectable(items, t["linked"], t["states"]).select("review_id", "actionable")


@planned("""SELECT method, decision, count(*) AS n FROM (SELECT i.review_id, CASE WHEN d.review_id IS NOT NULL AND (d.review_id % 2 = 0 OR fine) THEN CASE WHEN d.review_id % 2 = 0 THEN 'manual' ELSE 'policy' END WHEN fine THEN 'policy' END AS method, CASE WHEN d.review_id IS NOT NULL AND (d.review_id % 2 = 0 OR fine) THEN decision WHEN fine THEN 'approved' END AS decision
FROM (SELECT *, coalesce(confidence = 'high', false) AND outcome = 'accepted' AND NOT needs_review AND length(value) <= 250 AS fine FROM items) i LEFT JOIN decisions d USING (review_id)) WHERE method IS NOT NULL GROUP BY ALL""")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    had = t["decisions"].withColumn("method", F.when(F.col("review_id") % 2 == 0, "manual").otherwise("policy"))
    return Q.policy_decisions(t["items"], had, "v1").groupBy("method", "decision").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_orderkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, CASE WHEN l_quantity < 3 THEN 400 WHEN l_quantity < 5 THEN 503 WHEN l_quantity < 7 THEN NULL ELSE 200 END AS h FROM lineitem),
b AS (SELECT a, count(*) AS planned, min(seq) FILTER (coalesce(h, 0) <> 200) AS bad FROM o GROUP BY 1), c AS (SELECT b.*, o.h FROM b LEFT JOIN o ON o.a = b.a AND o.seq = b.bad)
SELECT a AS action_id, planned, coalesce(bad - 1, planned) AS made, CASE WHEN bad IS NULL THEN 'succeeded' WHEN h = 400 THEN 'failed' ELSE 'unknown' END AS status, coalesce(bad > 1, false) AS partial FROM c""")
def write_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    q = F.col("l_quantity")
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("action_id"), seq.alias("seq"), F.when(q < 3, 400).when(q < 5, 503).when(q >= 7, 200).alias("http_status"))
    return Q.written(lines.select("action_id", "seq"), lines).select("action_id", "planned", "made", "status", "partial")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS price, (SELECT count(*) FROM lineitem) AS total FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 4950")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 100 of all lines by price, from the table stored in ranges of that order."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    got = pages.paged(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return got.page(100, 50).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"), F.lit(got.total).cast("long").alias("total"))
