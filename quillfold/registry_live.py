"""Queries of plans against live tables: comparison scans by digest trees, plans derived anew, repairs, preflight. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bodies, derive, digests, preflight
from .registry import query, read
from .registry_review import REASONS, RESOURCES, _sql_list
from .sources import commits
from .sources.stored import scratch, stored
from .streaming import actions as live

# --- comparison scans ------------------------------------------------------------------

_LIVE_SQL = f"""WITH plan AS (SELECT o_orderkey AS action_id, 'court-' || (o_orderkey // 8) AS court_slug, {_sql_list(RESOURCES)}[o_orderkey % 8 + 1] AS resource, md5(o_custkey || ':' || o_orderpriority) AS hash FROM orders),
live AS (SELECT court_slug, resource, CASE WHEN action_id % 997 = 5 THEN md5('edited' || action_id) ELSE hash END AS hash FROM plan WHERE action_id % 499 <> 3 UNION ALL SELECT 'only-' || court_slug, resource, hash FROM plan WHERE action_id % 1009 = 7)"""


def _plan_and_live(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as planned sections; the live ones lack some, have others edited, and some of their own."""
    k = F.col("o_orderkey")
    resource = F.get(F.array(*[F.lit(r) for r in RESOURCES]), (k % 8).cast("int"))
    plan = read(spark, sf_dir, "orders").select(k.alias("action_id"), F.concat(F.lit("court-"), F.floor(k / 8).cast("string")).alias("court_slug"), resource.alias("resource"), F.md5(F.concat(F.col("o_custkey").cast("string"), F.lit(":"), "o_orderpriority")).alias("hash"))
    a = F.col("action_id")
    edited = F.when(a % 997 == 5, F.md5(F.concat(F.lit("edited"), a.cast("string")))).otherwise(F.col("hash"))
    live = plan.filter(a % 499 != 3).select("court_slug", "resource", edited.alias("hash"))
    return plan, live.unionByName(plan.filter(a % 1009 == 7).select(F.concat(F.lit("only-"), "court_slug").alias("court_slug"), "resource", "hash"))


@query(f"{_LIVE_SQL} SELECT action_id, l.court_slug IS NOT NULL AS has_existing, coalesce(l.hash = p.hash, false) AS no_change, l.hash AS current_hash, p.hash AS proposed_hash FROM plan p LEFT JOIN live l USING (court_slug, resource)")
def bulk_comparison_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.bulk_comparisons(*_plan_and_live(spark, sf_dir))


@query(f"""{_LIVE_SQL} SELECT coalesce(p.court_slug, l.court_slug) AS court_slug, coalesce(p.resource, l.resource) AS resource, CASE WHEN l.court_slug IS NULL THEN 'only_left' WHEN p.court_slug IS NULL THEN 'only_right' ELSE 'changed' END AS kind, p.hash AS left_hash, l.hash AS right_hash
FROM (SELECT court_slug, resource, hash FROM plan) p FULL JOIN live l ON p.court_slug = l.court_slug AND p.resource = l.resource WHERE p.hash IS DISTINCT FROM l.hash""")
def snapshot_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, live = _plan_and_live(spark, sf_dir)
    return digests.differences(digests.snapshot(plan.drop("action_id"), digests.SECTION), digests.snapshot(live, digests.SECTION))


# --- plans derived anew ----------------------------------------------------------------

_PLANS_SQL = f"""WITH original AS (SELECT o_orderkey AS action_id, 'court-' || (o_custkey // 2) AS court_slug, o_custkey AS "row", {_sql_list(RESOURCES)}[o_orderkey % 8 + 1] AS resource, 'old ' || o_orderpriority AS body FROM orders),
shifted AS (SELECT action_id + 1000000000 AS action_id, court_slug, "row", resource, replace(body, 'old', 'new') AS body FROM original WHERE "row" % 10 <> 3 AND action_id % 17 <> 1 UNION ALL SELECT action_id + 2000000000, court_slug, "row" + 100000000, resource, 'more' FROM original WHERE action_id % 23 = 2),
overrides AS (SELECT DISTINCT "row", 'moved-' || "row" AS court_slug FROM original WHERE "row" % 29 = 4),
derived AS (SELECT action_id, coalesce(o.court_slug, s.court_slug) AS court_slug, "row", resource, body FROM shifted s LEFT JOIN overrides o USING ("row")),
succeeded AS (SELECT action_id FROM original WHERE action_id % 19 = 6)"""


def _plans(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    resource = F.get(F.array(*[F.lit(r) for r in RESOURCES]), (k % 8).cast("int"))
    original = read(spark, sf_dir, "orders").select(k.alias("action_id"), F.concat(F.lit("court-"), F.floor(c / 2).cast("string")).alias("court_slug"), c.alias("row"), resource.alias("resource"), F.concat(F.lit("old "), "o_orderpriority").alias("body"))
    a, r = F.col("action_id"), F.col("row")
    derived = original.filter((r % 10 != 3) & (a % 17 != 1)).select((a + 1_000_000_000).alias("action_id"), "court_slug", "row", "resource", F.replace("body", F.lit("old"), F.lit("new")).alias("body"))
    more = original.filter(a % 23 == 2).select((a + 2_000_000_000).alias("action_id"), "court_slug", (r + 100_000_000).alias("row"), "resource", F.lit("more").alias("body"))
    overrides = original.filter(r % 29 == 4).select("row", F.concat(F.lit("moved-"), r.cast("string")).alias("court_slug")).distinct()
    return {"original": original, "derived": derived.unionByName(more), "overrides": overrides, "succeeded": original.filter(a % 19 == 6).select("action_id")}


_DERIVED_SQL = f"""{_PLANS_SQL}, protected AS (SELECT DISTINCT court_slug, resource FROM original WHERE action_id IN (SELECT action_id FROM succeeded)),
once AS (SELECT court_slug, resource, "row", min(action_id) AS old_id FROM original GROUP BY ALL HAVING count(*) = 1),
met AS (SELECT DISTINCT court_slug FROM original WHERE "row" IN (SELECT "row" FROM derived) UNION SELECT court_slug FROM derived),
next_plan AS (SELECT coalesce(old_id, action_id) AS action_id, d.court_slug, d."row", d.resource, body, CASE WHEN old_id IS NULL THEN 'new' ELSE 'kept_id' END AS origin FROM derived d LEFT JOIN once o ON o.court_slug = d.court_slug AND o.resource = d.resource AND o."row" = d."row" WHERE (d.court_slug, d.resource) NOT IN (SELECT (court_slug, resource) FROM protected)
UNION ALL SELECT action_id, court_slug, "row", resource, body, 'protected' FROM original WHERE (court_slug, resource) IN (SELECT (court_slug, resource) FROM protected)
UNION ALL SELECT action_id, court_slug, "row", resource, body, 'retained' FROM original WHERE (court_slug, resource) NOT IN (SELECT (court_slug, resource) FROM protected) AND court_slug NOT IN (SELECT court_slug FROM met))"""


@query(f"{_DERIVED_SQL} SELECT * FROM next_plan")
def derived_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plans(spark, sf_dir)
    return derive.derive(t["original"], t["derived"], t["succeeded"], t["overrides"])


_STATES = ["blocked", "failed", "awaiting_approval", "planned", "succeeded", "unknown"]
_MARKS = " OR ".join(f"contains(state_reason, '{m}')" for m in derive.REPAIRED)


@query(f"""{_DERIVED_SQL}, plan AS (SELECT action_id, court_slug, CASE WHEN action_id % 5 = 1 THEN 'pending' ELSE 'ready' END AS ready FROM next_plan),
states AS (SELECT action_id, court_slug, {_sql_list(_STATES)}[(action_id // 4) % 6 + 1] AS status, {_sql_list(REASONS)}["row" % 5 + 1] AS state_reason FROM original WHERE action_id % 3 > 0),
judged AS (SELECT s.*, CASE WHEN s.court_slug NOT IN (SELECT court_slug FROM plan) OR status IN ('succeeded', 'unknown') THEN NULL WHEN p.ready IS NULL THEN CASE WHEN status IN ('blocked', 'failed') AND ({_MARKS}) THEN 'removed' END
  WHEN s.action_id % 41 = 8 THEN 'omitted' WHEN status IN ('blocked', 'failed') AND ({_MARKS}) AND p.ready = 'ready' THEN 'reset' END AS change FROM states s LEFT JOIN plan p ON p.action_id = s.action_id AND p.court_slug = s.court_slug)
SELECT action_id, court_slug, CASE change WHEN 'omitted' THEN 'succeeded' WHEN 'reset' THEN 'planned' WHEN 'removed' THEN NULL ELSE status END AS status, CASE WHEN change = 'omitted' THEN 'every item was omitted; nothing is written' WHEN change IS NULL THEN state_reason END AS reason, change, coalesce(change IN ('removed', 'reset'), false) AS invalidates FROM judged""")
def plan_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plans(spark, sf_dir)
    a = F.col("action_id")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    plan = derive.derive(t["original"], t["derived"], t["succeeded"], t["overrides"]).select("action_id", "court_slug", F.when(a % 5 == 1, "pending").otherwise("ready").alias("readiness"))
    states = t["original"].filter(a % 3 > 0).select("action_id", "court_slug", pick(_STATES, F.floor(a / 4) % 6).alias("status"), pick(REASONS, F.col("row") % 5).alias("state_reason"))
    return derive.reconcile(states, plan, t["original"].filter(a % 41 == 8).select("action_id"))


@query("""SELECT p_partkey AS action_id, array_to_string(list_filter([CASE WHEN known AND p_size % 5 > 0 AND p_size % 4 <> 1 THEN 'liftDoorWidth' END, CASE WHEN known AND p_size % 7 <> 6 AND p_size % 3 = 2 THEN 'liftDoorLimit' END], lambda x: x IS NOT NULL), ',') AS defaulted,
CASE p_partkey % 4 WHEN 0 THEN known AND p_size % 5 > 0 AND p_size % 4 <> 1 WHEN 1 THEN known AND p_size % 5 > 0 AND p_size % 4 <> 1 AND p_size % 7 <> 6 AND p_size % 3 = 2 ELSE false END AS settled
FROM (SELECT *, p_partkey % 6 > 0 AND p_partkey % 11 > 0 AND p_size % 9 > 0 AS known FROM part)""")
def legacy_lift_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    p = read(spark, sf_dir, "part")
    width, limit = F.when(s % 5 == 0, 90), F.when(s % 7 == 6, 400)
    reason = F.when(k % 4 == 0, "liftDoorWidth is required when lift is true").when(k % 4 == 1, "liftDoorWidth is required when lift is true; liftDoorLimit is required when lift is true").when(k % 4 == 2, "email is not an e-mail address")
    actions = p.select(k.alias("action_id"), k.alias("row"), F.when(k % 6 > 0, "accessibility_options").otherwise("address").alias("resource"), reason.alias("reason"), F.struct((k % 11 > 0).alias("lift"), width.cast("int").alias("liftDoorWidth"), limit.cast("int").alias("liftDoorLimit")).alias("body"))
    evidence = p.select(k.alias("row"), (s % 9 > 0).alias("lift_available"), F.when(s % 4 == 1, "80 cm").when(s % 4 == 2, " Unknown").otherwise("n/a").alias("lift_door_width"), F.when(s % 3 == 2, "not applicable").otherwise("400kg").alias("lift_weight_limit"))
    return derive.legacy_defaults(actions, evidence).select("action_id", F.array_join("defaulted", ",").alias("defaulted"), "settled")


# --- preflight -------------------------------------------------------------------------

_FLIGHT_SQL = f"""WITH lines AS (SELECT l_orderkey AS action_id, l_orderkey || '-' || l_linenumber AS item_id, l_linenumber AS position, 'type-' || (l_partkey % 25) AS key, CASE WHEN l_quantity = 7 THEN '' ELSE CAST(l_quantity::INTEGER AS VARCHAR) END AS value,
  CASE WHEN l_suppkey % 6 > 0 THEN 'P' || (l_suppkey % 40) END AS postcode, CASE WHEN l_partkey % 7 < 2 THEN 'verified' ELSE 'review_required' END AS evidence, CASE WHEN l_returnflag = 'A' THEN 'u' || (l_partkey % 5) END AS approved_uprn, l_returnflag, l_linestatus FROM lineitem),
actions AS (SELECT o_orderkey AS action_id, 'court-' || o_custkey AS court_slug, (o_orderkey % 5)::INTEGER AS "row", {_sql_list(RESOURCES)}[(o_orderkey // 8) % 8 + 1] AS resource, CASE WHEN o_orderkey % 13 = 5 THEN 'pending' ELSE 'ready' END AS readiness, o_orderkey % 10 = 1 AS needs_source, CASE WHEN o_orderkey % 31 = 0 THEN 'old' WHEN o_orderkey % 2 = 0 THEN 'id-' || o_custkey END AS court_id, o_orderkey % 39 = 5 AS settled, o_custkey FROM orders),
states AS (SELECT o_orderkey AS action_id, ['succeeded', 'blocked', 'planned', 'failed', 'ready'][(o_orderkey // 16) % 5 + 1] AS status FROM orders WHERE o_orderkey % 3 > 0),
omitted AS (SELECT DISTINCT item_id FROM lines WHERE l_returnflag = 'R'),
left_over AS (SELECT * FROM lines ANTI JOIN omitted USING (item_id)),
many AS (SELECT action_id, count(*) AS n, count(o.item_id IS NULL OR NULL) AS kept FROM lines LEFT JOIN omitted o USING (item_id) GROUP BY 1),
courts AS (SELECT 'court-' || c_custkey AS court_slug, CASE c_custkey % 20 WHEN 0 THEN NULL WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS http, 'id-' || c_custkey AS id FROM customer WHERE c_custkey % 37 > 0),
selections AS (SELECT 'court-' || c_custkey AS court_slug, (c_custkey % 5)::INTEGER AS selected_row FROM customer WHERE c_custkey % 3 > 0),
unapproved AS (SELECT DISTINCT action_id FROM (SELECT o_orderkey AS action_id, unnest([o_orderkey % 1000, o_custkey % 777]) AS r FROM orders WHERE o_orderkey % 6 = 1) WHERE r % 4 = 0),
asked AS (SELECT action_id, position, postcode, approved_uprn, CASE substr(postcode, 2)::INTEGER % 10 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 429 ELSE 200 END AS http FROM left_over WHERE evidence <> 'verified' AND postcode IS NOT NULL),
lost AS (SELECT *, CASE WHEN http IS NULL THEN 'address_unknown' WHEN http = 200 AND approved_uprn IS NOT NULL AND substr(approved_uprn, 2)::INTEGER > 2 THEN 'address_blocked' WHEN http = 404 THEN 'address_blocked' WHEN http <> 200 THEN 'address_unknown' END AS verdict FROM asked),
address AS (SELECT action_id, verdict, http FROM lost WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY action_id ORDER BY position, verdict, http NULLS FIRST) = 1),
live AS (SELECT court_slug, resource, key, CASE WHEN l_linestatus = 'O' THEN value ELSE value || '!' END AS value FROM lines JOIN actions USING (action_id) WHERE position <= 2 AND action_id % 3 = 0),
counted AS (SELECT court_slug, resource, key, count(*) AS n_live, min(value) AS live_value FROM live GROUP BY ALL),
own AS (SELECT action_id, court_slug, resource, key, count(*) AS n, min(value) AS value, count(*) FILTER (value = '') AS bad FROM left_over JOIN actions USING (action_id) GROUP BY ALL),
facts AS (SELECT action_id, count(*) FILTER (n > 1 OR coalesce(n_live, 0) > 1) AS conflicts, sum(bad) AS bad, count(*) FILTER (n_live IS NULL OR value IS DISTINCT FROM live_value) AS changed FROM own LEFT JOIN counted USING (court_slug, resource, key) GROUP BY 1),
existing AS (SELECT court_slug, resource, count(*) AS n FROM live GROUP BY ALL),
judged AS (SELECT a.action_id, CASE WHEN s.status = 'succeeded' THEN 'already_succeeded' WHEN resource IN ('address', 'contact_detail', 'court_opening_hours') AND m.kept = 0 THEN 'all_items_omitted'
  WHEN (coalesce(c.http, 0) NOT IN (200, 404)) AND s.status = 'blocked' THEN 'left_blocked' WHEN coalesce(c.http, 0) NOT IN (200, 404) THEN 'court_lookup_failed' WHEN c.http = 404 THEN 'court_missing' WHEN a.court_id <> c.id THEN 'court_id_changed'
  WHEN needs_source AND selected_row IS NULL THEN 'source_not_selected' WHEN needs_source AND selected_row <> a."row" THEN 'other_row_selected' WHEN u.action_id IS NOT NULL THEN 'values_not_approved'
  WHEN readiness <> 'ready' AND NOT settled THEN 'plan_not_ready' WHEN coalesce(m.kept, 0) = 0 THEN 'empty_body' WHEN resource = 'address' AND d.verdict IS NOT NULL THEN d.verdict
  WHEN a.o_custkey % 23 = 0 THEN 'section_lookup_failed' WHEN a.o_custkey % 23 = 1 THEN 'section_unexpected' WHEN f.conflicts > 0 THEN 'merge_conflict' WHEN f.bad > 0 THEN 'merged_body_invalid'
  WHEN e.n > 0 AND f.changed = 0 THEN 'no_change' WHEN e.n > 0 AND a.action_id % 4 < 2 THEN 'replacement_not_approved' ELSE 'ready' END AS outcome, c.http AS court_http, d.http AS address_http, CASE a.o_custkey % 23 WHEN 0 THEN NULL WHEN 1 THEN 500 ELSE 200 END AS section_http
  FROM actions a LEFT JOIN states s USING (action_id) LEFT JOIN many m USING (action_id) LEFT JOIN courts c USING (court_slug) LEFT JOIN selections USING (court_slug) LEFT JOIN unapproved u USING (action_id) LEFT JOIN address d USING (action_id) LEFT JOIN facts f USING (action_id) LEFT JOIN existing e USING (court_slug, resource))"""
_TOLD_SQL = "CASE outcome " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in preflight.STATUS.items()) + " END"


def flight_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as actions, their lines as items, customers as courts; live sections from lines of some orders, approvals by the hashes of both sides."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    slug = lambda x: F.concat(F.lit("court-"), F.col(x).cast("string")).alias("court_slug")
    actions = o.select(
        k.alias("action_id"), slug("o_custkey"), (k % 5).cast("int").alias("row"), pick(RESOURCES, F.floor(k / 8) % 8).alias("resource"), F.when(k % 13 == 5, "pending").otherwise("ready").alias("readiness"), (k % 10 == 1).alias("needs_source"),
        F.when(k % 31 == 0, "old").when(k % 2 == 0, F.concat(F.lit("id-"), c.cast("string"))).alias("court_id"), (k % 39 == 5).alias("settled"),
    )
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("action_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_linenumber").alias("position"), text("type-", p % 25).alias("key"), F.when(F.col("l_quantity") == 7, "").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"),
        F.when(s % 6 > 0, text("P", s % 40)).alias("postcode"), F.when(p % 7 < 2, "verified").otherwise("review_required").alias("evidence"), F.when(F.col("l_returnflag") == "A", text("u", p % 5)).alias("approved_uprn"), "l_returnflag", "l_linestatus",
    )
    h = F.col("c_custkey")
    posts = stored(lines.filter("postcode is not null").select("postcode").distinct(), "postcodes")
    place = F.substring("postcode", 2, 9).cast("int") % 10
    live = stored(lines.filter("position <= 2 and action_id % 3 = 0").join(actions.select("action_id", "court_slug", "resource"), "action_id").select("court_slug", "resource", "key", F.when(F.col("l_linestatus") == "O", F.col("value")).otherwise(F.concat("value", F.lit("!"))).alias("value")), "live")
    items = lines.drop("l_returnflag", "l_linestatus")
    omitted = lines.filter("l_returnflag = 'R'").select("item_id", F.lit("omit").alias("decision"))
    ready = preflight.prepared({"items": items, "resolutions": omitted, "live": live}, F.col("value") == "")
    # What somebody approved: the section as it is now for some actions, as it was for others.
    seen = actions.filter("action_id % 4 > 0").select("action_id", *preflight.SECTION).join(ready["current"], preflight.SECTION).join(ready["proposed"].filter("n_sent > 0"), "action_id")
    approvals = seen.select("action_id", F.when(F.col("action_id") % 4 == 1, "before").otherwise(F.col("current_hash")).alias("current_hash"), "proposed_hash")
    return ready | {
        "actions": actions, "items": items, "resolutions": omitted, "live": live, "approvals": approvals,
        "states": o.filter(k % 3 > 0).select(k.alias("action_id"), pick(["succeeded", "blocked", "planned", "failed", "ready"], F.floor(k / 16) % 5).alias("status")),
        "courts": customers.filter(h % 37 > 0).select(slug("c_custkey"), F.when(h % 20 == 1, 503).when(h % 20 == 2, 404).when(h % 20 > 0, 200).alias("http_status"), text("id-", h).alias("court_id")),
        "selections": customers.filter(h % 3 > 0).select(slug("c_custkey"), (h % 5).cast("int").alias("selected_row")),
        "links": o.filter(k % 6 == 1).select(k.alias("action_id"), F.explode(F.array(k % 1000, c % 777)).alias("review_id")),
        "approved": spark.range(1000).filter("id % 4 > 0").select(F.col("id").alias("review_id")),
        "lookups": posts.select("postcode", F.when(place == 1, 404).when(place == 2, 429).when(place > 0, 200).alias("http_status")),
        "candidates": posts.select("postcode", F.explode(F.array(*[F.lit(f"u{i}") for i in range(3)])).alias("uprn")),
        "sections": actions.select("court_slug", "resource").distinct().withColumn("n", F.substring("court_slug", 7, 12).cast("int") % 23).select("court_slug", "resource", F.when(F.col("n") == 1, 500).when(F.col("n") > 0, 200).alias("http_status")),
    }


@query(f"""{_FLIGHT_SQL} SELECT action_id, outcome, {_TOLD_SQL} AS status, CASE WHEN outcome IN ('left_blocked', 'court_lookup_failed', 'court_missing', 'court_id_changed') THEN court_http WHEN outcome IN ('address_blocked', 'address_unknown') THEN address_http WHEN outcome IN ('section_lookup_failed', 'section_unexpected') THEN section_http END AS http_status FROM judged""")
def preflight_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outcomes of a preflight, each from the table that decides it."""
    return preflight.preflight(flight_tables(spark, sf_dir), F.col("value") == "")


# --- bodies of unknown schema -----------------------------------------------------------

_BODIES_SQL = """WITH before AS (SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","who":{"key":' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ',"tags":["a","b"]' ELSE '' END || '},"items":[{"index":3,"v":' || (o_orderkey % 7) || '},{"createdAt":5,"index":1,"w":null}]' || CASE WHEN o_orderkey % 5 = 0 THEN ',"extra":{"deep":{"x":true}}' WHEN o_orderkey % 5 = 1 THEN ',"extra":"none"' ELSE '' END || '}' AS body FROM orders),
after AS (SELECT o_orderkey AS id, '{"id":0,"status":"' || CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END || '","who":{' || CASE WHEN o_orderkey % 6 = 0 THEN '"tags":["c"]' ELSE '"key":' || o_custkey END || '}' || CASE WHEN o_orderkey % 10 = 5 THEN ',"extra":7' WHEN o_orderkey % 10 = 6 THEN ',"extra":{"deep":{"y":1}}' ELSE '' END || '}' AS body FROM orders)"""


def _bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as JSON bodies of mixed shapes, and what is submitted for them."""
    k, o = F.col("o_orderkey"), read(spark, sf_dir, "orders")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts]).alias("body")
    s, c = F.col("o_orderstatus"), F.col("o_custkey")
    tags = F.when(k % 3 == 0, ',"tags":["a","b"]').otherwise("")
    extra = F.when(k % 5 == 0, ',"extra":{"deep":{"x":true}}').when(k % 5 == 1, ',"extra":"none"').otherwise("")
    before = o.select(k.alias("id"), text('{"id":', k, ',"status":"', s, '","who":{"key":', c, tags, '},"items":[{"index":3,"v":', k % 7, '},{"createdAt":5,"index":1,"w":null}]', extra, "}"))
    who = F.when(k % 6 == 0, '"tags":["c"]').otherwise(F.concat(F.lit('"key":'), c.cast("string")))
    more = F.when(k % 10 == 5, ',"extra":7').when(k % 10 == 6, ',"extra":{"deep":{"y":1}}').otherwise("")
    return before, o.select(k.alias("id"), text('{"id":0,"status":"', F.when(k % 4 == 0, "X").otherwise(s), '","who":{', who, "}", more, "}"))


def _leaves_sql(table: str, arrays: bool = True) -> str:
    """Leaves of a table of bodies (id, body): what has no children, by path; the whole array where arrays aren't walked."""
    inside = "true" if arrays else "NOT contains(fullkey, '[')"
    kinds = "('OBJECT', 'ARRAY')" if arrays else "('OBJECT')"
    return f"""(SELECT b.id, replace(fullkey[3:], '"', '') AS path, value::VARCHAR AS value FROM {table} b, json_tree(b.body) t WHERE type NOT IN {kinds} AND type <> 'NULL' AND {inside} AND NOT regexp_matches(fullkey, '(id|createdAt|updatedAt)$') AND fullkey <> '$')"""


@query(f"""{_BODIES_SQL}, a AS {_leaves_sql("before")}, b AS {_leaves_sql("after")}
SELECT coalesce(a.id, b.id) AS id, coalesce(a.path, b.path) AS field, a.value AS before, b.value AS after FROM a FULL JOIN b ON a.id = b.id AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value""")
def body_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.differences(*_bodies(spark, sf_dir), ["id"], "body")


@query(f"""{_BODIES_SQL}, m AS (SELECT before.id, json_merge_patch(before.body::JSON, after.body::JSON) AS body FROM before JOIN after USING (id)), l AS {_leaves_sql("m", False)}
SELECT id, path, value FROM l WHERE NOT (id % 9 = 1 AND (path = 'who' OR starts_with(path, 'who.')))""")
def body_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the merged bodies; for some orders all of who is cleared."""
    before, after = _bodies(spark, sf_dir)
    return bodies.merged(before, after, ["id"], "body", clears=before.filter("id % 9 = 1").select("id", F.lit("who").alias("path"))).select("id", "path", "value")


@query(f"""{_BODIES_SQL}, s AS (SELECT id, replace(body, '"index":3,"v":' || (id % 7), '"index":3,"v":"new"') AS body FROM before) SELECT * FROM {_leaves_sql("s")}""")
def body_paths_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of index 3 gets another value, though it stands first; an item that isn't there stays so. Read again as leaves, items by position after they were put in order of their index."""
    before, _ = _bodies(spark, sf_dir)
    edits = before.select("id", F.explode(F.array(F.struct(F.lit("items[3].v").alias("path"), F.lit('"new"').alias("value")), F.struct(F.lit("items[9].v").alias("path"), F.lit("1").alias("value")))).alias("e")).select("id", "e.path", "e.value")
    got = bodies.leaves(bodies.with_path(before, ["id"], "body", edits), ["id"], "body")
    return got.withColumn("path", F.when(F.col("path").startswith("items["), F.translate("path", "01", "10")).otherwise(F.col("path")))


# --- state in a log of commits ---------------------------------------------------------

_WRITES_SQL = """WITH base AS (SELECT o_orderkey AS action_id, o_orderstatus AS status, (o_custkey % 50)::INTEGER AS saved_at FROM orders),
writes AS (SELECT *, 1 AS version FROM base UNION ALL SELECT action_id, 'second', (action_id % 60)::INTEGER, 2 FROM base WHERE action_id % 3 = 1
UNION ALL SELECT action_id + 7, 'third', saved_at, 3 FROM base WHERE action_id % 4 = 0 UNION ALL SELECT action_id, 'fourth', 49, 5 FROM base WHERE action_id % 5 < 2)"""


@query(f"{_WRITES_SQL} SELECT action_id, arg_max(status, (saved_at, version)) AS status, max(saved_at) AS saved_at, count(*) AS writes FROM writes GROUP BY action_id")
def committed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as state: a consolidated table, three later writes and a compaction between them; the last save counts, a later commit at a tie."""
    root = scratch(spark, "commits")
    k = F.col("action_id")
    base = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("action_id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 50).cast("int").alias("saved_at"))
    done = commits.commit(base, root, 0)
    done = commits.commit(base.filter(k % 3 == 1).select("action_id", F.lit("second").alias("status"), (k % 60).cast("int").alias("saved_at")), root, done.version)
    commits.append(base.filter(k % 4 == 0).select((k + 7).alias("action_id"), F.lit("third").alias("status"), "saved_at"), root)
    commits.compact(spark, root, base.schema, ["action_id"], ["saved_at"], at=done.version)
    commits.append(base.filter(k % 5 < 2).select("action_id", F.lit("fourth").alias("status"), F.lit(49).alias("saved_at")), root)
    b = F.col("action_id")
    wrote = base.select(b, F.explode(F.array_compact(F.array(b, F.when(b % 3 == 1, b), F.when(b % 4 == 0, b + 7), F.when(b % 5 < 2, b)))).alias("key")).groupBy(F.col("key").alias("action_id")).agg(F.count("*").alias("writes"))
    return commits.current(spark, root, base.schema, ["action_id"], ["saved_at"]).join(wrote, "action_id")


# --- states from a stream --------------------------------------------------------------

STALE = 3 * 86_400

_STREAM_SQL = f"""WITH e AS (SELECT user_id AS action_id, ts::TIMESTAMP AS t, event_id, CASE WHEN event_id % 35 = 2 THEN 'edit' WHEN event_id % 5 = 0 THEN 'comparison' WHEN event_id % 5 < 3 THEN 'approval' ELSE 'transition' END AS kind, event_id % 2 AS hash,
  CASE WHEN event_id % 5 > 2 THEN {_sql_list(["running", "failed", "planned"])}[event_id % 3 + 1] END AS status, event_id % 4 < 2 AS attempt FROM events),
placed AS (SELECT *, row_number() OVER w AS pos, epoch_us(t) // 1000 AS ms, coalesce(epoch_us(lead(t) OVER w) // 1000, (SELECT max(epoch_us(t) // 1000) FROM e)) AS next_ms,
  last_value(CASE kind WHEN 'comparison' THEN hash WHEN 'edit' THEN -1 END IGNORE NULLS) OVER (PARTITION BY action_id ORDER BY t, event_id) AS cur FROM e WINDOW w AS (PARTITION BY action_id ORDER BY t, event_id)),
marked AS (SELECT *, lag(cur) OVER (PARTITION BY action_id ORDER BY pos) AS before FROM placed),
ends AS (SELECT action_id, max(pos) FILTER (kind = 'approval' AND cur = hash) AS yes, max(pos) FILTER (kind = 'edit' OR (kind = 'comparison' AND before IS DISTINCT FROM cur)) AS no, max(pos) FILTER (kind = 'transition') AS said, arg_max(status, pos) FILTER (kind = 'transition') AS status,
  count(*) FILTER (kind = 'transition' AND attempt) AS attempts, count(*) AS events, max(ms) AS last_ms, nullif(arg_max(cur, pos), -1) AS compared_hash FROM marked GROUP BY 1)
SELECT n.action_id, CASE WHEN n.status = 'running' AND (SELECT bool_or(m.next_ms - m.ms > {1000 * STALE}) FROM marked m WHERE m.action_id = n.action_id AND m.pos >= n.said) THEN 'unknown' ELSE n.status END AS status, compared_hash, coalesce(yes > coalesce(no, 0), false) AS approved, attempts, events, last_ms FROM ends n"""


@query(_STREAM_SQL)
def streamed_action_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as files, read as a stream and folded into the state of every action; SQL says the same of the whole table."""
    at, k = scratch(spark, "action-stream"), F.col("event_id")
    kind = F.when(k % 35 == 2, "edit").when(k % 5 == 0, "comparison").when(k % 5 < 3, "approval").otherwise("transition")
    said = F.when(k % 5 > 2, F.get(F.array(F.lit("running"), F.lit("failed"), F.lit("planned")), (k % 3).cast("int")))
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("action_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", kind.alias("kind"), (k % 2).alias("hash"), said.alias("status"), (k % 4 < 2).alias("attempt"))
    events.write.parquet(f"{at}/events")
    live.keep_states(spark.readStream.schema(live.EVENTS).parquet(f"{at}/events"), f"{at}/states", f"{at}/checkpoint", STALE).awaitTermination()
    return live.current(spark, f"{at}/states")
