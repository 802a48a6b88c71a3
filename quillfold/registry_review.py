"""Queries of the execution and review operators over a plan made of orders, with their SQL.

Every order is a planned action of a court (a group of customers); states,
comparisons, approvals, review items and decisions are derived from its columns
by fixed arithmetic, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import execution as X
from .operators import overlay as O
from .operators import review as R
from .registry import query, read

RESOURCES = ["building_facilities", "accessibility_options", "translation_services", "professional_information", "counter_service_opening_hours", "address", "contact_detail", "court_opening_hours"]
REASONS = ["timed out", "server error 500", "phone does not match", "", "period overlaps"]


def _sql_list(x: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]"


_SQL = f"""actions AS (SELECT o_orderkey AS action_id, 'court-' || (o_custkey % 300) AS court_slug, (o_orderkey % 5)::INTEGER AS "row", {_sql_list(RESOURCES)}[o_orderkey % 8 + 1] AS resource,
  CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'ready' END AS readiness, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Address verification requires review' ELSE 'body incomplete' END END AS reason, o_orderkey % 10 = 0 AS needs_source FROM orders),
states AS (SELECT o_orderkey AS action_id, {_sql_list(X.ACTION_STATUSES)}[(o_orderkey // 4) % 8 + 1] AS status, CASE WHEN o_orderkey % 3 = 0 THEN 400 WHEN o_orderkey % 3 = 1 THEN 500 END::INTEGER AS http_status, {_sql_list(REASONS)}[o_custkey % 5 + 1] AS state_reason FROM orders WHERE o_orderkey % 4 <> 0),
comparisons AS (SELECT o_orderkey AS action_id, o_orderkey % 2 = 0 AS has_existing, o_orderkey % 5 = 0 AS no_change, o_orderkey % 13 = 0 AS conflicts, o_custkey % 50 AS current_hash, o_orderkey % 17 AS proposed_hash FROM orders WHERE o_orderkey % 3 <> 1),
approvals AS (SELECT o_orderkey AS action_id, o_custkey % 50 AS current_hash, o_orderkey % 17 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS proposed_hash FROM orders WHERE o_orderkey % 6 < 3),
selections AS (SELECT DISTINCT 'court-' || (o_custkey % 300) AS court_slug, (o_custkey % 300 % 5)::INTEGER AS selected_row FROM orders WHERE o_custkey % 300 % 9 = 0),
disposed AS (SELECT DISTINCT (o_orderkey % 5)::INTEGER AS "row", 'court-' || (o_custkey % 300) AS court_slug FROM orders WHERE o_custkey % 300 % 11 = 0 AND o_orderkey % 5 < 2),
active AS (SELECT a.*, s.selected_row FROM actions a LEFT JOIN selections s USING (court_slug) WHERE NOT EXISTS (SELECT 1 FROM disposed d WHERE d."row" = a."row" AND d.court_slug = a.court_slug) AND (NOT needs_source OR selected_row IS NULL OR selected_row = a."row")),
changes AS (SELECT a.*, c.has_existing, c.no_change, c.conflicts, c.action_id IS NOT NULL AS compared, p.action_id IS NOT NULL AS approved FROM active a LEFT JOIN comparisons c ON c.action_id = a.action_id
  LEFT JOIN approvals p ON p.action_id = c.action_id AND p.current_hash = c.current_hash AND p.proposed_hash = c.proposed_hash),
items AS (SELECT event_id AS review_id, (user_id % 400)::INTEGER AS "row", CASE WHEN event_id % 4 = 0 THEN 'address' ELSE 'field' END AS kind, CASE WHEN event_id % 4 = 0 THEN 'addresses[' || (event_id % 12) || ']' ELSE 'contacts[' || (event_id % 3) || '].' || event_type END AS field,
  CASE WHEN value < 20 THEN 'high' WHEN value < 50 THEN 'medium' WHEN value < 80 THEN 'low' END AS confidence, event_type || ':' || props AS value, event_id % 6 = 0 AS needs_review, CASE WHEN event_id % 5 = 0 THEN 'no_value' ELSE 'accepted' END AS outcome FROM events),
decisions AS (SELECT event_id AS review_id, CASE WHEN event_id % 7 = 0 THEN 'denied' ELSE 'approved' END AS decision FROM events WHERE event_id % 3 <> 0),
linked AS (SELECT o_orderkey AS action_id, e AS review_id FROM (SELECT o_orderkey, unnest([o_orderkey % 1000, o_custkey % 777]) AS e FROM orders WHERE o_orderkey % 2 = 1) GROUP BY ALL)"""


def _plan(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    slug = F.concat(F.lit("court-"), (c % 300).cast("string")).alias("court_slug")
    row = (k % 5).cast("int").alias("row")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    reason = F.when(k % 3 == 0, F.when(k % 2 == 0, "Address verification requires review").otherwise("body incomplete"))
    e = read(spark, sf, "events")
    i = F.col("event_id")
    field = F.when(i % 4 == 0, F.concat(F.lit("addresses["), (i % 12).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("contacts["), (i % 3).cast("string"), F.lit("]."), "event_type"))
    sure = F.when(F.col("value") < 20, "high").when(F.col("value") < 50, "medium").when(F.col("value") < 80, "low")
    t = {
        "actions": o.select(k.alias("action_id"), slug, row, pick(RESOURCES, k % 8).alias("resource"), F.when(k % 3 == 0, "pending").otherwise("ready").alias("readiness"), reason.alias("reason"), (k % 10 == 0).alias("needs_source")),
        "states": o.filter(k % 4 != 0).select(k.alias("action_id"), pick(X.ACTION_STATUSES, F.floor(k / 4) % 8).alias("status"), F.when(k % 3 == 0, 400).when(k % 3 == 1, 500).alias("http_status"), pick(REASONS, c % 5).alias("state_reason")),
        "comparisons": o.filter(k % 3 != 1).select(k.alias("action_id"), (k % 2 == 0).alias("has_existing"), (k % 5 == 0).alias("no_change"), (k % 13 == 0).alias("conflicts"), (c % 50).alias("current_hash"), (k % 17).alias("proposed_hash")),
        "approvals": o.filter(k % 6 < 3).select(k.alias("action_id"), (c % 50).alias("current_hash"), (k % 17 + F.when(k % 7 == 0, 1).otherwise(0)).alias("proposed_hash")),
        "selections": o.filter(c % 300 % 9 == 0).select(slug, (c % 300 % 5).cast("int").alias("selected_row")).distinct(),
        "disposed": o.filter((c % 300 % 11 == 0) & (k % 5 < 2)).select(row, slug).distinct(),
        "items": e.select(i.alias("review_id"), (F.col("user_id") % 400).cast("int").alias("row"), F.when(i % 4 == 0, "address").otherwise("field").alias("kind"), field.alias("field"), sure.alias("confidence"), F.concat("event_type", F.lit(":"), "props").alias("value"), (i % 6 == 0).alias("needs_review"), F.when(i % 5 == 0, "no_value").otherwise("accepted").alias("outcome")),
        "decisions": e.filter(i % 3 != 0).select(i.alias("review_id"), F.when(i % 7 == 0, "denied").otherwise("approved").alias("decision")),
        "linked": o.filter(k % 2 == 1).select(k.alias("action_id"), F.explode(F.array(k % 1000, c % 777)).alias("review_id")).distinct(),
    }
    t["active"] = X.active_actions(t["actions"], t["selections"], t["disposed"])
    t["changes"] = X.with_comparison(t["active"], t["comparisons"], t["approvals"])
    return t


def planned(sql: str):
    return query(f"WITH {_SQL} {sql}")


# --- comparisons and approvals ---------------------------------------------------


@planned("SELECT action_id, selected_row FROM active")
def active_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)["active"].select("action_id", "selected_row")


@planned("SELECT resource, count(*) AS n FROM actions a LEFT JOIN states s USING (action_id) WHERE coalesce(status, 'planned') IN ('planned', 'awaiting_approval', 'ready') GROUP BY 1")
def actions_to_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    return X.to_attempt(t["actions"], t["states"]).groupBy("resource").agg(F.count("*").alias("n"))


@planned("""SELECT count(*) AS total, count(*) FILTER (compared) AS checked, count(*) FILTER (NOT compared) AS not_checked, count(*) FILTER (compared AND no_change AND NOT conflicts) AS no_change,
count(*) FILTER (compared AND NOT has_existing AND NOT no_change AND NOT conflicts) AS empty_target, count(*) FILTER (compared AND has_existing AND NOT no_change AND NOT conflicts AND NOT approved) AS approval_required,
count(*) FILTER (compared AND has_existing AND NOT no_change AND NOT conflicts AND approved) AS approved, count(*) FILTER (compared AND conflicts) AS conflicts FROM changes""")
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.comparison_summary(_plan(spark, sf_dir)["changes"])


@planned("SELECT action_id FROM changes WHERE NOT compared OR conflicts OR (has_existing AND NOT no_change AND NOT approved)")
def changes_needing_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)["changes"].filter(X.needs_review()).select("action_id")


@planned("""SELECT hold, count(*) AS n FROM (SELECT unnest(list_filter(['all', CASE WHEN needs_source AND selected_row IS NULL THEN 'source_selection' END, CASE WHEN NOT compared THEN 'target_not_checked' END,
CASE WHEN has_existing AND NOT no_change AND NOT approved THEN 'target_replacement' END, CASE WHEN readiness = 'pending' AND NOT coalesce(contains(reason, 'Address verification'), false) THEN 'invalid_request' END,
CASE WHEN readiness = 'pending' AND contains(reason, 'Address verification') THEN 'os_resolution' END, CASE WHEN s.status IN ('blocked', 'failed', 'unknown') THEN 'execution_attention' END], lambda x: x IS NOT NULL)) AS hold FROM changes LEFT JOIN states s USING (action_id)) GROUP BY 1""")
def change_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    names = ["source_selection", "target_not_checked", "target_replacement", "invalid_request", "os_resolution", "execution_attention", "all"]
    held = t["changes"].join(t["states"], "action_id", "left").select(F.explode(F.array_compact(F.array(*[F.when(X.has_hold(h), h) for h in names]))).alias("hold"))
    return held.groupBy("hold").agg(F.count("*").alias("n"))


_NEW_SQL = "newer AS (SELECT action_id, has_existing, no_change, conflicts, current_hash, proposed_hash + CASE WHEN action_id % 4 = 0 THEN 1 ELSE 0 END AS proposed_hash FROM comparisons WHERE action_id % 9 < 4 UNION ALL SELECT action_id + 100000000, true, false, false, 1, 1 FROM comparisons WHERE action_id % 50 = 0)"


def _newer(t: dict[str, DataFrame]) -> DataFrame:
    k = F.col("action_id")
    c = t["comparisons"]
    again = c.filter(k % 9 < 4).withColumn("proposed_hash", F.col("proposed_hash") + F.when(k % 4 == 0, 1).otherwise(0))
    return again.unionByName(c.filter(k % 50 == 0).select((k + 100000000).alias("action_id"), F.lit(True).alias("has_existing"), F.lit(False).alias("no_change"), F.lit(False).alias("conflicts"), F.lit(1).cast("long").alias("current_hash"), F.lit(1).cast("long").alias("proposed_hash")))


@planned(f""", {_NEW_SQL}, after AS (SELECT * FROM newer UNION ALL SELECT * FROM comparisons WHERE action_id NOT IN (SELECT action_id FROM newer)),
left_over AS (SELECT * FROM approvals WHERE action_id NOT IN (SELECT o.action_id FROM comparisons o JOIN newer n USING (action_id) WHERE o.current_hash <> n.current_hash OR o.proposed_hash <> n.proposed_hash))
SELECT 'comparisons' AS side, action_id, proposed_hash FROM after UNION ALL SELECT 'approvals', action_id, proposed_hash FROM left_over""")
def upsert_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    kept, left = X.upsert_comparisons(t["comparisons"], _newer(t), t["approvals"])
    side = lambda df, name: df.select(F.lit(name).alias("side"), "action_id", "proposed_hash")
    return side(kept, "comparisons").unionByName(side(left, "approvals"))


@planned("""SELECT a.action_id, CASE WHEN c.action_id IS NULL THEN 'not compared' WHEN NOT (has_existing AND NOT no_change) THEN 'no approval needed' WHEN conflicts THEN 'ambiguous matches' ELSE 'fine' END AS verdict FROM actions a LEFT JOIN comparisons c USING (action_id)""")
def approval_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    _, refused = X.approve_targets(t["comparisons"], t["approvals"], t["actions"])
    return t["actions"].select("action_id").join(refused, "action_id", "left").select("action_id", F.coalesce("refusal", F.lit("fine")).alias("verdict"))


@planned(""", wanted AS (SELECT * FROM comparisons WHERE has_existing AND NOT no_change AND NOT conflicts)
SELECT action_id, current_hash, proposed_hash FROM wanted UNION ALL SELECT * FROM approvals WHERE action_id NOT IN (SELECT action_id FROM wanted)""")
def approve_all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    now, _ = X.approve_targets(t["comparisons"], t["approvals"], t["comparisons"].filter(f"{X.APPROVABLE} and not conflicts"))
    return now


@planned(""", edited AS (SELECT action_id FROM actions WHERE resource = 'address')
SELECT (SELECT count(*) FROM comparisons WHERE action_id NOT IN (SELECT action_id FROM edited)) AS comparisons, (SELECT count(*) FROM approvals WHERE action_id NOT IN (SELECT action_id FROM edited)) AS approvals""")
def invalidated_by_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    c, a = X.invalidate(t["comparisons"], t["approvals"], t["actions"].filter("resource = 'address'"))
    return c.select(F.lit(1).alias("c"), F.lit(0).alias("a")).unionByName(a.select(F.lit(0).alias("c"), F.lit(1).alias("a"))).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("comparisons"), F.coalesce(F.sum("a"), F.lit(0)).alias("approvals"))


@planned("""SELECT count(*) AS comparisons, count(*) FILTER (need) AS required, count(*) FILTER (need AND ok) AS approved, count(*) FILTER (need AND NOT ok) AS pending, greatest((SELECT count(*) FROM active) - count(*), 0) AS not_checked
FROM (SELECT has_existing AND NOT no_change AND NOT conflicts AS need, p.action_id IS NOT NULL AS ok FROM comparisons c LEFT JOIN approvals p ON p.action_id = c.action_id AND p.current_hash = c.current_hash AND p.proposed_hash = c.proposed_hash)""")
def replacement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    return X.replacement_counts(t["comparisons"], t["approvals"], t["active"])


# --- statuses ---------------------------------------------------------------------

_HELD_SQL = """decided AS (SELECT action_id, bool_or(decision IS NULL) AS undecided, bool_or(coalesce(decision = 'denied', false)) AS denied FROM linked LEFT JOIN decisions USING (review_id) GROUP BY 1),
held AS (SELECT c.action_id, c.court_slug, c.resource, s.status, s.http_status, s.state_reason, coalesce(s.status IN ('blocked', 'failed', 'unknown', 'running', 'succeeded'), false) AS final, c.needs_source AND c.selected_row IS NULL AS h1, coalesce(undecided, false) AS h2, coalesce(denied, false) AS h3,
  coalesce(has_existing AND NOT no_change, false) AND NOT approved AS h4 FROM changes c LEFT JOIN states s USING (action_id) LEFT JOIN decided d USING (action_id)),
effective AS (SELECT *, CASE WHEN final THEN status WHEN h1 OR h2 OR h3 OR h4 THEN 'awaiting_approval' WHEN coalesce(status, 'planned') = 'awaiting_approval' THEN 'planned' ELSE coalesce(status, 'planned') END AS effective_status FROM held)"""


def _held(t: dict[str, DataFrame]) -> DataFrame:
    return X.with_holds(t["changes"], t["states"], t["linked"], t["decisions"])


@planned(f""", {_HELD_SQL} SELECT action_id, effective_status, CASE WHEN final THEN '' ELSE array_to_string(list_filter([CASE WHEN h1 THEN 'source_selection' END, CASE WHEN h2 THEN 'value_approval' END, CASE WHEN h3 THEN 'denied_value' END, CASE WHEN h4 THEN 'target_replacement' END], lambda x: x IS NOT NULL), ',') END AS holds FROM effective""")
def effective_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(_plan(spark, sf_dir)).select("action_id", "effective_status", F.array_join("holds", ",").alias("holds"))


@planned(f", {_HELD_SQL} SELECT " + ", ".join(f"count(*) FILTER (effective_status = '{v}') AS {v}" for v in X.ACTION_STATUSES) + " FROM effective")
def action_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.status_counts(_held(_plan(spark, sf_dir)), "effective_status", X.ACTION_STATUSES)


@planned(f""", {_HELD_SQL}, courts AS (SELECT court_slug, CASE WHEN bool_and(effective_status = 'succeeded') THEN 'completed' WHEN bool_or(effective_status IN ('blocked', 'failed', 'unknown')) THEN 'attention_required' WHEN bool_or(effective_status = 'awaiting_approval') THEN 'awaiting_approval'
WHEN bool_or(effective_status <> 'planned') THEN 'in_progress' ELSE 'not_started' END AS s FROM effective GROUP BY 1) SELECT """ + ", ".join(f"count(*) FILTER (s = '{v}') AS {v}" for v in X.COURT_STATUSES) + " FROM courts")
def court_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.summaries import group_status

    return X.status_counts(group_status(_held(_plan(spark, sf_dir)), ["court_slug"], "effective_status"), "group_status", X.COURT_STATUSES)


@planned(f""", {_HELD_SQL} SELECT count(DISTINCT court_slug) FILTER (NOT final AND h1) AS source_selection, count(DISTINCT court_slug) FILTER (NOT final AND h2) AS value_approval, count(DISTINCT court_slug) FILTER (NOT final AND h3) AS denied_value, count(DISTINCT court_slug) FILTER (NOT final AND h4) AS target_replacement,
count(DISTINCT court_slug) FILTER (NOT final AND (h1 OR h2 OR h4)) AS held_by_approvals, count(DISTINCT court_slug) - count(DISTINCT court_slug) FILTER (NOT final AND (h1 OR h2 OR h4)) AS without_known_approval_hold FROM effective""")
def court_hold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.hold_counts(_held(_plan(spark, sf_dir)))


@planned(f""", {_HELD_SQL}, shown AS (SELECT *, coalesce(nullif(state_reason, ''), 'No diagnostic reason was recorded') AS said FROM effective WHERE status IN ('blocked', 'failed', 'unknown'))
SELECT resource, status, http_status, said, count(*) AS action_count, count(DISTINCT court_slug) AS court_count, array_to_string(list_sort(list(DISTINCT court_slug))[1:5], ',') AS example_courts FROM shown GROUP BY 1, 2, 3, 4""")
def attention_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.attention_groups(_held(_plan(spark, sf_dir)))


@planned("""SELECT action_id, CASE WHEN s.status = 'succeeded' THEN 'already_succeeded' WHEN court_slug LIKE '%7' THEN 'court_lookup_failed' WHEN court_slug LIKE '%13' THEN 'court_missing' WHEN needs_source AND selected_row IS NULL THEN 'source_not_selected' WHEN readiness = 'pending' THEN 'plan_not_ready'
WHEN conflicts THEN 'merge_conflict' WHEN no_change THEN 'no_change' WHEN has_existing AND NOT approved THEN 'replacement_not_approved' ELSE 'ready' END AS outcome FROM changes LEFT JOIN states s USING (action_id)""")
def preflight_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    checks = {
        "no_change": F.col("no_change"), "already_succeeded": F.col("status") == "succeeded", "court_lookup_failed": F.col("court_slug").endswith("7"), "court_missing": F.col("court_slug").endswith("13"),
        "source_not_selected": F.col("needs_source") & F.col("selected_row").isNull(), "plan_not_ready": F.col("readiness") == "pending", "merge_conflict": F.col("conflicts"), "replacement_not_approved": X.replaces() & ~F.col("approved"),
    }
    return t["changes"].join(t["states"], "action_id", "left").select("action_id", X.preflight(checks)["outcome"].alias("outcome"))


@planned("""SELECT action_id, coalesce(l.status, s.status) AS status, CASE WHEN l.action_id IS NULL THEN s.state_reason ELSE l.reason END AS reason, coalesce(l.n, 0)::BIGINT AS attempts FROM (SELECT user_id AS action_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status, arg_max('r' || event_id, struct_pack(a := ts, b := event_id)) AS reason, count(*) FILTER (event_id % 2 = 0) AS n FROM events GROUP BY 1) l
FULL JOIN states s USING (action_id)""")
def state_after_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    moves = read(spark, sf_dir, "events").select(F.col("user_id").alias("action_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), F.concat(F.lit("r"), "event_id").alias("reason"), (F.col("event_id") % 2 == 0).alias("attempt"))
    return X.appended(t["states"].select("action_id", "status", F.col("state_reason").alias("reason"), F.lit(0).cast("long").alias("attempts")), moves)


@query("""SELECT count(*) AS attempts, sum(CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id % 4 END)::BIGINT AS made, sum(CASE WHEN event_id % 2 = 0 THEN user_id + 1 ELSE 7 END)::BIGINT AS planned FROM events""")
def write_attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("event_id") % 2 == 0
    told = F.format_string("stopped after %d of 7 writes", F.col("event_id") % 4)
    attempts = read(spark, sf_dir, "events").select(F.when(known, F.col("user_id")).alias("made"), F.when(known, F.col("user_id") + 1).alias("planned"), F.when(~known, told).alias("message"))
    return X.attempt_counts(attempts, "message")


@query("""SELECT l_orderkey AS action_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'R')""")
def all_items_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").alias("item_id"), "l_returnflag")
    resolutions = lines.filter("l_returnflag = 'R'").select("item_id", F.lit("omit").alias("decision")).distinct()
    return X.all_omitted(lines.select("action_id", "item_id"), resolutions)


@query("""SELECT p_partkey AS item_id, CASE WHEN p_size % 5 = 1 THEN 'type-' || (p_size % 3) ELSE p_brand END AS type_id FROM part WHERE p_size % 5 <> 0""")
def resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    s = F.col("p_size")
    told = p.filter(s % 5 < 2).select(F.col("p_partkey").alias("item_id"), F.when(s % 5 == 0, "omit").otherwise("remap").alias("decision"), F.when(s % 5 == 1, F.concat(F.lit("type-"), (s % 3).cast("string"))).alias("replacement"))
    return X.resolved_items(p.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("type_id")), told)


@planned("""SELECT a.court_slug FROM actions a LEFT JOIN states s USING (action_id) GROUP BY 1 HAVING bool_and(a."row" < 5 AND a.court_slug LIKE '%3') AND NOT bool_or(coalesce(s.status = 'succeeded' AND a.action_id % 97 = 1, false))""")
def disposed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    records = t["actions"].select("court_slug", "row").distinct()
    won = t["actions"].join(t["states"].filter("status = 'succeeded' and action_id % 97 = 1"), "action_id", "left_semi")
    return X.disposed_records(records, records.filter(F.col("court_slug").endswith("3")), won)


@query("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_type, c := event_id)) AS event_type, arg_max(event_id, struct_pack(a := ts, b := event_type, c := event_id)) AS event_id FROM events GROUP BY 1")
def latest_job_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest_jobs(read(spark, sf_dir, "events").select("user_id", "ts", "event_type", "event_id"), "user_id", "ts", ["event_type", "event_id"])


@query("SELECT l_orderkey AS action_id FROM lineitem WHERE l_discount > 0.05 OR l_tax > 0.05 GROUP BY 1 HAVING bool_and(l_returnflag IN ('A', 'N'))")
def safe_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").filter("l_discount > 0.05 or l_tax > 0.05").select(F.col("l_orderkey").alias("action_id"), F.col("l_returnflag").alias("field"))
    return X.safe_changes(d, ["A", "N"])


# --- review items -------------------------------------------------------------------

_ENRICHED_SQL = """acts AS (SELECT review_id, count(*) AS actions, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status IN ('blocked', 'failed', 'unknown')) AS attention FROM linked LEFT JOIN states USING (action_id) GROUP BY 1),
enriched AS (SELECT i.*, coalesce(d.decision, 'pending') AS decision, coalesce(actions, 0) AS actions, coalesce(succeeded, 0) AS succeeded, coalesce(attention, 0) AS attention FROM items i LEFT JOIN decisions d USING (review_id) LEFT JOIN acts USING (review_id))"""


def _enriched(t: dict[str, DataFrame]) -> DataFrame:
    return R.enriched(t["items"], t["decisions"], t["linked"], t["states"])


@planned(f", {_ENRICHED_SQL} SELECT review_id, decision, actions, succeeded, attention FROM enriched")
def enriched_review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(_plan(spark, sf_dir)).select("review_id", "decision", "actions", "succeeded", "attention")


@planned(f", {_ENRICHED_SQL} SELECT review_id FROM enriched WHERE decision = 'pending' AND coalesce(confidence, 'unavailable') = 'unavailable' AND (contains(lower(field), 'click') OR contains(lower(value), 'click'))")
def filtered_review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filtered(_enriched(_plan(spark, sf_dir)), "pending", "unavailable", "CLICK").select("review_id")


@planned("SELECT review_id, row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, \"row\", coalesce(field, ''), review_id)::INTEGER AS place FROM items QUALIFY place <= 500")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 items of the queue: a top-k report."""
    from pyspark.sql import Window as W

    first = R.in_review_order(_plan(spark, sf_dir)["items"]).limit(500)
    # The ranked rows are at most the report's.
    w = W.orderBy(R.confidence_rank(F.col("confidence")), "row", F.coalesce("field", F.lit("")), "review_id")
    return first.select("review_id", F.row_number().over(w).alias("place"))


@planned(f""", {_ENRICHED_SQL} SELECT count(*) AS total, count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'denied') AS denied, count(*) FILTER (decision = 'pending' AND NOT (actions > 0 AND succeeded = actions)) AS pending, count(*) FILTER (decision = 'pending' AND actions > 0 AND succeeded = actions) AS already_written FROM enriched""")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.decision_counts(_enriched(_plan(spark, sf_dir)))


@planned("SELECT count(*) AS items, count(*) FILTER (kind = 'field') AS field_items, count(*) FILTER (kind = 'address') AS address_items, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (needs_review) AS flagged FROM items")
def review_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_counts(_plan(spark, sf_dir)["items"])


@planned("SELECT review_id FROM items WHERE confidence = 'high' AND outcome = 'accepted' AND NOT needs_review AND length(value) <= 250")
def policy_eligible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.policy_eligible(_plan(spark, sf_dir)["items"]).select("review_id")


_OVERLAP = "(a = b OR starts_with(a, b || '.') OR starts_with(a, b || '[') OR starts_with(b, a || '.') OR starts_with(b, a || '['))"


@planned(f""", src AS (SELECT o_orderkey AS action_id, (o_custkey % 400)::INTEGER AS "row", CASE WHEN o_orderkey % 3 = 0 THEN 'addresses[1]' WHEN o_orderkey % 3 = 1 THEN 'contacts[2]' ELSE 'contacts[1].click' END AS a, o_orderkey % 50 AS named FROM orders)
SELECT DISTINCT action_id, review_id FROM (SELECT action_id, review_id FROM (SELECT action_id, review_id, a, field AS b FROM src JOIN items USING ("row")) WHERE {_OVERLAP} UNION ALL SELECT action_id, named FROM src JOIN items ON review_id = named)""")
def action_review_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, "addresses[1]").when(k % 3 == 1, "contacts[2]").otherwise("contacts[1].click")
    actions = read(spark, sf_dir, "orders").select(k.alias("action_id"), (F.col("o_custkey") % 400).cast("int").alias("row"), F.array(path).alias("source_fields"), F.array(k % 50).alias("review_ids"))
    return R.links(_plan(spark, sf_dir)["items"], actions)


@planned(f""", issues AS (SELECT o_orderkey AS id, (o_custkey % 500)::INTEGER AS "row", CASE WHEN o_orderkey % 2 = 0 THEN 'field' ELSE 'address' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'contacts[' || (o_orderkey % 3) || '].click.text' ELSE 'addresses[' || (o_orderkey % 12) || '].line_1' END AS a FROM orders)
SELECT id, EXISTS (SELECT 1 FROM items i WHERE i."row" = issues."row" AND i.kind = issues.kind) AS covered FROM issues""")
def covered_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    even = k % 2 == 0
    path = F.when(even, F.concat(F.lit("contacts["), (k % 3).cast("string"), F.lit("].click.text"))).otherwise(F.concat(F.lit("addresses["), (k % 12).cast("string"), F.lit("].line_1")))
    issues = read(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 500).cast("int").alias("row"), F.when(even, "field").otherwise("address").alias("kind"), path.alias("field"))
    return R.covered(issues, _plan(spark, sf_dir)["items"]).select("id", "covered")


@planned(""", moves AS (SELECT o_orderkey % 12000 AS review_id, o_orderkey AS t, CASE o_orderkey % 4 WHEN 0 THEN 'denied' WHEN 1 THEN 'reconsider' ELSE 'approved' END AS decision FROM orders),
last AS (SELECT review_id, arg_max(decision, t) AS d, count(*) AS events FROM moves WHERE review_id IN (SELECT review_id FROM items) GROUP BY 1)
SELECT review_id, CASE WHEN d = 'reconsider' THEN NULL ELSE coalesce(d, decision) END AS decision, coalesce(events, 0) AS events FROM decisions FULL JOIN last USING (review_id) WHERE CASE WHEN d = 'reconsider' THEN NULL ELSE coalesce(d, decision) END IS NOT NULL""")
def decisions_after_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    k = F.col("o_orderkey")
    moves = read(spark, sf_dir, "orders").select((k % 12000).alias("review_id"), k.alias("at"), F.when(k % 4 == 0, "denied").when(k % 4 == 1, "reconsider").otherwise("approved").alias("decision"))
    return R.decide(t["items"], t["decisions"], moves)


@planned("SELECT review_id, CASE WHEN review_id % 10 = 0 THEN NULL WHEN review_id % 10 = 1 THEN 'new ' || review_id ELSE value END AS value FROM items")
def patched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    i = F.col("review_id")
    patches = t["items"].filter(i % 10 < 2).select("review_id", F.when(i % 10 == 1, F.concat(F.lit("new "), i.cast("string"))).alias("value"))
    return R.patched(t["items"], patches).select("review_id", "value")


@planned("""SELECT count(*) AS n, count(DISTINCT "row") AS "rows" FROM items WHERE "row" IN (SELECT "row" FROM actions WHERE "row" < 3)""")
def authoritative_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    return R.authoritative(t["items"], t["actions"].filter("row < 3")).agg(F.count("*").alias("n"), F.count_distinct("row").alias("rows"))


@query("""WITH met AS (SELECT event_type AS theme, user_id AS e, min(event_id) AS t FROM events GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY t, e) AS k FROM met)
SELECT theme, n, distinct_examples, examples FROM (SELECT event_type AS theme, count(*) AS n, count(DISTINCT user_id) AS distinct_examples FROM events GROUP BY 1) JOIN (SELECT theme, string_agg(e::VARCHAR, ',' ORDER BY k) AS examples FROM ranked WHERE k <= 5 GROUP BY 1) USING (theme)""")
def business_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.themes(read(spark, sf_dir, "events").select(F.col("event_type").alias("theme"), "user_id", "event_id"), "theme", "user_id", "event_id")


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS only_conflicts FROM orders""")
def reasons_of_one_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "several items of type A; several items of type B").when(k % 3 == 1, "several items of type A; body invalid").otherwise(" ; ")
    return read(spark, sf_dir, "orders").select("o_orderkey", R.only_parts(said, lambda x: x.startswith("several items")).alias("only_conflicts"))


@planned("""SELECT kind AS category, count(DISTINCT "row") AS "rows", count(*) AS items FROM items GROUP BY 1 UNION ALL SELECT '(outstanding)', count(DISTINCT "row"), count(*) FROM items""")
def review_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overview(_plan(spark, sf_dir)["items"].select("row", F.col("kind").alias("category")))


@planned("""SELECT count(*) AS row_count, count(*) FILTER (d > 0) AS decision_rows, count(*) FILTER (c > 0) AS source_rows, count(*) FILTER (a > 0) AS action_rows FROM (SELECT "row", count(*) FILTER (needs_review) AS d, count(*) FILTER (outcome = 'no_value') AS c, count(*) FILTER (kind = 'address') AS a FROM items GROUP BY 1)""")
def record_queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _plan(spark, sf_dir)["items"].groupBy("row").agg(F.count_if("needs_review").alias("decisions"), F.count_if(F.col("outcome") == "no_value").alias("corrections"), F.count_if(F.col("kind") == "address").alias("actions"))
    return R.queue_summary(rows)


# --- overlays ------------------------------------------------------------------------


@query("""WITH once AS (SELECT o_custkey AS court, o_orderpriority AS resource, count(*) AS n, min(o_orderkey) AS id FROM orders GROUP BY 1, 2 HAVING count(*) = 1)
SELECT c_custkey AS court, resource, coalesce(id, -c_custkey) AS action_id FROM (SELECT c_custkey, unnest(['1-URGENT', '2-HIGH', '5-LOW']) AS resource FROM customer) LEFT JOIN once ON court = c_custkey AND once.resource = resource""".replace("once.resource = resource", "once.resource = u.resource").replace(" FROM customer) LEFT", " FROM customer) AS u LEFT").replace("AS court, resource, coalesce", "AS court, u.resource, coalesce"))
def stable_action_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("court"), F.col("o_orderpriority").alias("resource"), F.col("o_orderkey").alias("action_id"))
    derived = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("court"), F.explode(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "5-LOW")])).alias("resource"), (-F.col("c_custkey")).alias("action_id"))
    return O.stable_ids(derived, original, ["court", "resource"]).select("court", "resource", "action_id")


@planned(""", done AS (SELECT DISTINCT court_slug, resource FROM actions JOIN states USING (action_id) WHERE status = 'succeeded')
SELECT action_id, readiness FROM actions SEMI JOIN done USING (court_slug, resource) UNION ALL SELECT action_id + 1000000000, 'derived' FROM actions ANTI JOIN done USING (court_slug, resource) WHERE action_id % 2 = 0""")
def protected_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _plan(spark, sf_dir)
    own = t["actions"].select("action_id", "court_slug", "resource", "readiness")
    derived = own.filter("action_id % 2 = 0").withColumns({"action_id": F.col("action_id") + 1000000000, "readiness": F.lit("derived")})
    return O.protected(derived, own, t["states"].filter("status = 'succeeded'"), ["court_slug", "resource"]).select("action_id", "readiness")


@query("""WITH original AS (SELECT o_custkey AS court, list(o_orderkey) AS rows FROM orders GROUP BY 1), again AS (SELECT o_orderkey AS r FROM orders WHERE o_orderkey % 25 = 0)
SELECT court, true AS retained FROM original WHERE court NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 25 = 0) UNION ALL SELECT DISTINCT o_custkey, false FROM orders WHERE o_orderkey % 25 = 0""")
def retained_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    listed = lambda df: df.groupBy(F.col("o_custkey").alias("court")).agg(F.collect_list("o_orderkey").alias("rows"))
    return O.retained(listed(o.filter("o_orderkey % 25 = 0")), listed(o), "court", "rows").select("court", "retained")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def stitched_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    new = o.filter("o_custkey % 4 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    return O.stitched(o.drop("o_custkey"), new, "o_orderkey")


@query("""SELECT c_custkey AS row, 'slug-' || (c_custkey % 700) AS target, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey <> c_custkey AND s_suppkey * 3 % 700 = c_custkey % 700) AS taken FROM customer""")
def target_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = lambda k: F.concat(F.lit("slug-"), (k % 700).cast("string"))
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), slug(F.col("c_custkey")).alias("target"))
    return O.target_conflicts(wanted, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), slug(F.col("s_suppkey") * 3).alias("slug"))).select("row", "target", "taken")


@query("""SELECT name, arg_max(api_id, struct_pack(o := o_orderkey, p := p)) AS api_id FROM (SELECT o_orderkey, o_orderpriority AS name, CASE WHEN o_custkey % 3 > 0 THEN 'id-' || (o_custkey % 3) END AS api_id, 0 AS p FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, 'st-' || (o_custkey % 9), 1 FROM orders) WHERE api_id IS NOT NULL GROUP BY 1""")
def vocabulary_from_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    ids = F.array(F.when(c % 3 > 0, F.concat(F.lit("id-"), (c % 3).cast("string"))), F.concat(F.lit("st-"), (c % 9).cast("string")))
    records = read(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("names"), ids.alias("ids"))
    return O.vocabulary_from_ids(records, "names", "ids", "o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def newest_record_per_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.newest_record(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")
