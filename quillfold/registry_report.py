"""Queries of the run's summary and attention report, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import execution as X
from .operators import ordered_rules
from .operators import report as P
from .registry import query, read
from .registry_review import _ENRICHED_SQL, _HELD_SQL, _enriched, _held, _plan, planned

# --- summary ---------------------------------------------------------------------------

_ITEMS_SQL = f"""{_ENRICHED_SQL}, marked AS (SELECT *, 'court-' || ("row" % 300) AS court, outcome = 'accepted' AS actionable, CASE WHEN review_id % 9 > 0 THEN outcome = 'accepted' OR needs_review END AS approvable, CASE WHEN decision <> 'pending' THEN CASE WHEN review_id % 4 < 2 THEN 'policy' ELSE 'manual' END END AS method FROM enriched),
judged AS (SELECT *, coalesce(approvable, actionable) AS fit, actionable AND coalesce(approvable, actionable) AS can, decision <> 'approved' AND actions > 0 AND succeeded = actions AS done FROM marked)"""
_COMPARED_SQL = """compared AS (SELECT a.court_slug AS court, c.*, has_existing AND NOT no_change AND NOT conflicts AS need, p.action_id IS NOT NULL AS ok FROM comparisons c JOIN actions a USING (action_id) LEFT JOIN approvals p ON p.action_id = c.action_id AND p.current_hash = c.current_hash AND p.proposed_hash = c.proposed_hash)"""
_COURTS_SQL = """full_held AS (SELECT e.*, e.court_slug AS court, a.readiness FROM effective e JOIN actions a USING (action_id)),
by_court AS (SELECT court, CASE WHEN bool_and(effective_status = 'succeeded') THEN 'completed' WHEN bool_or(effective_status IN ('blocked', 'failed', 'unknown')) THEN 'attention_required' WHEN bool_or(effective_status = 'awaiting_approval') THEN 'awaiting_approval' WHEN bool_or(effective_status <> 'planned') THEN 'in_progress' ELSE 'not_started' END AS s,
  bool_or(NOT final AND (h1 OR h2 OR h4)) AS waits, bool_or(h1) AS unchosen FROM full_held GROUP BY 1)"""
_ATTEMPTS_SQL = """attempts AS (SELECT 'court-' || (user_id % 300) AS court, CASE WHEN event_id % 3 = 0 THEN event_id % 4 END AS accepted, event_id % 2 AS rejected, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS uncertain, event_id % 900 AS request_ms, CASE WHEN event_id % 5 > 0 THEN event_id % 30 END AS persistence_ms FROM events)"""

_HOLD_TESTS = dict(zip(X.HOLDS, ("h1", "h2", "h3", "h4"), strict=True))
_SENT = "coalesce(accepted, 0) + rejected + uncertain"
_FACTS_SQL = [
    *[("full_held", "1", s, n, t) for s, n, t in [("totals", "actions", "true"), ("replacements", "not_checked", "true"), ("totals", "attention_actions", "effective_status IN ('blocked', 'failed', 'unknown')"), ("completion", "not_completed", "effective_status IN ('planned', 'awaiting_approval', 'ready', 'running')"), ("completion", "terminal", "effective_status IN ('succeeded', 'blocked', 'failed', 'unknown')")]],
    *[("full_held", "1", "action_status", v, f"effective_status = '{v}'") for v in X.ACTION_STATUSES],
    *[("full_held", "1", "court_holds", h, f"NOT final AND {t}") for h, t in _HOLD_TESTS.items()], ("full_held", "1", "court_holds", "held_by_approvals", "NOT final AND (h1 OR h2 OR h4)"),
    *[("full_held", "1", "review_progress", n, "readiness = 'pending'") for n in ("invalid_sections", "outstanding")],
    ("by_court", "1", "totals", "courts", "true"), ("by_court", "1", "court_holds", "without_known_approval_hold", "NOT waits"), ("by_court", "1", "source_selections", "pending_courts", "unchosen"),
    *[("by_court", "1", "court_status", v, f"s = '{v}'") for v in X.COURT_STATUSES],
    *[("judged", w, "value_approvals", n, t) for w, n, t in [
        ("1", "total", "can"), ("1", "approved", "can AND decision = 'approved'"), ("1", "manual_approved", "can AND decision = 'approved' AND method <> 'policy'"), ("1", "auto_approved", "can AND decision = 'approved' AND method = 'policy'"), ("1", "auto_approved_total", "decision = 'approved' AND method = 'policy'"),
        ("1", "denied", "can AND decision = 'denied'"), ("1", "already_executed", "can AND done"), ("1", "not_actionable", "NOT actionable"), ("CASE WHEN decision IN ('approved', 'denied') THEN 0 ELSE 1 END - CASE WHEN done THEN 1 ELSE 0 END", "pending", "can")]],
    *[("judged", "1", "review_progress", n, "fit AND decision = 'pending'") for n in ("pending_values", "outstanding", "ingestion_or_value_review", "source_or_value_review")],
    ("judged", "1", "review_progress", "pending_execution_values", "fit AND decision = 'pending' AND actionable"), ("judged", "1", "review_progress", "denied_values", "fit AND decision = 'denied'"),
    *[("compared", w, "replacements", n, t) for w, n, t in [("1", "comparisons", "true"), ("-1", "not_checked", "true"), ("1", "required", "need"), ("1", "approved", "need AND ok"), ("1", "pending", "need AND NOT ok")]],
    *[("compared", "1", "review_progress", n, t) for n, t in [("existing_data_approvals", "need AND NOT ok"), ("ambiguous_comparisons", "conflicts"), ("outstanding", "conflicts OR (need AND NOT ok)")]],
    ("(SELECT court_slug AS court FROM selections)", "1", "source_selections", "selected", "true"),
    *[("judged", "1", "review_progress", n, "outcome = 'no_value' AND review_id % 11 = 0") for n in ("source_corrections", "source_or_value_review", "outstanding")],
    *[("judged", "1", "review_progress", n, '"row" % 37 = 0') for n in ("ingestion_review", "ingestion_or_value_review")],
    *[("attempts", w, s, n, f"{w} > 0") for w, s, n in [(_SENT, "writes", "sent"), ("rejected + uncertain", "writes", "rejected_or_uncertain"), ("accepted", "writes", "accepted"), ("rejected", "writes", "rejected"), ("uncertain", "writes", "uncertain"), ("request_ms", "timing_ms", "request"), ("persistence_ms", "timing_ms", "persistence")]],
]
_SUMMARY_SQL = f""", {_HELD_SQL}, {_ITEMS_SQL}, {_COMPARED_SQL}, {_COURTS_SQL}, {_ATTEMPTS_SQL}, facts AS ({" UNION ALL ".join(f"SELECT '{s}' AS section, '{n}' AS name, court, {w} AS weight FROM {source} WHERE {t}" for source, w, s, n, t in _FACTS_SQL)}
UNION ALL {" UNION ALL ".join(f"SELECT '{s}', '{n}', NULL, 0" for s, names in P.COUNTERS.items() for n in names)})
SELECT section, name, CASE WHEN name = 'not_checked' THEN greatest(sum(n), 0) ELSE sum(n) END::BIGINT AS items, count(court) FILTER (n > 0) AS courts FROM (SELECT section, name, court, sum(weight) AS n FROM facts GROUP BY ALL) GROUP BY section, name"""


@planned(_SUMMARY_SQL)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of the run over actions, courts, items, comparisons, attempts and open work, as one relation."""
    t = _plan(spark, sf_dir)
    i = F.col("review_id")
    court = lambda c: F.concat(F.lit("court-"), (F.col(c) % 300).cast("string")).alias("court_slug")
    items = _enriched(t).withColumns({
        "court_slug": court("row"), "actionable": F.col("outcome") == "accepted", "approvable": F.when(i % 9 > 0, (F.col("outcome") == "accepted") | F.col("needs_review")),
        "method": F.when(F.col("decision") != "pending", F.when(i % 4 < 2, "policy").otherwise("manual")),
    })
    compared = X.with_comparison(t["actions"].select("action_id", "court_slug"), t["comparisons"], t["approvals"]).filter("compared")
    e = F.col("event_id")
    attempts = read(spark, sf_dir, "events").select(court("user_id"), F.when(e % 3 == 0, e % 4).alias("accepted"), (e % 2).alias("rejected"), F.when(e % 7 == 0, 1).otherwise(0).alias("uncertain"), (e % 900).alias("request_ms"), F.when(e % 5 > 0, e % 30).alias("persistence_ms"))
    return P.summary(_held(t), items, compared, t["selections"].select("court_slug"), items.filter((F.col("outcome") == "no_value") & (i % 11 == 0)).select("court_slug"), items.filter(F.col("row") % 37 == 0).select("court_slug"), attempts)


# --- attention report ------------------------------------------------------------------

THEMES = [P.Rule("write_timeout", ("timed out",), ("unknown",)), P.Rule("invalid_contact", ("phone does not match", "email does not match")), P.Rule("unavailable", http=(500, 599)), P.Rule("request_refused", http=(400, 400))]
CLASSES = [P.Rule("address_review", ("server error",), resources=("address",)), P.Rule("rejected", statuses=("failed",)), P.Rule("rejected", http=(400, 599)), P.Rule("uncertain", statuses=("unknown",)), P.Rule("invalid_form_data", resources=("contact_detail", "court_opening_hours"))]

_LEVEL_SQL = {"resource": ["resource"], "status": ["resource", "effective_status"], "outcome": ["resource", "effective_status", "http_status", "said", "classification"], "theme": ["theme"]}
_KEYS = ["resource", "effective_status", "http_status", "said", "classification", "theme"]


def _level(name: str, keys: list[str]) -> str:
    shown = ", ".join(f"{k if k in keys else ('NULL::INTEGER' if k == 'http_status' else 'NULL::VARCHAR')} AS {k}" for k in _KEYS)
    return f"""SELECT '{name}' AS level, {shown}, count(*) AS actions, count(DISTINCT court_slug) AS courts, arg_min(state_reason, action_id) FILTER (state_reason <> '') AS example_reason, array_to_string(list_sort(list(DISTINCT court_slug))[1:5], ',') AS example_courts FROM shown GROUP BY {", ".join(f"shown.{k}" for k in keys)}"""


@planned(f""", {_HELD_SQL}, shown AS (SELECT *, coalesce(nullif(state_reason, ''), '{P.SILENT}') AS said,
CASE WHEN contains(state_reason, 'timed out') AND effective_status = 'unknown' THEN 'write_timeout' WHEN contains(state_reason, 'phone does not match') OR contains(state_reason, 'email does not match') THEN 'invalid_contact' WHEN http_status BETWEEN 500 AND 599 THEN 'unavailable' WHEN http_status = 400 THEN 'request_refused' ELSE 'other' END AS theme,
CASE WHEN resource = 'address' AND contains(state_reason, 'server error') THEN 'address_review' WHEN effective_status = 'failed' OR http_status BETWEEN 400 AND 599 THEN 'rejected' WHEN effective_status = 'unknown' THEN 'uncertain' WHEN resource IN ('contact_detail', 'court_opening_hours') THEN 'invalid_form_data' ELSE 'human_review' END AS classification
FROM effective WHERE effective_status IN ('blocked', 'failed', 'unknown')) {" UNION ALL ".join(_level(n, k) for n, k in _LEVEL_SQL.items())}""")
def attention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.attention(_held(_plan(spark, sf_dir)), THEMES, CLASSES)


# --- rules over texts ------------------------------------------------------------------

_MARKS = 900  # rule k looks for a mark of three letters made of k, then for that mark with a blank before it and one letter changed


@query(f"""WITH digits AS (SELECT k, chr((97 + k % 26)::INTEGER) AS a, chr((97 + k * 7 // 26 % 26)::INTEGER) AS b, chr((97 + (k * 11 + 3) % 26)::INTEGER) AS c FROM range({_MARKS}) r(k)),
rules AS (SELECT k, a || b || c AS mark FROM digits UNION ALL SELECT k, ' ' || a || c || b FROM digits)
SELECT d.doc_id, coalesce('rule-' || min(k), 'other') AS rule FROM documents d LEFT JOIN rules ON contains(d.text, mark) GROUP BY d.doc_id""")
def first_of_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of 900 ordered rules with 1,800 marks that holds for each whole text, each text read once."""
    three = [(chr(97 + k % 26), chr(97 + k * 7 // 26 % 26), chr(97 + (k * 11 + 3) % 26)) for k in range(_MARKS)]
    rules = [(f"rule-{k}", [a + b + c, f" {a}{c}{b}"]) for k, (a, b, c) in enumerate(three)]
    return read(spark, sf_dir, "documents").select("doc_id", ordered_rules.first_rule(F.col("text"), rules, "other").alias("rule"))
