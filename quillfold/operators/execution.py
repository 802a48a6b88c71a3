"""State of planned actions: comparisons, approvals bound to hashes, holds, preflight and summaries.

Tables and their columns:

* actions: action_id, court_slug, row, resource, readiness, reason, needs_source
* states: action_id, status, http_status, state_reason (one row an action)
* comparisons: action_id, has_existing, no_change, conflicts, current_hash, proposed_hash
* approvals: action_id, current_hash, proposed_hash
* selections: court_slug, selected_row

All joins are equi-joins on ids; groups are counted, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .summaries import TERMINAL, effective_status

# Statuses, outcomes and holds of actions, in the order in which they are shown or decided.
ACTION_STATUSES = ["planned", "awaiting_approval", "ready", "running", "succeeded", "failed", "blocked", "unknown"]
COURT_STATUSES = ["not_started", "in_progress", "awaiting_approval", "attention_required", "completed"]
ATTENTION = ["blocked", "failed", "unknown"]
HOLDS = ["source_selection", "value_approval", "denied_value", "target_replacement"]
PREFLIGHT = [
    ("already_succeeded", "succeeded"), ("all_items_omitted", "succeeded"), ("court_lookup_failed", "unknown"), ("court_missing", "blocked"), ("court_id_changed", "blocked"),
    ("source_not_selected", "awaiting_approval"), ("values_not_approved", "awaiting_approval"), ("plan_not_ready", "blocked"), ("empty_body", "blocked"), ("address_blocked", "blocked"), ("address_unknown", "unknown"),
    ("section_lookup_failed", "unknown"), ("merge_conflict", "blocked"), ("merged_body_invalid", "blocked"), ("no_change", "succeeded"), ("replacement_not_approved", "awaiting_approval"),
]


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """Value of the first case that holds; a null test doesn't."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def preflight(checks: dict[str, Column]) -> Column:
    """(outcome, status) of an action from its checks, in the fixed order; an action that passes all is ready. Checks not given don't hold."""
    pair = lambda rule, status: F.struct(F.lit(rule).alias("outcome"), F.lit(status).alias("status"))
    return first_match([(checks[rule], pair(rule, status)) for rule, status in PREFLIGHT if rule in checks], pair("ready", "ready"))


def after_error(kind: Column) -> Column:
    """(status, reason) of an action whose call failed: only a refusal is certain; a lost answer leaves the outcome unknown."""
    # Kinds of failures.
    said = {"timeout": ("unknown", "the call timed out"), "connection": ("failed", "the service could not be reached"), "rejected": ("failed", "the request was refused"), "invalid": ("blocked", "the request is not valid")}
    cases = [(kind == k, F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))) for k, (s, r) in said.items()]
    return first_match(cases, F.struct(F.lit("unknown").alias("status"), F.lit("unexpected error").alias("reason")))


# --- comparisons and approvals ---------------------------------------------------


def upsert_comparisons(old: DataFrame, new: DataFrame, approvals: DataFrame, key: str = "action_id") -> tuple[DataFrame, DataFrame]:
    """(comparisons after a scan, approvals left): a new comparison replaces the old one, and an approval goes when either hash of its comparison changed."""
    hashes = ["current_hash", "proposed_hash"]
    kept = old.join(new.select(key), key, "left_anti").unionByName(new)
    changed = old.select(key, *[F.col(h).alias(f"_{h}") for h in hashes]).join(new.select(key, *hashes), key).filter(" or ".join(f"not (_{h} <=> {h})" for h in hashes)).select(key)
    return kept, approvals.join(changed, key, "left_anti")


APPROVABLE = "has_existing and not no_change"


def refusal(found: Column) -> Column:
    """Why a target can't be approved; null where it can."""
    return F.when(found.isNull(), "not compared").when(~(F.col("has_existing") & ~F.col("no_change")), "no approval needed").when(F.col("conflicts"), "ambiguous matches")


def approve_targets(comparisons: DataFrame, approvals: DataFrame, wanted: DataFrame, key: str = "action_id") -> tuple[DataFrame, DataFrame]:
    """(approvals afterwards, refused targets with the reason). All or nothing: nothing is approved while any is refused; approving twice changes nothing."""
    judged = wanted.select(key).distinct().join(comparisons.withColumn("_found", F.lit(True)), key, "left").withColumn("refusal", refusal(F.col("_found")))
    refused = judged.filter("refusal is not null").select(key, "refusal")
    fine = judged.filter("refusal is null" if refused.isEmpty() else F.lit(False)).select(key, "current_hash", "proposed_hash")
    return approvals.join(fine.select(key), key, "left_anti").select(key, "current_hash", "proposed_hash").unionByName(fine), refused


def invalidate(comparisons: DataFrame, approvals: DataFrame, edited: DataFrame, key: str = "action_id") -> tuple[DataFrame, DataFrame]:
    """Both without what belongs to edited actions."""
    gone = edited.select(key).distinct()
    return comparisons.join(gone, key, "left_anti"), approvals.join(gone, key, "left_anti")


def with_comparison(actions: DataFrame, comparisons: DataFrame, approvals: DataFrame) -> DataFrame:
    """actions with their comparison (nulls where there is none) and approved: both hashes are still those that were approved."""
    ok = approvals.select("action_id", "current_hash", "proposed_hash").distinct().withColumn("_ok", F.lit(True))
    compared = comparisons.join(ok, ["action_id", "current_hash", "proposed_hash"], "left").withColumn("approved", F.coalesce("_ok", F.lit(False))).drop("_ok").withColumn("compared", F.lit(True))
    return actions.join(compared, "action_id", "left").withColumn("compared", F.coalesce("compared", F.lit(False))).withColumn("approved", F.coalesce("approved", F.lit(False)))


def replaces(c: str = "") -> Column:
    """Whether a compared action would change live data."""
    col = lambda x: F.coalesce(F.col(f"{c}{x}"), F.lit(False))
    return col("has_existing") & ~col("no_change")


def needs_review() -> Column:
    return ~F.col("compared") | F.coalesce("conflicts", F.lit(False)) | (replaces() & ~F.col("approved"))


def has_hold(hold: str) -> Column:
    """Whether an enriched action has a hold of this name; an unknown name holds all."""
    address = F.coalesce(F.col("reason").contains("Address verification"), F.lit(False))
    pending = F.col("readiness") == "pending"
    tests = {
        "source_selection": F.col("needs_source") & F.col("selected_row").isNull(),
        "target_not_checked": ~F.col("compared"),
        "target_replacement": replaces() & ~F.col("approved"),
        "invalid_request": pending & ~address,
        "os_resolution": pending & address,
        "execution_attention": F.coalesce(F.col("status").isin(ATTENTION), F.lit(False)),
    }
    return tests.get(hold, F.lit(True))


def comparison_summary(changes: DataFrame) -> DataFrame:
    """One row of counts: every compared action without a conflict falls in one of no_change, empty_target, approval_required and approved."""
    conflict, same, live = (F.coalesce(F.col(c), F.lit(False)) for c in ("conflicts", "no_change", "has_existing"))
    clear = F.col("compared") & ~conflict
    return changes.agg(
        F.count("*").alias("total"), F.count_if("compared").alias("checked"), F.count_if(~F.col("compared")).alias("not_checked"),
        F.count_if(clear & same).alias("no_change"), F.count_if(clear & ~same & ~live).alias("empty_target"),
        F.count_if(clear & ~same & live & ~F.col("approved")).alias("approval_required"), F.count_if(clear & ~same & live & F.col("approved")).alias("approved"),
        F.count_if(F.col("compared") & conflict).alias("conflicts"),
    )


def replacement_counts(comparisons: DataFrame, approvals: DataFrame, planned: DataFrame) -> DataFrame:
    """Comparisons, those that need an approval, have one or wait for one, and planned actions not yet compared (never below 0)."""
    ok = with_comparison(comparisons.select("action_id"), comparisons, approvals)
    need = replaces() & ~F.coalesce("conflicts", F.lit(False))
    each = ok.select(F.lit(1).alias("c"), need.cast("int").alias("r"), (need & F.col("approved")).cast("int").alias("a"), F.lit(0).alias("p"))
    both = each.unionByName(planned.select(F.lit(0).alias("c"), F.lit(0).alias("r"), F.lit(0).alias("a"), F.lit(1).alias("p")))
    n = {k: F.coalesce(F.sum(k), F.lit(0)) for k in "crap"}
    return both.agg(n["c"].alias("comparisons"), n["r"].alias("required"), n["a"].alias("approved"), (n["r"] - n["a"]).alias("pending"), F.greatest(n["p"] - n["c"], F.lit(0).cast("long")).alias("not_checked"))


# --- statuses and summaries ---------------------------------------------------------


def active_actions(actions: DataFrame, selections: DataFrame, disposed: DataFrame) -> DataFrame:
    """Actions of rows that nobody disposed of; of a court with a selected source row, actions that need the choice stay only for that row."""
    left = actions.join(disposed.select("row", "court_slug").distinct(), ["row", "court_slug"], "left_anti").join(selections, "court_slug", "left")
    return left.filter(~F.col("needs_source") | F.col("selected_row").isNull() | (F.col("selected_row") == F.col("row")))


def to_attempt(actions: DataFrame, states: DataFrame) -> DataFrame:
    """Actions without a state, or whose state still lets them be tried."""
    return actions.join(states.select("action_id", "status"), "action_id", "left").filter(F.coalesce("status", F.lit("planned")).isin("planned", "awaiting_approval", "ready"))


def with_holds(actions: DataFrame, states: DataFrame, links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Enriched actions (of with_comparison and active_actions) with their holds and effective status.

    links: action_id, review_id; decisions: review_id, decision (approved or denied).
    """
    d = links.join(decisions, "review_id", "left").groupBy("action_id").agg(F.bool_or(F.col("decision").isNull()).alias("_open"), F.bool_or(F.coalesce(F.col("decision") == "denied", F.lit(False))).alias("_denied"))
    got = actions.join(states, "action_id", "left").join(d, "action_id", "left")
    tests = [F.col("needs_source") & F.col("selected_row").isNull(), F.coalesce("_open", F.lit(False)), F.coalesce("_denied", F.lit(False)), replaces() & ~F.col("approved")]
    final = F.coalesce(F.col("status").isin(TERMINAL), F.lit(False))
    holds = F.when(final, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(t, h) for h, t in zip(HOLDS, tests, strict=True)])))
    return got.withColumn("holds", holds).withColumn("effective_status", effective_status(F.col("status"), *tests)).drop("_open", "_denied")


def status_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: how often each of a fixed list of values occurs, 0 where it doesn't."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def hold_counts(held: DataFrame) -> DataFrame:
    """Distinct courts by hold, courts that wait for any approval, and the others."""
    wait = F.exists("holds", lambda h: h.isin("value_approval", "target_replacement", "source_selection"))
    court = lambda test: F.count_distinct(F.when(test, F.col("court_slug")))
    got = held.agg(*[court(F.array_contains("holds", h)).alias(h) for h in HOLDS], court(wait).alias("held_by_approvals"), F.count_distinct("court_slug").alias("_n"))
    return got.withColumn("without_known_approval_hold", F.col("_n") - F.col("held_by_approvals")).drop("_n")


def attempt_counts(attempts: DataFrame, message: str, told: str = r"(\d+) of (\d+) writes") -> DataFrame:
    """Attempts, writes made and planned: from their own columns, or from the message where only that says so."""
    of = lambda k: F.expr(f"try_cast(nullif(regexp_extract({message}, r'{told}', {k}), '') AS long)")
    return attempts.agg(F.count("*").alias("attempts"), F.coalesce(F.sum(F.coalesce("made", of(1))), F.lit(0)).alias("made"), F.coalesce(F.sum(F.coalesce("planned", of(2))), F.lit(0)).alias("planned"))


def appended(states: DataFrame, transitions: DataFrame, key: str = "action_id", at: str = "at") -> DataFrame:
    """Current state of each action after its transitions: status and reason of the last, the number of attempts, and all earlier states kept in the event table."""
    last = transitions.groupBy(key).agg(F.max_by(F.struct("status", "reason"), at).alias("_s"), F.count_if(F.col("attempt")).alias("_n"))
    both = states.join(last, key, "full_outer")
    return both.select(key, F.coalesce("_s.status", "status").alias("status"), F.when(F.col("_s").isNotNull(), F.col("_s.reason")).otherwise(F.col("reason")).alias("reason"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("attempts"))


def all_omitted(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """action_id of the actions that have items, all of which are to be left out."""
    return items.join(resolutions, "item_id", "left").groupBy("action_id").agg(F.bool_and(F.coalesce(F.col("decision") == "omit", F.lit(False))).alias("_all")).filter("_all").select("action_id")


def resolved_items(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Items left, each with the type it was remapped to, if it was."""
    return items.join(resolutions, "item_id", "left").filter(~F.coalesce(F.col("decision") == "omit", F.lit(False))).withColumn("type_id", F.coalesce("replacement", "type_id")).drop("decision", "replacement")


def disposed_records(records: DataFrame, dispositions: DataFrame, succeeded: DataFrame) -> DataFrame:
    """court_slug of the records all of whose rows are disposed of and none of whose actions succeeded. records: court_slug, row."""
    marks = records.join(dispositions.select("court_slug", "row").distinct().withColumn("_d", F.lit(True)), ["court_slug", "row"], "left").groupBy("court_slug").agg(F.bool_and(F.coalesce("_d", F.lit(False))).alias("_all"))
    return marks.filter("_all").join(succeeded.select("court_slug").distinct(), "court_slug", "left_anti").select("court_slug")


def latest_jobs(jobs: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The newest job of each run."""
    return jobs.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("_j")).select(key, "_j.*")


def safe_changes(differences: DataFrame, allowed: list[str], key: str = "action_id") -> DataFrame:
    """Keys that differ, and only in the allowed fields. differences: key, field."""
    return differences.groupBy(key).agg(F.bool_and(F.col("field").isin(allowed)).alias("_safe")).filter("_safe").select(key)


def attention_groups(actions: DataFrame, n: int = 5) -> DataFrame:
    """resource, status, http_status, reason: counts, first courts and first reason of the actions that need attention; most first."""
    reason = F.coalesce(F.nullif(F.col("state_reason"), F.lit("")), F.lit("No diagnostic reason was recorded"))
    shown = actions.filter(F.col("status").isin(ATTENTION)).withColumn("said", reason)
    keys = ["resource", "status", "http_status", "said"]
    counts = shown.groupBy(*keys).agg(F.count("*").alias("action_count"), F.count_distinct("court_slug").alias("court_count"))
    ranked = shown.select(*keys, "court_slug").distinct().withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("court_slug"))).filter(F.col("_k") <= n)
    first = ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("court_slug")), ",").alias("example_courts"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return counts.alias("c").join(first.alias("f"), same).select(*[F.col(f"c.{k}") for k in keys], "action_count", "court_count", "example_courts")
