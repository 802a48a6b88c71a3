"""The summary of a run as one relation of counters, and its attention report by grouping sets.

Every input row says which counters it adds to (`facts`); all inputs are united and counted in
one pass, first by counter and court, then by counter, so that no hot counter or court is
gathered and the same rows give items and distinct courts. A counter of several inputs (courts
with any open work, say) is one name that several inputs add to. All counters have a row, zero
where nothing adds to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .execution import ACTION_STATUSES, ATTENTION, COURT_STATUSES, HOLDS, first_match, replaces
from .summaries import group_status

SILENT = "No diagnostic reason was recorded"
WAITING = ["source_selection", "value_approval", "target_replacement"]
OPEN = ["planned", "awaiting_approval", "ready", "running"]

Fact = tuple[str, str, Column, Column | int]  # section, counter, whether a row adds to it, how much

COUNTERS = {
    "totals": ["courts", "actions", "attention_actions"],
    "court_status": COURT_STATUSES,
    "action_status": ACTION_STATUSES,
    "completion": ["not_completed", "terminal"],
    "value_approvals": ["total", "approved", "manual_approved", "auto_approved", "auto_approved_total", "denied", "pending", "already_executed", "not_actionable"],
    "review_progress": [
        "outstanding", "pending_values", "pending_execution_values", "denied_values", "ingestion_review", "ingestion_or_value_review", "source_or_value_review", "source_corrections",
        "existing_data_approvals", "ambiguous_comparisons", "invalid_sections",
    ],
    "court_holds": [*HOLDS, "held_by_approvals", "without_known_approval_hold"],
    "replacements": ["comparisons", "required", "approved", "pending", "not_checked"],
    "source_selections": ["selected", "pending_courts"],
    "writes": ["sent", "accepted", "rejected", "uncertain", "rejected_or_uncertain"],
    "timing_ms": ["request", "persistence"],
}


def facts(rows: DataFrame, court: str, tests: list[Fact]) -> DataFrame:
    """court, section, name and weight for every counter that a row adds to; a null test doesn't hold."""
    each = [F.when(test, F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), (F.lit(w) if isinstance(w, int) else w).cast("long").alias("weight"))) for s, n, test, w in tests]
    return rows.select(F.col(court).alias("court"), F.explode(F.array_compact(F.array(*each))).alias("f")).select("court", "f.*")


def action_facts(held: DataFrame) -> DataFrame:
    """Of the actions that count, with holds and effective status (of `execution.with_holds`)."""
    s, holds, yes = F.col("effective_status"), F.col("holds"), F.lit(True)
    pending = F.col("readiness") == "pending"
    tests: list[Fact] = [("totals", "actions", yes, 1), ("replacements", "not_checked", yes, 1), ("totals", "attention_actions", s.isin(ATTENTION), 1)]
    tests += [("action_status", v, s == v, 1) for v in ACTION_STATUSES]
    tests += [("completion", "not_completed", s.isin(OPEN), 1), ("completion", "terminal", s.isin("succeeded", *ATTENTION), 1)]
    tests += [("court_holds", h, F.array_contains(holds, h), 1) for h in HOLDS] + [("court_holds", "held_by_approvals", F.arrays_overlap(holds, F.array(*[F.lit(h) for h in WAITING])), 1)]
    tests += [("review_progress", n, pending, 1) for n in ("invalid_sections", "outstanding")]
    return facts(held, "court_slug", tests)


def court_facts(held: DataFrame) -> DataFrame:
    """Of the courts of these actions: one row a court."""
    waits = F.arrays_overlap("holds", F.array(*[F.lit(h) for h in WAITING]))
    unchosen = F.col("needs_source") & F.col("selected_row").isNull()
    marks = held.groupBy("court_slug").agg(F.bool_or(F.coalesce(waits, F.lit(False))).alias("_waits"), F.bool_or(F.coalesce(unchosen, F.lit(False))).alias("_unchosen"))
    s = F.col("group_status")
    tests: list[Fact] = [("totals", "courts", F.lit(True), 1), ("court_holds", "without_known_approval_hold", ~F.col("_waits"), 1), ("source_selections", "pending_courts", F.col("_unchosen"), 1)]
    return facts(group_status(held, ["court_slug"], "effective_status").join(marks, "court_slug"), "court_slug", tests + [("court_status", v, s == v, 1) for v in COURT_STATUSES])


def item_facts(items: DataFrame) -> DataFrame:
    """Of review items. items: court_slug, actionable, approvable, decision (or pending), method, actions, succeeded."""
    can = F.col("actionable") & F.coalesce("approvable", "actionable")
    approved, denied, open_ = (F.col("decision") == d for d in ("approved", "denied", "pending"))
    auto = approved & (F.col("method") == "policy")
    done = ~approved & (F.col("actions") > 0) & (F.col("succeeded") == F.col("actions"))
    waits = F.coalesce("approvable", "actionable") & open_
    v, p = "value_approvals", "review_progress"
    tests: list[Fact] = [
        (v, "total", can, 1), (v, "approved", can & approved, 1), (v, "manual_approved", can & approved & ~F.coalesce(auto, F.lit(False)), 1), (v, "auto_approved", can & auto, 1), (v, "auto_approved_total", auto, 1), (v, "denied", can & denied, 1),
        (v, "already_executed", can & done, 1), (v, "not_actionable", ~F.coalesce("actionable", F.lit(False)), 1),
        # What is left of the total when decided and executed items are taken away; a denied item that was executed is taken away twice.
        (v, "pending", can, 1), (v, "pending", can & approved, -1), (v, "pending", can & denied, -1), (v, "pending", can & done, -1),
        (p, "pending_execution_values", waits & F.col("actionable"), 1), (p, "denied_values", F.coalesce("approvable", "actionable") & denied, 1),
    ]
    return facts(items, "court_slug", tests + [(p, n, waits, 1) for n in ("pending_values", "outstanding", "ingestion_or_value_review", "source_or_value_review")])


def comparison_facts(compared: DataFrame) -> DataFrame:
    """Of comparisons with approved (of `execution.with_comparison`) and court_slug."""
    yes, conflict = F.lit(True), F.coalesce("conflicts", F.lit(False))
    need = replaces() & ~conflict
    r, p = "replacements", "review_progress"
    tests: list[Fact] = [(r, "comparisons", yes, 1), (r, "not_checked", yes, -1), (r, "required", need, 1), (r, "approved", need & F.col("approved"), 1), (r, "pending", need & ~F.col("approved"), 1)]
    tests += [(p, "existing_data_approvals", need & ~F.col("approved"), 1), (p, "ambiguous_comparisons", conflict, 1), (p, "outstanding", conflict | (need & ~F.col("approved")), 1)]
    return facts(compared, "court_slug", tests)


def attempt_facts(attempts: DataFrame) -> DataFrame:
    """Of write attempts. attempts: court_slug, accepted, rejected, uncertain, request_ms, persistence_ms; null counts are none."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("accepted", "rejected", "uncertain", "request_ms", "persistence_ms")}
    bad = n["rejected"] + n["uncertain"]
    weights = [("writes", "sent", n["accepted"] + bad), ("writes", "rejected_or_uncertain", bad), *[("writes", c, n[c]) for c in ("accepted", "rejected", "uncertain")], *[("timing_ms", c, n[f"{c}_ms"]) for c in ("request", "persistence")]]
    return facts(attempts, "court_slug", [(s, name, w > 0, w) for s, name, w in weights])


def summary(held: DataFrame, items: DataFrame, compared: DataFrame, selections: DataFrame, corrections: DataFrame, ingestion: DataFrame, attempts: DataFrame) -> DataFrame:
    """section, name, items and distinct courts of every counter.

    selections: court_slug; corrections: court_slug, one row for each open issue of the source;
    ingestion: court_slug of the records that wait for a human. Empty inputs give zeros.
    """
    yes, p = F.lit(True), "review_progress"
    parts = [
        action_facts(held), court_facts(held), item_facts(items), comparison_facts(compared), attempt_facts(attempts),
        facts(selections, "court_slug", [("source_selections", "selected", yes, 1)]),
        facts(corrections, "court_slug", [(p, n, yes, 1) for n in ("source_corrections", "source_or_value_review", "outstanding")]),
        facts(ingestion, "court_slug", [(p, n, yes, 1) for n in ("ingestion_review", "ingestion_or_value_review")]),
    ]
    none = held.sparkSession.createDataFrame([(None, s, n, 0) for s, names in COUNTERS.items() for n in names], "court string, section string, name string, weight long")
    every = none
    for part in parts:
        every = every.unionByName(part)
    by_court = every.groupBy("section", "name", "court").agg(F.sum("weight").alias("n"))
    got = by_court.groupBy("section", "name").agg(F.sum("n").alias("items"), F.count(F.when(F.col("n") > 0, F.col("court"))).alias("courts"))
    return got.withColumn("items", F.when(F.col("name") == "not_checked", F.greatest("items", F.lit(0))).otherwise(F.col("items")))


# --- attention -----------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Holds for a reason that contains any of the marks (no marks: any reason), of one of these statuses and with such an answer."""

    name: str
    marks: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    resources: tuple[str, ...] = ()
    http: tuple[int, int] | None = None

    def holds(self) -> Column:
        reason = F.coalesce("state_reason", F.lit(""))
        out = F.lit(True)
        if self.marks:
            found = F.lit(False)
            for m in self.marks:
                found = found | reason.contains(m)
            out = out & found
        for c, values in (("effective_status", self.statuses), ("resource", self.resources)):
            out = out & F.coalesce(F.col(c).isin(*values), F.lit(False)) if values else out
        return out & F.coalesce(F.col("http_status").between(*self.http), F.lit(False)) if self.http else out


def first_rule(rules: list[Rule], otherwise: str) -> Column:
    """Name of the first rule that holds."""
    return first_match([(r.holds(), F.lit(r.name)) for r in rules], F.lit(otherwise))


LEVELS = {"resource": ["resource"], "status": ["resource", "effective_status"], "outcome": ["resource", "effective_status", "http_status", "said", "classification"], "theme": ["theme"]}


def attention(held: DataFrame, themes: list[Rule], classes: list[Rule], examples: int = 5) -> DataFrame:
    """Actions that need attention by resource, by resource and status, by outcome and by theme, in one pass of grouping sets.

    level, its keys (null at the other levels), actions, courts, the first courts by name and the reason of
    the action with the smallest id that has one. A key that is itself null or empty is its own group: said and
    resource are filled, http_status may be null.
    """
    keys = ["resource", "effective_status", "http_status", "said", "classification", "theme"]
    shown = held.filter(F.col("effective_status").isin(ATTENTION)).withColumn("resource", F.coalesce("resource", F.lit("unknown")))
    shown = shown.withColumns({"said": F.coalesce(F.nullif("state_reason", F.lit("")), F.lit(SILENT)), "theme": first_rule(themes, "other"), "classification": first_rule(classes, "human_review")})
    first = F.min(F.when(F.coalesce("state_reason", F.lit("")) != "", F.struct("action_id", "state_reason")))
    cells = shown.groupBy(*keys, "court_slug").agg(F.count("*").alias("_n"), first.alias("_first"))
    sets = [[F.col(k) for k in [*level, "court_slug"]] for level in LEVELS.values()]
    level = first_match([(F.grouping(F.col(ks[-1])) == 0, F.lit(name)) for name, ks in [("theme", ["theme"]), ("outcome", ["classification"]), ("status", ["effective_status"])]], F.lit("resource"))
    per_court = cells.groupingSets(sets, *[F.col(k) for k in keys], F.col("court_slug")).agg(level.alias("level"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    totals = per_court.groupBy("level", *keys).agg(F.sum("_n").alias("actions"), F.count("court_slug").alias("courts"), F.min("_first")["state_reason"].alias("example_reason"))
    ranked = per_court.withColumn("_k", F.row_number().over(W.partitionBy("level", *keys).orderBy("court_slug"))).filter(F.col("_k") <= examples)
    listed = ranked.groupBy("level", *keys).agg(F.array_join(F.array_sort(F.collect_list("court_slug")), ",").alias("example_courts"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"l.{k}")) for k in ["level", *keys]]
    return totals.alias("t").join(listed.alias("l"), same).select("t.*", "l.example_courts")
