from pyspark.sql import functions as F

from quillfold.operators import report as P

HELD = "action_id long, court_slug string, resource string, effective_status string, http_status int, state_reason string, holds array<string>, needs_source boolean, selected_row int, readiness string"
ITEMS = "court_slug string, actionable boolean, approvable boolean, decision string, method string, actions long, succeeded long"
COMPARED = "action_id long, court_slug string, has_existing boolean, no_change boolean, conflicts boolean, approved boolean"
ATTEMPTS = "court_slug string, accepted int, rejected int, uncertain int, request_ms long, persistence_ms long"


def counted(spark, held=(), items=(), compared=(), selected=(), corrections=(), ingestion=(), attempts=()):
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    courts = [table([(c,) for c in x], "court_slug string") for x in (selected, corrections, ingestion)]
    got = P.summary(table(held, HELD), table(items, ITEMS), table(compared, COMPARED), *courts, table(attempts, ATTEMPTS)).collect()
    assert len(got) == sum(len(n) for n in P.COUNTERS.values())
    return {(r["section"], r["name"]): (r["items"], r["courts"]) for r in got}


def test_empty_inputs_give_zeros(spark):
    assert set(counted(spark).values()) == {(0, 0)}


def test_counters(spark):
    held = [
        (1, "a", "address", "succeeded", 200, None, [], False, None, "ready"),
        (2, "a", "address", "awaiting_approval", None, None, ["value_approval", "denied_value"], True, None, "pending"),
        (3, "b", "address", "failed", 400, "", [], False, None, "ready"),
        (4, "c", None, "planned", None, None, ["denied_value"], False, 3, None),
    ]
    items = [
        ("a", True, None, "approved", "policy", 1, 1), ("a", True, True, "pending", None, 0, 0), ("b", False, True, "pending", None, 0, 0), ("c", True, True, "denied", "manual", 2, 2),
        ("c", True, False, "pending", None, 0, 0), (None, True, True, "pending", None, 1, 1), ("d", None, None, "pending", None, 0, 0),
    ]
    compared = [(1, "a", True, False, False, True), (2, "a", True, False, False, False), (9, "z", True, False, True, False), (8, "y", None, None, None, False)]
    got = counted(spark, held, items, compared, ["a"], ["q"], ["b"], [("a", 2, None, 1, 10, None), ("a", None, None, None, None, 5)])
    assert got["totals", "courts"] == (3, 3) and got["totals", "attention_actions"] == (1, 1)
    assert [got["court_status", s][0] for s in P.COURT_STATUSES] == [1, 0, 1, 1, 0]
    assert got["completion", "terminal"] == (2, 2) and got["completion", "not_completed"] == (2, 2)
    assert got["court_holds", "denied_value"] == (2, 2) and got["court_holds", "held_by_approvals"] == (1, 1) and got["court_holds", "without_known_approval_hold"] == (2, 2)
    v = {n: got["value_approvals", n][0] for n in P.COUNTERS["value_approvals"]}
    assert v == {"total": 4, "approved": 1, "manual_approved": 0, "auto_approved": 1, "auto_approved_total": 1, "denied": 1, "pending": 0, "already_executed": 2, "not_actionable": 2}
    assert got["review_progress", "pending_values"] == (3, 2) and got["review_progress", "ingestion_or_value_review"][1] == 2
    assert got["review_progress", "outstanding"][1] == len({"a", "b", "q", "z"})
    assert got["replacements", "required"] == (2, 1) and got["replacements", "not_checked"][0] == 0
    assert got["source_selections", "pending_courts"] == (1, 1)
    assert got["writes", "sent"] == (3, 1) and got["writes", "rejected_or_uncertain"] == (1, 1) and got["timing_ms", "persistence"] == (5, 1)


def test_first_rule_wins_and_levels_agree(spark):
    rows = [(i, f"c{i % 7}", "address" if i % 2 else None, "failed" if i % 3 else "unknown", 400 if i % 5 else None, ["late reply", "bad mail", None, ""][i % 4], [], False, None, "ready") for i in range(60)]
    rows.append((99, "hot", "address", "planned", None, "late", [], False, None, "ready"))
    themes = [P.Rule("late", ("late",), ("unknown",)), P.Rule("mail", ("mail", "reply")), P.Rule("refused", http=(400, 499))]
    got = P.attention(spark.createDataFrame(rows, HELD), themes, [P.Rule("x", resources=("address",))]).collect()

    def theme(r):
        reason = r[5] or ""
        return "late" if "late" in reason and r[3] == "unknown" else "mail" if "mail" in reason or "reply" in reason else "refused" if r[4] else "other"

    want = {}
    for r in rows[:-1]:
        want.setdefault(theme(r), []).append(r)
    by = {r["theme"]: r for r in got if r["level"] == "theme"}
    assert {k: (len(v), len({x[1] for x in v}), ",".join(sorted({x[1] for x in v})[:5]), next((x[5] for x in v if x[5]), None)) for k, v in want.items()} == {k: (r["actions"], r["courts"], r["example_courts"], r["example_reason"]) for k, r in by.items()}
    for level in P.LEVELS:
        assert sum(r["actions"] for r in got if r["level"] == level) == 60
    assert {r["resource"] for r in got if r["level"] == "resource"} == {"address", "unknown"}


def test_no_court_is_gathered(spark):
    """One hot court: its facts are counted before they are shuffled."""
    held = spark.range(30_000).select(F.col("id").alias("action_id"), F.lit("hot").alias("court_slug"), F.lit("address").alias("resource"), F.lit("failed").alias("effective_status"), F.lit(400).alias("http_status"), F.lit("r").alias("state_reason"), F.array().cast("array<string>").alias("holds"), F.lit(False).alias("needs_source"), F.lit(None).cast("int").alias("selected_row"), F.lit("ready").alias("readiness"))
    got = P.attention(held, [], []).collect()
    assert {(r["level"], r["actions"], r["courts"], r["example_courts"]) for r in got} == {(level, 30_000, 1, "hot") for level in P.LEVELS}
