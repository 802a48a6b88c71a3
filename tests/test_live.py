"""Digest trees, derived plans and the preflight cascade."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillfold import registry_live
from quillfold.operators import derive, digests, preflight
from quillfold.sources import stored


def test_only_rows_of_leaves_that_differ_are_joined(spark, sf):
    """A tree of 4,096 leaves over 1,500 sections of which 6 differ."""
    plan, live = registry_live._plan_and_live(spark, sf)
    p = digests.TreeParams(fanout=16, depth=3)
    a, b = digests.snapshot(plan.drop("action_id"), digests.SECTION, p), digests.snapshot(live, digests.SECTION, p)
    got = digests.differences(a, b).collect()
    s = digests.scan(a, b)
    joined = s.left.count() + s.right.count()
    assert 0 < len(got) <= joined <= 6 * len(got) < a.rows.count() / 10
    assert s.left.count() + s.alike.count() == plan.count()


def test_trees_of_odd_tables(spark):
    """Null keys and values, repeated rows, tables without rows, equal tables in another order."""
    schema = "k string, m int, v string"
    rows = [("a", 1, "x"), ("a", None, "x"), (None, None, None), ("b", 2, None), ("c", 3, "y")]
    one = digests.snapshot(spark.createDataFrame(rows, schema), ["k", "m"])
    same = digests.snapshot(spark.createDataFrame(rows[::-1], schema).repartition(4), ["k", "m"])
    none = digests.snapshot(spark.createDataFrame([], schema), ["k", "m"])
    other = digests.snapshot(spark.createDataFrame([("a", 1, "x"), ("a", None, "z"), ("b", 2, None), ("c", 3, None), ("d", 4, "n")], schema), ["k", "m"])
    assert digests.differing_leaves(one, same).count() == 0 == digests.differences(one, same).count() == digests.differences(none, none).count()
    assert Counter(r["kind"] for r in digests.differences(one, none).collect()) == {"only_left": 5}
    got = {(r["k"], r["m"]): (r["kind"], r["left_v"], r["right_v"]) for r in digests.differences(one, other).collect()}
    assert got == {("a", None): ("changed", "x", "z"), (None, None): ("only_left", None, None), ("c", 3): ("changed", "y", None), ("d", 4): ("only_right", None, "n")}
    twice = digests.snapshot(spark.createDataFrame([*rows, rows[0]], schema), ["k", "m"])
    assert digests.differing_leaves(one, twice).count() == 1
    with pytest.raises(ValueError, match="shapes"):
        digests.differing_leaves(one, digests.snapshot(spark.createDataFrame(rows, schema), ["k", "m"], digests.TreeParams(8, 2)))


def test_bulk_comparisons_of_shared_and_empty_sections(spark):
    """Several actions of one section meet the same live one; without live sections all are new."""
    plan = spark.createDataFrame([(1, "c", "address", "h"), (2, "c", "address", "h"), (3, "d", "address", "h"), (4, None, "address", None)], "action_id long, court_slug string, resource string, hash string")
    live = spark.createDataFrame([("c", "address", "h"), ("d", "address", "g"), ("e", "address", "h")], "court_slug string, resource string, hash string")
    got = {r["action_id"]: (r["has_existing"], r["no_change"]) for r in digests.bulk_comparisons(plan, live).collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (True, False), 4: (False, False)}
    assert {(r["has_existing"], r["no_change"]) for r in digests.bulk_comparisons(plan, live.limit(0)).collect()} == {(False, False)}


ACTION = "action_id long, court_slug string, row long, resource string, body string"


def test_derive(spark):
    original = [(1, "a", 1, "address", "o"), (2, "a", 1, "contact", "o"), (3, "a", 2, "contact", "o"), (4, "b", 3, "address", "o"), (5, "b", 3, "address", "o"), (6, "gone", 9, "address", "o"), (7, "won", 8, "address", "o"), (8, "won", 8, "contact", "o")]
    derived = [(11, "a", 1, "address", "d"), (12, "a", 1, "contact", "d"), (14, "b", 3, "address", "d"), (15, "c", 4, "address", "d")]
    args = spark.createDataFrame(original, ACTION), spark.createDataFrame(derived, ACTION), spark.createDataFrame([(2,), (7,)], "action_id long")
    got = {(r["action_id"], r["court_slug"], r["body"], r["origin"]) for r in derive.derive(*args).collect()}
    assert got == {(1, "a", "d", "kept_id"), (2, "a", "o", "protected"), (3, "a", "o", "protected"), (14, "b", "d", "new"), (15, "c", "d", "new"), (6, "gone", "o", "retained"), (7, "won", "o", "protected"), (8, "won", "o", "retained")}
    moved = spark.createDataFrame([(3, "z")], "row long, court_slug string")
    got = {(r["action_id"], r["court_slug"]) for r in derive.derive(*args, moved).filter("origin = 'new'").collect()}
    assert got == {(14, "z"), (15, "c")}
    assert derive.derive(args[0], args[1].limit(0), args[2].limit(0)).filter("origin = 'retained'").count() == len(original)


def test_hot_court_is_derived_whole(spark):
    """A court of 30,000 actions, a third of all."""
    n = 90_000
    original = spark.range(n).select(F.col("id").alias("action_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("court_slug"), F.col("id").alias("row"), F.lit("address").alias("resource"), F.lit("o").alias("body"))
    derived = original.withColumn("action_id", F.col("action_id") + n).withColumn("body", F.lit("d"))
    got = derive.derive(original, derived, spark.range(2).select(F.col("id").alias("action_id")))
    assert {(r["origin"], r["count"]) for r in got.groupBy("origin").count().collect()} == {("protected", n // 3 + 1), ("kept_id", n - n // 3 - 1)}


def test_repairs_and_targets(spark):
    states = [(1, "a", "blocked", "period overlaps x"), (2, "a", "failed", "other"), (3, "a", "blocked", "email does not match"), (4, "a", "succeeded", "period overlaps"), (5, "a", "planned", None), (6, "b", "blocked", "period overlaps"), (7, "a", "blocked", "period overlaps")]
    plan = [(1, "a", "ready"), (2, "a", "ready"), (5, "a", None), (7, "a", "pending")]
    got = derive.reconcile(spark.createDataFrame(states, "action_id long, court_slug string, status string, state_reason string"), spark.createDataFrame(plan, "action_id long, court_slug string, readiness string"), spark.createDataFrame([(5,)], "action_id long"))
    assert {r["action_id"]: (r["status"], r["change"], r["invalidates"]) for r in got.collect()} == {
        1: ("planned", "reset", True), 2: ("failed", None, False), 3: (None, "removed", True), 4: ("succeeded", None, False), 5: ("succeeded", "omitted", False), 6: ("blocked", None, False), 7: ("blocked", None, False),
    }
    records = spark.createDataFrame([(1, None, [("COURT_SLUG_NOT_FOUND",), ("X",)]), (2, "s", [("COURT_SLUG_SUGGESTED",)])], "row long, court_slug string, issues array<struct<code:string>>")
    got = {r["row"]: (r["court_slug"], [i["code"] for i in r["issues"]], r["overridden"]) for r in derive.with_targets(records, spark.createDataFrame([(1, "t")], "row long, court_slug string")).collect()}
    assert got == {1: ("t", ["X"], True), 2: ("s", ["COURT_SLUG_SUGGESTED"], False)}


def test_every_outcome_of_the_preflight_occurs(spark, sf):
    got = registry_live.preflight_cascade(spark, "/root/testdata/sf0.01")
    seen = {r["outcome"] for r in got.select("outcome").distinct().collect()}
    assert seen == {*preflight.STATUS, "left_blocked", "other_row_selected"}


def test_later_stages_meet_open_actions_only(spark):
    """Verdicts of one stage are not among the rows of the next."""
    actions = spark.range(10).select(F.col("id").alias("action_id"))
    c = preflight.Cascade(actions)
    c.stage(c.open, [("even", F.col("action_id") % 2 == 0), ("low", F.col("action_id") < 4)])
    assert c.open.count() == 3
    c.stage(c.open, [("five", F.col("action_id") == 5)], last="ready")
    assert c.open.count() == 0
    assert Counter(r["outcome"] for r in c.result().collect()) == {"even": 5, "low": 2, "five": 1, "ready": 2}


def test_items_are_read_once_and_meet_their_section(spark):
    """Every item is made once for a whole preflight; repeated, null and omitted keys, several live values, and approvals of both hashes."""
    made = spark.sparkContext.accumulator(0)
    item = lambda a, key, value="v", omit=False: (a, f"{a}-{key}-{value}{'-omit' if omit else ''}", 1, key, value, None, "verified", None)
    items = [
        item(1, "k"), item(2, "k"), item(2, "k", "w"), item(3, None), item(3, None, "w"), item(4, "k", omit=True), item(6, "twice"), item(7, "k", ""), item(8, "k"), item(8, "only"),
        item(9, "k"), item(9, "k", "w", True), item(10, "k", "x"), item(11, "k", "x"), item(12, "k", "x"), item(13, None), item(14, "k", "x", True), item(15, "k", ""), item(15, "k"),
    ]
    counted = spark.sparkContext.parallelize(items, 2).map(lambda r: (made.add(1), r)[1])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    actions = [(a, "new" if a == 13 else "c", 1, "address" if a == 14 else "languages", "ready", False, None, False) for a in range(1, 16)]
    t = {
        "actions": frame(actions, "action_id long, court_slug string, row int, resource string, readiness string, needs_source boolean, court_id string, settled boolean"),
        "items": spark.createDataFrame(counted, "action_id long, item_id string, position int, key string, value string, postcode string, evidence string, approved_uprn string"),
        "resolutions": frame([(i[1], d) for i in items if i[1].endswith("omit") for d in ("omit", "omit")], "item_id string, decision string"),
        "states": frame([(1, "succeeded")], "action_id long, status string"), "selections": frame([], "court_slug string, selected_row int"),
        "courts": frame([("c", 200, "i"), ("new", 200, "j")], "court_slug string, http_status int, court_id string"),
        "links": frame([], "action_id long, review_id long"), "approved": frame([], "review_id long"), "lookups": frame([], "postcode string, http_status int"), "candidates": frame([], "postcode string, uprn string"),
        "sections": frame([(s, "languages", 200) for s in ("c", "new")], "court_slug string, resource string, http_status int"),
        "live": frame([("c", "languages", "k", "v"), ("c", "languages", "twice", "v"), ("c", "languages", "twice", "v")], "court_slug string, resource string, key string, value string"),
    }
    ready = preflight.prepared(t, F.col("value") == "")
    current = ready["current"].first()["current_hash"]
    hashes = {r["action_id"]: r["proposed_hash"] for r in ready["proposed"].collect()}
    t["approvals"] = frame([(10, current, hashes[10]), (10, "older", hashes[10]), (11, "older", hashes[11]), (12, current, hashes[8])], "action_id long, current_hash string, proposed_hash string")
    assert hashes[10] == hashes[11] and made.value == len(items)
    made.value = 0
    got = {r["action_id"]: r["outcome"] for r in preflight.preflight(t, F.col("value") == "").collect()}
    assert made.value == len(items)
    waits = "replacement_not_approved"
    assert got == {
        1: "already_succeeded", 2: "merge_conflict", 3: "merge_conflict", 4: "empty_body", 5: "empty_body", 6: "merge_conflict", 7: "merged_body_invalid", 8: waits,
        9: "no_change", 10: "ready", 11: waits, 12: waits, 13: "ready", 14: "all_items_omitted", 15: "merge_conflict",
    }


def test_a_machines_own_disk_is_refused():
    assert stored.own_disk("file:/tmp/w", "spark://host:7077") and stored.own_disk("/tmp/w", "yarn") and stored.own_disk("file:/w", "local-cluster[2,1,1024]")
    assert not stored.own_disk("file:/tmp/w", "local[8]") and not stored.own_disk("/w", "local") and not stored.own_disk("hdfs://n/w", "yarn")
