import pytest
from pyspark.sql import functions as F

from quillfold.operators import issues as I
from quillfold.operators import matching, merge, relations, selection, shaping, summaries, vocabulary

VOCAB = "vocabulary string, position int, code string, name string, api_id string, aliases array<string>"


def test_latest_wins_ties_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, None, 1), (4, None, 1), (5, "b", None)], "row int, k string, t int")
    order = [F.desc_nulls_last("t"), F.desc("row")]
    assert sorted(r["row"] for r in selection.latest_wins(df, ["k"], order).collect()) == [2, 3, 4, 5]
    got = {r["row"]: (r["selection_status"], r["superseded_by"]) for r in selection.with_selection(df, ["k"], order, "row").collect()}
    assert got[1] == ("superseded", 2) and got[3] == ("authoritative", None) and got[4] == ("authoritative", None)


def test_issue_algebra(spark):
    one = I.issue("f", "A", "warning", "m", F.lit("1"))
    two = I.issue("f", "A", "warning", "again", F.lit("1"))
    three = I.issue("f", "VOCAB_NO_MATCH", "warning", "m")
    row = spark.range(1).select(I.add_once(F.array(one, two), F.array(two, three)).alias("i"))
    got = row.select("i", I.without_codes(F.col("i")).alias("c"), I.status(F.col("i")).alias("s")).first()
    assert [(i["code"], i["message"]) for i in got["i"]] == [("A", "m"), ("VOCAB_NO_MATCH", "m")] and len(got["c"]) == 1 and got["s"] == "needs_human_review"


def test_status_lattice(spark):
    make = lambda code, sev: I.rules((F.lit(True), I.issue("f", code, sev, "m")))
    df = spark.range(1).select(make("X", "error").alias("a"), make("INVALID_TIME", "warning").alias("b"), make("COURT_SLUG_NORMALISED", "info").alias("c"), make("N", "info").alias("d"), F.array().cast(I.NO_ISSUES).alias("e"))
    assert list(df.select(*[I.status(F.col(c)) for c in "abcde"]).first()) == ["failed", "needs_human_review", "processed_with_warnings", "processed", "processed"]
    assert df.select(I.status(F.col("c"), code_warnings=False)).first()[0] == "processed"


def test_vocabulary_order_and_ids(spark):
    v = spark.createDataFrame([("t", 1, "b", "Beta", "2", ["shared"]), ("t", 0, "a", "Alpha", None, ["shared", "it’s"]), ("u", 0, "z", "Zed", "9", None)], VOCAB)
    df = spark.createDataFrame([(1, " SHARED "), (2, "It's"), (3, "beta"), (4, "zed"), (5, None), (6, "-")], "k int, x string")
    assert {r["k"]: r["code"] for r in vocabulary.match(df, F.col("x"), v, "t").collect()} == {1: "a", 2: "a", 3: "b", 4: None, 5: None, 6: None}
    assert sorted(r["k"] for r in vocabulary.unmatched(df, F.col("x"), v, "t").collect()) == [4, 6]
    assert vocabulary.match(df, F.col("x"), v, "absent").filter("code is not null").count() == 0
    ids = vocabulary.ids_of(spark.createDataFrame([(1, ["beta", "alpha"]), (2, ["none", "beta"])], "k int, v array<string>"), "k", "v", v, "t")
    assert {r["k"]: (r["ids"], r["reason"]) for r in ids.collect()} == {1: (["2", None], "no id: alpha"), 2: ([None, "2"], "not in vocabulary: none")}


def test_addresses(spark):
    df = spark.createDataFrame([("1 St Mary's Rd, Café & c/o X", "1 street mary s road cafe and care of x", "elsewhere")], "a string, b string, c string")
    r = df.select(matching.canonical_address("a").alias("a"), "b", "c").first()
    assert r["a"] == r["b"]
    s = spark.createDataFrame([("a b", "a b"), ("a b", "c a b"), ("a b", "a c"), ("a", "a c")], "x string, y string").withColumn("r", matching.sequence_ratio("x", "y"))
    got = [r[0] for r in s.select(matching.address_score(F.col("x"), F.col("y"), F.col("r"), F.lit(True))).collect()]
    assert got[:2] == [1.0, 0.99] and got[2] == pytest.approx(0.35 + 0.3 * 2 / 3, abs=1e-4) and got[3] == pytest.approx(0.7 + 0.3 * 0.5, abs=1e-4)


def test_margin(spark):
    df = spark.createDataFrame([("k", 1, 0.99), ("k", 2, 0.97), ("l", 3, 0.99), ("m", 4, 0.5), ("m", 5, 0.5)], "k string, c int, s double")
    got = {r["k"]: (r["c"], r["margin"], r["accepted"]) for r in matching.best_with_margin(df, ["k"], "s", [F.col("c")], 0.98, 0.05).collect()}
    assert got == {"k": (1, 0.02, False), "l": (3, 0.99, True), "m": (4, 0.0, False)}


def test_keyed_merge(spark):
    live = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "e")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (5, "n"), (4, "x"), (6, "p"), (6, "q")], "k int, v string")
    ops = merge.operations(live, new, ["k"], ["v"])
    assert {r["k"]: r["operation"] for r in ops.collect()} == {1: "no_change", 2: "update", 3: "preserve", 4: "conflict", 5: "create", 6: "conflict"}
    assert {r["k"]: r["v"] for r in merge.merged(ops, ["k"], ["v"]).collect()} == {1: "a", 2: "B", 3: "c", 4: "d", 5: "n"}


def test_approvals_fall_with_their_hash(spark):
    now = spark.createDataFrame([("c1", "h1", "p1"), ("c2", "h2x", "p2")], "change_id string, current_hash string, proposed_hash string")
    given = spark.createDataFrame([("c1", "h1", "p1"), ("c1", "h1", "p1"), ("c2", "h2", "p2")], "change_id string, current_hash string, proposed_hash string")
    assert {r["change_id"]: r["approved"] for r in merge.valid_approvals(now, given).collect()} == {"c1": True, "c2": False}


def test_complementary_items(spark):
    df = spark.createDataFrame([("a", "1", ""), ("a", None, "m"), ("b", "1", "m"), ("b", "2", "m")], "k string, phone string, mail string")
    got = {r["k"]: (r["phone"], r["mail"], r["conflict"]) for r in merge.coalesce_complementary(df, ["k"], ["phone", "mail"]).collect()}
    assert got["a"] == ("1", "m", False) and got["b"][2]


def test_overlay(spark):
    df = spark.createDataFrame([("live", "new", False), ("live", None, False), (None, None, False), ("live", "new", True)], "c string, s string, clear boolean")
    assert [r[0] for r in df.select(merge.overlay(F.col("c"), F.col("s"), F.lit("fb"), F.col("clear"))).collect()] == ["new", "live", "fb", None]


def test_fold_and_index(spark):
    df = spark.createDataFrame([("a", None, "c")], "x1 string, x2 string, x3 string")
    folded = df.select(shaping.fold_groups([{"x": F.col(f"x{k}")} for k in (1, 2, 3)], ["x"]).alias("g"))
    assert [(g["index"], g["x"]) for g in folded.first()["g"]] == [(1, "a"), (3, "c")]
    assert folded.select(shaping.indexed_item(F.col("g"), 3, "x")).first()[0] == "c"


def test_effective_status(spark):
    df = spark.createDataFrame([(None, False), ("planned", True), ("succeeded", True), ("awaiting_approval", False)], "s string, h boolean")
    assert [r[0] for r in df.select(summaries.effective_status(F.col("s"), F.col("h"))).collect()] == ["planned", "awaiting_approval", "succeeded", "planned"]


def test_pages(spark):
    df = spark.range(120)
    ids = lambda n: [r["id"] for r in relations.page(df, [F.col("id")], n).collect()]
    assert ids("x")[0] == 0 and ids(3) == list(range(100, 120)) and ids(99) == ids(3) and ids(-1)[0] == 0
    assert relations.page(df.limit(0), [F.col("id")], 1).count() == 0


def test_overlaps(spark):
    l, r = spark.createDataFrame([(1, "a[1].b"), (1, "a[10]")], "row int, p string"), spark.createDataFrame([(1, "a[1]"), (2, "a[1]")], "row int, q string")
    assert [(x["p"], x["q"]) for x in relations.path_overlap_join(l, r, ["row"], "p", "q").collect()] == [("a[1].b", "a[1]")]
    assert spark.createDataFrame([("a[1].b",)], "p string").select(relations.ancestors(F.col("p"))).first()[0] == ["a", "a[1]", "a[1].b"]


def test_issue_lists_are_computed_once(spark):
    """Neither list is written again inside the search for repeats, where it would be computed for every issue."""
    said = I.add_once(F.col("old_list"), F.col("new_list"))._jc.toString()
    assert said.count("old_list") == 1 and said.count("new_list") == 1


def test_computed_columns_are_written_once(spark):
    """However many fields of a computed column are taken later, the optimiser keeps one copy of its expression."""
    from quillfold.functions import text as T

    df = T.computed(spark.createDataFrame([("9:00",), (None,)], "h string"), "h", T.time_parts(F.col("h"), F.lit("marker")).alias("t"))
    used = df.select("h", "t.value", "t.status", "t.code")
    assert [tuple(r) for r in used.collect()] == [tuple(r) for r in df.select("h", "t.*").collect()] and len(used.collect()) == 2
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("inline(") == 1 and plan.count("Generate") == 1
