"""Whole lists of hot keys, in chunks."""

import json

from pyspark.sql import functions as F

from quillfold.operators import queues, selection
from quillfold.plans import validate


def test_a_hot_key_keeps_all_its_rows(spark):
    """100,000 rows of one e-mail, a third of the others' too: nothing is cut, and no row is longer than a chunk."""
    n = 100_000
    df = spark.range(n + 50).select(F.col("id").alias("row"), F.when(F.col("id") < n, "hot@x.org").otherwise(F.concat((F.col("id") % 25).cast("string"), F.lit("@x.org"))).alias("email"), F.lit("n").alias("name"))
    got = validate.users(df.repartition(7), F.col("email"), F.col("name"), "row").collect()
    hot = sorted((r["chunk"], r["source_rows"]) for r in got if r["email"] == "hot@x.org")
    assert [c for c, _ in hot] == list(range(n // 1000)) and all(len(x) == 1000 for _, x in hot)
    assert [x for _, xs in hot for x in xs] == list(range(n)) and {r["rows"] for r in got} == {n, 2}
    one = queues.submitters(df, F.col("email"), F.col("name"), "row").filter("email = 'hot@x.org'")
    assert one.agg(F.sum(F.size(F.split("listed", ", ")))).first()[0] == n
    rows = validate.duplicate_rows(df, "email", "row")
    assert rows.agg(F.sum(F.size("values"))).first()[0] == n + 50 and rows.agg(F.max(F.size("values"))).first()[0] == 1000


def test_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 1), ("a", None, None), (None, 5, 0), ("a", 1, 1)], "k string, v int, o int")
    got = {(r["k"], r["chunk"]): r["values"] for r in selection.chunked(df, ["k"], "v", [F.col("o")], 3).collect()}
    assert got == {("a", 0): [None, 1, 1], ("a", 1): [2], (None, 0): [5]}
    assert selection.chunked(df.limit(0), ["k"], "v", [F.col("o")]).count() == 0


def test_a_duplicate_issue_lists_every_row(spark):
    """More rows than any earlier list held: each member is told all of them, in order and once."""
    df = spark.range(130).select((F.col("id") * 37 % 130).alias("row"), F.when(F.col("id") < 120, "many").when(F.col("id") < 122, "two").when(F.col("id") > 122, F.col("id").cast("string")).alias("key"), F.array().cast("array<struct<field:string,code:string,severity:string,message:string,raw_value:string,cleaned_value:string>>").alias("issues"))
    once = validate.with_duplicate_issues(df.repartition(5), "key", "row")
    for got in (once, validate.with_duplicate_issues(once, "key", "row")):
        said = {}
        for r in got.collect():
            said.setdefault(r["key"], []).append((r["row"], [json.loads(i["cleaned_value"]) for i in r["issues"]]))
        for key in ("many", "two"):
            rows = sorted(x for x, _ in said[key])
            assert all(i == [{"source_row_numbers": rows, "rows": len(rows)}] for _, i in said[key])
        assert len(said["many"]) == 120 and all(i == [] for k, v in said.items() if k not in ("many", "two") for _, i in v)


def test_clears_meet_an_action_once(spark):
    """A thousand clears of one field and actions of one row: the join makes a row for each action, not for each clear."""
    from pyspark.sql import functions as F

    from quillfold.operators import queues

    items = spark.range(1000).select(F.lit(1).alias("row"), F.lit("contacts[0].explanation").alias("field"), F.lit("clear").alias("operation"), F.lit("accepted").alias("outcome"))
    actions = spark.range(50).select(F.col("id").alias("action_id"), F.lit(1).alias("row"), F.lit("contacts[0]").alias("section"))
    got = queues.clears(actions, items)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 50 and "Aggregate" in plan[plan.index("Join"):]
