import random

from pyspark.sql import functions as F

from quillfold.operators import ordered_rules as O


def plainly(text, rules, otherwise):
    if text is None:
        return otherwise
    return next((name for name, marks in rules if any(m in text for m in marks)), otherwise)


def test_both_ways_are_the_plain_one(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(r.randrange(1, n)))
    texts = [None, "", "a", "x" * 50_000 + "abc", *[word(40) for _ in range(300)]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    lists = [[], [("none", [])], [(f"r{k}", [word(6) for _ in range(r.randrange(1, 4))]) for k in range(60)], [("long", ["abcabc"]), ("inner", ["bca"]), ("same", ["bca", "c"])], [("first", ["b"]), ("empty", [""]), ("never", ["a"])]]
    for rules in lists:
        for short in (0, 10_000):
            got = {x["k"]: x["n"] for x in df.select("k", O.first_rule(F.col("text"), rules, "other", short).alias("n")).collect()}
            assert got == {k: plainly(t, rules, "other") for k, t in enumerate(texts)}, (rules, short)


def test_the_length_of_the_list_decides(spark):
    df = spark.createDataFrame([("ab",)], "text string")
    plan = lambda n: df.select(O.first_rule(F.col("text"), [(str(k), [f"m{k}"]) for k in range(n)]))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan(O.SHORT) and "ArrowEvalPython" in plan(O.SHORT + 1)
