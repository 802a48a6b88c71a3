"""Bodies of unknown schema: leaves, differences, merges, paths and business keys, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from quillfold.operators import bodies
from quillfold.operators.nested import SERVER_KEYS

BODIES = [
    '{"a":{"b":1,"c":null},"d":[{"index":3,"x":"q"},{"index":5,"x":[1,[2]]}],"e":[],"f":"t \\"u\\"","g":1.5,"h":{},"id":9}',
    '{"a":7,"d":"none","e":{"z":[]},"updatedAt":1}', '{"a":{"b":{"deep":[[{"k":true}]]}}}', "{}", "[]", None, "not json", '"plain"', '{"ü key":{"index":1}}',
]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "id long, body string, path string, pos int")


def expected_leaves(v, path=""):
    if isinstance(v, dict) and v:
        return [x for k, y in v.items() if k not in SERVER_KEYS for x in expected_leaves(y, f"{path}.{k}" if path else k)]
    if isinstance(v, list) and v:
        return [x for k, y in enumerate(v) for x in expected_leaves(y, f"{path}[{k}]")]
    return [] if v is None or not path else [(path, json.dumps(v, ensure_ascii=False, separators=(",", ":")))]


def load(t):
    try:
        return json.loads(t) if t else None
    except ValueError:
        return None


def test_leaves(spark):
    got = {(r["id"], r["path"], r["value"]) for r in bodies.leaves(frame(spark, BODIES).select("id", "body"), ["id"], "body").collect()}
    assert got == {(k, *x) for k, t in enumerate(BODIES) for x in expected_leaves(load(t))}


def test_too_deep_is_an_error(spark):
    with pytest.raises(Exception, match="deeper than 2"):
        bodies.leaves(frame(spark, ['{"a":{"b":{"c":1}}}']).select("id", "body"), ["id"], "body", most_depth=2).collect()


def test_rebuilt_round_trip(spark):
    df = frame(spark, BODIES).select("id", "body")
    got = {r["id"]: json.loads(r["body"]) for r in bodies.rebuilt(bodies.leaves(df, ["id"], "body", skip=()), ["id"]).collect()}

    def without_nulls(v):
        if isinstance(v, dict):
            return {k: without_nulls(x) for k, x in v.items() if x is not None}
        return [without_nulls(x) for x in v] if isinstance(v, list) else v

    assert got == {k: without_nulls(v) for k, t in enumerate(BODIES) if isinstance(v := load(t), dict | list) and v}


def test_differences_and_change_maps(spark):
    before, after = frame(spark, ['{"a":1,"b":{"c":[1,2]}}', '{"a":1}', '{"a":1}']).select("id", "body"), frame(spark, ['{"a":2,"b":{"c":[1,3],"d":null}}', '{"a":1,"id":4}']).select("id", "body")
    changes = bodies.differences(before, after, ["id"], "body")
    assert {(r["id"], r["field"], r["before"], r["after"]) for r in changes.collect()} == {(0, "a", "1", "2"), (0, "b.c[1]", "2", "3"), (2, "a", "1", None)}
    maps = {r["id"]: {k: tuple(v) for k, v in r["changes"].items()} for r in bodies.change_maps(changes, ["id"]).collect()}
    assert maps == {0: {"a": ("1", "2"), "b.c[1]": ("2", "3")}, 2: {"a": ("1", None)}}


def test_merges(spark):
    """Arrays whole, objects over leaves and leaves over objects, fallbacks, clears, sections of one side only."""
    cur = frame(spark, ['{"a":{"b":1,"k":2},"l":[1,2],"x":5,"y":{"z":1,"w":{"v":2}}}', '{"a":1}', '{"a":{}}', '{"only":1}']).select("id", "body")
    sub = frame(spark, ['{"a":{"b":9},"l":[3],"x":{"n":1},"y":3}', '{"a":{}}', '{"a":{"b":1}}']).select("id", "body")
    of = lambda df: {(r["id"], r["path"], r["value"], r["origin"]) for r in df.collect()}
    assert of(bodies.merged(cur, sub, ["id"], "body")) == {
        (0, "a.b", "9", "submitted"), (0, "a.k", "2", "current"), (0, "l", "[3]", "submitted"), (0, "x.n", "1", "submitted"), (0, "y", "3", "submitted"),
        (1, "a", "{}", "submitted"), (2, "a.b", "1", "submitted"), (3, "only", "1", "current"),
    }
    clears = spark.createDataFrame([(0, "a"), (3, "other")], "id long, path string")
    got = of(bodies.merged(cur, sub, ["id"], "body", ("l",), clears))
    assert (0, "l", "[1,2]", "current") in got and not any(x[:2] in ((0, "a.b"), (0, "a.k")) for x in got) and (3, "only", "1", "current") in got


def test_paths_are_set_by_index(spark):
    df = frame(spark, ['{"d":[{"index":5,"x":1},{"index":3,"x":2}]}', '{"d":[{"index":5,"x":1}]}', '{"p":{"q":1}}']).select("id", "body")
    edits = spark.createDataFrame([(0, "d[3].x", '"new"'), (1, "d[3].x", '"new"'), (2, "p", "[7]"), (2, "r.s", "true")], "id long, path string, value string")
    got = {r["id"]: json.loads(r["body"]) for r in bodies.with_path(df, ["id"], "body", edits).collect()}
    assert got == {0: {"d": [{"index": 3, "x": "new"}, {"index": 5, "x": 1}]}, 1: {"d": [{"index": 5, "x": 1}]}, 2: {"p": [7], "r": {"s": True}}}


def test_business_keys(spark):
    contacts = frame(spark, ['[{"courtContactDescriptionId":"u1"},{"courtContactDescription":{"id":"u2","name":"n"}},{"courtContactDescription":{"name":"n"}},{"courtContactDescriptionId":null,"phone":"1"}]', "[]", None]).select("id", "body")
    assert [(r["position"], r["key"]) for r in bodies.items_of(contacts, ["id"], "body", "contact_detail").orderBy("position").collect()] == [(0, "u1"), (1, "u2"), (2, "n"), (3, "untyped-3")]
    one = frame(spark, ['[{"addressType":"VISIT_US"},{"openingHourTypeId":4}]']).select("id", "body")
    assert [r["key"] for r in bodies.items_of(one, ["id"], "body", "address").orderBy("position").collect()] == ["VISIT_US", "untyped-1"]
    assert [r["key"] for r in bodies.items_of(one, ["id"], "body", "court_opening_hours").orderBy("position").collect()] == ["untyped-0", "4"]


def test_bodies_meet_by_ids_and_leaves_meet_nothing(spark):
    """Only bodies are shuffled: plans hold one join by ids for each table that is met, and no join of leaves."""
    df = frame(spark, BODIES).select("id", "body")
    edits, clears = df.select("id", F.lit("a").alias("path"), F.lit("1").alias("value")), df.select("id", F.lit("a").alias("path"))
    for got, joins in ((bodies.with_path(df, ["id"], "body", edits), 1), (bodies.merged(df, df, ["id"], "body", clears=clears), 2)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == joins and "variant_explode" not in plan and "path#" not in "".join(x for x in plan.splitlines() if "Join " in x)


def test_odd_bodies_merge_and_edit(spark):
    """Keys with dots that repeat a path, keys and numbers in one container, bodies without edits and edits without a body, null ids."""
    cur, sub = frame(spark, ['{"a.b":1,"a":{"b":2},"k":3}', '{"a":1}']).select("id", "body"), frame(spark, ['{"a.b":5}']).select("id", "body")
    got = sorted(tuple(r) for r in bodies.merged(cur, sub, ["id"], "body").collect())
    assert got == [(0, "a.b", "5", "submitted"), (0, "k", "3", "current"), (1, "a", "1", "current")]
    kept = sorted(tuple(r) for r in bodies.merged(cur, sub, ["id"], "body", ("a.b",)).collect())
    assert kept == [(0, "a.b", "1", "current"), (0, "a.b", "2", "current"), (0, "k", "3", "current"), (1, "a", "1", "current")]
    df = spark.createDataFrame([(0, '{"d":[{"y":[1]},2]}'), (1, '{"x":{}}'), (None, '{"n":1}')], "id long, body string")
    edits = spark.createDataFrame([(0, "d[0].z", '"new"'), (0, "d.name", "1"), (1, "x.y", "7"), (2, "p[0]", "1"), (2, "q", "2"), (None, "n", "9")], "id long, path string, value string")
    got = sorted((-1 if r["id"] is None else r["id"], r["body"]) for r in bodies.with_path(df, ["id"], "body", edits).collect())
    assert got == [(-1, '{"n":1}'), (-1, '{"n":9}'), (0, '{"d":{"name":1,"[0]":{"y":[1],"z":"new"},"[1]":2}}'), (1, '{"x":{"y":7}}'), (2, '{"q":2}')]
