import difflib
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillfold import registry, registry_forms, registry_review
from quillfold.operators import addresses, execution, modelled, nested, relations, review, selection, shaping, suggest
from quillfold.plans import contract, headers, validate
from quillfold.sources import archive, config


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_fuzzy_matches_agree_with_all_pairs(spark, sf):
    parts = {r["p_partkey"]: r["p_name"].lower() for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    names = sorted(set(parts.values()))
    got = {r["p_partkey"]: r for r in registry.QUERIES["fuzzy_best_match"](spark, sf).collect()}
    assert set(got) == set(parts)
    for k, name in parts.items():
        typed = "z" + name[1:] if k % 2 == 0 else name[:3] + "x" + name[4:]
        scored = sorted(((-ratio(typed, n), n) for n in names))
        assert got[k]["suggested"] == scored[0][1] and got[k]["score"] == pytest.approx(-scored[0][0])
        assert got[k]["accepted"] == (-scored[0][0] >= 0.8 and round(-scored[0][0] + scored[1][0], 4) >= 0.05)


def test_suggestions_agree_with_all_pairs(spark, sf):
    rows = registry.QUERIES["slug_suggestions"](spark, sf).collect()
    parts = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    slug = lambda x: "-".join(x.lower().split())
    known = sorted({slug(n) for n in parts.values()})
    for r in rows:
        k, name = r["p_partkey"], parts[r["p_partkey"]]
        typed = "x" + name[1:] if k % 3 == 0 else name.replace("i", "ii") if k % 3 == 1 else name + "s"
        assert r["confidence"] == pytest.approx(max(ratio(slug(typed), n) for n in known), abs=1e-6)
        assert ratio(slug(typed), r["suggested_slug"]) == pytest.approx(r["confidence"], abs=1e-6)


def test_variants_and_repairs(spark):
    df = spark.createDataFrame([("ab-bristol-county-court", "Bristol_County Court"), ("x", None)], "slug string, raw string")
    got = [r[0] for r in df.select(suggest.variants(F.col("slug"), F.col("raw"))).collect()]
    assert got[0][:3] == ["ab bristol county court", "bristol county court", "ab bristol"] and "Bristol" in got[0] and len(got[0]) <= 6 and got[1] == []
    recs = spark.createDataFrame([(1, "good", True), (2, "nearly", False), (3, "far", False), (4, "none", False)], "k int, court_slug string, found boolean").withColumn("issues", F.array().cast(nested_issues()))
    sug = spark.createDataFrame([(2, "near", "Near", 0.97, "q"), (3, "other", "Other", 0.5, "q")], "k int, suggested_slug string, suggested_name string, confidence double, query string")
    out = {r["k"]: (r["court_slug"], [i["code"] for i in r["issues"]]) for r in suggest.repaired(recs, sug, "k").collect()}
    assert out == {1: ("good", []), 2: ("near", ["COURT_SLUG_AUTO_REPAIRED"]), 3: ("far", ["COURT_SLUG_SUGGESTED", "COURT_SLUG_NOT_FOUND"]), 4: ("none", ["COURT_SLUG_NOT_FOUND"])}


def nested_issues():
    from quillfold.operators.issues import NO_ISSUES

    return NO_ISSUES


def test_word_differences(spark, sf):
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in registry.QUERIES["word_differences"](spark, sf).collect():
        runs = json.loads(r["diff"])
        join = lambda kinds: " ".join(x["text"] for x in runs if x["kind"] in kinds).split()
        assert join(("same", "removed")) == texts[r["item_id"]].split() and join(("same", "added")) == texts[r["item_id"] + 1].split()


def test_archive_hashes(spark, sf):
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(sf).glob("*.parquet")}
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in registry.QUERIES["archive_manifest_hash"](spark, sf).collect()} == want


ADDRESS = "row int, index int, line_1 string, line_2 string, town string, county string, postcode string"
CANDIDATE = "postcode string, position int, uprn string, organisation string, number string, name string, street string, town string, county string, address string, found_postcode string"


def test_addresses(spark):
    a = spark.createDataFrame([(1, 1, "12 High St", None, "Leeds", None, "LS1 1AA"), (2, 1, "Court House", None, "Leeds", None, "LS1 1AA"), (3, 1, "9 Low Rd", None, "Leeds", None, "LS2 2BB"), (4, 1, "x", None, "y", None, None), (5, 1, "x", None, "y", None, "LS9 9ZZ"), (6, 1, "12 High Street", None, "Leeds", None, "LS1 1AA")], ADDRESS)
    c = spark.createDataFrame([("LS1 1AA", 0, "u1", None, "12", None, "High Street", "Leeds", None, "12 HIGH STREET LEEDS", "LS1 1AA"), ("LS1 1AA", 1, "u1", None, "12", None, "High Street", "Leeds", None, "again", "LS1 1AA"), ("LS1 1AA", 2, "u2", "Court House A", "1", None, "Main", "Leeds", None, "COURT HOUSE A", "LS1 1AA"), ("LS1 1AA", 3, "u3", "Court House B", "2", None, "Main", "Leeds", None, "COURT HOUSE B", "LS1 1AA")], CANDIDATE)
    seen = spark.createDataFrame([("LS1 1AA", 200), ("LS2 2BB", 404)], "postcode string, http_status int")
    v = addresses.verified(a, c, seen).cache()
    got = {r["row"]: r for r in v.collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "auto_normalised", 2: "review_required", 3: "no_result", 4: "missing_postcode", 5: "unavailable", 6: "verified"}
    assert got[1]["score"] == 1.0 and got[1]["proposed"]["line_1"] == "12 High Street" and got[2]["margin"] < 0.05
    s = addresses.summary(v).first()
    assert s["addresses"] == 6 and s["blocking"] == 3 and s["blocked_rows"] == 3 and s["unavailable"] == 1
    offered = addresses.for_model(v, c)
    assert sorted(r["uprn"] for r in offered.collect()) == ["u1", "u2", "u3"]
    choices = spark.createDataFrame([(2, 1, "u3"), (2, 1, "other"), (1, 1, "u1")], "row int, index int, uprn string")
    assert {r["row"]: r["chosen_uprn"] for r in addresses.chosen(v, offered, choices).collect()}[2] == "u3"
    assert {r["row"] for r in addresses.chosen(v, offered, choices).collect() if r["chosen_uprn"]} == {2}


def test_model_never_sees_contacts(spark):
    df = spark.createDataFrame([("call 020 7946 0018",), ("020 7946 0018",), ("ab1 2cd",), ("plain",), (None,), ("a@b.org",)], "t string")
    assert [r[0] for r in df.select(modelled.sensitive(F.col("t"))).collect()] == [True, True, True, False, False, True]


def test_contract_of_empty_bodies(spark):
    one = spark.range(1)
    for resource, missing in contract.REQUIRED.items():
        got = one.select(contract.errors(resource, {})).first()[0]
        assert [f"{f} is required" for f in missing] == got[: len(missing)]
    assert one.select(contract.reason("court_opening_hours", {"courtId": F.lit("c"), "openingHourTypeId": F.lit("t")}, True)).first()[0] == "openingTimesDetails is required"


def test_pages_by_key(spark):
    df = spark.createDataFrame([(k // 3, k) for k in range(20)], "a int, b int")
    seen, last = [], None
    while rows := relations.page_after(df, ["a", "b"], last, 6).collect():
        seen += [r["b"] for r in rows]
        last = rows[-1].asDict()
    assert seen == list(range(20))


def test_selection_of_a_hot_key(spark):
    df = spark.createDataFrame([(1, k) for k in range(500)] + [(None, 900), (None, 901), (2, 902)], "k int, r int")
    got = {r["r"]: (r["selection_status"], r["superseded_by"]) for r in selection.with_selection(df, ["k"], [F.desc("r")], "r").collect()}
    assert got[499] == ("authoritative", None) and got[3] == ("superseded", 499) and got[900] == got[901] == got[902] == ("authoritative", None)


def test_regroup_in_runs(spark):
    df = spark.createDataFrame([(1, k, f"t{k}") for k in range(1000)] + [(2, 5, None)], "c int, n int, t string")
    got = {r["c"]: r for r in shaping.regroup(df, ["c"], "n", "t", "|", 7).collect()}
    assert got[1]["joined"] == "|".join(f"t{k}" for k in range(1000)) and got[1]["parts"] == 1000 and got[2]["joined"] == ""


def test_headers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"meta": {"id": {"column": "a", "expected_header": "ID"}}, "groups": [{"x": {"column": "B", "expected_header": "Name"}}, {"x": {"column": "b"}}]}))
    m = headers.mapping(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in headers.duplicate_columns(m).collect()] == [("duplicate_mapping_column", "B", "x, x")]
    like = spark.createDataFrame([("Name2", "name", True), ("name (if any)", "Name", True), ("Names", "Name", False), (" NA ME", "na me", True), ("name", "name 3", True)], "a string, e string, ok boolean")
    assert all(r["ok"] == r["got"] for r in like.select("ok", headers.broadly_alike(F.col("a"), F.col("e")).alias("got")).collect())


def test_configuration(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"fields": {"a.b": {"required": True, "llm": {"enabled": True, "purpose": "p", "use_only_when": "not_exact_vocab_match", "rules": ["x"]}}, "c": {}}}))
    assert {r["rule"]: r["enabled"] for r in config.field_rules(spark, str(tmp_path / "r.json")).collect()} == {"a.b": True, "c": False}
    (tmp_path / "e.txt").write_text('# none@x.org\nA@x.org\n["b@y.org", "c@z.org"]\n')
    assert {r["email"] for r in config.exclusions(spark, str(tmp_path / "e.txt")).collect()} == {"a@x.org", "b@y.org", "c@z.org"}
    assert config.exclusions(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "s.json").write_text('{"x": 3} and rubbish')
    assert config.tolerant_json(spark, [str(tmp_path / "none"), str(tmp_path / "s.json")], "x int").first()["x"] == 3
    items = spark.createDataFrame([("v", 0, "7", " Civil & Family "), ("v", 1, None, "Crime"), ("v", 2, "8", " ")], "vocabulary string, position int, id string, name string")
    own = config.owned_lists(items)
    assert [(r["code"], r["api_id"]) for r in own.orderBy("position").collect()] == [("civil_family", "7"), ("crime", None)]
    assert [r["api_id"] for r in config.type_options(own, "v").collect()] == ["7"]


def test_sinks(spark):
    recs = registry_forms._records(spark, "/root/testdata/sf0.001")
    done = validate.revalidated(recs, registry_forms._lists(spark), registry_forms._DAYS).cache()
    out = archive.processing_outputs(done, ["court_slug", "addresses"])
    n = {k: v.count() for k, v in out.items()}
    assert n["failed"] == done.filter("status = 'failed'").count() and n["summary"] == 1 and n["payload"] == done.filter("status like 'processed%'").count() and n["issues"] > 0
    assert set(archive.review_sheets(done)) == {"Records", "Addresses", "Contacts", "Opening hours", "Issues"} and archive.review_sheets(done)["Addresses"].count() == done.count()
    rows = spark.createDataFrame([(1, "a", "superseded", 2), (2, "a", "authoritative", None), (3, "b", "authoritative", None)], "source_row_number int, court_slug string, selection_status string, superseded_by int")
    sheets = archive.duplicate_sheets(rows)
    assert [tuple(r) for r in sheets["Overview"].collect()] == [("D001", "a", 2, 2)] and sheets["Rows"].count() == 2
    users = spark.createDataFrame([("a@x",), ("b@x",)], "email string")
    got = archive.approval_users(users, users.limit(1))
    assert got["users"].count() == got["excluded"].count() == 1


def test_approvals_are_all_or_nothing(spark):
    c = spark.createDataFrame([(1, True, False, False, 1, 1), (2, True, True, False, 1, 1)], "action_id int, has_existing boolean, no_change boolean, conflicts boolean, current_hash int, proposed_hash int")
    none = c.select("action_id", "current_hash", "proposed_hash").limit(0)
    now, refused = execution.approve_targets(c, none, c)
    assert now.count() == 0 and [tuple(r) for r in refused.collect()] == [(2, "no approval needed")]
    now, refused = execution.approve_targets(c, none, c.filter("action_id = 1"))
    again, _ = execution.approve_targets(c, now, c.filter("action_id = 1"))
    assert now.count() == again.count() == 1 and refused.count() == 0


def test_errors_of_calls(spark):
    df = spark.createDataFrame([("timeout",), ("rejected",), ("odd",), (None,)], "k string")
    assert [r[0]["status"] for r in df.select(execution.after_error(F.col("k"))).collect()] == ["unknown", "failed", "unknown", "unknown"]


def test_review_orders(spark):
    items = spark.createDataFrame([("b", 1, "address", None, None), ("a", 1, "field", "x", "low"), ("c", 0, "field", "y", "high"), ("d", 9, "field", "z", "sure")], "review_id string, row int, kind string, field string, confidence string")
    assert [r["review_id"] for r in review.in_review_order(items).collect()] == ["c", "a", "b", "d"]
    assert [r["review_id"] for r in items.orderBy(*review.report_order()).collect()] == ["c", "a", "b", "d"]
    assert registry_review.RESOURCES and nested.SERVER_KEYS


def test_links_are_each_made_once_and_pairs_are_not_shuffled(spark):
    """Paths inside each other, repeated rows, ids that stand in several places, nulls: the pairs of the definition, none twice, and no more rows shuffled than the two sides have."""
    import random

    r = random.Random(4)
    path = lambda: r.choice(["a", "a.b", "a.b.c", "a[1]", "a[1].b", "ab", "c", "c.d", None])
    items = [(k % 90, r.choice([1, 2, None]), path()) for k in range(110)]
    actions = [(k % 70, r.choice([1, 2, None]), [path() for _ in range(r.randint(0, 4))], [r.randint(0, 99) for _ in range(r.randint(0, 3))]) for k in range(80)]
    over = lambda x, y: x is not None and y is not None and (x == y or any(p.startswith(q + e) for p, q in ((x, y), (y, x)) for e in ".["))
    want = {(a, i) for a, _, _, named in actions for i, _, _ in items if i in named} | {(a, i) for a, ra, ps, _ in actions for i, ri, f in items if ra is not None and ra == ri and any(over(p, f) for p in ps)}
    frames = lambda i, a: (spark.createDataFrame(i, "review_id long, row int, field string"), spark.createDataFrame(a, "action_id long, row int, source_fields array<string>, review_ids array<long>"))
    got = [tuple(x) for x in review.links(*frames(items, actions)).select("action_id", "review_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    last = review.links(*frames(items, actions))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert last[0].startswith("Union")


def test_links_shuffle_each_side_once_and_meet_as_lists(spark):
    """Actions that share their paths and items that share their place meet as lists, not row by row; each table is gathered by its ids once; rows without an id make their pairs once too."""
    import re

    actions = [(k if k else None, k % 2, ["a.b"] if k % 3 else ["c", "a[1]"], [k % 7 if k else 8, None]) for k in range(600)]
    items = [(k if k else None, k % 2, ["a", "a.b.c", "a[1].x", "d"][k % 4]) for k in range(400)] + [(5, 0, "c.e")]
    over = lambda x, y: x == y or any(p.startswith(q + e) for p, q in ((x, y), (y, x)) for e in ".[")
    want = {(a, i) for a, ra, ps, named in actions for i, ri, f in items if (i is not None and i in named) or (ra == ri and any(over(p, f) for p in ps))}
    i, a = spark.createDataFrame(items, "review_id long, row int, field string"), spark.createDataFrame(actions, "action_id long, row int, source_fields array<string>, review_ids array<long>")
    df = review.links(i, a)
    got = [tuple(x) for x in df.select("action_id", "review_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [x for x in final.split("\n") if re.search(r"(?<!Reused)Exchange hashpartitioning", x)]
    assert sum("Reused" not in x for x in made) <= 7 and sum("Reused" in x for x in made) == 2
