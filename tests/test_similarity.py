"""Similarity joins by bounds: the same results as difflib over all pairs, few of them compared."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillfold.operators import addresses as A
from quillfold.operators import matching, suggest


@pytest.fixture(scope="module")
def lookup(spark):
    """Addresses of a few postcodes with many rivals of like names, exact ones, repeated uprns, long texts and letters beyond ASCII."""
    r = random.Random(3)
    streets, towns = ["King St", "Kings Street", "High Road", "Hill Rd", "Queen's Ave", "Émile Lane"], ["Leeds", "Hull", "Leeds"]
    candidates = []
    for post in ("P1", "P2", "P3"):
        for k in range(60):
            number, street, town = str(r.randint(1, 99)), r.choice(streets), r.choice(towns)
            candidates.append((post, k, f"u{r.randint(0, 70)}", r.choice([None, "The Law Centre", "x" * 210]), number, None, street, town, None, f"{number} {street}, {town}", post))
    rows = []
    for k in range(40):
        exact = r.choice(candidates)
        line = f"{exact[4]} {exact[6]}" if k % 3 else f"{r.randint(1, 99)} {r.choice(streets)}"
        rows.append((k, k % 2, line, r.choice([None, "Flat 2"]), r.choice([exact[7], None, "York"]), None, exact[0] if k % 7 else "P9"))
    return (
        spark.createDataFrame(rows, "row long, index int, line_1 string, line_2 string, town string, county string, postcode string"),
        spark.createDataFrame(candidates, "postcode string, position int, uprn string, organisation string, number string, name string, street string, town string, county string, address string, found_postcode string"),
    )


def all_scores(addresses, candidates):
    """Every pair's score, by the definition."""
    canon = lambda *p: matching.canonical_address.func(__import__("pandas").Series([" ".join(x for x in p if x)]))[0]
    first = {}
    for c in candidates:
        who = (c["postcode"], c["uprn"] or c["address"])
        if who not in first or c["position"] < first[who]["position"]:
            first[who] = c
    out = {}
    for a in addresses:
        source, town = canon(a["line_1"], a["line_2"], a["town"]), canon(a["town"])
        words = set(source.split())
        for c in first.values():
            if c["postcode"] != a["postcode"]:
                continue
            best = 0
            for t in (canon(c["organisation"], c["town"]), canon(c["organisation"], c["number"], c["name"], c["street"], c["town"]), canon(c["address"])):
                cover = len(words & set(t.split())) / len(words) if words else 0
                fits = not town or town in t
                ratio = difflib.SequenceMatcher(None, source, t).ratio()
                best = max(best, 1.0 if source == t and fits else 0.99 if cover == 1 and len(words) >= 2 and fits else round(0.7 * cover + 0.3 * ratio, 4))
            out.setdefault((a["row"], a["index"]), {})[c["position"]] = best
    return out


@pytest.mark.parametrize("k", [1, 2, 10])
def test_the_best_candidates_are_those_of_all_pairs(lookup, k):
    addresses, candidates = lookup
    want = all_scores(addresses.collect(), candidates.collect())
    got = {}
    for r in A.scored(addresses, candidates, k).collect():
        got.setdefault((r["row"], r["index"]), {})[r["position"]] = r["score"]
    assert set(got) == set(want)
    for key, scores in want.items():
        assert all(abs(got[key][p] - scores[p]) < 1e-4 + 1e-9 for p in got[key])
        top = sorted(scores.values(), reverse=True)[:k]
        assert sorted(got[key].values(), reverse=True)[:k] == pytest.approx(top, abs=1.1e-4)
    assert A.survivors(addresses, candidates, 1).count() < 0.25 * sum(map(len, want.values()))


def test_bounds_hold(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde -é7") for _ in range(r.choice([0, 1, 3, 12, 40, 230])))
    rows = [(a := word(), r.choice([word(), a, a[: len(a) // 2] + word(), word() + a[len(a) // 2 :]])) for _ in range(600)]
    df = spark.createDataFrame(rows, "a string, b string")
    low, high = matching.ratio_bounds(F.col("a"), F.col("b"), matching.letter_counts(F.col("a")), matching.letter_counts(F.col("b")))
    for x in df.select("a", "b", low.alias("low"), high.alias("high")).collect():
        ratio = difflib.SequenceMatcher(None, x["a"], x["b"]).ratio()
        assert x["low"] - 1e-12 <= ratio <= x["high"] + 1e-12, x


def test_best_names(spark):
    """The best known name of each asked one, as over all pairs that share two neighbouring letters."""
    r = random.Random(5)
    name = lambda: " ".join(r.choice(["north", "south", "leeds", "hull", "king", "queen", "bridge", "port"]) for _ in range(r.randint(1, 3)))
    known = sorted({name() for _ in range(60)})
    asked = [n[:3] + n[4:] for n in known] + [n + "s" for n in known]
    a, b = spark.createDataFrame([(x,) for x in sorted(set(asked))], "q string"), spark.createDataFrame([(x,) for x in known], "n string")
    rows = suggest.likeliest_names(a, b, "q", "n").collect()
    best = {}
    for x in rows:
        best[x["q"]] = max(best.get(x["q"], 0), x["score"])
    assert best == pytest.approx({q: max(difflib.SequenceMatcher(None, q, n).ratio() for n in known) for q in set(asked)})
    assert len(rows) < 0.2 * len(set(asked)) * len(known)


def test_best_pairs_of_blocks_are_those_of_all_pairs():
    """A postcode of many rivals: the first of the best, ties included, as over all pairs; few texts are compared."""
    import pandas as pd

    r = random.Random(8)
    asked = pd.DataFrame({"postcode": "P", "_source": sorted({f"{r.randint(1, 977)} king street leeds" for _ in range(40)} | {"", "hull", "leeds king street"})})
    asked["_town"] = ["leeds" if k % 3 else "" for k in range(len(asked))]
    candidates = pd.DataFrame({"position": list(range(900)), "_t": [["leeds", f"{k + 1} king street leeds"] if k % 4 else ["", f"{k + 1} kings road hull"] for k in range(900)]})
    for k in (1, 2, 10):
        matching._ratio.cache_clear()
        got = matching.best_pairs(asked, candidates, k)
        compared = matching._ratio.cache_info().misses
        want = []
        for source, town in zip(asked["_source"], asked["_town"], strict=True):
            words, all_ = set(source.split()), []
            for p, ts in zip(candidates["position"], candidates["_t"], strict=True):
                score = 0
                for t in ts:
                    cover = len(words & set(t.split())) / len(words) if words else 0.0
                    fits = town in t
                    score = max(score, 10000 if source == t and fits else 9900 if cover == 1 and len(words) >= 2 and fits else matching._points(0.7 * cover + 0.3 * difflib.SequenceMatcher(None, source, t).ratio()))
                all_.append((-score, p))
            want += [(source, p, -s / 10000) for s, p in sorted(all_)[:k]]
        assert sorted(zip(got["_source"], got["position"], got["score"], strict=True)) == sorted(want)
        assert compared < 0.25 * len(asked) * 1800


def test_small_blocks_give_the_same(lookup, monkeypatch):
    addresses, candidates = lookup
    rows = lambda: sorted((r["row"], r["index"], r["position"], r["score"]) for r in A.scored(addresses, candidates, 2).collect())
    want = rows()
    monkeypatch.setattr(A, "ADDRESS_BLOCK", 3)
    monkeypatch.setattr(A, "CANDIDATE_BLOCK", 7)
    assert rows() == want
