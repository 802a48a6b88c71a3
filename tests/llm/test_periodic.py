import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillfold.llm import periodic
from quillfold.llm.queries import planted


def expected_runs(words, times=4, least=6):
    """Every stretch of every period, and of those that cover one another the smallest period."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(r for r in out if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in out))


def expected(docs, rewrite=None, times=4, least=6):
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        if rewrite:
            w = [w[k] for k in rewrite([i], np.array([0, len(w)])).tolist()]
        runs = expected_runs(w, times, least)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), tuple(runs), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def got(df, **more):
    return Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["kept_sha256"]) for r in periodic.periodic_runs(df, **more).collect())


@pytest.fixture(scope="module")
def periodic_texts(spark):
    """Fibonacci and Thue-Morse words, powers inside powers, runs that touch, one word thousands of times, copies of a run in other documents."""
    r = random.Random(4)
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts = [" ".join(fib[-1]), " ".join("ab" * 40 + "ba" * 40), " ".join(("aab" * 5 + "c") * 6), "x " * 5, "x " * 6, "x y " * 3 + "x", "x y " * 4, "word " * 20_000, "a b c a b c a b c a b", "a b c " * 4]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += [" ".join((r.choices("abc", k=r.randint(1, 6)) * r.randint(1, 9))[r.randint(0, 3) :]) + " " + " ".join(r.choices("abc", k=9)) for _ in range(150)]
    texts += [texts[2], texts[2] + " tail", None, "", " \t\n"]
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "q " * 9, 1), (3, "x " * 5, 1)], "doc_id long, text string, runs int").repartition(3)


def test_against_every_period(periodic_texts, nasty, empty):
    short = periodic_texts.filter("text is null or length(text) < 10000")
    assert got(short) == expected(plain(short))
    assert got(nasty.filter("text is null or length(text) < 10000")) == expected(plain(nasty.filter("text is null or length(text) < 10000")))
    assert not got(empty)


def test_other_thresholds(periodic_texts):
    short = periodic_texts.filter("text is null or length(text) < 500")
    for times, least in ((2, 2), (3, 10)):
        assert got(short, params=periodic.RunParams(times, least)) == expected(plain(short), None, times, least)


def test_one_word_thousands_of_times(periodic_texts):
    row = periodic.periodic_runs(periodic_texts.filter("length(text) > 10000"), with_text=True).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 20_000, 1)] and row["kept_text"] == "word"


def test_query(documents):
    """The digest columns, with the planted periods, against the plain search."""
    short = documents.filter("length(text) < 6000")
    rows = {r["doc_id"]: r for r in periodic.digest(periodic.periodic_runs(short, rewrite=planted)).collect()}
    want = expected(plain(short), planted)
    assert len(rows) == sum(want.values()) and sum(len(x[2]) > 0 for x in want) > 5
    for i, _, runs, kept in want:
        r = rows[i]
        best = max(runs, key=lambda x: (x[1] * 10**9 // x[2], -x[0], -x[2]), default=None)
        assert (r["n_runs"], r["collapsed_sha256"]) == (len(runs), kept)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
