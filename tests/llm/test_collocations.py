import random
import re
from collections import Counter

import pytest

from quillfold.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_counts(docs, words=3):
    f = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und", ""] += len(w)
            for n in range(1, words + 1):
                for i in range(len(w) - n + 1):
                    f[lang or "und", " ".join(w[i : i + n])] += 1
    return f


def expected(docs, p):
    f = expected_counts(docs, p.words)
    cand = {k: a for k, a in f.items() if " " in k[1] and a >= p.least}
    out = {}
    for lang in {k[0] for k in cand}:
        rows = []
        for (_, phrase), a in ((k, a) for k, a in cand.items() if k[0] == lang):
            if any(f" {phrase} " in f" {o} " and 100 * b >= p.inside_percent * a for (m, o), b in cand.items() if m == lang and len(o) > len(phrase)):
                continue
            w = phrase.split(" ")
            cuts = [(1_000_000 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, phrase.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[: p.top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, f[lang, ""], -s)
    return out


def check(df, p):
    docs = [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]
    rows = C.collocations(df, p).collect()
    assert {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows} == expected(docs, p)
    return rows


@pytest.fixture(scope="module")
def phrases(spark):
    """Few words, so that phrases overlap and repeat; long pieces, odd separators, a hot phrase, upper case, null languages."""
    r = random.Random(11)
    words = ["a", "B", "c\x0bd", "é", "É", "x-y", " ", "zz\x1c", "w" * 200]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) + r.choice([".", ", ", "\t\t", "\n", "!?", ""]) + " ".join(r.choice("abc") for _ in range(12)) for _ in range(120)]
    texts += ["hot phrase here"] * 60 + [" ".join(r.choice("ab") for _ in range(3000)), None, "", " \t,;", "Hot  PHRASE\there"]
    return spark.createDataFrame([(k, t, r.choice(["en", "fr", None, "und"]), "shard", 2.5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, chunk string, a double").repartition(4)


@pytest.mark.parametrize("p", [C.CollocationParams(), C.CollocationParams(least=2, top=50, shard_bytes=2000), C.CollocationParams(words=4, least=3, every=2, shard_bytes=500), C.CollocationParams(words=2, every=1)])
def test_against_plain_counts(phrases, p):
    assert check(phrases, p)


def test_documents(documents, nasty, empty):
    assert check(documents, C.CollocationParams(shard_bytes=100_000))
    check(nasty, C.CollocationParams(least=2))
    assert C.collocations(empty).count() == 0


def test_chunks_own_each_phrase_once(documents):
    """The dictionary alone gives the counts of all phrases, rare ones too."""
    p = C.CollocationParams(least=1, shard_bytes=200_000)
    got = {(r["lang"], r["phrase"]): r["a"] for r in C.phrase_counts(documents, p).collect()}
    want = expected_counts([(r["lang"], r["text"]) for r in documents.select("lang", "text").collect()])
    assert got == {k: v for k, v in want.items() if v}


def test_scores_beyond_64_bits(spark):
    """The quotient of the score's expression is exact where products pass 64 bits."""
    r = random.Random(2)
    rows = []
    for _ in range(300):
        a = r.randint(10, 10 ** r.randint(2, 14))
        rows.append((a, a + r.randint(0, 10 ** r.randint(1, 14)), a + r.randint(0, 10 ** r.randint(1, 14))))
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [x["score"] for x in df.select(C.score("a", "l", "r").alias("score")).collect()] == [1_000_000 * a * a // (b * c) for a, b, c in rows]
