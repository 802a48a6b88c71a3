import random
import re
from collections import Counter

import pytest

from quillfold.llm import decontaminate as D
from quillfold.llm.common import materialise

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def windows_of(w, width):
    return [tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]


def expected(docs, items, width=10):
    known = {}
    for i, t in items:
        for x in windows_of(words(t), width):
            if i is not None:
                known.setdefault(x, set()).add(str(i))
    sizes = {len(x) for x in known}
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := known.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    named |= ids
        out.append((i, len(w), len(hit), tuple(sorted(named))))
    return Counter(out)


def got(docs, items, p=D.DecontaminationParams()):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in D.decontaminate(docs, items, p).collect())


def plain(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


@pytest.fixture(scope="module")
def tables(spark):
    """Few words, so that windows meet everywhere; short items, equal items, repeated rows, an id on two texts, nulls, clashing columns."""
    r = random.Random(8)
    some = lambda n, of="abcd": " ".join(r.choice(of) for _ in range(n))
    items = [(k, some(r.randint(1, 25))) for k in range(25)] + [(30, "a A-a"), (31, "a a, a!"), (32, None), (33, " .,"), (None, some(12)), (1, some(15)), (34, "É rare wörd"), (35, "x " * 12), (36, some(40)), (36, some(40))]
    copy = dict(items[:25])
    docs = [(k, some(r.randint(0, 120)) + "; " + (copy[k % 25] if k % 3 else "é rare wörd.") + "\n" + some(5, "uvw")) for k in range(80)]
    docs += [(100, None), (101, ""), (102, "x\tX " * 3000), (103, "É RARE WÖRD"), (5, docs[5][1]), (5, "a a a"), (None, docs[7][1]), (104, "É rare wörd")]
    return (
        spark.createDataFrame([(k, t, "z", 1, 2) for k, t in docs], "doc_id long, text string, word string, row int, pos int").repartition(3),
        spark.createDataFrame([(k, t, 9) for k, t in items], "item_id long, text string, seq int").repartition(2),
    )


@pytest.mark.parametrize("p", [D.DecontaminationParams(), D.DecontaminationParams(width=3), D.DecontaminationParams(width=1), D.DecontaminationParams(width=4, most_broadcast=0)])
def test_exact(tables, p):
    docs, items = tables
    assert got(docs, items, p) == expected(plain(docs, "doc_id"), plain(items, "item_id"), p.width)


def test_documents_nasty_and_empty(spark, sf, documents, nasty, empty, tables):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = expected(plain(documents, "doc_id"), plain(benchmark, "item_id"))
    assert got(documents, benchmark) == want and any(x[2] for x in want)
    assert got(nasty, tables[1]) == expected(plain(nasty, "doc_id"), plain(tables[1], "item_id"))
    assert not got(empty, benchmark)
    assert got(nasty, benchmark.limit(0)) == expected(plain(nasty, "doc_id"), [])


def test_near_matches(tables):
    """All words of a window within a span of the document that holds its rarest word."""
    docs, items = tables
    p = D.DecontaminationParams(width=4, slack=2)
    read = D.read_items(items)
    index = D.build_index(docs, materialise(read.places.select("word").distinct(), "terms"), p)
    found = D.near_matches(read, index, p)
    ids = {r["row"]: r["_id"] for r in index.filter("word is null").select("row", "_id").collect()}
    texts = {r["seq"]: [] for r in read.places.select("seq").distinct().collect()}
    for r in read.places.orderBy("seq", "ipos").collect():
        texts[r["seq"]].append(r["word"])
    got_ = {(ids[r["row"]], r["seq"], r["start"]) for r in found.collect() if ids[r["row"]] not in (5, None)}
    want, span = set(), p.width + p.slack
    for i, t in plain(docs, "doc_id"):
        w = words(t)
        for seq, item in texts.items():
            for k, x in enumerate(windows_of(item, p.width)):
                if i not in (5, None) and any(set(x) <= set(w[a : a + span]) for a in range(max(1, len(w) - span + 1))):
                    want.add((i, seq, k))
    assert got_ == want and want
