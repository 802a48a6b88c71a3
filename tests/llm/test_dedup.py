import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quillfold.llm import jaccard_join as J
from quillfold.llm import substring, suffix_index, superkmer
from quillfold.llm.components import connected_components


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def digest(b):
    return hashlib.sha256(b).hexdigest()


def expected_words(docs, width=13):
    first, out = {}, []
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), digest(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return Counter(out)


def expected_bytes(docs, width=100):
    first, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            if i is not None:
                key = b[k : k + width]
                first[key] = min(first.get(key, (i, k)), (i, k))
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - width + 1):
            if i is not None and first[b[k : k + width]] < (i, k):
                gone[k : k + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), digest(kept)))
    return Counter(out)


@pytest.mark.parametrize("which", ["documents", "nasty", "empty"])
def test_substring(which, request):
    df = request.getfixturevalue(which)
    assert Counter(tuple(r) for r in substring.remove_repeats(df).collect()) == expected_words(pairs(df))


@pytest.mark.parametrize("which", ["documents", "nasty", "empty"])
def test_suffix_index(which, request):
    df = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in suffix_index.remove_repeats(df).collect())
    want = expected_bytes(pairs(df))
    assert got == want


def test_suffix_index_in_small_batches(documents):
    small = suffix_index.SuffixParams(batches=40, least_batch=1)
    assert Counter(tuple(r) for r in suffix_index.remove_repeats(documents, small).collect()) == expected_bytes(pairs(documents))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def long_words(spark):
    """Words that polynomial hashes modulo a power of two take for one, and a word of a megabyte."""
    x, y = thue_morse(1024)
    tail = " ".join(f"w{k}" for k in range(12))
    big = "".join(f"{k:x}" for k in range(200_000))
    texts = [f"{x} {tail}", f"{y} {tail}", f"{x} {tail} more", big, f"{big} z", f"q {big[1:]}", " ".join([y, x] * 20), big[:500_000] + "!" + big[500_001:]]
    return spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)


def test_structured_and_very_long_words(long_words):
    assert Counter(tuple(r) for r in substring.remove_repeats(long_words).collect()) == expected_words(pairs(long_words))
    assert Counter(tuple(r) for r in suffix_index.remove_repeats(long_words).collect()) == expected_bytes(pairs(long_words))
    for n, percent in ((3, 90), (5, 80)):
        got = Counter(tuple(r) for r in J.jaccard_components(long_words, J.JaccardParams(n=n, percent=percent)).collect())
        assert got == expected_components(pairs(long_words), n, percent)


def test_rows_of_one_id_with_other_texts(spark):
    """Places are compared by id and start, across the rows of an id too."""
    r = np.random.default_rng(3)
    a, b, c = ("".join(map(chr, r.integers(97, 123, 260))) for _ in range(3))
    df = spark.createDataFrame([(1, a + b), (1, b + c), (1, a + b), (2, c + a), (0, b[:150]), (2, b)], "doc_id long, text string")
    assert Counter(tuple(x) for x in suffix_index.remove_repeats(df).collect()) == expected_bytes(pairs(df))


def test_a_changed_pack_is_an_error(spark):
    from pyspark.sql import functions as F

    df = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"w{k}") for k in range(20)], F.rand().cast("string"), *[F.lit(f"v{k}") for k in range(20)]).alias("text"))
    shaky = df.withColumn("text", F.concat("text", F.udf(lambda: str(__import__("time").time_ns()), "string").asNondeterministic()()))
    with pytest.raises(Exception, match="changed between two readings"):
        substring.remove_repeats(shaky).collect()


def test_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    family = suffix_index.IndexFamily(suffix_index.Text(data), 20)
    for k in range(1, 20):
        at = np.arange((k - 1) * 200, k * 200)
        family.add(at, at)
        assert [level.size for level in family.levels] == [1 << b for b in range(10, -1, -1) if k >> b & 1]
        for level in family.levels:
            texts = [data[p : p + 20].tobytes() for p in level.array.at]
            assert texts == sorted(set(texts))
            assert level.array.shared.tolist() == [0] + [next((i for i in range(20) if x[i] != y[i]), 20) for x, y in zip(texts, texts[1:], strict=False)]


def test_the_query_leaves_three_levels(documents):
    """The shards of the registered query's own parameters, put together as its tasks do."""
    import pyarrow as pa

    p = suffix_index.SuffixParams()
    w = superkmer.Windows(suffix_index.byte_units(p.gram), p.width, p.gram, bytewise=True, by_start=True)
    seen = []
    got = superkmer.packs(documents, w, 8, "doc_id", "text").toArrow()
    for k in range(8):
        part = got.filter(pa.compute.equal(got.column("bucket"), k))
        b = superkmer.opened(iter(part.to_batches()))
        if b is not None:
            suffix_index.mark_bytes(p, seen)(b)
    assert max(map(len, seen)) >= 3 and [4, 2, 1] in seen


def test_windows_with_one_fingerprint_are_told_apart(monkeypatch):
    words = np.array([1, 2, 3, 1, 2, 3, 9, 1, 2, 3])
    at = np.arange(8)
    want = substring.sorted_windows(words, at, 3)[1].sum()
    monkeypatch.setattr(substring.K, "gram_hashes", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    order, new = substring.sorted_windows(words, at, 3)
    groups = np.split(order, np.flatnonzero(new)[1:])
    assert new.sum() == want and sorted(map(tuple, map(sorted, groups)))[0] == (0, 3, 7)


def test_kept_text(nasty):
    got = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(nasty, with_text=True).collect()}
    assert got[4] == "" and got[6] == "one two"


def test_packed_columns_survive():
    a, b = np.array([-5, 3, 1 << 40]), np.array([], dtype=np.int64)
    x, y = superkmer.loose(superkmer.tight(a, b))
    assert x.tolist() == a.tolist() and len(y) == 0


def sets_of(docs, n):
    out = []
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def expected_components(docs, n, percent):
    sets = sets_of(docs, n)
    parent = {i: i for i, _ in sets if i is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i is not None and j is not None and a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= percent * (len(a) + len(b) - k):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


@pytest.mark.parametrize(("which", "n", "percent"), [("documents", 3, 90), ("documents", 5, 80), ("nasty", 3, 90), ("nasty", 5, 80), ("empty", 3, 90)])
def test_jaccard_components(which, n, percent, request):
    df = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in J.jaccard_components(df, J.JaccardParams(n=n, percent=percent)).collect())
    assert got == expected_components(pairs(df), n, percent)


def test_jaccard_with_tiny_tiles(documents):
    tiny = J.JaccardParams(n=3, percent=60, long_list=3, tile=3, bucket_rows=10)
    assert Counter(tuple(r) for r in J.jaccard_components(documents, tiny).collect()) == expected_components(pairs(documents), 3, 60)


def test_a_large_cluster_meets_its_hub(spark):
    """Near copies of one text in chains that lead away from the hub, far beyond a tile."""
    r = np.random.default_rng(11)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(160):
        w = base.copy()
        for _ in range(k % 12):
            w[int(r.integers(60))] = f"x{r.integers(9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for percent in (50, 70, 85):
        p = J.JaccardParams(n=2, percent=percent, long_list=40, tile=8)
        assert Counter(tuple(x) for x in J.jaccard_components(df, p).collect()) == expected_components(pairs(df), 2, percent)


def test_subsets_find_small_sets(spark):
    texts = ["a b c d e f g h i j k l m n", "a b c d e f g h i j k l m x", "a b c d e f g h i j k l m", "q r s"] * 4
    df = spark.createDataFrame([(i, f"{t}" if i % 2 else t.upper()) for i, t in enumerate(texts)], "doc_id long, text string")
    p = J.JaccardParams(n=1, percent=80)
    sets = J.signatures(df, np.zeros(1 << J.SLOT_BITS, np.int64), p, "doc_id", "text").dropDuplicates(["k1", "k2"])
    links = {tuple(sorted((r["u"], r["v"]))) for r in J.light_links(sets, 20, p).collect()}
    assert len(connected_components(J.light_links(sets, 20, p)).select("component").distinct().collect()) == 1 and links


def test_both_sides_have_sets(documents):
    """The boundary by cost leaves sets of the documents on the light side and on the heavy one."""
    p = J.JaccardParams(n=3, percent=90)
    sets = J.signatures(documents, J.shingle_sketch(documents, p, "text"), p, "doc_id", "text").filter("n > 0")
    x = J.choose_boundary(sets, p)
    assert x > 0 and sets.filter(f"n <= {x}").count() > 0 and sets.filter(f"n > {x}").count() > 0


def test_one_of_each(nasty):
    kept = J.one_of_each(nasty)
    assert kept.columns == nasty.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 4 not in ids and 5 not in ids and 3 in ids and 0 in ids and None in ids


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert set(got) == {*range(201), 500, 501} and {got[k] for k in range(201)} == {0} and got[501] == 500
