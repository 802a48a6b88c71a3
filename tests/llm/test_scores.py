import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillfold.llm import divergence, kernels, mixing, packing, quality, secret_scan, topk, toxicity


def test_words_split_like_the_pattern():
    texts = ["", " a  b", "x\x1cy\x85z\xa0w v", "ü\tö\x0b\x0cq\r\n", "tail ", None]
    data, rows = kernels.buffer_of(pa.array(texts))
    w = kernels.words_of(data, rows)
    got = [[bytes(data[a:b]).decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


@pytest.mark.parametrize("which", ["documents", "nasty", "empty"])
def test_divergence_base_counts(which, request):
    df = request.getfixturevalue(which)
    texts = Counter((r["doc_id"], *brute_base(r["text"])) for r in df.collect())
    rows = divergence.divergence_rules(df).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows) == texts
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_js_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    got = spark.createDataFrame([(p,)], "p array<double>").select(divergence.js_distance(F.col("p"), q).alias("d")).first()["d"]
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_toxicity(documents, labels, nasty, empty):
    rows = toxicity.classify(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    index = toxicity.fit(documents, labels)
    assert len(toxicity.score_documents(nasty, index).collect()) == nasty.count()
    assert toxicity.classify(empty, labels.limit(0)).count() == 0
    assert {r["score"] for r in toxicity.classify(nasty, labels.limit(0)).collect()} == {0.1}


def test_toxic_texts_of_the_held_out_fold_are_caught(spark):
    at = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in toxicity.classify(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    caught = [r["predicted"] for r in rows if truth[r["doc_id"]] == 1]
    alone = [r["predicted"] for r in rows if truth[r["doc_id"]] == 0]
    assert len(caught) > 100 and np.mean(caught) >= 0.9 and np.mean(alone) <= 0.02


def test_only_near_copies_leave_the_sample():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(400)]
    near, half = texts[7].split(), texts[8].split()
    near[60], half[60:] = "other", texts[9].split()[60:]
    texts += [texts[3], " ".join(near), " ".join(half), ""]
    h, first = toxicity.term_hashes(*kernels.buffer_of(pa.array(texts)))
    assert toxicity._spread_out([h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]) == [*range(400), 402]


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    a = rng.random((150, 40)).astype(np.float32) * (rng.random((150, 40)) < 0.2)
    a[a.sum(1) == 0, 0] = 1
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    q = rng.random((60, 40)).astype(np.float32) * (rng.random((60, 40)) < 0.2)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    maxima = np.maximum.reduceat(a, np.arange(0, 150, toxicity.BLOCK), axis=0).T
    index = toxicity.Index(np.empty(0, np.uint64), np.empty(0), a, maxima, np.zeros(150, int))
    sim, place = toxicity.nearest(index, q, 7)
    want = np.round(q @ a.T, 6)
    order = np.lexsort((np.broadcast_to(np.arange(150), want.shape), -want), axis=1)[:, :7]
    best = np.take_along_axis(want, order, 1)
    assert np.allclose(sim, np.maximum(best, 0), atol=2e-6) and ((place == order) | (best <= 0) | np.isclose(sim, best, atol=2e-6)).all()


def test_every_term_of_the_examples_counts():
    """Against the definition: cosine over all terms of whole texts, more of them than there are head columns."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(1500)]
    power = 1 / np.arange(1, 1501)
    texts = [" ".join(rng.choice(words, rng.integers(5, 90), p=power / power.sum())) for _ in range(420)]
    counts = [Counter(x for w in t.split() for x in (w, "~" + w[:5])) for t in texts]
    examples, asked = range(300), [*range(300, 420)]
    hashes = [toxicity.term_hashes(*kernels.buffer_of(pa.array([t])))[0] for t in texts]
    terms = np.unique(np.concatenate(hashes[:300]))
    names = {x for k in examples for x in counts[k]}
    df = np.array([sum(x in h for h in map(set, hashes)) for x in terms])
    assert len(terms) == len(names) > toxicity.HEAD
    index = toxicity.build_index(hashes[:300], [str(k) for k in examples], np.arange(300) % 2, terms, df, 420, 0.1)

    def factor(x):
        k1, k0 = (sum(x in counts[k] for k in examples if k % 2 == y) for y in (1, 0))
        table, cells = [(k1, 150), (k0, 150)], 0.0
        for k, n in table:
            for seen, share in ((k, (k1 + k0) / 300), (n - k, 1 - (k1 + k0) / 300)):
                cells += 2 * seen * math.log(seen / (n * share)) if seen else 0
        return 0.2 + 0.8 * (min(1, cells / 10.83) if k1 > k0 else 0)

    factors = {x: factor(x) for x in names}

    def vector(c):
        of = lambda x: sum(x in o for o in counts) if x in names else 1
        v = {x: (1 + math.log(n)) * math.log(421 / (1 + of(x))) * factors.get(x, 0.2) for x, n in c.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()}

    vectors = [vector(c) for c in counts]
    _, sim, place = toxicity.score_texts(index, *kernels.buffer_of(pa.array([texts[k] for k in asked])))
    for k, s, p in zip(asked, sim, place, strict=True):
        cosine = {e: sum(w * vectors[e].get(x, 0) for x, w in vectors[k].items()) for e in examples}
        assert s == pytest.approx(sorted(cosine.values(), reverse=True)[: len(s)], abs=3e-6)
        assert s == pytest.approx([cosine[int(index.ids[e])] for e in p], abs=3e-6)


def test_quality(documents, labels, nasty, empty, spark):
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.classify(documents, labels).collect()
    known = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == documents.count() and np.mean([a == b for a, b in known]) > 0.85
    model = quality.fit(documents, labels)
    kept = quality.keep_good(nasty, model)
    assert kept.columns == nasty.columns
    scores = {(r["doc_id"]): r["score"] for r in quality.score_documents(nasty, model).collect()}
    assert scores[0] == scores[1] == scores[2] == model.empty_score
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(nasty, labels.limit(0)).count() == nasty.count()


def test_scores_against_all_labellings(spark, documents, labels):
    """The query's scores of texts of few lines, from the sum over all labellings of their lines."""
    model = quality.fit(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["text"]}
    scored = {r["doc_id"]: r["score"] for r in quality.classify(documents, labels).collect()}
    checked = 0
    for i, t in texts.items():
        data, rows = kernels.buffer_of(pa.array([t]))
        x, length, first = quality.line_features(data, rows)
        n = len(x)
        if not 0 < n <= 9:
            continue
        odds = quality._design(x, first, model.mean, model.scale) @ model.weights
        total, good = 0.0, 0.0
        for m in range(1 << n):
            y = [m >> k & 1 for k in range(n)]
            w = math.exp(sum(odds[k] * y[k] for k in range(n)) + sum(model.transition[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            good += w * sum(v * a for v, a in zip(length, y, strict=True)) / sum(length)
        share = good / total
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * math.log((share + 0.01) / (1.01 - share)) + model.shift))), abs=1e-6)
        checked += 1
    assert checked > 20


def test_rare_and_missing_labels(spark):
    """A rare label is in the sample, labels without texts aren't, and one label alone drops nothing with words."""
    docs = spark.createDataFrame([(k, "$$$ ### BUY | !!!" if k % 40 == 0 else "The cat sat on the mat and it was warm.") for k in range(400)] + [(999, " ")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 40 > 0)) for k in range(400)] + [(k, 1) for k in range(1000, 3000)], "doc_id long, quality int")
    model = quality.fit(docs, labels, quality.QualityParams(max_train_docs=12), held_out=None)
    assert model.trained and {r["doc_id"] % 40 == 0 for r in quality.keep_good(docs, model).collect()} == {False}
    for one in (labels.filter("quality = 1"), labels.filter("quality = 0"), labels.limit(0)):
        assert quality.keep_good(docs, quality.fit(docs, one, held_out=None)).count() == 400


def test_a_repeated_id_gives_one_example(spark):
    rows = [(1, f"again {'abcdefgh'[k % 8]} {'ijklmnop'[k // 8]} word") for k in range(40)] + [(k, f"fine {'abcdefgh'[k - 2]} text") for k in range(2, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1), int(k > 1)) for k in range(1, 8)], "doc_id long, toxic int, quality int")
    index = toxicity.fit(docs, labels, toxicity.ToxicityParams(max_toxic=8, max_clean=8), held_out=None)
    assert sorted(index.ids) == [str(k) for k in range(1, 8)]
    assert quality.fit(docs, labels, quality.QualityParams(max_train_docs=12), held_out=None).trained


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    score, t, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 4, 7])
    p, pairs = quality.marginals(score, t, first)
    want, both = np.zeros(7), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        n, total = b - a, 0.0
        one, two = np.zeros(n), np.zeros((2, 2))
        for m in range(1 << n if n else 0):
            y = [m >> k & 1 for k in range(n)]
            w = math.exp(sum(score[a + k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            one += w * np.array(y)
            for k in range(n - 1):
                two[y[k], y[k + 1]] += w
        if n:
            want[a:b] = one / total
            both += two / total
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_long_chains_agree_with_short_steps(monkeypatch):
    rng = np.random.default_rng(9)
    lengths = [700, 3, 1, 0, 1025, 513]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score, t = rng.normal(size=first[-1]) * 3, rng.normal(size=(2, 2))
    fast = quality.marginals(score, t, first)
    monkeypatch.setattr(quality, "LONG_CHAIN", 1 << 40)
    slow = quality.marginals(score, t, first)
    assert np.allclose(fast[0], slow[0]) and np.allclose(fast[1], slow[1])


def test_a_text_of_very_many_lines(spark, documents, labels):
    model = quality.fit(documents, labels)
    df = spark.createDataFrame([(1, "a line of words\n" * 400_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_lines"] for r in quality.score_documents(df, model).collect()} == {1: 400_000, 2: 1}


def brute_spans(t):
    t = t or ""
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)).encode()).hexdigest()


@pytest.mark.parametrize("which", ["documents", "nasty", "empty"])
def test_secret_spans(which, request):
    df = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["base_sha256"]) for r in secret_scan.digest(secret_scan.scan(df)).collect())
    assert got == Counter((r["doc_id"], brute_spans(r["text"])) for r in df.collect())


def test_copied_examples_are_not_live(spark):
    live, copied = "Zq9xT4mB7vK2pL8wR5nD", "Ab3dEf6hIj9kLm2nOp5q"
    rows = [(k, f"see {copied} here" + (f" and {live}" if k == 0 else ""), f"s{k}", 0) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in secret_scan.scan(df).collect()}
    assert got[0]["n_live"] == 1 and got[0]["n_examples"] == 1 and got[1]["n_live"] == 0
    red = {r["doc_id"]: r for r in secret_scan.redact(df).collect()}
    assert red[0]["text"] == f"see {copied} here and [SECRET]" and red[0]["n_chars"] == len(red[0]["text"]) and red[1]["text"] == rows[1][1]


def test_one_owner_makes_no_example(spark):
    own, shared = "Zq9xT4mB7vK2pL8wR5nD", "Ab3dEf6hIj9kLm2nOp5q"
    langs = ("en", "fr", "de", "es")
    rows = [(k, f"see {own} here", "one", x) for k, x in enumerate(langs)] + [(9 + k, f"see {shared} here", f"s{k % 2}", x) for k, x in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    repo = ("source", "lang")
    got = {r["doc_id"]: (r["n_live"], r["n_examples"], r["spans"]) for r in secret_scan.digest(secret_scan.scan(df, repo_cols=repo)).collect()}
    assert {got[k] for k in range(4)} == {(1, 0, "owned:4:24")} and {got[9 + k] for k in range(4)} == {(0, 1, "")}
    assert {r["doc_id"] for r in secret_scan.redact(df, repo_cols=repo).collect() if r["text"] == "see [SECRET] here"} == set(range(4))


def test_short_and_plain_passwords_are_live(spark):
    live, not_live = ["abc123", "qwerty", "hunter7", "hunter22", "aabbccdd", "correcthorsebattery", "20240611"], ["changeme", "your_api-key_here", "xxxxxxxx", "short"]
    rows = [(k, f"x password: {v} y", f"s{k}", 0) for k, v in enumerate(live + not_live)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert got == {k: "x [SECRET] y" if k < len(live) else t for k, t, _, _ in rows}


def test_a_long_dump_of_tokens():
    """Against comparing every token with every base span; and in a time that grows with the text."""
    r = np.random.default_rng(4)
    text = " ".join("".join(r.choice(list("0123456789abcdefXYZ"), r.integers(18, 40))) if k % 3 else "token=" + "".join(r.choice(list("abcdef0123456789"), 30)) for k in range(3000))
    base, found = secret_scan.find(text)
    want = [(m.start(), m.end()) for m in secret_scan.OWNED.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base)]
    assert [(s, e) for s, k, e, _, _ in found if k == 3] == want and want and len(base) > 1000


def test_owned_spans_of_a_table(spark, documents):
    """Beside the table's own spans, a key of one source is added, and an example of many sources is not."""
    from pyspark.sql import functions as F

    own, copied = "Zq9xT4mB7vK2pL8wR5nD", "Ab3dEf6hIj9kLm2nOp5q"
    first = documents.agg(F.min("source").alias("s")).first()["s"]
    df = documents.withColumn("text", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.lit(copied), F.when(F.col("source") == first, own)))
    rows = secret_scan.digest(secret_scan.scan(df, repo_cols=("source", "lang"))).join(df.select("doc_id", "source", "text"), "doc_id").collect()
    for r in rows:
        spans = [r["text"][int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "owned"]
        assert copied not in spans and (own in spans) == (r["source"] == first) and r["n_examples"] >= 1


def test_redaction_keeps_rows(nasty):
    out = secret_scan.redact(nasty)
    assert out.columns == nasty.columns and out.count() == nasty.count()
    assert any("[SECRET]" in (r["text"] or "") for r in out.collect())


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 4]) for i in range(200)] + [(5, None), (6, [1.0, None] * 4), (7, [float("nan")] * 8), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (10, rows_vec := [0.5] * 8), (None, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, "extra") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, topk.TopKParams(k=9, block_rows=4, shard_rows=16, fan=3)).collect()
    good = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and not any(map(math.isnan, v))]
    want = []
    for i in sorted({i for i, _ in good if i % 20 == 0}):
        q = min(tuple(v) for j, v in good if j == i)
        s = sorted((-int(np.dot(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:9])]
    assert sorted(tuple(r) for r in got) == sorted(want) and rows_vec
    assert topk.top_k(df.limit(0), df).count() == 0


def test_huge_components_take_part(spark):
    rows = [(0, [0.0, 1.0]), (20, [3e17, 0.5]), (2, [0.0, 1e15]), (3, [3e38, -1.0]), (4, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df.filter("vec_id = 0"), df).collect()]
    assert sorted(got) == [(0, 1, 2, int(np.float32(1e15)) * 64 * 64), (0, 2, 20, 32 * 64), (0, 3, 3, -64 * 64)]
    with pytest.raises(Exception, match="leaves the range"):
        topk.top_k(df.filter("vec_id = 20"), df.union(spark.createDataFrame([(9, [3e17, 0.0])], df.schema))).collect()


def test_products_stay_exact():
    q = np.array([[2**40, 3]], dtype=np.int64)
    assert topk.tile_scores(q, np.array([[2**20, 1]], dtype=np.int64))[0, 0] == 2**60 + 3


def test_mixing_meets_its_quotas(spark, nasty, empty):
    rows = [(k, "w " * (1 + k % 7), "big" if k % 3 else f"s{k % 9}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for p in (mixing.MixingParams(block_tokens=500), mixing.MixingParams(target_entropy=1.0, max_repeats=1.5, block_tokens=300), mixing.MixingParams(keep_all=True, max_repeats=2.0, block_tokens=500)):
        out = mixing.mix(df, p).collect()
        sizes, taken, weight = Counter(), Counter(), {}
        for _, t, s in rows:
            sizes[s] += len(t.split()) + 1
        for r in out:
            taken[r["source"]] += r["n_tokens"]
            weight[r["source"]] = r["weight"]
        n = sum(sizes.values())
        budget = max(sizes[s] / weight[s] for s in sizes) if p.keep_all else n
        assert sum(weight.values()) == pytest.approx(1)
        for s in sizes:
            assert -9 < taken[s] - weight[s] * budget < 1, s
            assert weight[s] * budget / sizes[s] <= p.max_repeats + 1e-3
        copies = Counter((r["doc_id"], r["epoch"]) for r in out)
        assert max(copies.values()) == 1
        if p.keep_all:
            assert {r["doc_id"] for r in out} == {k for k, _, _ in rows}
    keep = mixing.mix_documents(nasty, mixing.MixingParams(keep_all=True, max_repeats=1.5))
    assert keep.columns == nasty.columns and {r["doc_id"] for r in keep.collect()} == {r["doc_id"] for r in nasty.collect()}
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_against_a_plain_version(spark, documents):
    """The query's rows from their definition: shares to an exponent, whole epochs of permuted blocks, and a last block cut by hash."""
    from pyspark.sql import functions as F

    p = mixing.MixingParams(block_tokens=4000)
    docs = documents.unionByName(documents.filter("doc_id % 9 = 0").withColumn("source", F.lit("rare")).withColumn("doc_id", F.col("doc_id") + 100_000))
    s, h = mixing._keys(docs, "source", "doc_id", p)
    rows = [(r["doc_id"], r["s"], r["h"], r["n"]) for r in docs.select("doc_id", s.alias("s"), h.alias("h"), mixing.token_count(F.col("text")).alias("n")).collect()]
    total = Counter()
    for _, s_, _, n in rows:
        total[s_] += n
    all_tokens = sum(total.values())

    def at(a):
        w = {k: (v / all_tokens) ** a for k, v in total.items()}
        z = sum(w.values())
        return {k: x / z for k, x in w.items()}

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    target = (entropy(at(1)) + math.log(len(total))) / 2
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(at(mid)) >= target else (low, mid)
    weight = at(low)
    if max(weight[k] * all_tokens / total[k] for k in total) > p.max_repeats:
        pytest.skip("the repetition limit decides")
    blocks = {k: min(-(-v // p.block_tokens), p.max_blocks) for k, v in total.items()}
    frame = spark.createDataFrame(rows, "doc_id long, _s string, _h long, _n long")
    of = {(r["doc_id"], r["_s"]): r["b"] for r in frame.join(spark.createDataFrame(list(blocks.items()), "_s string, blocks long"), "_s").select("doc_id", "_s", mixing.block_of(F.col("_h"), F.col("blocks")).alias("b")).collect()}
    want = Counter()
    for k, v in total.items():
        quota, filled, epoch = weight[k] * all_tokens, 0, 0
        own = [(i, h_, n, of[i, k]) for i, s_, h_, n in rows if s_ == k]
        while filled < quota - 1:
            named = spark.createDataFrame([(b,) for b in sorted({x[3] for x in own})], "_block long").select("_block", F.xxhash64(F.lit(p.seed), F.lit(k), F.lit(epoch), "_block").alias("o")).collect()
            for b in [r["_block"] for r in sorted(named, key=lambda r: (r["o"], r["_block"]))]:
                members = sorted((x for x in own if x[3] == b), key=lambda x: x[1])
                room = quota - filled
                took = 0
                for i, _, n, _ in members:
                    if took + n <= room + 1e-3:
                        took += n
                        want[i, epoch] += 1
                    else:
                        break
                filled += sum(x[2] for x in members)
                if filled >= quota:
                    break
            epoch += 1
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(docs, p).collect())
    # The exponents agree to the grid's last step: a document at the edge of a source may differ.
    assert sum((got - want).values()) + sum((want - got).values()) <= len(total) and sum(got.values()) > 150


def test_keep_all_keeps_large_sources_whole(spark):
    """The quota of the largest source is a product of powers, which may fall below its tokens by more than the tolerance."""
    from pyspark.sql import functions as F

    p, rng = mixing.MixingParams(keep_all=True, max_repeats=2.0), np.random.default_rng(0)
    for _ in range(4):
        big = [(f"s{k}", k * 10 + j, int(x)) for k in range(3) for j, x in enumerate(rng.integers(1 << 33, 1 << 36, 2))]
        sources, blocks = mixing.plan_blocks(spark.createDataFrame(big, "_s string, _h long, _n long").coalesce(1), p)
        assert all(r["quota"] >= r["tokens"] for r in sources.collect())
        dealt = spark.createDataFrame(big, "_s string, _h long, _n long").join(sources.select("_s", "blocks"), "_s")
        taken = dealt.withColumn("_block", mixing.block_of(F.col("_h"), F.col("blocks"))).join(blocks.filter("epoch = 0"), ["_s", "_block"]).filter("cut is null or _h <= cut")
        assert taken.count() == len(big)


def test_exponent_changes_the_shares_of_the_documents(documents):
    rows = documents.select(mixing.source_key(documents["source"]).alias("_s"), mixing.token_count(documents["text"]).alias("tokens")).groupBy("_s").sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    a, z, n, _ = mixing.choose_exponent(rows)
    p = np.array([r["tokens"] for r in rows.collect()]) / n
    h = lambda w: -(w * np.log(w)).sum()
    assert 0 < a < 1 and h(p**a / z) == pytest.approx((h(p) + math.log(len(p))) / 2, abs=1e-4)


def test_exponent_meets_the_entropy(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "_s string, tokens long")
    a, z, n, _ = mixing.choose_exponent(totals, mixing.MixingParams(target_entropy=0.9, max_repeats=1e9))
    p = np.array([1000, 100, 10]) / n
    w = p**a / (p**a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * math.log(3), abs=1e-4) and z == pytest.approx((p**a).sum())


@pytest.mark.parametrize("which", ["documents", "nasty", "empty"])
def test_packing_round_trip(which, request):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    rows = packing.pack_documents(df).collect()
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in df.collect():
        ids = exact.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want[(r["doc_id"], len(ids))] += len(ids)
    have = Counter()
    by = {}
    for r in rows:
        have[(r["doc_id"], r["doc_tokens"])] += r["length"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    texts = {(r["doc_id"], r["text"]) for r in df.collect()}
    once = {i: t for i, t in texts if sum(j == i for j, _ in texts) == 1}
    for r in rows:
        if r["doc_id"] in once:
            ids = np.array(exact.encode(once[r["doc_id"]] or "", add_special_tokens=False).ids + [1], dtype="<u4")
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_both_encoders_agree():
    import public_tokenizers as P
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")

    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=60))
    def same(t):
        assert fast(t).tolist() == exact.encode(t, add_special_tokens=False).ids

    same()
    r = np.random.default_rng(2)
    mixed = "".join(chr(int(c)) for c in r.choice([*range(32, 127), *range(0x3B1, 0x3C9), *range(0x4E00, 0x4E40), *range(0x430, 0x44F), 0x1F600, 10, 0xA0, 0x200D], 40_000))
    word = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 30_000))
    for t in ("a" * 20_000, " " * 20_000, "\n" * 9_000, "1" * 9_999, "é" * 5_000, "中" * 5_000, "!?" * 5_000, mixed, word, word.upper() + " " + word):
        assert fast(t).tolist() == exact.encode(t, add_special_tokens=False).ids
    for t in ("a <|endoftext|> b", "  \n\n  x", "　  ", "é́é", "'S're 123abc"):
        assert fast(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_least_squares_is_non_negative_and_optimal():
    rng = np.random.default_rng(4)
    a, b = rng.random((8, 20)), rng.random(8)
    x = packing.non_negative_least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max() < 1e-6


@pytest.mark.parametrize("lengths", [[1], [2048], [2047, 1], [5000], [1] * 3000, [1500] * 500, [2048 * 3 + 7] * 9])
def test_pack_shapes(lengths):
    out = packing.pack(np.array(lengths))
    assert sum(p[2] for p in out) == sum(lengths)
    seen = Counter()
    for d, s, n, _, _ in out:
        seen[d] += n
        assert 0 <= s < lengths[d]
    assert all(seen[d] == n for d, n in enumerate(lengths))
