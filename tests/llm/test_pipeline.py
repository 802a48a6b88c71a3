import duckdb
import pytest

import corpus_pipeline as P
from quillfold.llm import queries


def test_stages_keep_the_columns(spark, sf, nasty, empty):
    for docs in (nasty, empty):
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, sf)
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns
                docs = out
        assert set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
        out.count()


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    kept = {r["doc_id"] for r in rows}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, q in truth.items() if q == 1]
    bad = [d for d, q in truth.items() if q == 0]
    assert sum(d in kept for d in bad) <= 0.2 * len(bad) and sum(d in kept for d in good) >= 0.6 * len(good)


def test_stages_against_plain_versions(spark, sf):
    """Each stage on what the one before kept: scores, all pairs of sets, spans one by one, copies, and tokens."""
    import hashlib
    from collections import Counter

    from test_dedup import expected_components, pairs

    from quillfold.llm import quality, secret_scan
    from quillfold.llm.common import materialise

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stage = dict(P.STAGES)
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, quality.fit(docs, labels, held_out=None)).collect()}
    kept = materialise(stage["quality classifier"](spark, docs, sf), "test")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.5}
    groups = {i: c for i, _, c in expected_components(pairs(kept), 5, 80)}
    single = materialise(stage["n-gram Jaccard join"](spark, kept, sf), "test")
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in groups.items() if i == c}
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in single.collect()}
    owners = {}
    for t, source in texts.values():
        for _, _, _, _, v in secret_scan.find(t)[1]:
            owners.setdefault(hashlib.sha256(v.encode()).hexdigest(), set()).add(source)
    clean = materialise(stage["secret scans"](spark, single, sf), "test")
    masked = {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, (t, _) in texts.items():
        live = [(s, e) for s, k, e, _, v in secret_scan.find(t)[1] if len(owners[hashlib.sha256(v.encode()).hexdigest()]) < 2 and secret_scan.looks_random(v, k, 3.0)]
        assert ("[SECRET]" in masked[i]) == bool(live) or not live and "[SECRET]" in t
        assert all(t[s:e] not in masked[i] for s, e in live)
    mixed = materialise(stage["mixing sources"](spark, clean, sf), "test")
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) == set(texts) and max(copies.values()) <= 2
    pieces = Counter()
    tokens = {}
    for r in stage["packing"](spark, mixed, sf).collect():
        pieces[r["doc_id"]] += r["length"]
        tokens[r["doc_id"]] = r["doc_tokens"]
    assert pieces == Counter({i: copies[i] * tokens[i] for i in copies})
    run = Counter()
    for r in P.run(spark, sf).collect():
        run[r["doc_id"]] += r["length"]
    assert run == pieces


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.select(", ".join(order)).fetchall()))
