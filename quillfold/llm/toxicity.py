"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled documents, near copies left out.
All their terms (runs of letters in ASCII lower case, and the first bytes of each) form the vocabulary.
Inverse document frequencies are counted over all documents. Every term counts,
but a term's idf is multiplied by what the examples' labels say of it: from
``base_weight``, for terms that toxic and clean examples hold alike, to 1, where
the likelihood-ratio statistic of toxic examples holding it more often reaches
``sure``. (With all factors 1, the random words of a text outweigh the few that
make it toxic.) Vectors (1 + ln tf) * weight have unit length over all terms of
a text; a term that no example holds weighs as if one document held it. The ``HEAD`` terms of most
examples are columns, with the largest weight of each block of similar
examples; all other terms have postings, whose products are summed exactly. A
document's bound on a block is the product with the maxima and the block's
largest sum, so blocks whose bound is below the k-th best score are left out:
the k nearest examples are exact. They vote with their squared similarity against a prior vote, and a
logistic curve fitted on leave-one-out votes, weighted to the labels' own
rates, makes that a probability. The nearest examples are the evidence.

At most ``max_toxic`` and ``max_clean`` labelled documents of at most
``max_example_bytes`` bytes are read as candidates (smallest hash of the id
first). The index is broadcast: it has (max_toxic + max_clean) * HEAD weights
and one posting for each other term of an example, so its size is bounded by
the sample's bytes. Every whole text is scored. A
text without known terms (null, empty, other) gets the score of the prior
vote. Ties go to the example with the smaller position. Null labels are
ignored, an id labelled twice takes the larger label, and without examples of
both kinds every score is the prior rate. Repeated rows are scored alike. An
empty table gives no rows; very long texts are scored whole, a row at a time
where they fill a piece. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fold_of

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
BLOCK = 32
HEAD = 1024
ROWS = 64  # texts scored at once
POSTINGS = 1 << 20  # products summed at once
STEM_BYTES = 5
NEAR_COPY = 0.8  # of the word pairs of two examples
RIDGE = 1.0  # keeps the calibration finite where the votes separate the labels


@dataclass(frozen=True)
class ToxicityParams:
    max_toxic: int = 3000
    max_clean: int = 3500
    max_example_bytes: int = 1 << 16
    neighbours: int = 24
    prior_votes: float = 1.0
    base_weight: float = 0.2
    sure: float = 10.83  # of the chi-squared distribution, one in a thousand lies beyond
    evidence: int = 3


@dataclass(frozen=True)
class Index:
    terms: np.ndarray  # sorted term hashes
    idf: np.ndarray
    weights: np.ndarray  # examples x head terms, parts of unit rows, in block order
    maxima: np.ndarray  # head terms x blocks
    label: np.ndarray
    ids: list[str] = field(default_factory=list)
    prior: float = 0.1
    slope: float = 1.0
    shift: float = 0.0
    params: ToxicityParams = ToxicityParams()
    unseen: float = 0.0  # idf of a term that no example holds
    column: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # of a head term, else -1
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # postings of term t: first[t] to first[t + 1]
    example: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    posted: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))


@dataclass(frozen=True)
class Vectors:
    """Unit vectors of a run of texts: row r has the entries first[r] to first[r + 1]; term -1 is in no example."""

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def term_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, first term of every row): each word, and beside it the stem of a longer word."""
    w = K.words_of(_LETTERS[data], rows)
    stems = ~K.span_hashes(w.data, w.starts, np.minimum(w.ends, w.starts + STEM_BYTES))
    return np.stack([w.hashes(), stems], axis=1).ravel(), 2 * w.first


def _term_counts(h: np.ndarray, first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in terms or -1, count) of every distinct term of every row, by row."""
    every, at = np.unique(h, return_inverse=True)
    if not len(every):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key, count = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * len(every) + at, return_counts=True)
    place = np.minimum(np.searchsorted(terms, every), max(0, len(terms) - 1))
    place = np.where(terms[place] == every, place, -1) if len(terms) else np.full(len(every), -1)
    return key // len(every), place[key % len(every)].astype(np.int32), count


def _vectors(h: np.ndarray, first: np.ndarray, terms: np.ndarray, idf: np.ndarray, unseen: float) -> Vectors:
    owner, term, count = _term_counts(h, first, terms)
    w = (1 + np.log(count)) * np.append(idf, unseen)[term]
    n = len(first) - 1
    w /= np.maximum(np.sqrt(np.bincount(owner, w * w, minlength=n)), 1e-12)[owner]
    return Vectors(np.searchsorted(owner, np.arange(n + 1)), term, w.astype(np.float32))


def _spread_out(hashes: list[np.ndarray]) -> list[int]:
    """Rows left when later near copies go: those whose word pairs have a Jaccard similarity of at least NEAR_COPY with a row that stays.

    Sets that similar share one of their rarest pairs (as many as may differ, and one), so only such rows are compared.
    """
    sets = [np.unique(K.gram_hashes(h[::2], min(2, max(1, len(h) // 2)))) for h in hashes]
    every, held = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
    seen: dict[int, list[int]] = {}
    out = []
    for i, s in enumerate(sets):
        if not len(s):
            continue
        n = held[np.searchsorted(every, s)]
        rare = np.lexsort((s, n))[: len(s) - math.ceil(NEAR_COPY * len(s)) + 1]
        rare = s[rare[n[rare] > 1]].tolist()
        if any(_jaccard(s, sets[j]) >= NEAR_COPY for j in sorted({j for x in rare for j in seen.get(x, ())}) if min(len(s), len(sets[j])) >= NEAR_COPY * max(len(s), len(sets[j]))):
            continue
        out.append(i)
        for x in rare:
            seen.setdefault(x, []).append(i)
    return out


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def label_weights(hashes: list[np.ndarray], label: np.ndarray, terms: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """The factor of every term's idf: how surely toxic examples hold it more often than clean ones."""
    held = np.zeros((2, len(terms)))
    for h, y in zip(hashes, label.tolist(), strict=True):
        held[int(y > 0), np.searchsorted(terms, np.unique(h))] += 1
    both = np.array([[np.sum(label <= 0)], [np.sum(label > 0)]], dtype=float)
    share = held.sum(0) / max(1.0, both.sum())

    def surprise(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0).sum(0)

    ratio = 2 * (surprise(held, both * share) + surprise(both - held, both * (1 - share)))
    toxic = held[1] * both[0] > held[0] * both[1]
    return params.base_weight + (1 - params.base_weight) * np.where(toxic, np.minimum(1.0, ratio / params.sure), 0.0)


def build_index(hashes: list[np.ndarray], ids: list[str], label: np.ndarray, terms: np.ndarray, df: np.ndarray, n_docs: int, prior: float, params: ToxicityParams = ToxicityParams()) -> Index:
    idf, unseen = np.log((1 + n_docs) / (1 + df)) * label_weights(hashes, label, terms, params), params.base_weight * float(np.log((1 + n_docs) / 2)) if n_docs else 0.0
    parts = [_vectors(h, np.array([0, len(h)]), terms, idf, unseen) for h in hashes]
    some = [k for k, v in enumerate(parts) if v.weight.any()]
    order = sorted(some, key=lambda k: (label[k], parts[k].term[parts[k].weight.argmax()], k))
    parts, label, ids = [parts[k] for k in order], label[order], [ids[k] for k in order]
    sizes = [len(v.term) for v in parts]
    own = Vectors(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate([np.empty(0, np.int32), *[v.term for v in parts]]), np.concatenate([np.empty(0, np.float32), *[v.weight for v in parts]]))
    del parts
    example = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    held = np.bincount(own.term, minlength=len(terms))
    head = np.sort(np.argsort(-held, kind="stable")[:HEAD])
    column = np.full(len(terms), -1, np.int32)
    column[head] = np.arange(len(head))
    w = np.zeros((len(ids), len(head)), np.float32)
    for k in range(len(ids)):
        at = slice(own.first[k], own.first[k + 1])
        some = column[own.term[at]] >= 0
        w[k, column[own.term[at]][some]] = own.weight[at][some]
    tail = np.flatnonzero(column[own.term] < 0).astype(np.int32)
    tail = tail[np.argsort(own.term[tail], kind="stable")]
    maxima = np.maximum.reduceat(w, np.arange(0, len(w), BLOCK), axis=0).T if len(w) else np.zeros((len(head), 0), np.float32)
    index = Index(terms, idf, w, np.ascontiguousarray(maxima), label, ids, prior, params=params, unseen=unseen, column=column, first=np.searchsorted(own.term[tail], np.arange(len(terms) + 1)), example=example[tail], posted=own.weight[tail])
    if len(set(label.tolist())) < 2:
        return index
    # The nearest of each example but itself.
    k = min(params.neighbours, len(w) - 1)
    top, place = nearest_to(index, own, k + 1)
    order = np.argsort(place == np.arange(len(w))[:, None], axis=1, kind="stable")[:, :k]
    top, place = np.take_along_axis(top, order, 1), np.take_along_axis(place, order, 1)
    votes = _vote(top, np.where(place >= 0, label[place], 0), index)
    weight = np.where(label > 0, prior / label.mean(), (1 - prior) / (1 - label.mean()))
    slope, shift = _logistic(_logit(votes), label.astype(float), weight)
    return replace(index, slope=slope, shift=shift)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log((p + 1e-3) / (1 + 1e-3 - p))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, s = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        h = np.array([[np.sum(s * x * x) + RIDGE, np.sum(s * x)], [np.sum(s * x), np.sum(s) + 1e-6]])
        step = np.clip(np.linalg.solve(h, np.array([np.sum(r * x) - RIDGE * a, np.sum(r)])), -1, 1)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def _vote(similarity: np.ndarray, label: np.ndarray, index: Index) -> np.ndarray:
    s = similarity.astype(float) ** 2
    return ((s * label).sum(1) + index.params.prior_votes * index.prior) / (s.sum(1) + index.params.prior_votes)


def _tail_sums(index: Index, v: Vectors, i: int, j: int) -> np.ndarray:
    """Products of rows i to j of v with every example over the terms that have postings."""
    at, n = slice(v.first[i], v.first[j]), len(index.label)
    owner, term, w = np.repeat(np.arange(j - i), np.diff(v.first[i : j + 1])), v.term[at], v.weight[at]
    counts = np.where(term >= 0, index.first[term + 1] - index.first[term], 0)
    some = np.flatnonzero(counts)
    owner, term, w, counts = owner[some], term[some], w[some], counts[some]
    total, out = np.cumsum(counts), np.zeros((j - i) * n)
    cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, POSTINGS)))
    for a, b in zip(cuts, [*cuts[1:], len(total)][: len(cuts)], strict=True):
        p = K.ranges(index.first[term[a:b]], counts[a:b])
        low = owner[a] * n
        got = np.bincount(np.repeat(owner[a:b] * n - low, counts[a:b]) + index.example[p], np.repeat(w[a:b], counts[a:b]) * index.posted[p])
        out[low : low + len(got)] += got
    return out.reshape(j - i, n).astype(np.float32)


def nearest_to(index: Index, v: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, example positions) of the k nearest examples of each row of v."""
    n = len(v.first) - 1
    best, place = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
    if not len(index.label):
        return best, place
    for i in range(0, n, ROWS):
        j = min(i + ROWS, n)
        at = slice(v.first[i], v.first[j])
        column = np.where(v.term[at] >= 0, index.column[v.term[at]], -1)
        q = np.zeros((j - i, index.weights.shape[1]), np.float32)
        q[np.repeat(np.arange(j - i), np.diff(v.first[i : j + 1]))[column >= 0], column[column >= 0]] = v.weight[at][column >= 0]
        best[i:j], place[i:j] = nearest(index, q, k, _tail_sums(index, v, i, j))
    return best, place


def nearest(index: Index, q: np.ndarray, k: int, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, example positions) of the k nearest examples of each row of q (head terms) and its sums over all other terms, best first; -1 where there are fewer."""
    n, m = len(q), len(index.weights)
    best, place = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
    if not n or not m:
        return best, place
    starts = np.arange(0, m, BLOCK)
    # The margin covers rounding: a block is left out only if its bound is below the k-th score for certain.
    bounds = q @ index.maxima + 1e-5
    if tail is not None:
        bounds += np.maximum.reduceat(tail, starts, axis=1)
    # The blocks of the best bounds hold more than k examples: their k-th score is a floor for all.
    few = min(len(starts), k // BLOCK + 2)
    lead = np.argpartition(-bounds, few - 1, axis=1)[:, :few]
    scores = np.full((n, len(starts) * BLOCK), -1, np.float32)
    done = np.zeros(bounds.shape, bool)

    def score(todo: np.ndarray) -> None:
        for b in np.flatnonzero(todo.any(0)):
            rows, at = np.flatnonzero(todo[:, b]), slice(b * BLOCK, min(m, (b + 1) * BLOCK))
            scores[rows, at] = q[rows] @ index.weights[at].T + (0 if tail is None else tail[rows, at])
        done[todo] = True

    first = np.zeros(bounds.shape, bool)
    np.put_along_axis(first, lead, True, axis=1)
    score(first)
    k = min(k, scores.shape[1])
    floor = np.maximum(-np.partition(-scores, k - 1, axis=1)[:, k - 1], 2e-5)
    left = ~done & (bounds >= floor[:, None])
    if left.mean() > 0.25:
        # Most blocks are needed: one product of all is faster than one of each.
        scores[:, :m] = q @ index.weights.T + (0 if tail is None else tail)
    else:
        score(left)
    # Whole numbers order by score and then by smaller position.
    key = np.rint(scores.astype(float) * 1e6).astype(np.int64) * scores.shape[1] + np.arange(scores.shape[1] - 1, -1, -1)
    at = np.argpartition(-key, k - 1, axis=1)[:, :k]
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 1), axis=1), 1)
    s = np.round(np.take_along_axis(scores, at, 1), 6)
    best[:, :k], place[:, :k] = np.maximum(s, 0), np.where(s > 0, at, -1)
    return best, place


def score_texts(index: Index, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, similarities, example positions) of whole texts."""
    h, first = term_hashes(data, rows)
    sim, place = nearest_to(index, _vectors(h, first, index.terms, index.idf, index.unseen), index.params.neighbours)
    votes = _vote(sim, np.where(place >= 0, index.label[place] if len(index.label) else 0, 0), index)
    if len(set(index.label.tolist())) < 2:
        return np.full(len(rows) - 1, index.prior), sim, place
    return 1 / (1 + np.exp(-(index.slope * _logit(votes) + index.shift))), sim, place


def document_frequencies(docs: DataFrame, terms: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many documents hold each term, over all documents; at most one row per term reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            data, offsets = K.buffer_of(b.column(0))
            n += b.num_rows
            for _, _, d, r in K.pieces(data, offsets):
                at = _term_counts(*term_hashes(d, r), shared.value)[1]
                df += np.bincount(at[at >= 0], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["term", "n"])

    got = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1, dtype=np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] | None = (4, 2)) -> Index:
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter("_id is not null and _y is not null")
    if held_out:
        known = known.filter(fold_of(F.col("_id"), held_out[0]) != held_out[1])
    known = known.groupBy("_id").agg((F.max("_y") > 0).cast("int").alias("_y"))
    rate = known.agg(F.avg("_y").alias("r")).first()["r"]
    order = (F.xxhash64("_id"), "_id")
    sample = known.filter("_y = 1").orderBy(*order).limit(params.max_toxic).union(known.filter("_y = 0").orderBy(*order).limit(params.max_clean))
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.octet_length("_t") <= params.max_example_bytes)
    # The sample is bounded by max_toxic + max_clean, whatever the input.
    # One text for each id, that of the smallest hash.
    rows = text.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t"))).alias("_s")).select("_id", "_y", F.col("_s._t").alias("_t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, first = term_hashes(*K.buffer_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array([h[first[k] : first[k + 1]].tobytes() for k in range(b.num_rows)], pa.binary())], names=["id", "y", "h"])

    got = sorted(rows.mapInArrow(hashed, "id string, y int, h binary").collect(), key=lambda r: (len(r["id"]), r["id"], r["h"]))
    hashes = [np.frombuffer(r["h"], dtype=np.uint64) for r in got]
    keep = _spread_out(hashes)
    hashes, label, ids = [hashes[i] for i in keep], np.array([got[i]["y"] for i in keep], dtype=int), [got[i]["id"] for i in keep]
    del got
    prior = min(max(float(rate or 0.1), 1e-3), 1 - 1e-3)
    terms = np.unique(np.concatenate([np.unique(h) for h in hashes])) if len(set(label.tolist())) == 2 else np.empty(0, np.uint64)
    df, n = document_frequencies(docs, terms, text_col) if len(terms) else (np.empty(0, np.int64), 0)
    return build_index(hashes, ids, label, terms, df, n, prior, params)


def score_documents(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, and the nearest examples with label and similarity as evidence, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        n = index.params.evidence
        for b in batches:
            data, offsets = K.buffer_of(b.column(1))
            for i, j, d, r in K.pieces(data, offsets):
                s, sim, place = score_texts(index, d, r)
                text = [";".join(f"{index.ids[p]}:{index.label[p]}:{x:.6f}" for p, x in zip(ps[:n], xs[:n], strict=True) if p >= 0) for ps, xs in zip(place.tolist(), sim.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(s), pa.array(text, pa.string())], names=[id_col, "score", "evidence"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, score double, evidence string")


def classify(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), threshold: float = 0.3, held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id") -> DataFrame:
    scored = score_documents(docs, fit(docs, labels, params, id_col=id_col, held_out=held_out), id_col)
    return scored.select(id_col, (fold_of(F.col(id_col), held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
