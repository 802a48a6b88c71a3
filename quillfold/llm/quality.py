"""Document quality from a linear-chain conditional random field over lines.

Each line that holds a word is one element of its document's chain and is
labelled good or bad. A line's features are its own shape (length, character
classes, word shapes, repetition, common words) and those of the line before
and after it. The chain is trained here, on a bounded sample of labelled
documents; as labels are given per document, lines of bad documents are
relabelled between fits: those the chain believes good become good, except
the worst line. Forward-backward marginals, weighted by line length, give the
share of good text, and a logistic curve fitted on the same sample turns that
share into a score.

Training reads at most ``max_train_docs`` labelled documents of at most
``max_train_bytes`` bytes each, up to half of them for each label, those with
the smallest hash of their id; the curve is weighted to the labels' own rates.
Scoring covers every line of every text; documents do not affect each other,
so ties, repeated rows and hot sources need no care. A text without words
(null, empty, blank) has no lines and gets score ``empty_score``. Labels that
are null are ignored; an id labelled twice takes the larger label; without
labels of both kinds, everything scores ``empty_score`` and every document with
words is kept. An empty table gives no rows; a text of any length or number of
lines is scored whole, its chain by doubling. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fold_of, materialise

# Frequent short words of the languages served.
FUNCTION_WORDS = "the of and to in a is that for it was with by this are on as be at or from le la les de des et en un une du que est dans pour sur der die das und den von zu mit sich auf ist im dem nicht ein eine el los las y del se con una su al lo como no".split()
LONG_CHAIN = 512  # lines
FEATURES = ("log_bytes", "letters", "upper", "digits", "punctuation", "symbols", "exclamation", "word_length", "same_as_previous_word", "one_byte_words", "few_words", "function_words", "repeated_line", "bars", "capital_run")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # one per feature of the line, its neighbours and the bias
    transition: np.ndarray  # 2 x 2 log potentials
    slope: float
    shift: float
    empty_score: float = 0.05
    trained: bool = True  # False where the sample has no two labels


@dataclass(frozen=True)
class QualityParams:
    max_train_docs: int = 2500
    max_train_bytes: int = 1 << 16
    rounds: int = 2
    steps: int = 80
    empty_score: float = 0.05


_CLASS = np.zeros(256, dtype=np.uint8)
for _chars, _code in ((range(97, 123), 1), (range(128, 256), 1), (range(65, 91), 2), (range(48, 58), 3), (b".,;:'\"?()-", 4), (b"#*$%&<>=+@/\\^_~{}[]`", 5), (b"!", 6), (b"|", 7)):
    _CLASS[list(_chars)] = _code


def _function_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(FUNCTION_WORDS).encode(), dtype=np.uint8)
    return np.sort(K.words_of(data, np.array([0, len(data)])).hashes())


_FUNCTION = _function_hashes()


def line_features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, byte lengths, first line of every row) of the lines that hold a word."""
    breaks = np.flatnonzero(data == 10) + 1
    begin = np.unique(np.concatenate([rows[:-1][rows[:-1] < rows[1:]], breaks[breaks < len(data)]])) if len(data) else np.empty(0, np.int64)
    end = np.append(begin[1:], len(data))[: len(begin)]
    w = K.words_of(data, rows)
    word_at = np.searchsorted(w.starts, np.append(begin, len(data)))
    words = np.diff(word_at)
    full = words > 0
    begin, end, words, word_at = begin[full], end[full], words[full], word_at[:-1][full]
    n = len(begin)
    first = np.searchsorted(begin, rows)
    if not n:
        return np.zeros((0, len(FEATURES))), np.zeros(0), first
    solid = np.add.reduceat(w.ends - w.starts, word_at).astype(float)
    kind = _CLASS[data]
    share = []
    for code in range(1, 8):
        c = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kind == code, out=c[1:])
        share.append((c[end] - c[begin]) / solid)
    h = w.hashes()
    fold = K.span_hashes(K.LOWER[data], w.starts, w.ends)
    same = np.zeros(len(h))
    same[1:] = fold[1:] == fold[:-1]
    same[word_at] = 0
    short = (w.ends - w.starts) == 1
    common = _FUNCTION[np.minimum(np.searchsorted(_FUNCTION, fold), len(_FUNCTION) - 1)] == fold
    capital = (kind[w.starts] == 2) & (kind[w.ends - 1] != 1) & ~short
    per_line = lambda x: np.add.reduceat(x.astype(float), word_at) / words
    line = np.add.reduceat(K.mix(h + np.arange(len(h), dtype=np.uint64) - np.repeat(word_at, words).astype(np.uint64)), word_at)
    owner = np.searchsorted(first, np.arange(n), side="right") - 1
    order = np.lexsort((np.arange(n), line, owner))
    again = np.zeros(n)
    again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    x = np.stack([np.log1p(solid), *share[:6], np.log(solid / words), per_line(same), per_line(short), words < 4, per_line(common), again, share[6], per_line(capital)], axis=1)
    return x, solid, first


def _design(x: np.ndarray, first: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Own, previous and next features of every line, edges and bias."""
    n = len(x)
    z = np.clip((x - mean) / scale, -4, 4)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    full = first[:-1] < first[1:]
    head[first[:-1][full]] = True
    tail[first[1:][full] - 1] = True
    before, after = np.zeros_like(z), np.zeros_like(z)
    before[1:], after[:-1] = z[:-1], z[1:]
    before[head], after[tail] = 0, 0
    return np.concatenate([z, before, after, head[:, None], tail[:, None], np.ones((n, 1))], axis=1)


def _prefixes(m: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Products of all 2 x 2 matrices from a chain's begin to each place, up to a factor, by doubling; begin: first place of every entry's chain."""
    out, at, step = m.copy(), np.arange(len(m)), 1
    while True:
        i = np.flatnonzero(at - step >= begin)
        if not len(i):
            return out
        joined = out[i - step] @ out[i]
        out[i] = joined / joined.max((1, 2), keepdims=True)
        step *= 2


def _long_chains(emit: np.ndarray, t: np.ndarray, first: np.ndarray, rows: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> None:
    """Fills in the given rows in a number of steps that grows with the logarithm of their lines."""
    for r in rows.tolist():
        at = slice(first[r], first[r + 1])
        m = t[None] * emit[at][:, None, :]
        m[0] = emit[at][0]
        begin = np.zeros(len(m), np.int64)
        f = _prefixes(m, begin)[:, 0]
        # From the end: the transposed matrices in reverse order, beginning with the last line.
        b = np.ones((len(m), 2))
        if len(m) > 1:
            back = np.ascontiguousarray(m[:0:-1].transpose(0, 2, 1))
            b[-2::-1] = np.ones(2) @ _prefixes(back, begin[1:])
        forward[at], backward[at] = f / f.sum(1, keepdims=True), b / b.sum(1, keepdims=True)


def marginals(score: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good per line, pair marginals summed over neighbours) by forward-backward; score: log odds of good."""
    n, t = len(score), np.exp(transition - transition.max())
    emit = np.stack([np.exp(-np.logaddexp(0, score)), np.exp(-np.logaddexp(0, -score))], axis=1)
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    # Chains of usual length go side by side, a line a step; longer ones by doubling.
    long = order[counts[order] > LONG_CHAIN]
    _long_chains(emit, t, first, long, forward, backward)
    order = order[len(long) :]
    start, left = first[:-1][order], counts[order]
    longest = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(longest), side="left")  # rows with more than k lines
    for k in range(longest):
        at = start[: active[k]] + k
        f = emit[at] if k == 0 else (forward[at - 1] @ t) * emit[at]
        forward[at] = f / f.sum(1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        at = start[: active[k + 1]] + k
        b = (backward[at + 1] * emit[at + 1]) @ t.T
        backward[at] = b / b.sum(1, keepdims=True)
    p = forward * backward
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    inner = np.ones(n, bool)
    inner[first[1:][counts > 0] - 1] = False
    i = np.flatnonzero(inner)
    pair = forward[i][:, :, None] * t[None] * (emit[i + 1] * backward[i + 1])[:, None, :]
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return p[:, 1], pair.sum(0)


def _weighted(p: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean over each row's lines; NaN without lines."""
    c, w = np.concatenate([[0], np.cumsum(p * length)]), np.concatenate([[0], np.cumsum(length)])
    with np.errstate(invalid="ignore"):
        return (c[first[1:]] - c[first[:-1]]) / (w[first[1:]] - w[first[:-1]])


def _fit_chain(d: np.ndarray, y: np.ndarray, weight: np.ndarray, first: np.ndarray, w: np.ndarray, t: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by gradient steps with adaptive sizes."""
    n = len(y)
    inner = np.ones(n, bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), 1)
    theta = np.concatenate([w, t.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs = marginals(d @ w, t, first)
        g = np.concatenate([d.T @ ((y - p) * weight) - 0.5 * w, (seen - pairs).ravel() - 0.5 * t.ravel()]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, s = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        h = np.array([[np.sum(s * x * x) + 1e-2, np.sum(s * x)], [np.sum(s * x), np.sum(s) + 1e-6]])
        step = np.linalg.solve(h, np.array([np.sum(r * x) - 1e-2 * a, np.sum(r)]))
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, b


def train(x: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, params: QualityParams = QualityParams(), rate: float | None = None) -> QualityModel:
    """The model from the lines of labelled documents (label: 1 good, 0 bad); rate: share of good ones among all, if not that of the sample."""
    size = 3 * len(FEATURES) + 3
    if len(set(label.tolist())) < 2 or not len(x):
        return QualityModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(size), np.zeros((2, 2)), 0.0, _logit(params.empty_score), params.empty_score, False)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    d = _design(x, first, mean, scale)
    of_line = np.repeat(label, np.diff(first)).astype(float)
    owner = np.repeat(np.arange(len(label)), np.diff(first))
    y, w, t = of_line.copy(), np.zeros(size), np.zeros((2, 2))
    for _ in range(params.rounds):
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        w, t = _fit_chain(d, y, np.minimum(weight, 4), first, w, t, params.steps)
        p, _ = marginals(d @ w, t, first)
        worst = np.zeros(len(p), bool)
        order = np.lexsort((p, owner))
        worst[order[np.unique(owner[order], return_index=True)[1]]] = True
        y = np.where((of_line > 0) | ((p > 0.5) & ~worst), 1.0, 0.0)
    good = _weighted(p, length, first)
    some = ~np.isnan(good)
    rate = label.mean() if rate is None else rate
    weight = np.where(label > 0, rate / label.mean(), (1 - rate) / (1 - label.mean()))
    a, b = _fit_logistic(_squash(good[some]), label[some].astype(float), weight[some])
    return QualityModel(mean, scale, w, t, a, b, params.empty_score)


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _squash(share: np.ndarray) -> np.ndarray:
    return np.log((share + 0.01) / (1.01 - share))


def score(model: QualityModel, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document scores, line marginals, share of good text) of rows."""
    p, _ = marginals(_design(x, first, model.mean, model.scale) @ model.weights, model.transition, first)
    share = _weighted(p, length, first)
    out = 1 / (1 + np.exp(-(model.slope * _squash(np.nan_to_num(share)) + model.shift)))
    return np.where(np.isnan(share), model.empty_score, out), p, share


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] | None = (3, 1)) -> QualityModel:
    """Train on a bounded sample; held_out = (folds, fold) are never read."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter("_id is not null and _y is not null")
    if held_out:
        known = known.filter(fold_of(F.col("_id"), held_out[0]) != held_out[1])
    known = known.groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.octet_length("_t") <= params.max_train_bytes)
    # Only ids with a text to train on are sampled, each label on its own.
    known = materialise(known.join(text.select("_id").distinct(), "_id", "left_semi"), "quality-labels")
    rate = known.agg(F.avg((F.col("_y") > 0).cast("int")).alias("r")).first()["r"]
    order = (F.xxhash64("_id"), "_id")
    sample = known.filter("_y > 0").orderBy(*order).limit(params.max_train_docs // 2).union(known.filter("_y <= 0").orderBy(*order).limit(params.max_train_docs // 2))
    # The sample is bounded by max_train_docs, whatever the input.
    # One text for each id, that of the smallest hash.
    rows = text.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t"))).alias("_s")).select("_id", "_y", F.col("_s._t").alias("_t"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.buffer_of(b.column(2))
            for i, j, d, r in K.pieces(data, offsets):
                x, length, first = line_features(d, r)
                cut = lambda a: [a[first[k] : first[k + 1]].astype(np.float32).tobytes() for k in range(j - i)]  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.string()), b.column(1)[i:j], pa.array(cut(x), pa.binary()), pa.array(cut(length), pa.binary())], names=["id", "y", "x", "length"])

    got = sorted(rows.mapInArrow(features, "id string, y int, x binary, length binary").collect(), key=lambda r: (r["id"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in got), dtype=np.float32).reshape(-1, len(FEATURES)).astype(float)
    length = np.frombuffer(b"".join(r["length"] for r in got), dtype=np.float32).astype(float)
    first = np.concatenate([[0], np.cumsum([len(r["length"]) // 4 for r in got])]).astype(np.int64)
    return train(x, length, first, np.array([r["y"] for r in got], dtype=int), params, rate)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, share of good text, lines and good lines of every document."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.buffer_of(b.column(1))
            for i, j, d, r in K.pieces(data, offsets):
                x, length, first = line_features(d, r)
                s, p, share = score(model, x, length, first)
                good = np.concatenate([[0], np.cumsum(p >= 0.5)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], pa.array(s), pa.array(share, from_pandas=True), pa.array(np.diff(first).astype(np.int64)), pa.array((good[first[1:]] - good[first[:-1]]).astype(np.int64))],
                    names=[id_col, "score", "good_share", "n_lines", "n_good_lines"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {id_type.simpleString()}, score double, good_share double, n_lines long, n_good_lines long")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model accepts, all columns unchanged; no text is shuffled.

    A text without words has nothing to judge and goes, as its score is below the threshold. Without a trained model all others stay.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.buffer_of(b.column(at))
            scored = [score(model, *line_features(d, r)) for _, _, d, r in K.pieces(data, offsets)]
            good = [s >= threshold if model.trained else ~np.isnan(share) for s, _, share in scored]
            if good:
                yield b.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), threshold: float = 0.5, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id") -> DataFrame:
    """Scores of all documents from a model that never saw the held-out fold."""
    scored = score_documents(docs, fit(docs, labels, params, id_col=id_col, held_out=held_out), id_col)
    return scored.select(id_col, (fold_of(F.col(id_col), held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "good_share", "n_lines", "n_good_lines")
