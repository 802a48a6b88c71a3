"""Periodic runs of words: maximal stretches that repeat with one period.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and a length of at least ``times`` periods and ``least`` words,
that no neighbouring word extends keeping period q.

Runs come from the suffixes of a document, by Kruskal over descending LCP: pairs
of neighbours in the suffix array are united from the longest common prefix
down. Each class keeps its positions in order; the smaller set is merged into
the larger, and positions that become neighbours there at a distance d are told
apart by nothing in between: where d fits ``times - 1`` times into the common
prefix, they seed a run of period d. A seed whose preceding words agree starts
inside its run and is left out. Classes that share fewer words than any run
needs can't seed one, so the unions end there, and documents in which no words
come back at a fitting distance are passed without a suffix array.

Documents are independent: no shuffle, one Arrow batch at a time, very long
texts whole. Null and empty texts have no words and no runs. A null id is a
document like any other, repeated rows give repeated results, and an empty table
gives no rows. Ties can't arise: runs are ordered by start, then period. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .substring import word_numbers

RUN = "struct<start:long,length:long,period:long>"


@dataclass(frozen=True)
class RunParams:
    times: int = 4
    least: int = 6

    @property
    def least_prefix(self) -> int:
        """No run is seeded by suffixes that share fewer words."""
        return min(max((self.times - 1) * d, self.least - d) for d in range(1, self.least + 1))


#: (ids, first word of every row) -> for every word, the word whose text it takes
Rewrite = Callable[[list, np.ndarray], np.ndarray]


def live_rows(words: np.ndarray, first: np.ndarray, p: RunParams) -> np.ndarray:
    """Rows in which some stretch of the least prefix comes back so near that a run may start there."""
    grams = K.gram_hashes(words.astype(np.uint64), p.least_prefix)
    at = K.ranges(first[:-1], np.maximum(np.diff(first) - p.least_prefix + 1, 0))
    if not len(at):
        return np.empty(0, np.int64)
    row = np.searchsorted(first, at, side="right") - 1
    key = K.mix(grams[at] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = at[order[again]], at[order[again + 1]]
    fits = (row[order[again]] == row[order[again + 1]]) & (p.times * (b - a) <= first[row[order[again]] + 1] - a)
    return np.unique(row[order[again[fits]]])


def suffix_levels(words: np.ndarray, row: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words; the last ones all differ. Suffixes of unlike rows never share a rank."""
    n = len(words)
    order = np.lexsort((words, row))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return levels
        behind = open_ + step
        inside = behind < end[open_]
        second = np.where(inside, rank[np.minimum(behind, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        a, b = rank[open_][order], second[order]
        begins = np.ones(len(order), bool)
        begins[1:] = a[1:] != a[:-1]
        group = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
        new = begins.copy()
        new[1:] |= b[1:] != b[:-1]
        within = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) - group
        rank = rank.copy()
        rank[open_[order]] = a + within
        levels.append(rank)
        step *= 2


def neighbour_prefixes(levels: list[np.ndarray], row: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, words in common) of neighbours in the suffix array that belong to one row."""
    order = np.argsort(levels[-1])
    a, b = order[:-1], order[1:]
    one = row[a] == row[b]
    a, b = a[one], b[one]
    common = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = np.zeros(len(a), bool)
        same[inside] = levels[t][x[inside]] == levels[t][y[inside]]
        common[same] += 1 << t
    return a, b, common


def seeds(a: np.ndarray, b: np.ndarray, common: np.ndarray, p: RunParams) -> np.ndarray:
    """(start, period, words in common) of positions that become neighbours in their class at a distance that fits."""
    long_enough = np.flatnonzero(common >= p.least_prefix)
    long_enough = long_enough[np.argsort(-common[long_enough], kind="stable")]
    found: list[tuple[int, int, int]] = []
    parent = {x: x for x in np.unique(np.concatenate([a[long_enough], b[long_enough]])).tolist()}
    sets = {x: [x] for x in parent}
    more, least = p.times - 1, p.least

    def root(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    for x, y, shared in zip(a[long_enough].tolist(), b[long_enough].tolist(), common[long_enough].tolist(), strict=True):
        x, y = root(x), root(y)
        large, small = sets[x], sets[y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        parent[y] = x
        del sets[y]
        last = len(small) - 1
        for k, at in enumerate(small):
            j = bisect_left(large, at)
            if j and (not k or small[k - 1] < large[j - 1]):
                d = at - large[j - 1]
                if more * d <= shared and d + shared >= least:
                    found.append((large[j - 1], d, shared))
            if j < len(large) and (k == last or small[k + 1] > large[j]):
                d = large[j] - at
                if more * d <= shared and d + shared >= least:
                    found.append((at, d, shared))
        if 16 * len(small) < len(large) or not last:
            for at in small:
                insort(large, at)
        else:
            large += small
            large.sort()
    return np.array(found, np.int64).reshape(-1, 3)


def find_runs(words: np.ndarray, first: np.ndarray, p: RunParams = RunParams()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period) of all runs, by row, start and period; row r holds the numbers words[first[r]:first[r + 1]]."""
    live = live_rows(words, first, p)
    nothing = (np.empty(0, np.int64),) * 4
    if not len(live):
        return nothing
    counts = np.diff(first)[live]
    own = words[K.ranges(first[live], counts)]
    end = np.repeat(np.cumsum(counts), counts)
    begin = end - np.repeat(counts, counts)
    row = np.repeat(np.arange(len(live)), counts)
    found = seeds(*neighbour_prefixes(suffix_levels(own, row, end), row, end), p)
    if not len(found):
        return nothing
    start, period, shared = found.T
    inner = start > begin[start]
    inner[inner] = own[start[inner] - 1] == own[start[inner] + period[inner] - 1]
    start, period, shared = start[~inner], period[~inner], shared[~inner]
    order = np.lexsort((period, start))
    start, period, shared = start[order], period[order], shared[order]
    return live[row[start]], start - begin[start], period + shared, period


def periodic_runs(docs: DataFrame, params: RunParams = RunParams(), id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, with_text: bool = False) -> DataFrame:
    """id, n_words, runs (start, length, period) and kept_sha256 of every row: the digest of the words that stay when each run keeps its first period only, joined by one space; those words themselves if asked for.

    rewrite: says which word of its row each word is to be read as, before runs are sought.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, rows = K.buffer_of(batch.column(1))
            for lo, hi, part, offsets in K.pieces(data, rows):
                ids = batch.column(0).slice(lo, hi - lo)
                w = K.words_of(part, offsets)
                numbers = word_numbers(part, w.starts, w.ends) if len(w.starts) else np.empty(0, np.int64)
                source = rewrite(ids.to_pylist(), w.first) if rewrite else np.arange(len(numbers))
                row, start, length, period = find_runs(numbers[source], w.first, params)
                gone = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(gone, w.first[row] + start + period, 1)
                np.add.at(gone, w.first[row] + start + length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                plain = np.ones(hi - lo, bool)
                changed = np.flatnonzero(~kept | (source != np.arange(len(source))))
                plain[np.searchsorted(w.first, changed, side="right") - 1] = False
                digest, texts = [], []
                for r in range(hi - lo):
                    words = part[offsets[r] : offsets[r + 1]].tobytes().split()
                    if not plain[r]:
                        own = slice(w.first[r], w.first[r + 1])
                        words = [words[k] for k in (source[own][kept[own]] - w.first[r]).tolist()]
                    joined = b" ".join(words)
                    digest.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode() if with_text else None)
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(w.first), pa.int64()), runs, pa.array(digest, pa.string()), pa.array(texts, pa.string())], names=["_id", "n_words", "runs", "kept_sha256", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(work, f"_id {kind}, n_words long, runs array<{RUN}>, kept_sha256 string, kept_text string")
    out = out.withColumnRenamed("_id", id_col)
    return out if with_text else out.drop("kept_text")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of runs, the run of greatest length / period (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    first = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
        lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best),
    )
    lines = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    return found.withColumn("_best", first).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), *[F.col("_best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.col("kept_sha256").alias("collapsed_sha256"),
    )
