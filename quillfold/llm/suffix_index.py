"""Exact long-match removal with a logarithmic family of suffix arrays.

Texts are UTF-8 bytes. A byte goes if it is covered by a ``width``-byte string
that also starts earlier: in a document with a smaller id, or earlier in the
same one. Matches overlap freely and never cross documents; strings are judged
on the input.

The suffixes of all documents are sharded by minimiser (a string and its
repeats have the same), and every shard keeps its own family of indexes. New
batches come in order of place (id, then start), ``batches`` of them to a
shard. A batch gets a suffix array over its positions with at least ``width``
bytes left, in the order of those bytes, and the lengths of the prefixes that
neighbours share, both by sorting eight bytes at a time wherever suffixes are
still tied. The batch is merge-scanned against every existing level: both
arrays are merged by their leading bytes, ties are refined in the same way, and
a batch suffix that shares ``width`` bytes with a neighbour of the level starts
later than it: a long match. The batch then becomes a level, and levels of
equal size merge geometrically, so that n batches leave about log2 n levels and
each suffix is merged as often. Of equal suffixes a level keeps the earliest.
Longer common prefixes than ``width`` say nothing more, as the next suffix
covers the next byte; so order and prefix lengths stop there.

Null and empty texts have no bytes. Rows that share an id count as one document
each; of two such rows the one with the smaller start removes the other's, and
exact repeats of a row lose the same bytes. A row without an id removes nothing
and loses nothing. An empty table gives no rows. Very long texts are read whole,
in overlapping pieces. Ids are integers. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import superkmer as S


@dataclass(frozen=True)
class SuffixParams:
    width: int = 100
    gram: int = 20
    batches: int = 7  # that a shard's suffixes come in: three levels at the end
    least_batch: int = 1 << 10  # suffixes, so that tiny shards aren't cut to pieces


def byte_units(gram: int) -> S.Units:
    def units(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(len(data), dtype=np.int64)
        n = max(0, len(data) - gram + 1)
        return at, at + 1, rows, K.rolling_hashes(data, at[:n], at[:n] + gram)

    return units


class Text:
    """Bytes whose eight from any position on can be read as one number that sorts like them."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = K.words_at(data)

    def lead(self, positions: np.ndarray, depth: int = 0) -> np.ndarray:
        return self.at[positions + depth].byteswap()


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that two numbers of eight bytes share."""
    x = a ^ b
    out = np.zeros(len(x), np.int32)
    for k in range(8):
        out += x < np.uint64(1 << 8 * (7 - k))
    return out


@dataclass
class SuffixArray:
    """Positions in the order of their first width bytes, their first eight bytes, their places in time, and the bytes shared with the one before (at most width)."""

    at: np.ndarray
    lead: np.ndarray
    rank: np.ndarray
    shared: np.ndarray


def refined(text: Text, order: SuffixArray, width: int) -> SuffixArray:
    """Sorts by all width bytes what is sorted by its first eight, and fills in the shared prefixes."""
    n = len(order.at)
    group, shared = np.arange(n), np.zeros(n, np.int32)
    same = np.zeros(n, bool)
    same[1:] = order.lead[1:] == order.lead[:-1]
    first = np.flatnonzero(~same)
    shared[first[1:]] = _shared_bytes(order.lead[first[1:]], order.lead[first[1:] - 1])
    group = first[np.cumsum(~same) - 1]
    open_ = same.copy()
    open_[:-1] |= same[1:]
    slots = np.flatnonzero(open_)
    at, lead, rank = order.at.copy(), order.lead, order.rank.copy()
    for depth in [*range(8, width - 7, 8), *([width - 8] if width % 8 else [])]:
        if not len(slots):
            break
        key, g = text.lead(at[slots], depth), group[slots]
        tied = np.zeros(len(slots), bool)
        tied[1:] = g[1:] == g[:-1]
        # Only ties that this depth breaks need sorting; long repeats stay as they are.
        heads = np.flatnonzero(~tied)
        size = np.diff(np.append(heads, len(slots)))
        broken = np.logical_or.reduceat(key != np.repeat(key[heads], size), heads)
        some = np.flatnonzero(np.repeat(broken, size))
        if len(some):
            moved = some[np.lexsort((key[some], g[some]))]
            key[some], at[slots[some]], rank[slots[some]] = key[moved], at[slots[moved]], rank[slots[moved]]
            apart = some[tied[some]]
            apart = apart[key[apart] != key[apart - 1]]
            shared[slots[apart]] = depth + _shared_bytes(key[apart], key[apart - 1])
            tied[apart] = False
        head = np.flatnonzero(~tied)
        group[slots] = slots[head][np.cumsum(~tied) - 1]
        still = tied.copy()
        still[:-1] |= tied[1:]
        slots = slots[still]
    left = np.zeros(n, bool)
    left[slots] = True
    left[1:] &= group[1:] == group[:-1]
    left[0] = False
    shared[left] = width
    return SuffixArray(at, lead, rank, shared)


@dataclass
class Level:
    size: int  # in batches
    array: SuffixArray  # distinct suffixes


@dataclass
class IndexFamily:
    """Suffix arrays over one text whose sizes, in batches, are falling powers of two."""

    text: Text
    width: int
    levels: list[Level] = field(default_factory=list)

    def sorted_batch(self, at: np.ndarray, rank: np.ndarray) -> SuffixArray:
        lead = self.text.lead(at)
        order = np.argsort(lead, kind="stable")
        return refined(self.text, SuffixArray(at[order], lead[order], rank[order], np.zeros(len(at), np.int32)), self.width)

    def _merged(self, a: SuffixArray, b: SuffixArray) -> SuffixArray:
        lead = np.concatenate([a.lead, b.lead])
        order = np.argsort(lead, kind="stable")  # two sorted runs: one merge
        return refined(self.text, SuffixArray(np.concatenate([a.at, b.at])[order], lead[order], np.concatenate([a.rank, b.rank])[order], np.zeros(len(lead), np.int32)), self.width)

    def _judged(self, array: SuffixArray, new: int) -> tuple[SuffixArray, np.ndarray]:
        """(distinct suffixes, the earliest of each; positions of those from rank ``new`` on that an earlier one equals)."""
        head = np.flatnonzero(array.shared < self.width)
        least = np.minimum.reduceat(array.rank, head)
        of = np.cumsum(array.shared < self.width) - 1
        again = (least[of] < array.rank) & (array.rank >= new)
        # The earliest of equal suffixes stands for them; they are the same bytes, so order and prefixes hold.
        earliest = np.flatnonzero(array.rank == least[of])
        _, pick = np.unique(of[earliest], return_index=True)
        kept = earliest[pick]
        return SuffixArray(array.at[kept], array.lead[kept], array.rank[kept], array.shared[head]), array.at[again]

    def add(self, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Positions of the new batch whose window starts earlier elsewhere, in the batch or in a level; ranks are places in time, none below those before."""
        new = int(rank.min(initial=0))
        batch, found = self._judged(self.sorted_batch(at, rank), new)
        hits, carry, size = [found], batch, 1
        for level in reversed(self.levels):
            merging = level is self.levels[-1] and level.size == size
            array, found = self._judged(self._merged(level.array, carry if merging else batch), new)
            hits.append(found)
            if merging:
                carry, size = array, 2 * size
                self.levels.pop()
        self.levels.append(Level(size, carry))
        return np.concatenate(hits)


def mark_bytes(params: SuffixParams, watch: list[list[int]] | None = None):
    """watch, if given, takes the sizes of each shard's levels at the end."""

    def mark(b: S.Bucket) -> np.ndarray:
        """Which windows of each segment's smallest place start earlier elsewhere."""
        at = K.ranges(b.rows[:-1], b.windows)
        before = np.cumsum(b.windows) - b.windows
        step = np.arange(len(at)) - np.repeat(before, b.windows)
        id_, start = np.repeat(b.id, b.windows), np.repeat(b.start, b.windows) + step
        # Segments come by place, so only rows of one id can be out of order.
        order = np.arange(len(at)) if (np.diff(b.id) > 0).all() else np.lexsort((start, id_))
        new = np.ones(len(order), bool)
        new[1:] = (id_[order][1:] != id_[order][:-1]) | (start[order][1:] != start[order][:-1])
        rank = np.cumsum(new) - 1
        family = IndexFamily(Text(b.data), params.width)
        marked = np.zeros(len(b.data), bool)
        n = int(rank[-1]) + 1
        size = max(params.least_batch, -(-n // params.batches))
        for k in range(0, n, size):
            low, high = np.searchsorted(rank, [k, k + size])
            marked[family.add(at[order[low:high]], rank[low:high])] = True
        if watch is not None:
            watch.append([level.size for level in family.levels])
        return marked[at]

    return mark


def remove_repeats(docs: DataFrame, params: SuffixParams = SuffixParams(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and the kept bytes themselves if asked for."""

    def finish(ids: pa.Array, data: np.ndarray, rows: np.ndarray, spans: list[np.ndarray | None]) -> list[pa.Array]:
        total, removed, runs, digest, kept_bytes = [], [], [], [], []
        for k, cut in enumerate(spans):
            text = data[rows[k] : rows[k + 1]].tobytes()
            kept, n = text, 0
            if cut is not None:
                parts, at = [], -1
                for start, end in cut.tolist():
                    if start > at:
                        parts.append(text[max(at, 0) : start])
                        n += 1
                    at = max(at, end)
                kept = b"".join([*parts, text[at:]])
            total.append(len(text))
            removed.append(len(text) - len(kept))
            runs.append(n)
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_bytes.append(kept if with_text else None)
        return [ids, *(pa.array(x, pa.int64()) for x in (total, removed, runs)), pa.array(digest, pa.string()), pa.array(kept_bytes, pa.binary())]

    windows = S.Windows(byte_units(params.gram), params.width, params.gram, bytewise=True, by_start=True)
    out = S.without_repeats(docs, windows, mark_bytes(params), finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary", id_col, text_col)
    return out if with_text else out.drop("kept_bytes")
