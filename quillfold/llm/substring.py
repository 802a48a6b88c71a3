"""Substring deduplication by word windows, partitioned by super-k-mers.

Every window of ``width`` consecutive words of a document is looked for in all
documents with a smaller id. Windows travel in super-k-mers to the bucket of
their minimiser; there words are numbered, windows sorted by a fingerprint of
their numbers, and neighbours compared number by number, so the smallest id of
every distinct window is exact: no hash decides. Words covered
by a window that starts in a document with a smaller id are removed. Windows
are judged on the input, not on what is left.

Words are runs of anything but 0x20 and 0x09 to 0x0D, unchanged. Null, empty
and short texts lose nothing. Rows of one id never remove each other's words,
and repeated rows lose the same words. A row without an id removes nothing and
loses nothing. An empty table gives no rows. Very long texts and words are read
whole. Ids are integers. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import superkmer as S


@dataclass(frozen=True)
class SubstringParams:
    width: int = 13
    gram: int = 3


def word_units(gram: int) -> S.Units:
    def units(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = K.words_of(data, rows)
        return w.starts, w.ends, w.first, K.gram_hashes(w.hashes(), gram)

    return units


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, other numbers for others."""
    h, n = K.span_hashes(data, starts, ends), ends - starts
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    at = np.flatnonzero(same)
    a, b = order[at - 1], order[at]
    alike = n[a] == n[b]
    # The hash of up to eight bytes of one length is a bijection; longer words are compared.
    long = np.flatnonzero(alike & (n[a] > 8))
    alike[long] = K.equal_spans(data, starts[a[long]], starts[b[long]], n[a[long]])
    if not alike.all():
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(data[i:j].tobytes(), len(seen)) for i, j in zip(starts, ends, strict=True)], dtype=np.int64)
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(~same) - 1
    return out


def sorted_windows(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the windows that start at the given words, which of its entries differ from the one before): equal windows are neighbours."""
    prints = K.gram_hashes(words.astype(np.uint64), width)[at]
    order = np.argsort(prints, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = prints[order][1:] == prints[order][:-1]
    close = np.flatnonzero(same)
    a, b = at[order[close - 1]], at[order[close]]
    if all((words[a + k] == words[b + k]).all() for k in range(width)):
        return order, ~same
    # A fingerprint that unlike windows share: the words themselves give the order.
    order = np.lexsort([words[at + k] for k in range(width)])
    new = np.ones(len(order), bool)
    new[1:] = np.any([words[at[order[1:]] + k] != words[at[order[:-1]] + k] for k in range(width)], axis=0)
    return order, new


def mark_words(width: int):
    def mark(b: S.Bucket) -> np.ndarray:
        """Which windows start in a smaller id than the segment's own smallest."""
        w = K.words_of(b.data, b.rows)
        at = K.ranges(w.first[:-1], b.windows)
        order, new = sorted_windows(word_numbers(b.data, w.starts, w.ends), at, width)
        owner = np.repeat(b.id, b.windows)[order]
        begin = np.flatnonzero(new)
        smallest = np.minimum.reduceat(owner, begin)[np.cumsum(new) - 1]
        marked = np.zeros(len(order), bool)
        marked[order] = smallest < owner
        return marked

    return mark


def remove_repeats(docs: DataFrame, params: SubstringParams = SubstringParams(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row, and the kept words themselves if asked for."""

    def finish(ids: pa.Array, data: np.ndarray, rows: np.ndarray, spans: list[np.ndarray | None]) -> list[pa.Array]:
        total, removed, digest, kept_text = [], [], [], []
        for k, cut in enumerate(spans):
            # Splitting bytes takes exactly the white space above.
            words = data[rows[k] : rows[k + 1]].tobytes().split()
            kept = words
            if cut is not None:
                kept, at = [], 0
                for start, end in cut.tolist():
                    kept += words[at:start]
                    at = max(at, end)
                kept += words[at:]
            joined = b" ".join(kept)
            total.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(joined).hexdigest())
            kept_text.append(joined.decode() if with_text else None)
        return [ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())]

    windows = S.Windows(word_units(params.gram), params.width, params.gram, bytewise=False, by_start=False)
    out = S.without_repeats(docs, windows, mark_words(params.width), finish, "n_words long, n_removed long, kept_sha256 string, kept_text string", id_col, text_col)
    return out if with_text else out.drop("kept_text")
