"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, cut
into pieces of about one megabyte so that the working set stays small whatever
the batch size; one very long text forms a piece of its own. A null text has
no words, no bytes and no lines.

Words are named by ``span_hashes``: every eight bytes pass through a bijective
avalanche step, so no structure of a word makes it collide; words beyond
``LONG_SPAN`` bytes take a cryptographic digest. ``rolling_hashes`` is a cheap
polynomial for spans at every byte: equal spans have equal values, and nothing
may rest on the converse. Operators that promise exact results compare the
bytes themselves after sorting by a hash (``equal_spans``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Words are maximal runs of anything but these bytes: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PIECE_BYTES = 1 << 20
LONG_SPAN = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step on 64-bit values (finaliser of the splitmix generator)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit values of data[start:end] by a polynomial modulo 2^64: equal spans have equal ones, unlike spans may too."""
    up, down = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one little-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for every pair; another seed gives independent ones."""
    n = ends - starts
    h = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1))
    at = words_at(data)
    live = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    for k in range(0, LONG_SPAN, 8):
        if not len(live):
            break
        h[live] = mix(h[live] ^ (at[starts[live] + k] & _LOW_BYTES[np.minimum(n[live] - k, 8)]))
        live = live[n[live] > k + 8]
    for k in np.flatnonzero(n > LONG_SPAN).tolist():
        h[k] ^= np.uint64(int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little"))
    return h


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[a:a + length] and data[b:b + length] hold the same bytes, for every pair."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(lengths)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (PIECE_BYTES << 2), side="right")))
        some = np.flatnonzero(lengths[i:j] > 0)
        if len(some):
            n = lengths[i:j][some]
            same = data[ranges(a[i:j][some], n)] == data[ranges(b[i:j][some], n)]
            out[i + some] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        i = j
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive entries of h, in order."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x9FB21C651E98DF25)) ^ mix(h[k : len(h) - n + 1 + k] + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 63) - 1))
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    return mix(out)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[off[0] : off[-1]] if values is not None else np.empty(0, np.uint8)
    return data, off - off[0]


@dataclass
class Words:
    """Words of a run of rows: row r holds words first[r] to first[r + 1]."""

    data: np.ndarray
    rows: np.ndarray  # byte offsets of the rows
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def words_of(data: np.ndarray, rows: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Word spans between the bytes that space marks; a word never crosses a row."""
    solid = ~space[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = rows[:-1] < rows[1:]
    begin[rows[:-1][full]] = solid[rows[:-1][full]]
    end[rows[1:][full] - 1] = solid[rows[1:][full] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows))


def pieces(data: np.ndarray, rows: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about size bytes."""
    at, n = 0, len(rows) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + size, side="right")) - 1)
        yield at, to, data[rows[at] : rows[to]], rows[at : to + 1] - rows[at]
        at = to


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of counts, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    full = counts > 0
    starts, counts = starts[full], counts[full]
    at = np.cumsum(counts) - counts
    out[at[0]] = starts[0]
    out[at[1:]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct n-word shingles of every row; a row of 1 to n - 1 words gives its whole sequence."""
    h = w.hashes()
    counts = np.diff(w.first)
    grams = gram_hashes(h, n)
    per_row = np.maximum(counts - n + 1, 0)
    values = grams[ranges(w.first[:-1], per_row)]
    owner = np.repeat(np.arange(len(counts)), per_row)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([mix(np.array([np.bitwise_xor.reduce(gram_hashes(h[w.first[r] : w.first[r + 1]], int(counts[r])))], np.uint64) + np.uint64(counts[r]))[0] for r in short], dtype=np.uint64)
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))
