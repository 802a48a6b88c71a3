"""Packing token sequences by non-negative least squares over length combinations.

Documents are tokenised and closed with an end id. Whole windows of a long
document stand alone; what is left of each document is one remainder shorter
than the window. Remainders of a block are counted by length in steps of
``unit`` tokens. All combinations of up to ``depth`` steps that fill a window
are enumerated, and non-negative least squares finds how often to use each so
that together they meet the histogram. Counts are rounded down and realised;
remainders that are left over are cut to fill the gaps of those windows and
then packed greedily one behind the other. The last part of a block, shorter
than a window, is cut at powers of two, so that nothing needs padding.

A block is a run of about ``block_tokens`` tokens of one partition, so memory
is bounded, nothing is shuffled, no document is dropped, and a lost task is
simply run again with the same result. Within a block, ties keep input order.
A null text counts as empty and has the end id alone; an empty table gives no
rows. A very long text is tokenised whole and makes a block of its own. Repeated
rows are packed each for itself. Columns other than id and text, whatever their
names, are ignored. Sequence ids are unique over all partitions, not consecutive.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingParams:
    window: int = 2048
    unit: int = 32
    depth: int = 3
    end_id: int = 1
    block_tokens: int = 6_000_000
    #: The vocabulary for the exact tokeniser, and the same one as ranks for the fast one.
    tokenizer: str = "byte_bpe_50k.json"
    ranks: str = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str) -> Callable[[str], np.ndarray]:
    """text -> ids as the ``tokenizers`` library gives them for the vocabulary file.

    The rank file holds the same vocabulary and split pattern, and its encoder
    gives the same ids several times faster; texts that spell a special token
    go to the library itself, which gives that token's id.
    """
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    with open(P.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    exact = Tokenizer.from_file(P.path(tokenizer))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


@lru_cache(maxsize=4)
def combinations(steps: int, depth: int) -> np.ndarray:
    """Matrix (steps x combinations): how often each length is in each multiset of at most depth lengths that add up to steps."""
    out: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(chosen)
        elif len(chosen) < depth:
            for part in range(min(left, chosen[-1] if chosen else left), 0, -1):
                grow((*chosen, part), left - part)

    grow((), steps)
    a = np.zeros((steps, len(out)))
    for k, parts in enumerate(out):
        for p in parts:
            a[p - 1, k] += 1
    return a


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set of positive entries."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(most):
        slope = np.where(active, -np.inf, target - gram @ x)
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=None)[0]
            if (z > tolerance * 1e-3).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= tolerance * 1e-3
            ratio = x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)
            x[on] += min(1.0, float(ratio.min())) * (z - x[on])
            drop = on[low & (x[on] <= tolerance * 1e-3)]
            if not len(drop):
                drop = on[low][[int(ratio.argmin())]]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def plan(lengths: np.ndarray, params: PackingParams) -> tuple[list[list[int]], list[int]]:
    """(remainders of every planned window, remainders that are left over); lengths are below the window."""
    steps = params.window // params.unit
    bins = -(-lengths // params.unit)
    order = np.argsort(bins, kind="stable")
    cuts = np.searchsorted(bins[order], np.arange(1, steps + 2))
    queues = [order[cuts[k] : cuts[k + 1]].tolist()[::-1] for k in range(steps)]
    left = np.array([len(q) for q in queues])
    a = combinations(steps, params.depth)
    x = non_negative_least_squares(a, left.astype(float))
    windows: list[list[int]] = []
    for j in np.lexsort((np.arange(len(x)), -x)):
        if x[j] < 1:
            break
        parts = np.flatnonzero(a[:, j])
        times = min(int(x[j] + 1e-9), int((left[parts] // a[parts, j].astype(int)).min()))
        for _ in range(times):
            windows.append([queues[p].pop() for p in parts for _ in range(int(a[p, j]))])
        left[parts] -= times * a[parts, j].astype(int)
    rest = [i for q in reversed(queues) for i in reversed(q)]
    # Leftovers must be enough to fill every gap; else the last windows are taken apart again.
    gap = len(windows) * params.window - sum(int(lengths[i]) for w in windows for i in w)
    spare = sum(int(lengths[i]) for i in rest)
    while windows and spare < gap:
        w = windows.pop()
        used = sum(int(lengths[i]) for i in w)
        rest += w
        spare, gap = spare + used, gap - (params.window - used)
    return windows, rest


def pack(lengths: np.ndarray, params: PackingParams = PackingParams()) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; lengths are positive."""
    size, out, sequence = params.window, [], 0
    for i in np.flatnonzero(lengths >= size).tolist():
        for k in range(int(lengths[i]) // size):
            out.append((i, k * size, size, sequence, 0))
            sequence += 1
    whole = lengths // size * size
    docs = np.flatnonzero(lengths % size)
    if not len(docs):
        return out
    windows, rest = plan((lengths % size)[docs], params)
    stream = [[int(docs[i]), int(whole[docs[i]]), int(lengths[docs[i]] % size)] for i in rest]
    at, total = 0, sum(s[2] for s in stream)

    def pour(offset: int, room: int) -> None:
        nonlocal at, total
        while room:
            doc, start, length = stream[at]
            n = min(room, length)
            out.append((doc, start, n, sequence, offset))
            offset, room, total = offset + n, room - n, total - n
            if n == length:
                at += 1
            else:
                stream[at] = [doc, start + n, length - n]

    for w in windows:
        offset = 0
        for i in w:
            d = int(docs[i])
            n = int(lengths[d] % size)
            out.append((d, int(whole[d]), n, sequence, offset))
            offset += n
        pour(offset, size - offset)
        sequence += 1
    while total:
        n = min(size, 1 << (total.bit_length() - 1))
        pour(0, n)
        sequence += 1
    return out


def pack_documents(docs: DataFrame, params: PackingParams = PackingParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(params.tokenizer, params.ranks)
        first = TaskContext.get().partitionId() << 40
        ids: list[pa.Scalar] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            found = pack(np.array([len(t) for t in tokens], dtype=np.int64), params)
            crc = [zlib.crc32(tokens[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in found]
            doc, start, length, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
            out = pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in doc.tolist()], id_type), *map(pa.array, (start, length, np.array(crc, np.int64), np.array([len(tokens[d]) for d in doc.tolist()], np.int64), sequence + first, offset))],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            first += int(sequence.max()) + 1
            ids.clear()
            tokens.clear()
            return out

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = np.append(encode(text.as_py() or ""), np.uint32(params.end_id))
                ids.append(i)
                tokens.append(t)
                held += len(t)
                if held >= params.block_tokens:
                    yield flush()
                    held = 0
        if tokens:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")
