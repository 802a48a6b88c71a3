"""Super-k-mer transport: runs of windows that share a minimiser travel together.

A text is a row of units (words or bytes). Every window of ``width`` units has
a minimiser, the least hash of its ``gram``-unit grams. Consecutive windows
with the same minimiser form one segment, sent as one packed string to the
bucket of that minimiser; equal windows have equal minimisers, so all places of
a window meet in one bucket.

Texts are read in packs of a bounded size, numbered by partition and order. A
pack sends each of its distinct segments once, with its smallest place only;
the other places stay where they are. So a passage that a third of all
documents hold reaches its bucket once per pack, not once per document. In the
bucket, segments whose minimiser has a single place anywhere are dropped: none
of their windows can repeat. Equal segments of different packs become one;
equality is that of the bytes, hashes only bring candidates together. The
verdict on a segment (its smallest place, and which of that place's windows
start earlier elsewhere) goes back to every pack that holds it; there the pack
is read again, and each place takes the verdict: all windows of a later place,
the marked ones of the smallest.

Reading a pack twice must give the same pack: the input should be a stored
table (or anything that gives the same rows in the same order when read
again). Every verdict carries a fingerprint of its pack, and a pack that has
changed is an error, never a silent loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import buckets_for

FLUSH_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20  # of text, before windows overlap
MOST_TASKS = 20_000  # beyond these, tasks take several buckets one after another
PACK = "bucket int, pack long, print long, facts binary, bytes binary"
VERDICT = "pack long, print long, verdict binary"
TEXTS = "pack long, ids array<long>, lengths binary, bytes binary"
#: (data, row offsets) -> (start and end byte of every unit, first unit of every row, gram hash at every unit)
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

#: A gram's place takes the low bits of its key: the least key is the leftmost least gram, and its high bits are the minimiser.
_PLACE_BITS = np.uint64(24)


def tight(*columns: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type each column needs, byte planes apart."""
    out = []
    for c in columns:
        low = int(c.min(initial=0))
        c = (c - low).astype(np.uint64)
        width = max(1, -(-int(c.max(initial=0)).bit_length() // 8))
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), 8)[:, :width]
        out += [np.array([low, width, len(c)], np.int64).tobytes(), planes.T.tobytes()]
    return b"".join(out)


def loose(data: bytes) -> list[np.ndarray]:
    """The columns that tight() wrote."""
    out, at = [], 0
    while at < len(data):
        low, width, n = np.frombuffer(data, np.int64, 3, at).tolist()
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 24).reshape(width, n).T
        out.append(planes.view(np.int64).reshape(n) + low)
        at += 24 + width * n
    return out


def sliding_least(g: np.ndarray, span: int) -> np.ndarray:
    """Least of every span consecutive entries."""
    if len(g) < span:
        return g[:0]
    have, out = 1, g
    while 2 * have <= span:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = span - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments_of(first: np.ndarray, grams: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window's unit, windows, minimiser, whether it has several places) of every segment; a window lies in one row."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    at = K.ranges(first[:-1], counts)
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))
    keys = (grams >> _PLACE_BITS << _PLACE_BITS) | (np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << 24) - 1))
    key = sliding_least(keys, width - gram + 1)[at]
    least = key >> _PLACE_BITS
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    new[(np.cumsum(counts) - counts)[counts > 0]] = True
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(at)))
    moved = np.zeros(len(at), bool)
    moved[1:] = key[1:] != key[:-1]
    moved[begin] = False
    several = np.logical_or.reduceat(moved, begin) | (windows > width - gram + 1)
    return np.searchsorted(first, at[begin], side="right") - 1, at[begin], windows, least[begin], several


@dataclass(frozen=True)
class Windows:
    """What a window is: ``width`` units, told apart by minimisers of ``gram`` units; rows of byte units may be cut anywhere."""

    units: Units
    width: int
    gram: int
    bytewise: bool
    by_start: bool  # whether a place of the same id with a smaller start comes earlier


def cut_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(number, ids, bytes, row offsets) of packs of (partition, id, text) batches."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = count = part = 0

    def joined() -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
        lengths = np.concatenate([np.diff(r) for _, _, r in held])
        out = (part << 32) + count, pa.concat_arrays([x for x, _, _ in held]), np.concatenate([d for _, d, _ in held]), np.concatenate([[0], np.cumsum(lengths)])
        held.clear()
        return out

    for b in batches:
        part = b.column(0)[0].as_py() if b.num_rows else part
        for i, j, d, r in K.pieces(*K.buffer_of(b.column(2)), K.PIECE_BYTES // 4):
            held.append((b.column(1)[i:j], d, r))
            size += len(d) + 16 * (j - i)
            if size >= FLUSH_BYTES:
                yield joined()
                size, count = 0, count + 1
    if held:
        yield joined()


@dataclass(frozen=True)
class Segments:
    """All segments of a pack, one entry for each place, and its distinct ones, numbered by bucket and order."""

    least: np.ndarray
    lengths: np.ndarray
    windows: np.ndarray
    several: np.ndarray
    id: np.ndarray
    row: np.ndarray
    start: np.ndarray  # first unit in the row
    begin: np.ndarray  # first byte in the pack
    number: np.ndarray  # of each place's segment
    leader: np.ndarray  # smallest place of each distinct segment
    bucket: np.ndarray  # of each distinct segment
    print: int


def _order_equal(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, least: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that brings equal segments together, by place; which of its entries differ from the one before)."""
    order = np.lexsort((*reversed(places), lengths, hashes, least))
    same = np.zeros(len(order), bool)
    same[1:] = True
    for c in (hashes, lengths, least):
        same[1:] &= c[order][1:] == c[order][:-1]
    at = np.flatnonzero(same)
    same[at] = K.equal_spans(data, begin[order[at - 1]], begin[order[at]], lengths[order[at]])
    return order, ~same


def pack_segments(ids: pa.Array, data: np.ndarray, rows: np.ndarray, w: Windows, buckets: int) -> Segments:
    """Segments of a pack; rows without an id have none."""
    known, id_of = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    found: list[tuple[np.ndarray, ...]] = []
    chunk = K.PIECE_BYTES // 4
    for i, j, d, r in K.pieces(data, rows, chunk):
        cut = w.bytewise and len(d) > chunk  # one long row
        for base in range(0, max(1, len(d) - w.width + 1), chunk) if cut else (0,):
            part, ends_at = (d[base : base + chunk + w.width - 1], None) if cut else (d, r)
            starts, ends, first, grams = w.units(part, np.array([0, len(part)]) if cut else ends_at)
            row, at, windows, least, several = segments_of(first, grams, w.width, w.gram)
            ok = known[i + row]
            row, at, windows = row[ok], at[ok], windows[ok]
            from_, to = starts[at], ends[at + windows + w.width - 2]
            found.append((least[ok], K.rolling_hashes(part, from_, to), to - from_, windows, several[ok], id_of[i + row], i + row, at - first[row] + base, from_ + base + rows[i]))
    least, hashes, lengths, windows, several, id_, row, start, begin = (np.concatenate(c) for c in zip(*found, strict=True))
    order, new = _order_equal(data, begin, lengths, hashes, least, id_, start)
    leader = order[new]
    bucket = (K.mix(least[leader]) % np.uint64(buckets)).astype(np.int64)
    rank = np.lexsort((leader, bucket))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    number = np.empty(len(order), np.int64)
    number[order] = place[np.cumsum(new) - 1]
    check = int(np.bitwise_xor.reduce(K.mix(hashes + np.arange(len(hashes), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + id_.astype(np.uint64)), initial=np.uint64(len(hashes)))) >> 1
    return Segments(least, lengths, windows, several, id_, row, start, begin, number, leader[rank], bucket[rank], check)


def _numbered_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.spark_partition_id().alias("_part"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))


def packs(docs: DataFrame, w: Windows, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct segments of all packs with their smallest places, compressed, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for number, ids, data, rows in cut_packs(batches):
            s = pack_segments(ids, data, rows, w, buckets)
            if not len(s.leader):
                continue
            times = np.bincount(s.number)
            cuts = np.searchsorted(s.bucket, np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = s.leader[cuts[k] : cuts[k + 1]]
                more = s.several[at].astype(np.int64) + 2 * (times[cuts[k] : cuts[k + 1]] > 1)
                facts = tight(cuts[k : k + 1], np.diff(s.id[at], prepend=0), s.start[at], (s.least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), s.lengths[at], s.windows[at], more)
                out.append((k, number, s.print, squeeze(facts), squeeze(data[K.ranges(s.begin[at], s.lengths[at])].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "pack", "print", "facts", "bytes"])

    return _numbered_rows(docs, id_col, text_col).mapInArrow(run, PACK)


@dataclass
class Bucket:
    """Distinct segments that may repeat, in order of their smallest place, and the packs that hold them."""

    id: np.ndarray  # the smallest place of each segment
    start: np.ndarray
    windows: np.ndarray
    data: np.ndarray
    rows: np.ndarray  # byte offsets of the segments
    packs: list[tuple[int, int]]  # number and fingerprint
    pack: np.ndarray  # of every entry, as a place in packs
    number: np.ndarray  # of every entry in its pack
    segment: np.ndarray  # of every entry
    again: np.ndarray  # whether the entry has several places in its pack


def opened(batches: Iterator[pa.RecordBatch]) -> Bucket | None:
    """The bucket's packs as one; None if nothing in it can repeat."""
    open_ = zstandard.ZstdDecompressor().decompress
    columns: list[list[np.ndarray]] = []
    texts: list[bytes] = []
    packs: list[tuple[int, int]] = []
    for b in batches:
        for pack, check, facts, text in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
            first, delta, *rest = loose(open_(facts))
            columns.append([np.full(len(delta), len(packs)), first[0] + np.arange(len(delta)), np.cumsum(delta), *rest])
            texts.append(text)
            packs.append((pack, check))
    pack, number, id_, start, least, lengths, windows, more = (np.concatenate(c) for c in zip(*columns, strict=True))
    _, kind, held = np.unique(least, return_inverse=True, return_counts=True)
    repeated = (held[kind] > 1) | (more > 0)
    if not repeated.any():
        return None
    parts, at = [], 0
    for c, t in zip(columns, texts, strict=True):
        keep = np.flatnonzero(repeated[at : at + len(c[0])])
        at += len(c[0])
        if len(keep):
            parts.append(np.frombuffer(open_(t), np.uint8)[K.ranges((np.cumsum(c[5]) - c[5])[keep], c[5][keep])])
    del texts, columns
    pack, number, id_, start, least, lengths, windows, more = (c[repeated] for c in (pack, number, id_, start, least, lengths, windows, more))
    data = np.concatenate(parts)
    del parts
    begin = np.cumsum(lengths) - lengths
    hashes = np.concatenate([np.empty(0, np.uint64), *(K.rolling_hashes(d, r[:-1], r[1:]) for _, _, d, r in K.pieces(data, np.append(begin, len(data))))])
    order, new = _order_equal(data, begin, lengths, hashes, least, id_, start)
    leader = order[new]
    rank = np.lexsort((start[leader], id_[leader]))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    segment = np.empty(len(order), np.int64)
    segment[order] = place[np.cumsum(new) - 1]
    leader = leader[rank]
    return Bucket(id_[leader], start[leader], windows[leader], data[K.ranges(begin[leader], lengths[leader])], np.concatenate([[0], np.cumsum(lengths[leader])]), packs, pack, number, segment, more >= 2)


def runs_of(marked: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of marked windows, none of which crosses a segment; segment s has the windows first[s] to first[s + 1]."""
    run_start, run_end = marked.copy(), marked.copy()
    run_start[1:] &= ~marked[:-1]
    run_start[first[:-1]] = marked[first[:-1]]
    run_end[:-1] &= ~marked[1:]
    run_end[first[1:] - 1] = marked[first[1:] - 1]
    return np.flatnonzero(run_start), np.flatnonzero(run_end) + 1


def verdicts(b: Bucket, marked: np.ndarray) -> pa.RecordBatch:
    """One row for each pack that holds a segment with something to remove: its smallest place and the marked runs of that place's windows."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    first = np.concatenate([[0], np.cumsum(b.windows)])
    begin, end = runs_of(marked, first)
    run_at = np.searchsorted(begin, first)
    n_runs = np.diff(run_at)
    tell = (np.bincount(b.segment, minlength=len(b.windows)) > 1) | (n_runs > 0) | (np.bincount(b.segment, b.again, minlength=len(b.windows)) > 0)
    entries = np.flatnonzero(tell[b.segment])
    entries = entries[np.lexsort((b.number[entries], b.pack[entries]))]
    cuts = np.searchsorted(b.pack[entries], np.arange(len(b.packs) + 1))
    out = []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        e = entries[cuts[k] : cuts[k + 1]]
        s = b.segment[e]
        run = K.ranges(run_at[:-1][s], n_runs[s])
        low = np.repeat(first[s], n_runs[s])
        out.append((*b.packs[k], squeeze(tight(b.number[e], np.diff(b.id[s], prepend=0), b.start[s], n_runs[s], begin[run] - low, end[run] - low))))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["pack", "print", "verdict"])


def removed_spans(s: Segments, told: list[bytes], w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the units that a pack's verdicts remove, by row and start."""
    open_ = zstandard.ZstdDecompressor().decompress
    of = np.full(len(s.leader), -1)
    columns, total = [], 0
    for t in told:
        number, delta, *rest = loose(open_(t))
        of[number] = total + np.arange(len(number))
        total += len(number)
        columns.append([np.cumsum(delta), *rest])
    id_, start, n_runs, begin, end = (np.concatenate(c) for c in zip(*columns, strict=True))
    run_at = np.cumsum(n_runs) - n_runs
    place = np.flatnonzero(of[s.number] >= 0)
    v = of[s.number[place]]
    later = s.id[place] > id_[v]
    if w.by_start:
        later |= (s.id[place] == id_[v]) & (s.start[place] > start[v])
    whole, v = place[later], v[~later]
    part = np.repeat(place[~later], n_runs[v])
    run = K.ranges(run_at[v], n_runs[v])
    row = np.concatenate([s.row[whole], s.row[part]])
    from_ = np.concatenate([s.start[whole], s.start[part] + begin[run]])
    to = np.concatenate([s.start[whole] + s.windows[whole], s.start[part] + end[run]]) - 1 + w.width
    order = np.lexsort((from_, row))
    return row[order], from_[order], to[order]


def without_repeats(docs: DataFrame, w: Windows, mark: Callable[[Bucket], np.ndarray], finish: Callable[[pa.Array, np.ndarray, np.ndarray, list[np.ndarray | None]], list[pa.Array]], columns: str, id_col: str, text_col: str) -> DataFrame:
    """finish(ids, bytes, offsets, per row: the spans of units to remove, as rows (start, end), or None) on every pack.

    mark() says of every window of a bucket's segments, at the segment's smallest place, whether it starts earlier elsewhere.
    """
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    buckets = buckets_for(size, BUCKET_BYTES, 8)
    tasks = min(buckets, MOST_TASKS)
    id_type = docs.schema[id_col].dataType

    def judge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = opened(batches)
        if b is not None:
            yield verdicts(b, mark(b))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for number, ids, data, rows in cut_packs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([tight(np.diff(rows))], pa.binary()), pa.array([squeeze(data.tobytes())], pa.binary())], names=["pack", "ids", "lengths", "bytes"])

    def close(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for pack, lengths, text, ids in zip(*(texts.column(c).to_pylist() for c in ("pack", "lengths", "bytes")), texts.column("ids").chunks[0] if texts.num_rows else [], strict=True):
            data, rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8), np.concatenate([[0], np.cumsum(loose(lengths)[0])])
            ids = ids.values
            spans: list[np.ndarray | None] = [None] * len(ids)
            if told.num_rows:
                s = pack_segments(ids, data, rows, w, buckets)
                if set(told.column("print").to_pylist()) != {s.print}:
                    raise ValueError(f"pack {pack} changed between two readings: store the documents first")
                row, start, end = removed_spans(s, told.column("verdict").to_pylist(), w)
                both = np.stack([start, end], axis=1)
                cuts = np.searchsorted(row, np.arange(len(ids) + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    spans[k] = both[cuts[k] : cuts[k + 1]]
            out.append(pa.table(finish(ids, data, rows, spans), schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    names = [c.split()[0] for c in columns.split(",")]
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([("_id", pa.int64()), *[(n, arrow[c.split()[1]]) for n, c in zip(names, columns.split(","), strict=True)]])
    told = packs(docs, w, buckets, id_col, text_col).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(judge, VERDICT)
    texts = _numbered_rows(docs, id_col, text_col).mapInArrow(ship, TEXTS)
    done = texts.repartition(tasks, "pack").groupBy("pack").cogroup(told.repartition(tasks, "pack").groupBy("pack")).applyInArrow(close, f"_id long, {columns}")
    return done.select(F.col("_id").cast(id_type).alias(id_col), *names)
