"""Exact Jaccard join of word-shingle sets, size-aware with a light and a heavy side.

Two documents link when inter * 100 >= percent * union over their sets of
distinct n-word shingles (64-bit hashes). Documents with the same set are one
class, represented by the smallest id; only representatives are joined.

Light side, sets of at most ``x`` shingles: two sets of sizes s and s' link
exactly when they share o = ceil(percent * (s + s') / (100 + percent))
shingles, so each set enumerates its subsets of every size o that it can need,
and meets its partners at equal subsets. All members of a subset that link at
all link to its smallest set: a star says everything.

Heavy side, larger sets and the light ones within reach of them: each set
enters the inverted lists of its rarest shingles, as many as a partner must
hold one of. Lists are scanned for pairs that sizes and parity bitmaps (a
lower bound on the symmetric difference) allow; sets joined by such pairs form
clusters, which contain every component of true links. Each member's whole set
then goes once to its cluster, where pairs not yet connected are verified.
Lists beyond ``long_list`` are linked unscanned. Clusters beyond ``tile``
members are cut into blocks whose bitmaps meet block against block. In the
verified clusters beyond ``tile`` each member first meets one hub, row by row in
a join that may be split; those linked to it are connected, and only the others
are dealt into blocks that meet the blocks of all members. So a hot group of near
copies costs one comparison of sets a member, no task grows with it, and no link
is lost.

The boundary x minimises the cost of enumerated subsets, each shuffled once,
and of list entries, each shuffled ``entry_cost`` times (to count its list, to
meet its bitmap, to be scanned) and scanned against its list. List lengths come
from a count sketch of fixed size over all shingles, less what a slot holds by
chance. The same sketch orders shingles by rarity. Shingles are told apart by
64 bits of a hash without structure: within a pair of sets of a thousand
shingles, unlike ones meet with a probability below 1e-13.

An empty table gives no rows; very long texts and words are read whole. A text
with fewer than n words has its whole sequence as one shingle; a null or
wordless text has none and links with nothing. Ids are integers; rows that
share an id are one document of the graph, and a row without an id keeps its
count and has no component. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import buckets_for, materialise
from .components import connected_components

SLOT_BITS = 18
CHUNKS = 64
SMALL = 64  # sets up to this size keep all their shingles until the boundary is known
BITMAP_WORDS = 8


@dataclass(frozen=True)
class JaccardParams:
    n: int = 5
    percent: int = 80
    lower: bool = True
    long_list: int = 2048
    tile: int = 2048
    bucket_rows: int = 1000
    max_subsets: int = 20_000
    entry_cost: int = 3


def need(percent: int, a: np.ndarray | int, b: np.ndarray | int):
    """Shingles that sets of sizes a and b must share."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(percent: int, s: int) -> list[int]:
    """Sizes of the subsets by which a set of size s can meet a partner."""
    least, most = -(-percent * s // 100), 100 * s // percent
    return sorted({o for p in range(max(1, least), most + 1) if (o := need(percent, s, p)) <= min(s, p)})


def subset_count(percent: int, s: int) -> int:
    return sum(math.comb(s, o) for o in subset_sizes(percent, s))


def _pieces(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, d, r in K.pieces(*K.buffer_of(column)):
        yield i, j, K.LOWER[d] if lower else d, r


def shingle_sketch(docs: DataFrame, params: JaccardParams, text_col: str) -> np.ndarray:
    """Counts of all shingles by the leading bits of their hash; its size is fixed, whatever the input."""
    per_chunk = (1 << SLOT_BITS) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for b in batches:
            for _, _, d, r in _pieces(b.column(0), params.lower):
                w = K.words_of(d, r)
                h = K.gram_hashes(w.hashes(), params.n)
                inside = K.ranges(w.first[:-1], np.maximum(np.diff(w.first) - params.n + 1, 0))
                total += np.bincount((h[inside] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(total[k * per_chunk : (k + 1) * per_chunk].tobytes(), 1) for k in range(CHUNKS)], pa.binary())], names=["chunk", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per_chunk, dtype=np.int64)
        for b in batches:
            for x in b.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(x), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    parts = docs.select(text_col).mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for r in parts:
        out[r["chunk"] * per_chunk : (r["chunk"] + 1) * per_chunk] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
    return out


def bitmaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity bitmaps of sets: the bits in which two differ are no more than the elements in which the sets differ."""
    n, bits = len(first) - 1, 64 * BITMAP_WORDS
    owner = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(owner * bits + (values & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.reshape(n, bits).astype(np.uint8), axis=1, bitorder="little")


def bitmap_levels(size: np.ndarray) -> np.ndarray:
    """Level of a set's scaled bitmap: it has 512 << level bits, at least two for each element."""
    return np.maximum(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) - 8, 0)


def scaled_bitmaps(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A parity bitmap of every set whose length follows its size; halves of a longer one, put together by parity, give a shorter one."""
    size = np.diff(first)
    bits = 512 << bitmap_levels(size)
    start = np.cumsum(bits) - bits
    at = np.repeat(start, size) + (values & np.repeat(bits.astype(np.uint64) - np.uint64(1), size)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
    return [packed[a // 8 : (a + b) // 8].tobytes() for a, b in zip(start.tolist(), bits.tolist(), strict=True)]


def signatures(docs: DataFrame, sketch: np.ndarray, params: JaccardParams, id_col: str, text_col: str) -> DataFrame:
    """_id, n, two hashes of the whole set, its rarest shingles (all of a small set), their list cost and two bitmaps."""
    usual = float(sketch.mean())
    excess = docs.sparkSession.sparkContext.broadcast(params.entry_cost + np.maximum(0, sketch - usual - 3 * math.sqrt(usual + 1)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = excess.value
        for b in batches:
            for i, j, d, r in _pieces(b.column(1), params.lower):
                v, first = K.shingle_sets(K.words_of(d, r), params.n)
                size = np.diff(first)
                owner = np.repeat(np.arange(j - i), size)
                cost = extra[(v >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                order = np.lexsort((v, cost, owner))
                ranked, cost = v[order], cost[order]
                prefix = np.where(size > 0, size - -(-params.percent * size // 100) + 1, 0)
                keep = np.where(size <= SMALL, size, prefix)
                at = K.ranges(first[:-1], keep)
                total = np.concatenate([[0], np.cumsum(cost)])
                m1, m2 = K.mix(v), K.mix(v ^ np.uint64(0xA0761D6478BD642F))
                sums = lambda m: np.concatenate([np.zeros(1, np.uint64), np.cumsum(m, dtype=np.uint64)])
                s1, s2 = sums(m1), sums(m2)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[i:j], pa.array(size.astype(np.int32)),
                        pa.array((s1[first[1:]] - s1[first[:-1]]).view(np.int64)), pa.array((s2[first[1:]] - s2[first[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(ranked[at].view(np.int64))),
                        pa.array((total[first[:-1] + prefix] - total[first[:-1]]).astype(np.int64)),
                        pa.array([x.tobytes() for x in bitmaps(v, first)], pa.binary()),
                        pa.array(scaled_bitmaps(v, first), pa.binary()),
                    ],
                    names=["_id", "n", "k1", "k2", "tokens", "cost", "bitmap", "scaled"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_col)
    return rows.mapInArrow(run, "_id long, n int, k1 long, k2 long, tokens array<long>, cost long, bitmap binary, scaled binary")


def choose_boundary(sets: DataFrame, params: JaccardParams) -> int:
    """The size up to which subsets cost no more than list scans; at most one row per small size reaches the driver."""
    by_size = {r["n"]: (r["sets"], r["cost"]) for r in sets.filter(F.col("n") <= SMALL).groupBy("n").agg(F.count("*").alias("sets"), F.sum("cost").alias("cost")).collect()}
    best, best_cost = 0, math.inf
    for x in range(SMALL * params.percent // 100 + 1):
        if x and subset_count(params.percent, x) > params.max_subsets:
            break
        light = sum(k * subset_count(params.percent, s) for s, (k, _) in by_size.items() if s <= x)
        heavy = sum(c for s, (_, c) in by_size.items() if s > params.percent * x // 100)
        if light + heavy < best_cost:
            best, best_cost = x, light + heavy
    return best


def light_links(sets: DataFrame, x: int, params: JaccardParams) -> DataFrame:
    """Star edges u, v of all links among sets of at most x shingles."""

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for i, n, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = tokens.values.to_numpy().view(np.uint64)
                m1, m2 = K.mix(t), K.mix(t ^ np.uint64(0xE7037ED1A0B428DB))
                for o in subset_sizes(params.percent, n):
                    gone = np.array(list(combinations(range(n), n - o)), dtype=np.int64).reshape(math.comb(n, o), n - o)
                    out.append((i, n, o, m1.sum(dtype=np.uint64) - m1[gone].sum(1, dtype=np.uint64), m2.sum(dtype=np.uint64) - m2[gone].sum(1, dtype=np.uint64)))
            if out:
                count = [len(x[3]) for x in out]
                rep = lambda k, t: pa.array(np.repeat(np.array([x[k] for x in out]), count).astype(t))  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([rep(0, np.int64), rep(1, np.int32), rep(2, np.int32), *(pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (3, 4))], names=["id", "n", "o", "a", "b"])

    keys = sets.filter((F.col("n") > 0) & (F.col("n") <= x)).select("_id", "n", "tokens").mapInArrow(subsets, "id long, n int, o int, a long, b long")
    keys = materialise(keys, "jaccard-subsets")
    first = keys.groupBy("o", "a", "b").agg(F.min(F.struct("n", "id")).alias("m"), F.count("*").alias("k")).filter("k > 1")
    met = keys.join(first, ["o", "a", "b"]).filter((F.col("id") != F.col("m.id")) & (100 * F.col("o") >= params.percent * (F.col("n") + F.col("m.n") - F.col("o"))))
    return met.select(F.col("id").alias("u"), F.col("m.id").alias("v")).distinct()


def _join_labels(adjacent: np.ndarray) -> np.ndarray:
    """Smallest position reachable, from a symmetric adjacency matrix."""
    label = np.arange(len(adjacent))
    while True:
        least = np.where(adjacent, label[None, :], len(label)).min(1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def list_clusters(lists: DataFrame, params: JaccardParams) -> DataFrame:
    """Edges u, v of a forest over the pairs that sizes and bitmaps allow; lists: _t, _id, n, bitmap."""
    p = params.percent

    def scan(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).combine_chunks()
        if not held.num_rows:
            return
        t, ids, n = (held.column(k).to_numpy() for k in ("_t", "_id", "n"))
        n = n.astype(np.int64)
        bits = np.frombuffer(b"".join(held.column("bitmap").to_pylist()), dtype=np.uint64).reshape(len(t), BITMAP_WORDS)
        order = np.lexsort((ids, n, t))
        t, ids, n, bits = t[order], ids[order], n[order], bits[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1, [len(t)]])
        u, v = [], []

        def may_link(i, j) -> np.ndarray:
            total = n[i] + n[j]
            share = need(p, n[i], n[j])
            return (share <= np.minimum(n[i], n[j])) & (np.bitwise_count(bits[i] ^ bits[j]).sum(-1) <= total - 2 * share)

        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        ok = may_link(two, two + 1)
        u.append(ids[two[ok] + 1])
        v.append(ids[two[ok]])
        for a, k in zip(cuts[:-1][size > 2], size[size > 2], strict=True):
            adjacent = np.empty((k, k), bool)
            every = np.arange(a, a + k)
            for s in range(0, k, 64):
                adjacent[s : s + 64] = may_link(every[s : s + 64, None], every[None, :])
            label = _join_labels(adjacent)
            other = np.flatnonzero(label != np.arange(k))
            u.append(ids[a + other])
            v.append(ids[a + label[other]])
        found = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return lists.groupBy("_bucket").applyInArrow(scan, "u long, v long")


def verify(ids: np.ndarray, sides: np.ndarray, values: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the true links among sets; sides: pairs within one side are not asked for unless all sides are equal."""
    k = len(ids)
    _, token = np.unique(values, return_inverse=True)
    size = np.diff(first)
    mark = np.zeros(int(token.max(initial=-1)) + 1, bool)
    label, out = np.arange(k), []
    single = (sides == sides[0]).all()
    for p in range(k):
        other = label != label[p]
        other[: p + 1] = False
        other &= ids != ids[p]
        if not single:
            other &= sides != sides[p]
        other &= need(percent, size, size[p]) <= np.minimum(size, size[p])
        other = np.flatnonzero(other)
        if not len(other):
            continue
        own = token[first[p] : first[p + 1]]
        mark[own] = True
        hit = mark[token[K.ranges(first[other], size[other])]]
        shared = np.add.reduceat(hit, np.cumsum(size[other]) - size[other], dtype=np.int64)
        mark[own] = False
        for q in other[shared >= need(percent, size[other], size[p])].tolist():
            if label[q] != label[p]:
                label[label == label[q]] = label[p]
                out.append((int(ids[q]), int(ids[p])))
    return out


def _placed(clusters: DataFrame, params: JaccardParams) -> tuple[DataFrame, int]:
    """(_id, component, number of blocks nb and own block; how many buckets the clusters of one block share)."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("k"))
    members = materialise(clusters.join(sizes, "component"), "jaccard-clusters")
    placed = members.select(F.col("node").alias("_id"), "component", F.ceil(F.col("k") / params.tile).cast("int").alias("nb"))
    return placed.withColumn("block", F.pmod(F.xxhash64("_id"), F.col("nb")).cast("int")), buckets_for(members.count(), params.bucket_rows, 8)


def _alone(whole: DataFrame, buckets: int, *payload: str) -> DataFrame:
    """Members of clusters of one block, with the bucket that their whole cluster goes to."""
    return whole.select(F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("_g"), F.lit(-1).alias("_i"), F.lit(-1).alias("_j"), "_id", "component", F.lit(0).alias("block"), *payload)


def _meetings(big: DataFrame, payload: tuple[str, ...], meets: Callable[..., bool]) -> tuple[DataFrame, DataFrame]:
    """Of clusters of several blocks: edges u, v to each cluster's hub (its smallest id), and the tiles (side 0: members that don't meet the hub, side 1: all) left to be judged.

    meets(member's payload..., hub's payload...) tells whether two are connected.
    """
    hub = big.groupBy("component").agg(F.min("_id").alias("_hub"), F.min_by(F.struct(*payload), "_id").alias("_h")).select("component", "_hub", *[F.col(f"_h.{p}").alias(f"_h_{p}") for p in payload])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [b.column(k).to_pylist() for k in range(4, 4 + 2 * len(payload))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([meets(*x) for x in zip(*sides, strict=True)], pa.bool_())], names=["_id", "component", "nb", "_hub", "met"])

    # A hot cluster is one key of this join: its hub is one row, and an adaptive plan can split the other side.
    asked = big.join(hub, "component").select("_id", "component", "nb", "_hub", *payload, *[f"_h_{p}" for p in payload])
    asked = materialise(asked.mapInArrow(ask, "_id long, component long, nb int, _hub long, met boolean"), "jaccard-hubs")
    edges = asked.filter("met and _id <> _hub").select(F.col("_id").alias("u"), F.col("_hub").alias("v"))
    rest = asked.filter("not met and _id <> _hub").select("_id", "component")
    count = rest.groupBy("component").agg(F.count("*").alias("_n"))
    tile = F.ceil(F.col("nb") * F.col("_n") / F.col("_k")).cast("int")
    size = asked.groupBy("component").agg(F.count("*").alias("_k"), F.first("nb").alias("nb")).join(count, "component").select("component", F.greatest(tile, F.lit(1)).alias("nu"))
    left = big.join(rest, ["_id", "component"], "left_semi").join(size, "component").select(F.col("component").alias("_g"), F.pmod(F.xxhash64("_id"), F.col("nu")).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("_j"), "_id", "component", F.lit(0).alias("block"), *payload)
    right = big.join(size, "component").select(F.col("component").alias("_g"), F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("_i"), F.col("block").alias("_j"), "_id", "component", F.lit(1).alias("block"), *payload)
    return edges, left.unionByName(right)


def _judged(hold: Callable[[DataFrame], DataFrame], placed: DataFrame, buckets: int, payload: tuple[str, ...], meets: Callable[..., bool], judge: Callable) -> DataFrame:
    """Edges u, v of all clusters; hold(placed) adds the payload; judge sees whole clusters or tiles of two sides."""
    group = lambda df: df.groupBy("_g", "_i", "_j").applyInArrow(judge, "u long, v long")
    alone, several = _alone(hold(placed.filter("nb = 1")), buckets, *payload), placed.filter("nb > 1")
    if several.isEmpty():
        return group(alone)
    edges, tiles = _meetings(materialise(hold(several).select("_id", "component", "nb", "block", *payload), "jaccard-large"), payload, meets)
    return group(alone.unionByName(tiles)).unionByName(edges)


def possible_pairs(size: np.ndarray, sides: np.ndarray, maps: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that sizes and scaled bitmaps allow; pairs of one side are left out unless all sides are equal."""
    level = bitmap_levels(size)
    single = (sides == sides[0]).all()
    left, right = [], []
    for k in np.unique(level).tolist():
        words = 8 << k
        own = np.flatnonzero(level == k)
        near = np.flatnonzero((level >= k) & (level <= k + 2))
        folded = np.empty((len(near), words), np.uint64)
        for r, x in enumerate(near.tolist()):
            m = np.frombuffer(maps[x], np.uint64)
            while len(m) > words:
                m = m[: len(m) // 2] ^ m[len(m) // 2 :]
            folded[r] = m
        mine = folded[np.searchsorted(near, own)]
        step = max(1, (1 << 20) // (len(near) * words))
        for a in range(0, len(own), step):
            i = own[a : a + step, None]
            total = size[i] + size[near][None]
            share = need(percent, size[i], size[near][None])
            ok = (share <= np.minimum(size[i], size[near][None])) & (i != near[None]) & ((level[near][None] > k) | (i < near[None]))
            if not single:
                ok &= sides[i] != sides[near][None]
            x, y = np.nonzero(ok)
            apart = np.bitwise_count(mine[a + x] ^ folded[y]).sum(1) if len(x) * words < 1 << 22 else np.concatenate([np.bitwise_count(mine[a + x[c : c + 4096]] ^ folded[y[c : c + 4096]]).sum(1) for c in range(0, len(x), 4096)])
            good = apart <= total[x, y] - 2 * share[x, y]
            left.append(own[a + x[good]])
            right.append(near[y[good]])
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def refined(sets: DataFrame, clusters: DataFrame, params: JaccardParams) -> DataFrame:
    """Edges u, v of a forest over the pairs within clusters that the scaled bitmaps allow."""
    placed, buckets = _placed(clusters, params)
    def scan(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, component, block, n = (got.column(k).to_numpy() for k in ("_id", "component", "block", "n"))
        maps = got.column("scaled").to_pylist()
        order = np.lexsort((ids, component))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(component[order])) + 1, [len(order)]])
        u, v = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            x, y = possible_pairs(n[at].astype(np.int64), block[at], [maps[k] for k in at], params.percent)
            label = _forest(b - a, x, y)
            other = np.flatnonzero(label != np.arange(b - a))
            u.append(ids[at[other]])
            v.append(ids[at[label[other]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    held = sets.select("_id", "n", "scaled").join(placed, "_id")
    alone = F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j")).cast("struct<g:long,i:int,j:int>"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.col("component").alias("g"), F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")).cast("struct<g:long,i:int,j:int>"))
    side = F.when((F.col("nb") == 1) | (F.col("t.i") == F.col("t.j")), 0).otherwise(F.col("block")).alias("block")
    sent = held.select("*", F.explode(F.when(F.col("nb") == 1, alone).otherwise(tiles)).alias("t")).select(F.col("t.g").alias("_g"), F.col("t.i").alias("_i"), F.col("t.j").alias("_j"), "_id", "component", side, "n", "scaled")
    return sent.groupBy("_g", "_i", "_j").applyInArrow(scan, "u long, v long")


def heavy_links(docs: DataFrame, sets: DataFrame, x: int, params: JaccardParams, id_col: str, text_col: str) -> DataFrame:
    """Edges u, v: a forest of all links in which a set of more than x shingles takes part."""
    reach = sets.filter(F.col("n") > params.percent * x // 100)
    prefix = (F.col("n") - F.ceil(F.col("n") * F.lit(params.percent) / F.lit(100)) + 1).cast("int")
    entries = reach.select("_id", "n", F.explode(F.slice("tokens", F.lit(1), prefix)).alias("_t"))
    counts = entries.groupBy("_t").agg(F.count("*").alias("k"), F.min("_id").alias("m")).filter("k > 1")
    lists = materialise(entries.join(counts, "_t"), "jaccard-lists")
    rows = lists.count()
    short = lists.filter(F.col("k") <= params.long_list).select("_t", "_id", "n").join(reach.select("_id", "bitmap"), "_id")
    short = short.withColumn("_bucket", F.pmod(F.xxhash64("_t"), F.lit(buckets_for(rows, 20 * params.bucket_rows, 8))))
    long = lists.filter((F.col("k") > params.long_list) & (F.col("_id") != F.col("m"))).select(F.col("_id").alias("u"), F.col("m").alias("v"))
    clusters = connected_components(list_clusters(short, params).unionByName(long))
    # Long sets saturate the short bitmaps: clusters are taken apart once more by bitmaps that grow with the set.
    clusters = connected_components(refined(sets, clusters, params))
    placed, buckets = _placed(clusters, params)
    # A representative's own row only: other rows of its class hold the same set.
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, d, r in _pieces(b.column(4), params.lower):
                v, first = K.shingle_sets(K.words_of(d, r), params.n)
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(4)), pa.array([v[first[k] : first[k + 1]].tobytes() for k in range(j - i)], pa.binary())], names=["_id", "component", "nb", "block", "set"])

    def hold(some: DataFrame) -> DataFrame:
        return text.join(some, "_id").select("_id", "component", "nb", "block", "_text").mapInArrow(own_sets, "_id long, component long, nb int, block int, set binary")

    def check(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, component, block = (got.column(k).to_numpy() for k in ("_id", "component", "block"))
        order = np.lexsort((ids, component))
        raw = got.column("set").to_pylist()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(component[order])) + 1, [len(order)]])
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            sets = [np.frombuffer(raw[k], dtype=np.uint64) for k in at]
            first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            out += verify(ids[at], block[at], np.concatenate(sets), first, params.percent)
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def meets(one: bytes, other: bytes) -> bool:
        a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
        return len(np.intersect1d(a, b, assume_unique=True)) >= need(params.percent, len(a), len(b))

    return _judged(hold, placed, buckets, ("set",), meets, check)


def jaccard_components(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row."""
    signed = materialise(signatures(docs, shingle_sketch(docs, params, text_col), params, id_col, text_col), "jaccard-sets")
    some = signed.filter("n > 0 and _id is not null")
    sets = materialise(some.groupBy("k1", "k2", "n").agg(F.min("_id").alias("_id"), F.first("tokens").alias("tokens"), F.first("cost").alias("cost"), F.first("bitmap").alias("bitmap"), F.first("scaled").alias("scaled")), "jaccard-classes")
    x = choose_boundary(sets, params)
    links = light_links(sets, x, params).unionByName(heavy_links(docs, sets, x, params, id_col, text_col))
    # Rows of one id are one node, so an id of several sets ties their classes together.
    same = some.groupBy("_id").agg(F.count_distinct("k1", "k2", "n").alias("k")).filter("k > 1").select("_id")
    tied = some.join(same, "_id").select("_id", "k1", "k2", "n").join(sets.select("k1", "k2", "n", F.col("_id").alias("_rep")), ["k1", "k2", "n"]).select(F.col("_id").alias("u"), F.col("_rep").alias("v"))
    found = connected_components(links.unionByName(tied))
    classes = sets.select("k1", "k2", "n", F.col("_id").alias("node")).join(found, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component"))
    rows = signed.select("_id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left")
    kind = docs.schema[id_col].dataType
    return rows.select(F.col("_id").cast(kind).alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")).cast(kind).alias("component_id"))


def one_of_each(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id; of the rows of one id, all stay or go together."""
    found = jaccard_components(docs, params, id_col, text_col)
    gone = found.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    own = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    left = own.join(gone, F.col(f"_c{docs.columns.index(id_col)}") == F.col("_gone"), "left_anti")
    return left.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
