"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and line ends, and pieces into
overlapping chunks: a chunk ends where a phrase of ``words - 1`` words hashes to
a trigger, and the next one begins with that phrase. The distinct chunks of each
language form a dictionary with parse frequencies; it is a table bucketed by
shard, and everything after it works on distinct chunks weighted by their
frequency. Phrases that start in the overlap belong to the next chunk alone, so
each occurrence is counted once; the last chunk of a piece owns all its phrases.

A shard counts its phrases by hash and sends sorted hashes with their weights to
the bucket of the hash. A bucket adds them up and answers each shard which of
its hashes reach the least count; only for those does the shard spell the
phrases out. Hashes only bring phrases together for that sieve, which lets too
much through at worst: the counts that decide are those of the phrases
themselves. Whole words that no candidate needs never leave their shard as text.

Scores are exact: products are decimals, quotients are whole numbers.

Null texts are empty, and a null language is ``und``. Empty texts and pieces add
nothing; an empty table, or one without frequent phrases, gives no rows. Very
long texts and words are read whole, repeated rows count each for themselves.
Ties are broken by count, then by the phrase's bytes, so ranks are unique. A
phrase that a third of all rows hold is a row of the dictionary with a large
weight. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import shared_folder
from . import kernels as K
from .common import buckets_for, materialise
from .superkmer import loose, tight

# Bytes that end a piece, and bytes that separate words within one.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = PIECE_END.copy()
GAP[[0x20, 0x09]] = True

PACK_BYTES = 16 << 20


@dataclass(frozen=True)
class CollocationParams:
    words: int = 3  # longest phrase
    least: int = 10  # least count of a candidate
    top: int = 2000  # rows of a language
    inside_percent: int = 50  # a phrase is dropped if a longer one has so much of its count
    every: int = 8  # one phrase in so many is a trigger
    shard_bytes: int = 6 << 20


def _chunks(data: np.ndarray, rows: np.ndarray, lang: np.ndarray, p: CollocationParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, offsets, hash, row, whether it is the last of its piece) of every chunk; lang: a hash for each row."""
    data = K.LOWER[data]
    w = K.words_of(data, rows, GAP)
    n, keep = len(w.starts), p.words - 1
    if not n:
        return data[:0], np.zeros(1, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    h = w.hashes()
    ends = np.concatenate([[0], np.cumsum(PIECE_END[data])])[w.starts]
    row = np.searchsorted(w.first, np.arange(n), side="right") - 1
    begins = np.ones(n, bool)
    begins[1:] = (ends[1:] != ends[:-1]) | (row[1:] != row[:-1])
    piece = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    trigger = np.zeros(n, bool)
    trigger[keep - 1 :] = K.gram_hashes(h, keep) % np.uint64(p.every) == 0
    # A chunk owns at least one word's phrases, and the piece goes on after it.
    trigger &= np.arange(n) - piece >= keep
    trigger[:-1] &= ~begins[1:]
    trigger[-1] = False
    start = np.sort(np.concatenate([np.flatnonzero(begins), np.flatnonzero(trigger) - keep + 1]))
    last = np.ones(len(start), bool)
    last[:-1] = begins[start[1:]]
    stop = np.where(last, np.append(start[1:], n), 0)
    stop[~last] = start[1:][~last[:-1]] + keep
    counts = stop - start
    at = K.ranges(start, counts)
    place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    mixed = K.mix(h[at] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019))
    key = K.mix(np.add.reduceat(mixed, np.cumsum(counts) - counts) + lang[row[start]] + last.astype(np.uint64))
    length = w.ends[at] - w.starts[at] + 1
    text = np.append(data, np.uint8(0x20))[K.ranges(w.starts[at], length)]
    text[np.cumsum(length) - 1] = 0x20
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(length, np.cumsum(counts) - counts))])
    return text, offsets, key, row[start], last


def _grouped(key: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, which entries begin a group): entries of a group have the same key, extra and bytes."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero((key[a] == key[b]) & (extra[a] == extra[b]) & (ends[a] - starts[a] == ends[b] - starts[b]))
    new[1:][alike] = ~K.equal_spans(data, starts[a[alike]], starts[b[alike]], ends[a[alike]] - starts[a[alike]])
    return order, new


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tobytes()), pa.py_buffer(data[K.ranges(starts, lengths)].tobytes())).cast(pa.string())


def _lang_hashes(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The languages and a hash of each row's."""
    coded = column.dictionary_encode()
    names = [x.encode() for x in coded.dictionary.to_pylist()]
    data, at = np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)
    return coded, K.span_hashes(data, at[:-1], at[1:], 7)[coded.indices.to_numpy(zero_copy_only=False)]


def dictionary(docs: DataFrame, p: CollocationParams, text_col: str, lang_col: str) -> tuple[DataFrame, int]:
    """The distinct chunks with their parse frequency, bucketed by shard, and the number of shards."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    shards = buckets_for(size, p.shard_bytes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            text = np.concatenate([x[0] for x in held])
            base = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])
            starts = np.concatenate([x[1][:-1] + b for x, b in zip(held, base[:-1], strict=True)])
            ends = np.concatenate([x[1][1:] + b for x, b in zip(held, base[:-1], strict=True)]) - 1
            key, last = np.concatenate([x[2] for x in held]), np.concatenate([x[4] for x in held])
            langs = pa.concat_arrays([x[3] for x in held])
            codes = langs.dictionary_encode()
            number = codes.indices.to_numpy(zero_copy_only=False)
            order, new = _grouped(key, text, starts, ends, 2 * number + last)
            begin = np.flatnonzero(new)
            one = order[begin]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array((key[one] % np.uint64(shards)).astype(np.int32)), langs.take(pa.array(one)), pa.array(last[one]), _strings(text, starts[one], ends[one]), pa.array(np.diff(np.append(begin, len(order))))],
                names=["shard", "lang", "last", "chunk", "freq"],
            )

        for batch in batches:
            coded, hashes = _lang_hashes(batch.column(1))
            data, rows = K.buffer_of(batch.column(0))
            for lo, hi, part, offsets in K.pieces(data, rows):
                text, at, key, row, last = _chunks(part, offsets, hashes[lo:hi], p)
                if len(key):
                    held.append((text, at, key, coded.dictionary.take(coded.indices.take(pa.array(row + lo))), last))
                if sum(len(x[0]) for x in held) >= PACK_BYTES:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang")).filter("_text is not null")
    parsed = rows.mapInArrow(parse, "shard int, lang string, last boolean, chunk string, freq long")
    # The rows of a key are few by now (one from each pack), so they are dealt first and added up where they meet.
    merged = parsed.repartition(shards, "shard").groupBy("shard", "lang", "last", "chunk").agg(F.sum("freq").alias("freq"))
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    merged.write.bucketBy(shards, "shard").option("path", path).format("parquet").saveAsTable(name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.table(name), shards


@dataclass
class Phrases:
    """The phrases that a shard's chunks own: hash, weight and, if asked for, first and last byte and language."""

    data: np.ndarray
    hash: np.ndarray
    weight: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None
    lang: np.ndarray | None
    n_words: np.ndarray | None
    languages: list[str]
    totals: np.ndarray  # owned words of each language


def phrases_of(chunks: pa.Table, p: CollocationParams, spans: bool) -> Phrases:
    chunks = chunks.combine_chunks()
    coded, lang_hash = _lang_hashes(chunks.column("lang").chunk(0))
    code = coded.indices.to_numpy(zero_copy_only=False)
    data, rows = K.buffer_of(chunks.column("chunk"))
    freq, last = chunks.column("freq").to_numpy(), chunks.column("last").to_numpy(zero_copy_only=False).astype(bool)
    w = K.words_of(data, rows, GAP)
    h = w.hashes()
    stop = w.first[1:] - np.where(last, 0, p.words - 1)
    owned = K.ranges(w.first[:-1], stop - w.first[:-1])
    row = np.repeat(np.arange(len(freq)), stop - w.first[:-1])
    fits = [owned + n <= w.first[row + 1] for n in range(1, p.words + 1)]
    joined = lambda f: np.concatenate([f(n + 1, owned[x], row[x]) for n, x in enumerate(fits)])
    hashes = joined(lambda n, at, r: K.mix(K.gram_hashes(h, n)[at] + lang_hash[r] + np.uint64(n)))
    weight = joined(lambda n, at, r: freq[r])
    totals = np.bincount(code[row], freq[row], len(coded.dictionary)).astype(np.int64)
    if not spans:
        return Phrases(data, hashes, weight, None, None, None, None, [], totals)
    return Phrases(
        data, hashes, weight, joined(lambda n, at, r: w.starts[at].astype(np.int32)), joined(lambda n, at, r: w.ends[at + n - 1].astype(np.int32)),
        joined(lambda n, at, r: code[r].astype(np.int32)), joined(lambda n, at, r: np.full(len(at), n, np.int8)), coded.dictionary.to_pylist(), totals,
    )


def _sieve_keys(x: Phrases, buckets: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the phrases by short hash, which begin a new one, the short hashes, the first of each bucket): a bucket is a range of hashes, short ones keep the high bits."""
    short = x.hash >> np.uint64(low)
    order = np.argsort(short, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = short[order][1:] != short[order][:-1]
    keys = short[order][new]
    edges = np.array([-(-(b << 64) // buckets) >> low for b in range(1, buckets)], np.uint64)
    return order, new, keys, np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def phrase_counts(docs: DataFrame, p: CollocationParams = CollocationParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, n_words, phrase and a of every phrase of up to ``words`` words that occurs ``least`` times or more, and one row of n_words 0 with all words of each language."""
    chunks, shards = dictionary(docs, p, text_col, lang_col)
    # Short hashes: 12 bits beyond what tells all phrases apart; a shared one lets a rare phrase through to the exact count.
    low = max(0, 64 - 12 - int(np.ceil(np.log2(max(2, shards * p.shard_bytes)))))

    def count(table: pa.Table) -> pa.Table:
        x = phrases_of(table, p, False)
        order, new, keys, cuts = _sieve_keys(x, shards, low)
        weights = np.add.reduceat(x.weight[order], np.flatnonzero(new)) if len(keys) else np.empty(0, np.int64)
        shard = table.column("shard")[0].as_py()
        some = np.flatnonzero(np.diff(cuts)).tolist()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        packed = [squeeze(tight(np.diff(keys[a:b].astype(np.int64), prepend=0), weights[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if a < b]
        return pa.table([pa.array(some, pa.int32()), pa.array([shard] * len(some), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "shard", "sums"])

    def sift(table: pa.Table) -> pa.Table:
        """Which hashes of each shard reach the least count, as bits."""
        open_ = zstandard.ZstdDecompressor().decompress
        parts = [loose(open_(x)) for x in table.column("sums").to_pylist()]
        key = np.concatenate([np.cumsum(x[0]) for x in parts])
        weight = np.concatenate([x[1] for x in parts])
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        enough = np.add.reduceat(weight[order], np.flatnonzero(new)) >= p.least
        said = np.empty(len(key), bool)
        said[order] = enough[np.cumsum(new) - 1]
        cuts = np.cumsum([0, *(len(x[0]) for x in parts)])
        return pa.table([table.column("shard"), table.column("bucket"), pa.array([np.packbits(said[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["shard", "bucket", "bits"])

    def spell(table: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())])
        if not table.num_rows:
            return schema.empty_table()
        x = phrases_of(table, p, True)
        order, new, _, cuts = _sieve_keys(x, shards, low)
        bits = dict(zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist(), strict=True))
        enough = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(n)) for b, n in enumerate(np.diff(cuts).tolist()) if n] or [np.empty(0, np.uint8)]).astype(bool)
        take = order[enough[np.cumsum(new) - 1]] if len(order) else order
        by, fresh = _grouped(x.hash[take], x.data, x.starts[take], x.ends[take], x.lang[take])
        begin = np.flatnonzero(fresh)
        one = take[by[begin]]
        sums = np.add.reduceat(x.weight[take][by], begin) if len(begin) else np.empty(0, np.int64)
        names = pa.array(x.languages, pa.string())
        found = pa.table([names.take(pa.array(x.lang[one])), pa.array(x.n_words[one].astype(np.int32)), _strings(x.data, x.starts[one], x.ends[one]), pa.array(sums)], schema=schema)
        return pa.concat_tables([found, pa.table([names, pa.array([0] * len(names), pa.int32()), pa.array([""] * len(names), pa.string()), pa.array(x.totals)], schema=schema)])

    sums = chunks.groupBy("shard").applyInArrow(count, "bucket int, shard int, sums binary")
    told = sums.repartition(shards, "bucket").groupBy("bucket").applyInArrow(sift, "shard int, bucket int, bits binary")
    spelt = chunks.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(spell, "lang string, n_words int, phrase string, a long")
    return spelt.groupBy("lang", "n_words", "phrase").agg(F.sum("a").alias("a")).filter((F.col("a") >= p.least) | (F.col("n_words") == 0))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a^2 / (l r)) in whole numbers, for counts below 10^15."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, p: CollocationParams = CollocationParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = materialise(phrase_counts(docs, p, text_col, lang_col), "phrases")
    words = F.split("phrase", " ")
    cut = lambda k, size: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, size), " ").alias("right"))
    candidates = counts.filter("n_words > 1")
    cuts = candidates.select("lang", "phrase", "n_words", "a", F.explode(F.filter(F.array(*[cut(k, p.words) for k in range(1, p.words)]), lambda c: c["k"] < F.col("n_words"))).alias("c"))
    # A part is as frequent as the phrase at least, so its count is known; both parts of a cut are looked up in one join.
    parts = cuts.select("lang", "phrase", "n_words", "a", "c.k", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("c.left").alias("part")), F.struct(F.lit("r").alias("side"), F.col("c.right").alias("part")))).alias("x"))
    known = counts.filter("n_words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("b"))
    parts = parts.select("lang", "phrase", "n_words", "a", "k", "x.side", "x.part").join(known, ["lang", "part"])
    sides = parts.groupBy("lang", "phrase", "n_words", "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("b"))).alias(s) for s in ("l", "r")])
    scored = sides.withColumn("score", score("a", "l", "r")).groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # Every shorter phrase inside a candidate, with the count of the most frequent candidate that holds it.
    within = lambda n: F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    inner = [candidates.filter(F.col("n_words") > n).select("lang", F.explode(within(n)).alias("phrase"), F.col("a").alias("longer")) for n in range(2, p.words)]
    for more in inner[1:]:
        inner[0] = inner[0].unionByName(more)
    if inner:
        held = inner[0].groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(held, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {p.inside_percent} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = scored.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    # Spark keeps the best rows of each partition before they meet (a limit inside the window).
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= p.top)
    totals = counts.filter("n_words = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
