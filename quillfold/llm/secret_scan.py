"""Secret scan with corpus-wide ownership frequency.

Every whole text is matched against three base patterns (assigned values,
access keys, long hexadecimal runs) and one wider pattern (long mixed tokens).
The hash of every candidate value is counted over the corpus by distinct
repositories and distinct owners. A value that several owners hold is a widely
copied example: ``example_owners`` of them, or ``shared_owners`` over
``example_repositories``. One owner's copies are never an example, however many
repositories hold them. A value of few owners that looks random is taken as live;
an assigned value of few owners is live however short or plain, unless it is a
known placeholder or one repeated character. An empty table gives no rows; very
long texts are scanned whole. Base spans always stay in the result; mixed tokens are added as kind ``owned`` only
when they are live. Values are never output, only spans and counts.

Spans count code points, end exclusive. Null and empty texts have no spans.
Repeated rows each give their own result, and count once for their owner. A
null repository or owner is one unknown party. Input columns other than the
named ones are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# The base patterns, their kinds in order, and the least lengths.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_OWNED = 6, 20, 24, 20
#: Assigned values that stand for one to be filled in; cases and separators don't count.
PLACEHOLDERS = frozenset("changeme changethis changeit placeholder example yourpassword yoursecret yourtoken yourapikey yourkey yourpasswordhere yoursecrethere yourtokenhere yourapikeyhere yourkeyhere insertpasswordhere insertsecrethere inserttokenhere insertapikeyhere redacted undefined".split())
OWNED = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A text that this doesn't match holds no candidate; a linear-time engine runs it over whole batches.
MAY_HOLD = r"(?i:passw|secret|token|api_?key)|[A-Za-z0-9+/_-]{20}"
#: A text that this doesn't match holds nothing live: live values are assigned, or long runs with a digit.
MAY_BE_LIVE = r"(?i:passw|secret|token|api_?key)|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})[A-Za-z+/_-]*[0-9]"
SPAN = "array<struct<start:int,kind:int,end:int>>"
CANDIDATE = "array<struct<hash:binary,start:int,kind:int,end:int,random:boolean>>"


@dataclass(frozen=True)
class SecretParams:
    example_owners: int = 3
    example_repositories: int = 4
    shared_owners: int = 2  # that the repositories of an example must have at least
    min_entropy: float = 3.0


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str, kind: int, least: float) -> bool:
    """Digits beside letters, and no fewer bits per character than least; long mixed tokens also need both cases. Of assigned values all but placeholders: entropy is at most log2(length), so short passwords can't show it."""
    if kind == 0:
        return len(set(value)) > 1 and re.sub("[^a-z0-9]", "", value.lower()) not in PLACEHOLDERS
    digit, lower, upper = (any(a <= ch <= b for ch in value) for a, b in (("0", "9"), ("a", "z"), ("A", "Z")))
    mixed = digit and lower and upper if kind == 3 else digit and (lower or upper)
    return mixed and entropy(value) >= least + (0.5 if kind == 3 else 0)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, str]]]:
    """(base spans (start, kind, end), candidates (start, kind, end, value start, value)) of one text."""
    base, found = [], []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= MIN_ASSIGN:
            base.append((m.start(), 0, m.end()))
            found.append((m.start(), 0, m.end(), m.start(2), m[2]))
    for pattern, kind, least in ((ACCESS, 1, MIN_ACCESS), (HEX, 2, MIN_HEX)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                base.append((m.start(), kind, m.end()))
                found.append((m.start(), kind, m.end(), m.start(), m[0]))
    base.sort()
    # Base spans as sorted stretches that don't meet: one search tells whether a token overlaps any.
    ends: list[int] = []
    starts: list[int] = []
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in OWNED.finditer(text):
        at = bisect_right(ends, m.start())
        if at == len(ends) or starts[at] >= m.end():
            found.append((m.start(), 3, m.end(), m.start(), m[0]))
    return base, found


def candidates(docs: DataFrame, params: SecretParams = SecretParams(), id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row per document: _row, id, _owner, _repo, base spans and hashed candidates."""
    party = lambda names: F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in names])), 256)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), party((owner_col,)).alias("_owner"), party(repo_cols).alias("_repo"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    span_type, candidate_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("hash", pa.binary()), ("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("random", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            spans, cands = [[] for _ in range(n)], [[] for _ in range(n)]
            hit = pc.fill_null(pc.match_substring_regex(b.column(5), MAY_HOLD), False)
            for i in pc.indices_nonzero(hit).to_pylist():
                base, found = find(b.column(5)[i].as_py())
                spans[i] = [{"start": s, "kind": k, "end": e} for s, k, e in base]
                cands[i] = [{"hash": hashlib.sha256(v.encode()).digest()[:16], "start": s, "kind": k, "end": e, "random": looks_random(v, k, params.min_entropy)} for s, k, e, _, v in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(spans, span_type), pa.array(cands, candidate_type)], names=["_row", "_id", "_hash", "_owner", "_repo", "_base", "_found"])

    return rows.mapInArrow(run, f"_row long, _id {kind}, _hash long, _owner string, _repo string, _base {SPAN}, _found {CANDIDATE}")


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners and repositories that hold it, and its occurrences; counted before and after the shuffle."""
    held = found.select(F.explode("_found.hash").alias("hash"), "_owner", "_repo").groupBy("hash", "_owner", "_repo").agg(F.count("*").alias("n"))
    return held.groupBy("hash").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repo").alias("repositories"), F.sum("n").alias("occurrences"))


def _text_of(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, params: SecretParams = SecretParams(), id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row per document: id, _row, base spans, all spans, live spans, and counts of live values and copied examples."""
    found = materialise(candidates(docs, params, id_col, text_col, owner_col, repo_cols), "secrets")
    wide = ownership(found).filter((F.col("owners") >= params.example_owners) | ((F.col("owners") >= params.shared_owners) & (F.col("repositories") >= params.example_repositories))).select("hash", F.lit(True).alias("_wide"))
    each = found.select("_row", F.explode("_found").alias("c")).select("_row", F.col("c.hash").alias("hash"), "c")
    span = F.struct(F.col("c.start"), F.col("c.kind"), F.col("c.end"))
    # A hot value is one key of this join; only the small side is unique, so an adaptive plan can split it.
    judged = each.join(wide, "hash", "left").select("_row", span.alias("s"), F.coalesce("_wide", F.lit(False)).alias("wide"), F.col("c.random").alias("random"))
    per_row = judged.groupBy("_row").agg(
        F.collect_list(F.when(~F.col("wide") & F.col("random"), F.col("s"))).alias("_live"),
        F.sum(F.col("wide").cast("long")).alias("n_examples"),
    )
    rows = found.select("_row", "_id", "_hash", "_base").join(per_row, "_row", "left")
    none = F.array().cast(SPAN)
    live = F.coalesce("_live", none)
    return rows.select(
        F.col("_id").alias(id_col), "_row", "_hash",
        F.coalesce("_base", none).alias("base_spans"),
        F.concat(F.coalesce("_base", none), F.filter(live, lambda s: s["kind"] == 3)).alias("all_spans"),
        live.alias("live_spans"),
        F.size(live).cast("long").alias("n_live"),
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans and the text of all spans."""
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        id_col, *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_text_of(F.col("base_spans")), 256).alias("base_sha256"),
        _text_of(F.col("all_spans")).alias("spans"),
        "n_live", "n_examples",
    )


def redact(docs: DataFrame, params: SecretParams = SecretParams(), mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source",), length_col: str | None = "n_chars") -> DataFrame:
    """docs with every live span replaced by a mark; copied examples stay. The length column, where there is one, follows the text."""
    found = scan(docs, params, id_col, text_col, owner_col, repo_cols).filter("n_live > 0")
    # Rows of one id and text have the same spans, so one of them stands for all.
    live = found.groupBy(F.col(id_col).alias("_id"), "_hash").agg(F.first("live_spans").alias("_live"))
    own = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    at = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    # Only rows that can hold something live meet the join; the rest keep their text where it lies.
    may = F.coalesce(F.col(at[text_col]).rlike(MAY_BE_LIVE), F.lit(False))
    untouched = own.filter(~may).select(*[F.col(at[c]).alias(c) for c in docs.columns])
    rows = own.filter(may).join(live, F.col(at[id_col]).eqNullSafe(F.col("_id")) & (F.xxhash64(at[text_col]) == F.col("_hash")), "left")

    def joined(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        meets = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    pair = F.transform(F.array_sort("_live"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spans = F.aggregate(pair, F.array().cast("array<struct<start:int,end:int>>"), joined)
    # Cut from the back, so that earlier positions stay true.
    cut = lambda text, s: F.concat(F.substr(text, F.lit(1), s["start"]), F.lit(mark), F.substr(text, s["end"] + 1))
    text = F.aggregate(F.reverse(spans), F.col(at[text_col]), cut)
    marked = F.col("_live").isNotNull()
    new = {text_col: F.when(marked, text).otherwise(F.col(at[text_col]))}
    rows = rows.withColumn("_text", new[text_col])
    out = {c: F.col(at[c]) for c in docs.columns} | {text_col: F.col("_text")}
    if length_col in docs.columns:
        out[length_col] = F.when(marked, F.length("_text").cast(docs.schema[length_col].dataType)).otherwise(F.col(at[length_col]))
    return rows.select(*[x.alias(c) for c, x in out.items()]).unionByName(untouched)
