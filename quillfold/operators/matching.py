"""Scored candidates: similarity, coverage, best candidate and its margin."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.text import ADDRESS_ALIASES


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts; not symmetric, so the order of the two matters."""
    one = difflib.SequenceMatcher
    return pd.Series([None if x is None or y is None else one(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 -"
#: From this length on the similarity may pass over frequent letters, so common ends promise nothing.
LONG = 200


def letter_counts(c: Column) -> Column:
    """How often each of LETTERS occurs, and last how many characters are none of them."""
    each = F.transform(F.array(*[F.lit(x) for x in LETTERS]), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))
    return F.concat(each, F.array(F.length(F.translate(c, LETTERS, ""))))


def ratio_bounds(a: Column, b: Column, counts_a: Column, counts_b: Column) -> tuple[Column, Column]:
    """(least, greatest) that the similarity of two texts can be, without comparing them: letters in common from above, a common beginning or end from below.

    counts: of letter_counts. Characters beyond LETTERS count as if all were in common.
    """
    total = F.length(a) + F.length(b)
    common = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    short = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(k) for k in (64, 32, 16, 8, 4, 2, 1)])

    def shared(part: Callable[[Column, Column], Column]) -> Column:
        """Length of the common beginning or end, up to 127, by halving: a part that agrees stays."""
        return F.aggregate(steps, F.lit(0), lambda s, k: F.when((s + k <= short) & (part(a, s + k) == part(b, s + k)), s + k).otherwise(s))

    ends = F.greatest(shared(lambda c, k: F.substring(c, F.lit(1), k)), shared(lambda c, k: F.substring(c, -k, k)))
    low = F.when(F.length(b) < LONG, F.when(a == b, F.length(a)).otherwise(ends)).otherwise(0)
    whole = F.when(total == 0, F.lit(1.0))
    return whole.otherwise(2.0 * low / total), whole.otherwise(2.0 * F.least(common, short) / total)


@F.pandas_udf(StringType())
def canonical_address(text: pd.Series) -> pd.Series:
    """ASCII words of an address, common short forms written out."""

    def canon(x: str | None) -> str | None:
        if x is None:
            return None
        plain = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()
        plain = re.sub(r"\bc\s*/\s*o\b", "care of", plain, flags=re.IGNORECASE).replace("&", " and ").lower()
        return " ".join(ADDRESS_ALIASES.get(w, w) for w in re.findall("[a-z0-9]+", plain))

    return text.map(canon)


@F.pandas_udf(StringType())
def compatible_text(text: pd.Series) -> pd.Series:
    """Unicode compatibility form."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))


def coverage(source: Column, candidate: Column) -> Column:
    """Share of the source's words that the candidate has; null for a source without words."""
    s = words(source)
    return F.size(F.array_intersect(s, words(candidate))) / F.nullif(F.size(s), F.lit(0))


def covered_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, other, coverage of all pairs of rows that share a word: counts of shared words by an equi-join on them, over the row's own number of words."""
    each = df.select(key, words(F.col(text)).alias("_w")).select(key, F.size("_w").alias("_n"), F.explode("_w").alias("word"))
    other = each.select(F.col(key).alias("other"), "word")
    shared = each.join(other, "word").filter(F.col(key) != F.col("other")).groupBy(key, "other", "_n").agg(F.count("*").alias("_k"))
    return shared.select(key, "other", (F.col("_k") / F.col("_n")).alias("coverage"))


def address_score(source: Column, candidate: Column, ratio: Column, town_fits: Column) -> Column:
    """1 for the same text, 0.99 for all of at least two words, else weighted coverage and similarity."""
    c = F.coalesce(coverage(source, candidate), F.lit(0.0))
    return F.when((source == candidate) & town_fits, 1.0).when((c == 1.0) & (F.size(words(source)) >= 2) & town_fits, 0.99).otherwise(F.round(0.7 * c + 0.3 * ratio, 4))


@functools.lru_cache(1 << 17)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _points(x: float) -> int:
    """Ten thousandths, rounded as Spark rounds."""
    return int(Decimal(repr(x)).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))


def best_pairs(asked: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of every address of a block, ties to the first position, each with its best reading's address_score.

    asked: postcode, _source, _town; candidates: position, _t (readings). Words in common
    and a bound of the similarity by letters are counted for all pairs at once; texts are
    compared from the greatest bound on, until no other candidate can be among the k best.
    """
    readings: dict[int, set[str]] = {}
    for at, ts in zip(candidates["position"], candidates["_t"], strict=True):
        readings.setdefault(int(at), set()).update(ts)
    positions = sorted(readings)
    texts = [t for p in positions for t in sorted(readings[p])]
    starts = np.cumsum([0, *[len(readings[p]) for p in positions]])
    letters = sorted({x for s in asked["_source"] for x in s})
    counts_t = np.array([[t.count(x) for x in letters] for t in texts], np.int16)
    long_t = np.array([len(t) for t in texts])
    vocabulary = {w: j for j, w in enumerate(sorted({w for s in asked["_source"] for w in s.split()}))}
    held = np.zeros((len(vocabulary), len(texts)), np.float32)
    for j, t in enumerate(texts):
        held[[vocabulary[w] for w in set(t.split()) if w in vocabulary], j] = 1
    fits = {town: np.array([town in t for t in texts]) for town in set(asked["_town"])}
    post, sources, towns = asked["postcode"].iloc[:1].tolist(), asked["_source"].tolist(), asked["_town"].tolist()
    out = []
    for at in range(0, len(sources), 64):
        some = sources[at : at + 64]
        common = np.zeros((len(some), len(texts)), np.int16)
        for j, x in enumerate(letters):
            common += np.minimum.outer(np.array([s.count(x) for s in some], np.int16), counts_t[:, j])
        asked_words = np.zeros((len(some), len(vocabulary)), np.float32)
        for i, s in enumerate(some):
            asked_words[i, [vocabulary[w] for w in set(s.split())]] = 1
        shared = asked_words @ held
        for i, (source, town) in enumerate(zip(some, towns[at : at + 64], strict=True)):
            n = int(asked_words[i].sum())
            cover = shared[i].astype(np.float64) / n if n else np.zeros(len(texts))
            total = len(source) + long_t
            high = np.where(total == 0, 1.0, 2.0 * np.minimum(common[i], np.minimum(len(source), long_t)) / np.maximum(total, 1))
            # Never below the rounded score; what the rules decide is known.
            bound = np.floor((0.7 * cover + 0.3 * high) * 10000 + 0.5 + 1e-6).astype(np.int64)
            fit = fits[town]
            sure = fit & (cover == 1.0) & (n >= 2)
            bound[sure] = 9900
            for j in np.nonzero(fit & (common[i] == len(source)) & (long_t == len(source)))[0]:
                if texts[j] == source:
                    bound[j], sure[j] = 10000, True
            most = np.maximum.reduceat(bound, starts[:-1])
            best: list[tuple[int, int]] = []
            for c in np.argsort(-most, kind="stable"):
                if len(best) == k and (-int(most[c]), positions[c]) > best[-1]:
                    break
                score = -1
                for j in range(starts[c], starts[c + 1]):
                    if bound[j] > score:
                        score = max(score, int(bound[j]) if sure[j] else _points(0.7 * float(cover[j]) + 0.3 * _ratio(source, texts[j])))
                best = sorted([*best, (-score, positions[c])])[:k]
            out += [(*post, source, town, p, -s / 10000) for s, p in best]
    return pd.DataFrame(out, columns=["postcode", "_source", "_town", "position", "score"])


def best_with_margin(scored: DataFrame, keys: list[str], score: str, tie: list[Column], threshold: float, margin: float) -> DataFrame:
    """The best candidate of every key with its margin over the runner-up, and whether both suffice.

    A single candidate's margin is its score. Only the two best of a key pass the rank limit.
    """
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    two = scored.withColumn("_rank", F.row_number().over(w)).filter("_rank <= 2")
    led = two.withColumn("_next", F.lead(score).over(w)).filter("_rank = 1")
    alone = F.col("_next").isNull()
    gap = F.round(F.col(score) - F.coalesce("_next", F.lit(0.0)), 4)
    return led.withColumn("margin", gap).withColumn("accepted", (F.col(score) >= threshold) & (alone | (gap >= margin))).drop("_rank", "_next")


def top_candidates(scored: DataFrame, keys: list[str], score: str, tie: list[Column], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
