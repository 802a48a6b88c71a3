"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens raised to an exponent, normalised.
Exponent 1 keeps the natural shares, 0 makes all sources equal. The exponent
is bisected between 0 and 1 (in sections of a grid, each round one aggregate
over the source totals) until the weights' entropy meets the target: the
natural shares' entropy plus ``entropy_gain`` of what it lacks of the greatest,
the logarithm of the number of sources (or ``target_entropy`` of the greatest,
if given). If some source would then be repeated more often than
``max_repeats``, the exponent rises to where the limit holds.

The token budget times its weight is a source's quota. Each source is dealt
into blocks by a hash of the document id; every epoch permutes the blocks
anew. Whole epochs are taken while the quota lasts; in the last epoch blocks
are taken in order, and in the block where the quota ends, the documents with
the smallest hashes while they fit. So a quota is missed by less than one
document. ``position`` is where a copy's block begins within its source's
quota, from 0 to 1; in order of position, any prefix holds the sources near
their weights.

Tokens are words plus one per document, so null and empty texts count one. A
null source is a source of its own. Repeated rows are dealt like others; rows
of one id share their block and their hash. An empty table gives no rows; very
long texts count all their words. ``mix_documents`` keeps all columns of the
table, whatever their names; ``mix`` ignores those not named.
Totals, blocks and cuts are aggregates; no source is gathered in one task: a
source has at most ``max_blocks`` blocks, and only one block of it is sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, materialise


@dataclass(frozen=True)
class MixingParams:
    entropy_gain: float = 0.5
    target_entropy: float | None = None  # a share of the greatest entropy, in place of a gain
    max_repeats: float = 4.0
    budget_tokens: int | None = None  # the tokens there are, if None
    keep_all: bool = False  # take as the budget what holds every document at least once
    block_tokens: int = 1 << 18
    max_blocks: int = 1 << 16
    seed: int = 17
    grid: int = 33
    rounds: int = 4


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def token_count(text: Column) -> Column:
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")) + 1).cast("long")


def _at_exponents(totals: DataFrame, n: float, exponents: list[float], params: MixingParams) -> list[tuple[float, float, float]]:
    """(entropy, budget, repetitions of the smallest source) at each exponent: one row reaches the driver."""
    share = F.col("tokens") / F.lit(float(n))
    row = totals.agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"), *[F.sum(F.pow(share, F.lit(a))).alias(f"z{k}") for k, a in enumerate(exponents)], *[F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"d{k}") for k, a in enumerate(exponents)]).first()
    out = []
    for k, a in enumerate(exponents):
        z = row[f"z{k}"]
        budget = float(n * z * (row["most"] / n) ** (1 - a) if params.keep_all else params.budget_tokens or n)
        out.append((math.log(z) - a * row[f"d{k}"] / z, budget, budget * (row["least"] / n) ** a / z / row["least"]))
    return out


def choose_exponent(totals: DataFrame, params: MixingParams = MixingParams()) -> tuple[float, float, float, float]:
    """(exponent, sum of powered shares, tokens, budget): the smallest change from the natural shares that meets the target, within the limit."""
    whole = totals.agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).first()
    n, k = float(whole["n"] or 0), whole["k"]
    if not k:
        return 1.0, 1.0, 0.0, 0.0
    most = math.log(k)
    natural = _at_exponents(totals, n, [1.0], params)[0][0]
    target = natural + params.entropy_gain * max(0.0, most - natural) if params.target_entropy is None else params.target_entropy * most
    low, high = 0.0, 1.0

    # Entropy falls and the limit loosens as the exponent rises: the answer is the largest exponent that meets the target, or the smallest within the limit if that is larger.
    def narrowed(holds, low: float, high: float) -> tuple[float, float]:
        for _ in range(params.rounds):
            grid = [low + (high - low) * i / (params.grid - 1) for i in range(params.grid)]
            met = [holds(e, r) for e, _, r in _at_exponents(totals, n, grid, params)]
            last = max((i for i, ok in enumerate(met) if ok), default=0)
            low, high = grid[last], grid[min(last + 1, params.grid - 1)]
        return low, high

    exponent = narrowed(lambda e, r: e >= target - 1e-12, low, high)[0]
    if _at_exponents(totals, n, [exponent], params)[0][2] > params.max_repeats:
        exponent = narrowed(lambda e, r: r > params.max_repeats, exponent, high)[1]
    budget = _at_exponents(totals, n, [exponent], params)[0][1]
    z = totals.agg(F.sum(F.pow(F.col("tokens") / F.lit(n), F.lit(exponent))).alias("z")).first()["z"]
    return exponent, z, n, budget


def plan_blocks(rows: DataFrame, params: MixingParams = MixingParams()) -> tuple[DataFrame, DataFrame]:
    """(sources with weight and quota; blocks of every epoch with rank, position and cut). rows: _s, _h, _n."""
    totals = materialise(rows.groupBy("_s").agg(F.sum("_n").alias("tokens"), F.count("*").alias("documents")), "mixing-sources")
    exponent, z, n, budget = choose_exponent(totals, params)
    weight = F.pow(F.col("tokens") / F.lit(n or 1.0), F.lit(exponent)) / F.lit(z)
    sources = totals.select("_s", "tokens", "documents", weight.alias("weight"), quota_of(weight * budget, F.col("tokens"), params).alias("quota"))
    sources = sources.withColumn("blocks", F.least(F.ceil(F.col("tokens") / params.block_tokens), F.lit(params.max_blocks)).cast("long")).withColumn("epochs", F.floor(F.col("quota") / F.col("tokens") + 1e-9).cast("int"))
    dealt = rows.join(sources.select("_s", "blocks"), "_s").withColumn("_block", block_of(F.col("_h"), F.col("blocks")))
    sizes = materialise(dealt.groupBy("_s", "_block").agg(F.sum("_n").alias("size")), "mixing-blocks")
    each = sizes.join(sources, "_s").select("*", F.explode(F.sequence(F.lit(0), F.col("epochs"))).alias("epoch"))
    order = W.partitionBy("_s", "epoch").orderBy(F.xxhash64(F.lit(params.seed), "_s", "epoch", "_block"), "_block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.select("_s", "_block", "epoch", "epochs", "tokens", "quota", "size", F.row_number().over(order).alias("block_rank"), (F.col("epoch").cast("long") * F.col("tokens") + before).alias("_from"))
    each = each.filter(F.col("_from") < F.col("quota"))
    # The block in which the quota ends: its documents are sorted by hash and cut.
    edge = each.filter(F.col("_from") + F.col("size") > F.col("quota") + 1e-6).select("_s", "_block", (F.col("quota") - F.col("_from")).alias("room"))
    in_edge = dealt.select("_s", "_block", "_h", "_n").join(edge, ["_s", "_block"])
    filled = F.sum("_n").over(W.partitionBy("_s", "_block").orderBy("_h"))
    cuts = in_edge.withColumn("_filled", filled).filter(F.col("_filled") <= F.col("room") + 1e-6).groupBy("_s", "_block").agg(F.max("_h").alias("cut"))
    ends = F.col("_from") + F.col("size") > F.col("quota") + 1e-6
    blocks = each.join(cuts, ["_s", "_block"], "left").filter(~ends | F.col("cut").isNotNull())
    return sources, blocks.select("_s", "_block", "epoch", "block_rank", (F.col("_from") / F.col("quota")).alias("position"), F.when(ends, F.col("cut")).alias("cut"))


def quota_of(due: Column, tokens: Column, params: MixingParams) -> Column:
    """The tokens due to a source; with keep_all never fewer than it has, however the powers are rounded."""
    return F.greatest(due, tokens.cast("double")) if params.keep_all else due


def block_of(h: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(h), blocks)


def _keys(docs: DataFrame, source_col: str, id_col: str, params: MixingParams) -> tuple[Column, Column]:
    return source_key(F.col(source_col)), F.xxhash64(F.lit(params.seed), F.col(id_col))


def mix(docs: DataFrame, params: MixingParams = MixingParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per copy taken: id, source, tokens, weight, epoch, block_rank and position."""
    s, h = _keys(docs, source_col, id_col, params)
    rows = materialise(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), s.alias("_s"), h.alias("_h"), token_count(F.col(text_col)).alias("_n")), "mixing-rows")
    sources, blocks = plan_blocks(rows.select("_s", "_h", "_n"), params)
    dealt = rows.join(sources.select("_s", "blocks", "weight"), "_s").withColumn("_block", block_of(F.col("_h"), F.col("blocks")))
    taken = dealt.join(blocks, ["_s", "_block"]).filter(F.col("cut").isNull() | (F.col("_h") <= F.col("cut")))
    return taken.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_n").alias("n_tokens"), "weight", "epoch", "block_rank", "position")


def mix_documents(docs: DataFrame, params: MixingParams = MixingParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture with the columns of docs: documents left out go, repeated ones come once per copy."""
    own = [F.col(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)]
    s, h = _keys(docs, source_col, id_col, params)
    rows = materialise(docs.select(s.alias("_s"), h.alias("_h"), token_count(F.col(text_col)).alias("_n")), "mixing-rows")
    sources, blocks = plan_blocks(rows, params)
    dealt = docs.select(*own, s.alias("_s"), h.alias("_h")).join(sources.select("_s", "blocks"), "_s").withColumn("_block", block_of(F.col("_h"), F.col("blocks")))
    taken = dealt.join(blocks, ["_s", "_block"]).filter(F.col("cut").isNull() | (F.col("_h") <= F.col("cut")))
    return taken.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
