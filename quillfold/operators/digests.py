"""Digest trees: what differs between two large keyed tables, without joining them.

Rows fall into leaves by a hash of their key; a leaf's digest is the number of
its rows and two order-free sums of row hashes. A node is the sum of ``fanout``
children. A snapshot is stored with its tree: rows by branch and leaf, and one
small table of nodes. Two trees are compared from the root down, children only
below nodes that differ, and then only the rows of leaves that differ are read
and joined; a branch without such leaves isn't opened.

Two leaves are told apart by 128 bits of sums and their counts. Null keys are keys of
their own, repeated rows count, and the order of rows means nothing. A table
without rows is a tree without nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored


@dataclass(frozen=True)
class TreeParams:
    fanout: int = 32
    depth: int = 3  # levels below the root: 32,768 leaves
    most_broadcast: int = 200_000  # leaves; beyond that they are joined by shuffle

    @property
    def leaves(self) -> int:
        return self.fanout**self.depth


@dataclass
class Snapshot:
    """A stored table (columns, leaf, branch), its tree (level, node, n, total, mixed) and the names of its keys."""

    rows: DataFrame
    tree: DataFrame
    keys: list[str]
    params: TreeParams


def node_digests(df: DataFrame, leaf: Column, values: list[str], p: TreeParams) -> DataFrame:
    """One row a node of every level: leaves are summed before the shuffle, upper levels from the leaves."""
    one, other = F.xxhash64(*values).cast("decimal(20,0)"), F.xxhash64(F.lit(1), *[F.struct(v) for v in values])
    low = df.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.sum(one).alias("total"), F.bit_xor(other).alias("mixed"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("leaf") / p.fanout ** (p.depth - k)).alias("node")) for k in range(p.depth + 1)])).alias("at")
    return low.select("n", "total", "mixed", levels).groupBy("at.level", "at.node").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mixed").alias("mixed"))


def snapshot(df: DataFrame, keys: list[str], p: TreeParams = TreeParams(), what: str = "snapshot") -> Snapshot:
    """df stored by branch and leaf, with its tree; all columns count as values."""
    leaf = F.pmod(F.xxhash64(*keys), F.lit(p.leaves))
    placed = df.withColumn("leaf", leaf).withColumn("branch", F.floor(F.col("leaf") / p.fanout ** (p.depth - 1)).cast("int"))
    # A branch that holds a hot key is split over several tasks; files are found by branch, row groups by leaf.
    rows = stored(placed.hint("rebalance", F.col("branch")).sortWithinPartitions("branch", "leaf"), what, ["branch"])
    return Snapshot(rows, stored(node_digests(rows, F.col("leaf"), df.columns, p), f"{what}-tree"), keys, p)


def differing_leaves(a: Snapshot, b: Snapshot) -> DataFrame:
    """branch and leaf of every leaf whose digests differ; each level is read below the nodes that differ only."""
    p, open_ = a.params, None
    if p != b.params:
        raise ValueError("the trees are of different shapes")
    for level in range(p.depth + 1):
        sides = [s.tree.filter(F.col("level") == level).select("node", F.struct("n", "total", "mixed").alias(name)) for s, name in ((a, "x"), (b, "y"))]
        if open_ is not None:
            sides = [s.withColumn("up", F.floor(F.col("node") / p.fanout)).join(open_, "up", "left_semi").drop("up") for s in sides]
        differ = sides[0].join(sides[1], "node", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
        open_ = differ.select(F.col("node").alias("up"))
    return open_.select(F.floor(F.col("up") / p.fanout ** (p.depth - 1)).cast("int").alias("branch"), F.col("up").alias("leaf"))


@dataclass
class Scan:
    """What a scan has to look at: the rows of both sides in leaves that differ, and those of the first side in all other leaves."""

    left: DataFrame
    right: DataFrame
    alike: DataFrame


def scan(a: Snapshot, b: Snapshot) -> Scan:
    leaves = stored(differing_leaves(a, b), "leaves")
    few = leaves.limit(a.params.most_broadcast + 1).count() <= a.params.most_broadcast
    met = F.broadcast(leaves) if few else leaves
    within = lambda s: s.rows.join(met, ["branch", "leaf"], "left_semi")
    return Scan(within(a), within(b), a.rows.join(met, ["branch", "leaf"], "left_anti"))


def _same(keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return test


def differences(a: Snapshot, b: Snapshot) -> DataFrame:
    """Keys, kind (only_left, only_right, changed) and both values of rows that differ; keys are unique on either side."""
    s = scan(a, b)
    rest = [c for c in a.rows.columns if c not in (*a.keys, "leaf", "branch")]
    both = s.left.withColumn("_here", F.lit(True)).alias("l").join(s.right.withColumn("_here", F.lit(True)).alias("r"), _same(a.keys), "full_outer")
    kind = F.when(F.col("r._here").isNull(), "only_left").when(F.col("l._here").isNull(), "only_right").when(~F.struct(*[f"l.{c}" for c in rest]).eqNullSafe(F.struct(*[f"r.{c}" for c in rest])), "changed")
    out = both.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in a.keys], kind.alias("kind"), *[F.col(f"{side}.{c}").alias(f"{name}_{c}") for c in rest for side, name in (("l", "left"), ("r", "right"))])
    return out.filter("kind is not null")


SECTION = ["court_slug", "resource"]


def bulk_comparisons(plan: DataFrame, live: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """The comparison of every planned action with the live section: action_id, has_existing, no_change, current_hash, proposed_hash.

    plan: action_id, court_slug, resource, hash; live: court_slug, resource, hash (one row
    a section). Sections of leaves that agree are unchanged as they stand; only the others are joined.
    """
    ids = plan.select("action_id", *SECTION, "hash")
    left = snapshot(ids.select(*SECTION, "hash"), SECTION, p, "plan")
    right = snapshot(live.select(*SECTION, "hash"), SECTION, p, "live")
    leaves = stored(differing_leaves(left, right), "leaves")
    met = F.broadcast(leaves) if leaves.limit(p.most_broadcast + 1).count() <= p.most_broadcast else leaves
    leaf = F.pmod(F.xxhash64(*SECTION), F.lit(p.leaves))
    placed = ids.withColumn("leaf", leaf)
    open_ = placed.join(met.select("leaf"), "leaf", "left_semi").alias("l").join(right.rows.join(met, ["branch", "leaf"], "left_semi").alias("r"), _same(SECTION), "left")
    there = F.col("r.leaf").isNotNull()
    looked = open_.select("l.action_id", there.alias("has_existing"), (there & F.col("r.hash").eqNullSafe(F.col("l.hash"))).alias("no_change"), F.col("r.hash").alias("current_hash"), F.col("l.hash").alias("proposed_hash"))
    alike = placed.join(met.select("leaf"), "leaf", "left_anti").select("action_id", F.lit(True).alias("has_existing"), F.lit(True).alias("no_change"), F.col("hash").alias("current_hash"), F.col("hash").alias("proposed_hash"))
    return looked.unionByName(alike)
