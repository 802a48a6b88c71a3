"""Planned sections against live ones: merged bodies, operations, conflicts and hashes, for single sections and for collections of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from . import nested as N


def sections(df: DataFrame, current: str, submitted: str, fallbacks: tuple[str, ...] = (), clears: tuple[str, ...] = (), allowed: list[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """df with the comparison of two struct columns of one type: proposed, both hashes, has_existing, no_change, purpose and operation_body.

    What is submitted wins leaf by leaf, a fallback yields to what is live, cleared paths become null, and defaults fill what is
    still missing. Server-managed keys neither count as a change nor are sent; of the rest only allowed fields are sent.
    """
    kind: StructType = df.schema[current].dataType
    merged = N.deep_merge(F.col(current), F.col(submitted), kind, fallbacks, clears)
    out = df.withColumn("proposed", merged)
    for name, value in (defaults or {}).items():
        out = out.withColumn("proposed", F.col("proposed").withField(name, F.coalesce(F.col(f"proposed.{name}"), value)))
    plain = lambda c: N.without_keys(F.col(c), kind)
    live = F.col(current).isNotNull() & (F.size(N.leaves(F.col(current), kind)) > 0)
    sent = N.allowed(F.col("proposed"), kind, allowed if allowed is not None else [f for f in kind.names if f not in N.SERVER_KEYS])
    return (
        out.withColumn("current_hash", T.canonical_hash(F.col(current))).withColumn("proposed_hash", T.canonical_hash(F.col("proposed")))
        .withColumn("has_existing", live).withColumn("no_change", live & F.to_json(plain(current)).eqNullSafe(F.to_json(plain("proposed"))))
        .withColumn("purpose", F.when(live, "update").otherwise("create")).withColumn("operation_body", F.to_json(sent))
    )


def collections(current: DataFrame, submitted: DataFrame, section: list[str], kind: StructType, id_field: str = "id") -> DataFrame:
    """One row per section and business key: the operation and the merged body. Both sides: section columns, key, body.

    A key that several items of either side have is a conflict without an operation;
    a key on both sides updates the item in place (method PUT, its id in the path), a new
    key creates one (POST), and items that only live are preserved. Nothing is deleted.
    Sides are counted before they meet, so a hot key is one row on each.
    """
    side = lambda df, name: df.groupBy(*section, "key").agg(F.count("*").alias(f"n_{name}"), F.min_by("body", F.to_json("body")).alias(name))
    both = side(current, "current").join(side(submitted, "submitted"), [*section, "key"], "full_outer")
    clash = (F.coalesce("n_current", F.lit(0)) > 1) | (F.coalesce("n_submitted", F.lit(0)) > 1)
    merged = N.deep_merge(F.col("current"), F.col("submitted"), kind)
    same = F.to_json(N.without_keys(F.col("current"), kind)).eqNullSafe(F.to_json(N.without_keys(merged, kind)))
    op = F.when(clash, "conflict").when(F.col("n_submitted").isNull(), "preserve").when(F.col("n_current").isNull(), "create").when(same, "no_change").otherwise("update")
    out = both.withColumn("operation", op).withColumn("body", F.when(~clash, merged))
    method = F.when(op == "create", "POST").when(op == "update", "PUT")
    return out.select(*section, "key", "operation", method.alias("method"), F.when(op == "update", F.col(f"current.{id_field}")).alias("item_id"), "body")


def section_state(operations: DataFrame, section: list[str]) -> DataFrame:
    """Comparison of each collection section: items live and proposed, operations by kind, conflicts, has_existing and no_change."""
    n = lambda *ops: F.count_if(F.col("operation").isin(*ops))
    got = operations.groupBy(*section).agg(n("create").alias("creates"), n("update").alias("updates"), n("preserve").alias("preserved"), n("conflict").alias("conflicts"), n("no_change").alias("unchanged"))
    live = F.col("updates") + F.col("preserved") + F.col("unchanged") + F.col("conflicts") > 0
    return got.withColumn("has_existing", live).withColumn("no_change", (F.col("creates") + F.col("updates") + F.col("conflicts") == 0) & live)


def checked(operations: DataFrame, reason: Column) -> DataFrame:
    """Operations that send something, with what the contract says of the merged body: the last check before a write."""
    return operations.filter("method is not null").withColumn("reason", reason).withColumn("valid", F.coalesce(F.col("reason") == "", F.lit(False)))
