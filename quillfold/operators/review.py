"""Review items: links to actions, decisions, filters, counts and order.

items: review_id, row, kind, field, confidence, operation, value, needs_review, outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, paths_overlap
from .relations import ancestors

# Confidences from the surest on, and codes that do not ask for a correction at the source.
CONFIDENCES = ["high", "medium", "low", "unavailable"]
LONG_TEXT = 250
# Fixed value: ids in a list; the pairs that two lists make are held in memory by a task.
MOST_LISTED = 256


def confidence(c: Column) -> Column:
    return F.when(c.isin(CONFIDENCES[:3]), c).otherwise("unavailable")


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CONFIDENCES]), confidence(c))


def in_review_order(items: DataFrame) -> DataFrame:
    """Surest first, then row, field and id."""
    return items.orderBy(confidence_rank(F.col("confidence")), "row", F.coalesce("field", F.lit("")), "review_id")


def report_order() -> list[Column]:
    """Row, fields before addresses, field."""
    return [F.col("row"), F.col("kind") != "field", F.coalesce("field", F.lit(""))]


def _outermost(paths: Column) -> Column:
    """The distinct paths that lie in no other of them, in order."""
    strict = lambda p: F.slice(ancestors(p), 1, F.size(ancestors(p)) - 1)
    return let(F.array_sort(F.array_distinct(F.array_compact(paths))), lambda ps: F.when(F.size(ps) < 2, ps).otherwise(F.filter(ps, lambda p: ~F.arrays_overlap(strict(p), ps))))


def _meets(rows: Column, place: Column) -> Column:
    """Whether an item's place overlaps one of the paths that an action has in the place's row."""
    return F.exists(rows, lambda r: F.coalesce(r["row"] == place["row"], F.lit(False)) & F.exists(r["paths"], lambda p: F.coalesce(paths_overlap(p, place["path"]), F.lit(False))))


def _blocks(members: DataFrame, key: str, *same: str) -> DataFrame:
    """members that agree in the named columns, as lists of at most MOST_LISTED of those that lie in one partition; keys are distinct within them."""
    none = F.lit(None).cast(members.schema[key].dataType)
    got = members.withColumn("_part", F.spark_partition_id()).withColumn("_none", F.col(key).isNull()).groupBy(*same, "_part", "_none").agg(F.collect_list(key).alias("_l"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("_l"), F.lit(MOST_LISTED)), lambda k: F.slice("_l", k, F.lit(MOST_LISTED)))
    return got.select(*same, F.explode(F.when(F.col("_none"), F.array(F.array(none))).otherwise(cuts)).alias(f"{key}s"))


def links(items: DataFrame, actions: DataFrame) -> DataFrame:
    """action_id, review_id, each pair once: the ids that an action names itself, and those of its row whose field overlaps one of its source fields.

    actions: action_id, row, source_fields, review_ids. Overlaps are an equi-join on (row, path): a path overlaps another when one is among the other's ancestors.

    Pairs may be far more than either side's rows, so they are made only once and go
    through no shuffle: of an action's paths those inside another of them are left out,
    and then a field is either one of the paths or around one, or inside exactly one.
    Both sides meet as short lists of the actions with the same paths and of the items
    with the same place, and pairs are written out where the lists have met. An item that
    stands in several places is linked by the first of them that the action meets.
    """
    own = actions.groupBy("action_id").agg(F.collect_list(F.struct("row", "source_fields", "review_ids")).alias("_l"))
    of_row = lambda r: F.flatten(F.transform(F.filter("_l", lambda x: x["row"] == r), lambda x: F.coalesce(x["source_fields"], F.array().cast("array<string>"))))
    rows = F.transform(F.array_sort(F.array_distinct(F.array_compact(F.transform("_l", lambda x: x["row"])))), lambda r: F.struct(r.alias("row"), _outermost(of_row(r)).alias("paths")))
    acts = own.select("action_id", "_l", rows.alias("_rows"))
    # A struct is never null, so that no filter of one use makes the shuffle of the other another one.
    at = items.select(F.struct("review_id").alias("_id"), F.struct("row", F.col("field").alias("path")).alias("_x")).groupBy("_id").agg(F.array_sort(F.collect_set("_x")).alias("_at"))
    of = lambda inside, paths: F.transform(paths, lambda p: F.struct(F.lit(inside).alias("inside"), p.alias("path")))

    several = F.when(F.size("_rows") > 1, F.col("_rows"))
    members = acts.select("action_id", several.alias("_several"), F.explode("_rows").alias("_r")).select("action_id", "_several", "_r.row", "_r.paths")
    around = F.array_distinct(F.flatten(F.transform("paths", ancestors)))
    rows_of = F.coalesce("_several", F.array(F.struct("row", "paths"))).alias("_rows")
    asked = _blocks(members, "action_id", "row", "paths", "_several").select("action_ids", "row", rows_of, F.explode(F.concat(of(False, around), of(True, F.col("paths")))).alias("_x")).select("action_ids", "row", "_rows", "_x.*")

    places = at.select("_id", "_at", F.posexplode("_at").alias("_k", "_x")).filter("_x.path is not null and _x.row is not null")
    before = F.when(F.size("_at") > 1, F.slice("_at", F.lit(1), F.col("_k")))
    up = ancestors(F.col("path"))
    each = F.concat(of(False, F.array("path")), of(True, F.slice(up, 1, F.size(up) - 1)))
    fields = _blocks(places.select("_id.review_id", "_x.row", "_x.path", before.alias("_before")), "review_id", "row", "path", "_before")
    fields = fields.select("review_ids", "row", "_before", F.explode(each).alias("_y")).select("review_ids", "row", "_before", "_y.*")
    # Lists are small beside the pairs they make, so tasks are not merged by their bytes.
    n, on = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), ["row", "inside", "path"]
    found = asked.repartition(n, *on).join(fields.repartition(n, *on), on)
    first = found.filter(F.col("_before").isNull() | ~F.exists("_before", lambda x: _meets(F.col("_rows"), x)))
    pairs = first.select("review_ids", F.explode("action_ids").alias("action_id")).select("action_id", F.explode("review_ids").alias("review_id"))

    ids = F.array_distinct(F.array_compact(F.flatten(F.transform("_l", lambda x: F.coalesce(x["review_ids"], F.array())))))
    named = acts.select("action_id", "_rows", F.explode(ids).alias("review_id")).select("action_id", "_rows", F.struct("review_id").alias("_id"))
    alone = named.join(at, "_id").filter(~F.exists("_at", lambda x: _meets(F.col("_rows"), x)))
    return pairs.unionByName(alone.select("action_id", "_id.review_id"))


def enriched(items: DataFrame, decisions: DataFrame, linked: DataFrame, states: DataFrame) -> DataFrame:
    """items with decision (pending where there is none), their actions, and how many of these succeeded or need attention."""
    acts = linked.join(states.select("action_id", "status"), "action_id", "left").groupBy("review_id").agg(F.count("*").alias("actions"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status").isin("blocked", "failed", "unknown")).alias("attention"))
    zero = F.lit(0).cast("long")
    got = items.join(decisions, "review_id", "left").join(acts, "review_id", "left")
    return got.withColumn("decision", F.coalesce("decision", F.lit("pending"))).withColumns({c: F.coalesce(c, zero) for c in ("actions", "succeeded", "attention")})


def filtered(items: DataFrame, decision: str | None = None, sure: str | None = None, text: str | None = None, columns: tuple[str, ...] = ("field", "value")) -> DataFrame:
    """Items by decision, confidence and a piece of text in any of the named columns, whatever its case."""
    out = items
    if decision:
        out = out.filter(F.col("decision") == decision)
    if sure:
        out = out.filter(confidence(F.col("confidence")) == sure)
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
        out = out.filter(hit)
    return out


def policy_eligible(items: DataFrame) -> DataFrame:
    """Items that a policy may approve: sure, accepted, not flagged, and not a text too long for its field."""
    return items.filter((F.col("confidence") == "high") & (F.col("outcome") == "accepted") & ~F.coalesce("needs_review", F.lit(False)) & (F.coalesce(F.length("value"), F.lit(0)) <= LONG_TEXT))


def covered(issues: DataFrame, items: DataFrame) -> DataFrame:
    """issues with covered: an item of the kind on the row overlaps the issue's field, or, where none does, any of the kind on the row stands for it; so any does."""
    some = items.select("row", "kind").distinct().withColumn("_some", F.lit(True))
    return issues.join(some, ["row", "kind"], "left").withColumn("covered", F.coalesce("_some", F.lit(False))).drop("_some")


def decision_counts(items: DataFrame) -> DataFrame:
    """Items by decision; those whose actions all succeeded need none."""
    done = (F.col("actions") > 0) & (F.col("succeeded") == F.col("actions"))
    return items.agg(
        F.count("*").alias("total"), F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision") == "denied").alias("denied"),
        F.count_if((F.col("decision") == "pending") & ~done).alias("pending"), F.count_if((F.col("decision") == "pending") & done).alias("already_written"),
    )


def report_counts(items: DataFrame) -> DataFrame:
    """Items by kind and outcome, and those flagged for review."""
    return items.agg(F.count("*").alias("items"), *[F.count_if(F.col("kind") == k).alias(f"{k}_items") for k in ("field", "address")], F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if("needs_review").alias("flagged"))


def decide(items: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Decision of every item after decision events (review_id, at, decision, by): the last wins, reconsider takes it back, events on unknown items are ignored."""
    known = events.join(items.select("review_id"), "review_id", "left_semi")
    last = known.groupBy("review_id").agg(F.max_by("decision", F.struct("at", "decision")).alias("_d"), F.count("*").alias("events"))
    both = decisions.join(last, "review_id", "full_outer")
    now = F.when(F.col("_d") == "reconsider", F.lit(None)).otherwise(F.coalesce("_d", "decision"))
    return both.select("review_id", now.alias("decision"), F.coalesce("events", F.lit(0).cast("long")).alias("events")).filter("decision is not null")


def patched(items: DataFrame, patches: DataFrame) -> DataFrame:
    """items with the approved value in place of their own; a patch to null takes the value away."""
    p = patches.select("review_id", F.col("value").alias("_v"), F.lit(True).alias("_p"))
    return items.join(p, "review_id", "left").withColumn("value", F.when(F.col("_p"), F.col("_v")).otherwise(F.col("value"))).drop("_v", "_p")


def authoritative(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Items of the authoritative rows only."""
    return items.join(rows.select("row").distinct(), "row", "left_semi")


def themes(events: DataFrame, theme: str, example: str, ordinal: str, n: int = 5) -> DataFrame:
    """Counts by theme with the first n distinct examples in order of encounter, most frequent first; examples are made distinct before they are ranked."""
    from pyspark.sql import Window as W

    counts = events.groupBy(theme).agg(F.count("*").alias("n"), F.count_distinct(example).alias("distinct_examples"))
    met = events.filter(F.col(example).isNotNull()).groupBy(theme, example).agg(F.min(ordinal).alias("_at"))
    first = met.withColumn("_k", F.row_number().over(W.partitionBy(theme).orderBy("_at", example))).filter(F.col("_k") <= n)
    listed = first.groupBy(theme).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(example).cast("string").alias("e")))), lambda x: x["e"]), ",").alias("examples"))
    return counts.join(listed, theme, "left").withColumn("examples", F.coalesce("examples", F.lit(""))).orderBy(F.desc("n"), theme)


def only_parts(reason: Column, test) -> Column:
    """Whether a reason made of parts has any, and every part passes."""
    parts = F.filter(F.transform(F.split(reason, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, test), F.lit(False))


def overview(marks: DataFrame) -> DataFrame:
    """category: distinct rows and items, all categories together as the last row. marks: row, category."""
    return marks.groupBy("category").agg(F.count_distinct("row").alias("rows"), F.count("*").alias("items")).unionByName(marks.agg(F.lit("(outstanding)").alias("category"), F.count_distinct("row").alias("rows"), F.count("*").alias("items")))


def queue_summary(records: DataFrame) -> DataFrame:
    """Rows of the record queue that wait for a decision, a source correction or an action. records: row, decisions, corrections, actions."""
    return records.agg(F.count("*").alias("row_count"), F.count_if(F.col("decisions") > 0).alias("decision_rows"), F.count_if(F.col("corrections") > 0).alias("source_rows"), F.count_if(F.col("actions") > 0).alias("action_rows"))
