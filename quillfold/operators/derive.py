"""The plan of an archived run derived anew: one three-way merge of archived, derived and succeeded actions, and what it repairs.

Actions: action_id, court_slug, row, resource and any other columns, the same on
both sides. Keys are counted before they meet the rows again, so a hot court or
section is one small row on the other side of each join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SECTION = ["court_slug", "resource"]
PLACE = [*SECTION, "row"]
# Codes that a chosen target settles, statuses that a repair may touch, and reasons (this engine's wording) that a derived plan repairs.
SETTLED = ["COURT_SLUG_NOT_FOUND", "COURT_SLUG_SUGGESTED"]
UNFINISHED = ["blocked", "failed", "awaiting_approval", "planned", "ready"]
REPAIRED = ["phone does not match", "email does not match", "period overlaps", "period is empty", "needs an entry", "not allowed characters"]
LIFT = {"liftDoorWidth": "lift_door_width", "liftDoorLimit": "lift_weight_limit"}


def with_targets(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """records (row, court_slug, issues) with the court that somebody chose for a row; issues about the unknown one go."""
    got = records.join(overrides.select("row", F.col("court_slug").alias("_to")), "row", "left")
    kept = F.when(F.col("_to").isNotNull(), F.filter("issues", lambda i: ~i["code"].isin(SETTLED))).otherwise(F.col("issues"))
    return got.withColumn("issues", kept).withColumn("court_slug", F.coalesce("_to", "court_slug")).withColumn("overridden", F.col("_to").isNotNull()).drop("_to")


def derive(original: DataFrame, derived: DataFrame, succeeded: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The plan to go on with: every action of either side that stays, with its origin and the id it goes by.

    Origins: ``protected`` (a section of the archived plan with an action that succeeded
    stays whole, and what was derived for it goes), ``retained`` (an archived court none
    of whose rows was derived again), ``kept_id`` (derived, where the archived plan has
    exactly one action of the court, section and row: it goes on by that id) and ``new``.
    Rows in overrides (row, court_slug) are derived for the chosen court.
    """
    rest = [c for c in original.columns if c not in ("action_id", *PLACE)]
    if overrides is not None:
        chosen = overrides.select("row", F.col("court_slug").alias("_to"))
        derived = derived.join(chosen, "row", "left").withColumn("court_slug", F.coalesce("_to", "court_slug")).drop("_to")
    won = original.join(succeeded.select("action_id").distinct().withColumn("_won", F.lit(True)), "action_id", "left")
    sides = won.select(*PLACE, "action_id", F.coalesce("_won", F.lit(False)).alias("won"), F.lit(True).alias("old"))
    sides = sides.unionByName(derived.select(*PLACE, F.lit(None).cast(original.schema["action_id"].dataType).alias("action_id"), F.lit(False).alias("won"), F.lit(False).alias("old")))
    # One pass over both sides: what each place, section and row has, counted before the shuffle.
    places = sides.groupBy(*PLACE).agg(F.count_if("old").alias("n_old"), F.min("action_id").alias("old_id"), F.max("won").alias("won"), F.count_if(~F.col("old")).alias("n_new"))
    protected = places.groupBy(*SECTION).agg(F.max("won").alias("won")).filter("won").select(*SECTION)
    again = places.groupBy("row").agg(F.sum("n_new").alias("n")).filter("n > 0").select("row")
    met = places.filter("n_old > 0").join(again, "row", "left_semi").select("court_slug").unionByName(places.filter("n_new > 0").select("court_slug")).distinct()
    once = places.filter("n_old = 1").select(*PLACE, "old_id")
    fresh = derived.join(protected, SECTION, "left_anti").join(once, PLACE, "left")
    fresh = fresh.select(F.coalesce("old_id", "action_id").alias("action_id"), *PLACE, *rest, F.when(F.col("old_id").isNotNull(), "kept_id").otherwise("new").alias("origin"))
    stays = original.join(protected, SECTION, "left_semi").select("action_id", *PLACE, *rest, F.lit("protected").alias("origin"))
    left = original.join(protected, SECTION, "left_anti").join(met, "court_slug", "left_anti").select("action_id", *PLACE, *rest, F.lit("retained").alias("origin"))
    return fresh.unionByName(stays).unionByName(left)


def repaired_reason(reason: Column, markers: list[str] = REPAIRED) -> Column:
    return F.coalesce(reason.rlike("|".join(markers)), F.lit(False))


def reconcile(states: DataFrame, plan: DataFrame, omitted: DataFrame, markers: list[str] = REPAIRED) -> DataFrame:
    """states after a derivation: action_id, status, reason, change and whether approvals and comparisons of the action go.

    Only unfinished actions of courts that the plan has are touched. An action that the
    plan lacks is ``removed`` if it failed for a reason the derivation repairs; one all of
    whose items are omitted has succeeded without a write; one that failed for such a
    reason and is ready now is planned again. states: action_id, court_slug, status,
    state_reason; plan: action_id, court_slug, readiness; omitted: action_id.
    """
    courts = plan.select("court_slug").distinct().withColumn("_court", F.lit(True))
    got = states.join(courts, "court_slug", "left").join(plan.select("action_id", "court_slug", F.coalesce("readiness", F.lit("")).alias("_ready")), ["action_id", "court_slug"], "left")
    got = got.join(omitted.select("action_id").distinct().withColumn("_omitted", F.lit(True)), "action_id", "left")
    broken = F.col("status").isin("blocked", "failed") & repaired_reason(F.col("state_reason"), markers)
    here = F.col("_ready").isNotNull()
    change = (
        F.when(F.col("_court").isNull() | ~F.col("status").isin(UNFINISHED), F.lit(None).cast("string"))
        .when(~here, F.when(broken, "removed")).when(F.col("_omitted"), "omitted").when(broken & (F.col("_ready") == "ready"), "reset")
    )
    got = got.withColumn("change", change)
    status = F.when(F.col("change") == "omitted", "succeeded").when(F.col("change") == "reset", "planned").when(F.col("change") == "removed", F.lit(None)).otherwise(F.col("status"))
    reason = F.when(F.col("change") == "omitted", "every item was omitted; nothing is written").when(F.col("change").isin("reset", "removed"), F.lit(None)).otherwise(F.col("state_reason"))
    return got.select("action_id", "court_slug", status.alias("status"), reason.alias("reason"), "change", F.coalesce(F.col("change").isin("removed", "reset"), F.lit(False)).alias("invalidates"))


def unavailable(value: Column) -> Column:
    """Whether a cell says that there is no measurement."""
    return F.coalesce(T.null_if_empty_like(value), F.lit("")).rlike(r"(?i)^(|unknown|not (known|available|applicable)|none|unavailable|n/?k)$")


def legacy_defaults(actions: DataFrame, evidence: DataFrame) -> DataFrame:
    """actions of older plans with the defaults that a blank lift measurement stands for, and whether those lift every reason that held the action.

    actions: action_id, row, resource, reason, body (lift, liftDoorWidth, liftDoorLimit);
    evidence: row, lift_available and the two cells. A reason names the field that it misses; several are parted by ``;``.
    """
    cells = evidence.select("row", "lift_available", *[F.col(c).alias(f"_{c}") for c in LIFT.values()])
    got = actions.join(cells, "row", "left")
    known = (F.col("resource") == "accessibility_options") & F.col("body.lift") & F.col("lift_available")
    one = lambda field, cell: F.when(F.coalesce(known, F.lit(False)) & F.col(f"body.{field}").isNull() & unavailable(F.col(f"_{cell}")), F.lit(field))
    got = got.withColumn("defaulted", F.array_compact(F.array(*[one(f, c) for f, c in LIFT.items()])))
    parts = F.filter(F.transform(F.split(F.coalesce("reason", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    settled = (F.size(parts) > 0) & F.forall(parts, lambda x: F.exists("defaulted", lambda d: x.startswith(d)))
    return got.withColumn("settled", settled).drop("lift_available", *[f"_{c}" for c in LIFT.values()])
