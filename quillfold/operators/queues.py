"""Lists of records, actions and factors that a reviewer works through, and the counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import chunked

from . import evidence as E
from . import issues as I

# Issue codes that the operational view leaves out.
SETTLED_CODES = ["DUPLICATE_COURT_SLUG"]


def operational(records: DataFrame) -> DataFrame:
    """Authoritative records without settled codes, their status by severity and code alone. records: selection_status, issues, status."""
    seen = records.filter("selection_status = 'authoritative'").withColumn("issues", I.without_codes(F.col("issues"), SETTLED_CODES))
    return seen.withColumn("status", I.status(F.col("issues"), code_warnings=False))


def filtered(records: DataFrame, status: str | None = None, outstanding: bool = False, category: str | None = None) -> DataFrame:
    """Records by status, those with something left to decide or correct, and those with an issue of a category."""
    out = records
    if status:
        out = out.filter(F.col("status") == status)
    if outstanding:
        out = out.filter(F.exists("issues", lambda i: E.needs_correction(i["code"], i["severity"])))
    if category:
        out = out.filter(E.has_category(F.col("issues"), category))
    return out


def with_code(records: DataFrame, code: str, key: str) -> DataFrame:
    """Issues of one code."""
    return I.report(records, key).filter(F.col("code") == code)


def model_factors(records: DataFrame, key: str) -> DataFrame:
    """Model issues that hold a record up, in order of rows; rows without a number come last."""
    found = I.report(records, key, "status").filter(F.col("code").startswith("LLM_") & F.col("code").isin(I.REVIEW_CODES))
    return found.orderBy(F.col(key).asc_nulls_last(), "field", "code")


def factor_summary(records: DataFrame, blocking: DataFrame, key: str) -> DataFrame:
    """Distinct courts, rows and issues that the model holds up, and rows and addresses that verification blocks. blocking: key."""
    model = I.report(records, key).filter(F.col("code").startswith("LLM_") & F.col("code").isin(I.REVIEW_CODES)).select(F.lit("m").alias("side"), F.col(key).cast("string").alias("k"))
    os = blocking.select(F.lit("o").alias("side"), F.col(key).cast("string").alias("k"))
    courts = records.select(F.lit("c").alias("side"), F.col("court_slug").alias("k")).filter("k is not null")
    n = lambda s: F.count_distinct(F.when(F.col("side") == s, F.col("k")))
    rows = lambda s: F.count_if(F.col("side") == s)
    return courts.unionByName(model).unionByName(os).agg(n("c").alias("courts"), n("m").alias("model_rows"), rows("m").alias("model_issues"), n("o").alias("blocked_rows"), rows("o").alias("blocked_addresses"))


def tasks(rows: DataFrame) -> DataFrame:
    """Each task of a row once. rows: row, state, label."""
    return rows.select("row", "state", "label").distinct()


def plan_summary(actions: DataFrame) -> DataFrame:
    """Records and actions of a plan by readiness, and those that rest on assumptions. actions: court_slug, readiness, assumptions."""
    from .summaries import readiness

    by = actions.groupBy("court_slug").agg(F.count("*").alias("n"), F.count_if(F.col("readiness") == "ready").alias("r"), F.count_if(F.size("assumptions") > 0).alias("a"))
    state = readiness(F.col("n"), F.col("r"))
    return by.agg(F.count("*").alias("records"), *[F.count_if(state == s).alias(f"{s}_records") for s in ("ready", "partially_ready", "pending")], F.sum("n").alias("actions"), F.sum("r").alias("ready_actions"), (F.sum("n") - F.sum("r")).alias("pending_actions"), F.sum("a").alias("assumed_actions"))


def submitters(records: DataFrame, email: Column, name: Column, row: str, per_chunk: int = 1000) -> DataFrame:
    """Rows by e-mail and name, nulls being one of their kind: their number and all of them, in chunks of rows."""
    each = records.select(email.alias("email"), name.alias("name"), F.col(row).alias("row"))
    counts = each.groupBy("email", "name").agg(F.count("*").alias("rows"))
    lists = chunked(each, ["email", "name"], "row", [F.col("row")], per_chunk)
    same = F.col("a.email").eqNullSafe(F.col("b.email")) & F.col("a.name").eqNullSafe(F.col("b.name"))
    return counts.alias("a").join(lists.alias("b"), same).select("a.email", "a.name", "rows", "chunk", F.array_join(F.transform("values", lambda r: r.cast("string")), ", ").alias("listed"))


def duplicate_sheet(records: DataFrame, key: str, row: str, columns: list[str], per_chunk: int = 1000) -> DataFrame:
    """Groups of records with one key: their number, first and last row and, for some columns, all distinct values in order of rows, in chunks."""
    known = records.filter(F.col(key).isNotNull())
    groups = known.groupBy(key).agg(F.count("*").alias("rows"), F.min(row).alias("first_row"), F.max(row).alias("last_row")).filter("rows > 1")
    each = known.select(key, row, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).filter("x.v is not null")
    met = each.groupBy(key, "x.column", "x.v").agg(F.min(row).alias("_at")).join(groups.select(key), key, "left_semi")
    lists = chunked(met, [key, "column"], "v", [F.col("_at")], per_chunk)
    return groups.join(lists, key, "left").select(key, "rows", "first_row", "last_row", "column", "chunk", F.array_join("values", "; ").alias("listed"))


def workflow(pending_values: Column, unchecked: Column, pending_changes: Column, conflicts: Column) -> Column:
    """The first step that isn't done."""
    return F.when(pending_values > 0, "values").when((unchecked > 0) | (pending_changes > 0) | (conflicts > 0), "changes").otherwise("courts")


def one(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; an error if there is none."""
    got = df.filter(F.col(key) == F.lit(value))
    if got.isEmpty():
        raise KeyError(value)
    return got


def clears(actions: DataFrame, items: DataFrame) -> DataFrame:
    """action_id, field of the accepted clears of explanations under an action's contacts, however often one was cleared. actions: action_id, row, section (path)."""
    gone = items.filter((F.col("operation") == "clear") & (F.col("outcome") == "accepted") & F.col("field").rlike(r"\.explanation$")).select("row", F.regexp_extract("field", r"^(.*)\.explanation$", 1).alias("section"), "field").distinct()
    return actions.select("action_id", "row", "section").join(gone, ["row", "section"]).select("action_id", "field").distinct()


def manual_selectable(items: DataFrame, linked: DataFrame, states: DataFrame) -> DataFrame:
    """items with actionable: accepted with a value, or an address with candidates, and with an action that isn't done."""
    open_ = linked.join(states.filter("status = 'succeeded'").select("action_id"), "action_id", "left_anti").select("review_id").distinct().withColumn("_open", F.lit(True))
    usable = (F.col("outcome") == "accepted") & ((F.col("operation") == "clear") | F.col("value").isNotNull())
    got = items.join(open_, "review_id", "left")
    return got.withColumn("actionable", F.coalesce("_open", F.lit(False)) & (usable | ((F.col("kind") == "address") & (F.col("candidates") > 0)))).drop("_open")


def policy_decisions(items: DataFrame, decisions: DataFrame, version: str) -> DataFrame:
    """Decisions after a policy run: eligible items nobody decided are approved by it; its own approvals of items that aren't eligible any more go; manual ones stay. decisions: review_id, decision, method."""
    from .review import policy_eligible

    fine = policy_eligible(items).select("review_id")
    manual = decisions.filter("method <> 'policy'")
    kept = decisions.filter("method = 'policy'").join(fine, "review_id", "left_semi")
    own = manual.unionByName(kept)
    new = fine.join(own.select("review_id"), "review_id", "left_anti").select("review_id", F.lit("approved").alias("decision"), F.lit("policy").alias("method"))
    return own.select("review_id", "decision", "method").unionByName(new).withColumn("policy_version", F.when(F.col("method") == "policy", version))


def written(operations: DataFrame, answers: DataFrame) -> DataFrame:
    """Outcome of each action from its operations (in order) and their answers: those after the first that failed were not sent; some written and some not is a partial failure.

    operations: action_id, seq; answers: action_id, seq, http_status.
    """
    got = operations.join(answers, ["action_id", "seq"], "left")
    ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    first = got.groupBy("action_id").agg(F.count("*").alias("planned"), F.min(F.when(~ok, F.col("seq"))).alias("_bad"), F.min_by("http_status", F.when(~ok, F.col("seq"))).alias("failed_status"))
    made = got.join(first, "action_id").groupBy("action_id", "planned", "failed_status").agg(F.count_if(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).alias("made"))
    status = F.when(F.col("made") == F.col("planned"), "succeeded").when(F.col("failed_status").isNull() | (F.col("failed_status") >= 500), "unknown").otherwise("failed")
    return made.select("action_id", "planned", "made", "failed_status", status.alias("status"), ((F.col("made") > 0) & (F.col("made") < F.col("planned"))).alias("partial"))
