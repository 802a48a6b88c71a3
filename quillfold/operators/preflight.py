"""Preflight of planned actions as a cascade over live tables.

Every stage joins its tables for the actions that no earlier stage has decided,
decides some of them, and stores the rest: the first outcome that holds is the
action's, and tables of later stages never meet an action that is decided. A
lost executor costs the stage at work. What is asked by the same key, or needs
no table of its own, is decided in one stage; its cases stand in the order of
the outcomes.

Items meet their resolutions once, and each action's are digested once (`prepared`).

Tables and their columns:

* actions: action_id, court_slug, row, resource, readiness, needs_source, court_id (planned; may be null), settled (whether older blockers are lifted)
* states: action_id, status
* items: action_id, item_id, position, key, value, postcode, evidence, approved_uprn (what an action would send, item by item)
* resolutions: item_id, decision
* courts: court_slug, http_status (null: no answer), court_id
* selections: court_slug, selected_row
* links: action_id, review_id; approved: review_id
* lookups: postcode, http_status; candidates: postcode, uprn
* sections: court_slug, resource, http_status; live: court_slug, resource, key, value
* approvals: action_id, current_hash, proposed_hash
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .execution import PREFLIGHT, first_match

# Sections that are lists of items, evidence that needs no fresh lookup, and answers that say there is a section or none.
LISTS = ["address", "contact_detail", "court_opening_hours"]
SURE = ["auto_normalised", "verified"]
ANSWERED = [200, 204, 404]
SECTION = ["court_slug", "resource"]
STATUS = dict(PREFLIGHT) | {"section_unexpected": "unknown", "ready": "ready"}


class Cascade:
    """Actions still open, and the verdicts so far."""

    def __init__(self, actions: DataFrame) -> None:
        self.open, self.verdicts = actions, []

    def stage(self, joined: DataFrame, cases: list[tuple], keep: list[str] | None = None, last: str | None = None) -> None:
        """Decide the open actions, joined with tables: the first case that holds, or last for all that are left.

        A case is a name, a test and, where there was an answer, its status. keep: columns that
        later stages need of the actions left, all that they had if none are named.
        """
        keep = self.open.columns if keep is None else keep
        outcome = first_match([(c[1], F.lit(c[0])) for c in cases], F.lit(last).cast("string"))
        http = first_match([(F.col("outcome") == c[0], c[2]) for c in cases if len(c) > 2], F.lit(None).cast("int"))
        done = stored(joined.withColumn("outcome", outcome).select(*keep, "outcome", http.cast("int").alias("http_status")), "preflight")
        self.verdicts.append(done.filter("outcome is not null").select("action_id", "outcome", "http_status"))
        self.open = done.filter("outcome is null").select(*keep)

    def result(self) -> DataFrame:
        out = self.verdicts[0]
        for v in self.verdicts[1:]:
            out = out.unionByName(v)
        return out


def address_verdicts(items: DataFrame, lookups: DataFrame, candidates: DataFrame) -> DataFrame:
    """action_id, verdict (address_blocked or address_unknown) and http_status of the first item whose address a fresh lookup doesn't bear out.

    Sure evidence and items without a postcode need no lookup. A postcode that was found
    is enough, unless somebody approved a candidate: then it must still be among those found.
    """
    asked = items.filter(~F.coalesce(F.col("evidence").isin(SURE), F.lit(False)) & (F.coalesce("postcode", F.lit("")) != ""))
    got = asked.join(lookups.select("postcode", "http_status"), "postcode", "left")
    there = candidates.select("postcode", F.col("uprn").alias("approved_uprn")).distinct().withColumn("_there", F.lit(True))
    got = got.join(there, ["postcode", "approved_uprn"], "left")
    code = F.col("http_status")
    verdict = (
        F.when(code.isNull(), "address_unknown").when((code == 200) & F.col("approved_uprn").isNotNull() & F.col("_there").isNull(), "address_blocked")
        .when(code == 200, F.lit(None).cast("string")).when(code.isin(400, 404), "address_blocked").otherwise("address_unknown")
    )
    return got.withColumn("verdict", verdict).filter("verdict is not null").groupBy("action_id").agg(F.min(F.struct("position", "verdict", "http_status")).alias("_v")).select("action_id", "_v.verdict", F.col("_v.http_status").alias("address_http"))


def sums(sent: Column | None = None) -> list[Column]:
    """What a digest is made of: the number of items and order-free sums of two hashes of (key, value); of sent items if a test is given. Nothing is gathered."""
    pair = [F.coalesce("key", F.lit("")), F.lit("\u0001"), F.coalesce("value", F.lit(""))]
    of = lambda c: c if sent is None else F.when(sent, c)
    one, other = F.xxhash64(*pair), F.xxhash64(F.lit(1), *pair)
    return [F.count(of(F.lit(1))).alias("_n"), F.sum(of(one.bitwiseAND(0xFFFFFFFF))).alias("_low"), F.sum(of(F.shiftrightunsigned(one, 32))).alias("_high"), F.bit_xor(of(other)).alias("_mixed")]


def listing(rows: DataFrame, keys: list[str], name: str, *more: Column) -> DataFrame:
    """Number of items and a hash of all (key, value) of each group, in any order, from rows with `sums`."""
    parts = F.concat_ws(":", *[F.coalesce(c, F.lit(0)) for c in ("_n", "_low", "_high", "_mixed")])
    return rows.select(*keys, F.col("_n").alias(f"n_{name}"), F.sha2(parts, 256).alias(f"{name}_hash"), *more)


def prepared(t: dict[str, DataFrame], invalid: Column) -> dict[str, DataFrame]:
    """What several stages, and whoever binds approvals to hashes, need of the items and the live sections; stored.

    * sent: items with _sent (false: omitted)
    * proposed: action_id, n_sent, repeated (a key comes twice), bad (an invalid value), proposed_hash; one row for every action with items
    * current: court_slug, resource, n_current, current_hash
    """
    # The ids of each partition's omitted items are held in memory; the items themselves aren't sorted.
    omitted = t["resolutions"].filter("decision = 'omit'").select("item_id").distinct().withColumn("_omit", F.lit(True))
    columns = ["action_id", "position", "key", "value", "postcode", "evidence", "approved_uprn"]
    sent = stored(t["items"].join(omitted.hint("shuffle_hash"), "item_id", "left").select(*columns, F.col("_omit").isNull().alias("_sent")), "sent")
    low = sent.repartition("action_id").groupBy("action_id", "key").agg(*sums(F.col("_sent")), F.count_if(F.col("_sent") & invalid).alias("_bad"))
    per = low.groupBy("action_id").agg((F.max("_n") > 1).alias("repeated"), (F.sum("_bad") > 0).alias("bad"), *[F.sum(c).alias(c) for c in ("_n", "_low", "_high")], F.bit_xor("_mixed").alias("_mixed"))
    proposed = listing(per, ["action_id"], "sent", "repeated", "bad").withColumnRenamed("sent_hash", "proposed_hash")
    current = listing(t["live"].groupBy(*SECTION).agg(*sums()), SECTION, "current")
    return {"sent": sent, "proposed": stored(proposed, "proposed"), "current": stored(current, "current")}


def merge_facts(actions: DataFrame, items: DataFrame, live: DataFrame) -> DataFrame:
    """action_id with what its items meet in the live section: conflicts (keys that the section has several times) and changed ones.

    Items meet by business key; an item that equals the live one is no change.
    """
    counted = live.groupBy(*SECTION, "key").agg(F.count("*").alias("n_live"), F.min("value").alias("live_value"))
    met = items.select("action_id", "key", "value").join(actions.select("action_id", *SECTION), "action_id").join(counted, [*SECTION, "key"], "left")
    return met.groupBy("action_id").agg(F.count_if(F.col("n_live") > 1).alias("conflicts"), F.count_if(~F.col("value").eqNullSafe(F.col("live_value")) | F.col("n_live").isNull()).alias("changed"))


def preflight(t: dict[str, DataFrame], invalid: Column) -> DataFrame:
    """action_id, outcome, status and http_status of every action; a null status leaves the action as it is.

    t: the tables above by name, with those of `prepared` if the caller has them; invalid: a test of a sent value (column ``value``).
    """
    flag = lambda name: F.lit(True).alias(name)
    t = t if "proposed" in t else t | prepared(t, invalid)
    sent, proposed = t["sent"].filter("_sent"), t["proposed"]
    c = Cascade(t["actions"])
    # What is done, and lists all of whose items are omitted.
    first = c.open.join(t["states"].select("action_id", "status"), "action_id", "left").join(proposed.select("action_id", "n_sent", "repeated", "bad"), "action_id", "left")
    facts = ["status", "n_sent", "repeated", "bad"]
    c.stage(first, [("already_succeeded", F.col("status") == "succeeded"), ("all_items_omitted", F.col("resource").isin(LISTS) & (F.col("n_sent") == 0))], [*c.open.columns, *facts])
    # The court: an outage never overwrites a block. And which row speaks for it.
    court = t["courts"].select("court_slug", F.col("http_status").alias("_http"), F.col("court_id").alias("_id"), flag("_asked")).join(t["selections"].select("court_slug", "selected_row"), "court_slug", "left")
    http, row = F.col("_http"), F.col("selected_row")
    failed = F.col("_asked").isNull() | http.isNull() | ~http.isin(200, 404)
    cases = [("left_blocked", failed & (F.col("status") == "blocked"), http), ("court_lookup_failed", failed, http), ("court_missing", http == 404, http), ("court_id_changed", F.col("court_id") != F.col("_id"), http)]
    cases += [("source_not_selected", F.col("needs_source") & row.isNull()), ("other_row_selected", F.col("needs_source") & (row != F.col("row")))]
    c.stage(c.open.join(court, "court_slug", "left"), cases, ["action_id", *SECTION, "readiness", "settled", *facts[1:]])
    # Values that somebody has to approve, and what would be sent.
    mine = t["links"].join(c.open.select("action_id"), "action_id", "left_semi")
    open_values = mine.join(t["approved"].select("review_id").distinct(), "review_id", "left_anti").select("action_id", flag("_open")).distinct()
    cases = [("values_not_approved", F.col("_open").isNotNull()), ("plan_not_ready", ~(F.col("readiness") == "ready") & ~F.coalesce("settled", F.lit(False))), ("empty_body", F.coalesce("n_sent", F.lit(0)) == 0)]
    c.stage(c.open.join(open_values, "action_id", "left"), cases, ["action_id", *SECTION, "repeated", "bad"])
    # Addresses that nothing bears out yet, and the live section.
    mine = sent.join(c.open.filter("resource = 'address'").select("action_id"), "action_id", "left_semi")
    section = t["sections"].select(*SECTION, F.col("http_status").alias("_http"))
    joined = c.open.join(address_verdicts(mine, t["lookups"], t["candidates"]), "action_id", "left").join(section, SECTION, "left").join(t["current"], SECTION, "left")
    cases = [(v, F.col("verdict") == v, F.col("address_http")) for v in ("address_blocked", "address_unknown")]
    cases += [("section_lookup_failed", http.isNull(), http), ("section_unexpected", ~http.isin(ANSWERED), http)]
    c.stage(joined, cases, [*c.open.columns, "n_current", "current_hash"])
    # What the merge comes to, and who approved it: by both hashes. Only what is sent to a section with items meets it.
    existing = F.coalesce("n_current", F.lit(0)) > 0
    met = c.open.filter(existing)
    facts = merge_facts(met, sent, t["live"])
    hashes = met.select("action_id", F.col("current_hash").alias("_current")).join(proposed.select("action_id", F.col("proposed_hash").alias("_proposed")), "action_id")
    approved = t["approvals"].join(hashes, "action_id").filter("current_hash = _current and proposed_hash = _proposed").select("action_id", flag("_approved")).distinct()
    last = c.open.join(facts, "action_id", "left").join(approved, "action_id", "left")
    cases = [("merge_conflict", F.col("repeated") | (F.col("conflicts") > 0)), ("merged_body_invalid", F.col("bad")), ("no_change", existing & (F.col("changed") == 0)), ("replacement_not_approved", existing & F.col("_approved").isNull())]
    c.stage(last, cases, ["action_id"], "ready")
    status = first_match([(F.col("outcome") == name, F.lit(s)) for name, s in STATUS.items()], F.lit(None).cast("string"))
    return c.result().select("action_id", "outcome", status.alias("status"), "http_status")
