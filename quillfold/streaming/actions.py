"""State of every action from a stream of events: comparisons, approvals bound to their hash, edits, transitions, and attempts that nobody finished.

events: action_id, at (timestamp), event_id (decides ties), kind, hash, status, attempt (boolean):

* comparison: the target was compared, with this hash; another hash than before takes an approval away
* approval: counts if this hash is that of the last comparison
* edit: comparison and approval go
* transition: the action has this status; attempt says whether a call was made

An action that is `running` and hears nothing for `stale` is `unknown`: a timer says so in
the stream, and the same test is made on every event that comes later than that, so the
outcome does not depend on how events fall into batches. Nulls: an event without action,
time or kind is left out, a null hash is no hash and is never approved, a transition to
null keeps the status.

The state of an action is one short row. States are kept in BUCKETS groups by a hash of the
action, since a call to Python for every action costs many times its fold; a bucket's timer
is the earliest of its actions'. The number of buckets belongs to a checkpoint, and one made
with a state for every action is refused by Spark. Events of one bucket are put in order
inside a batch, so a batch (`files_per_trigger`) bounds what a hot action brings at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import commits

EVENTS = "action_id long, at timestamp, event_id long, kind string, hash long, status string, attempt boolean"
STATE = "status string, compared_hash long, approved boolean, attempts long, events long, last_ms long"
OUT = f"action_id long, {STATE}"
RUNNING, LOST = "running", "unknown"
NEW = (None, None, False, 0, 0, None)
BUCKETS = 4096


def fold(state: tuple, events: Iterable[tuple], stale_ms: int) -> tuple:
    """State after events in order of time: ms, kind, hash, status, attempt; nulls are None."""
    status, compared, approved, attempts, n, last = state
    for ms, kind, digest, said, attempt in events:
        if status == RUNNING and last is not None and ms - last > stale_ms:
            status = LOST
        if kind == "comparison":
            digest = None if digest is None else int(digest)
            approved = approved and compared == digest
            compared = digest
        elif kind == "approval":
            approved = approved or (digest is not None and compared == int(digest))
        elif kind == "edit":
            compared, approved = None, False
        elif kind == "transition":
            status = status if said is None else said
            attempts += bool(attempt)
        n, last = n + 1, ms
    return status, compared, approved, attempts, n, last


def plain(events: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """Rows of these columns with None for nulls."""
    return zip(*[events[c].astype(object).where(events[c].notna(), None) for c in columns])


FOLDED = ["ms", "kind", "hash", "status", "attempt"]


def folded(state: tuple, events: pd.DataFrame, stale_ms: int) -> tuple:
    """`fold` of a table in order of time."""
    return fold(state, plain(events, FOLDED), stale_ms)


def changed_states(known: dict[int, tuple], events: pd.DataFrame, stale_ms: int) -> dict[int, tuple]:
    """States of the actions that have events; events: action_id, at, event_id and the rest in any order."""
    got = events.assign(ms=events["at"].astype("datetime64[ms]").astype("int64")).sort_values(["action_id", "at", "event_id"], kind="stable")
    return {a: fold(known.get(a, NEW), (r[1:] for r in rows), stale_ms) for a, rows in groupby(plain(got, ["action_id", *FOLDED]), key=lambda r: r[0])}


def states(events: DataFrame, stale_seconds: int, late: str = "0 seconds") -> DataFrame:
    """A stream of changed states: OUT. Events older than the watermark (the newest time less `late`) are dropped."""
    stale_ms = 1000 * stale_seconds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {a[0]: tuple(a[1:]) for a in state.get[0]} if state.exists else {}
        changed = {} if state.hasTimedOut else changed_states(known, pd.concat(list(batches)), stale_ms)
        mark = state.getCurrentWatermarkMs()
        # No watermark yet is 0.
        changed |= {a: (LOST, *s[1:]) for a, s in (known | changed).items() if s[0] == RUNNING and 0 < mark and mark - s[5] > stale_ms}
        now = known | changed
        state.update(([(a, *s) for a, s in now.items()],))
        waiting = [s[5] for s in now.values() if s[0] == RUNNING]
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting) + stale_ms, mark + 1))
        if changed:
            yield pd.DataFrame([(a, *s) for a, s in changed.items()], columns=[c.split()[0] for c in OUT.split(", ")]).astype({"compared_hash": "Int64", "last_ms": "Int64"})

    known = events.filter("action_id is not null and at is not null and kind is not null").withWatermark("at", late)
    # A column of longs with nulls would reach Python as doubles.
    rows = known.select(F.pmod(F.xxhash64("action_id"), F.lit(BUCKETS)).alias("bucket"), "action_id", "at", F.coalesce("event_id", F.lit(2**63 - 1)).alias("event_id"), "kind", F.col("hash").cast("string").alias("hash"), "status", "attempt")
    return rows.groupBy("bucket").applyInPandasWithState(step, OUT, f"actions array<struct<{OUT}>>", "update", GroupStateTimeout.EventTimeTimeout)


def keep_states(events: DataFrame, root: str, checkpoint: str, stale_seconds: int, late: str = "0 seconds") -> StreamingQuery:
    """Append the changed states of every batch to a log of commits, and end when all events are read.

    A batch that is run again appends the same states again; the later commit wins with the same values.
    """

    def add(batch: DataFrame, n: int) -> None:
        commits.append(batch.withColumn("batch", F.lit(n).cast("long")), root)

    return states(events, stale_seconds, late).writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The last state of every action."""
    schema = spark.createDataFrame([], f"{OUT}, batch long").schema
    return commits.current(spark, root, schema, ["action_id"], ["batch"]).drop("batch")
