import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from quillfold.sources import commits
from quillfold.streaming import actions as A

START = datetime(2024, 1, 1)
NEW = (None, None, False, 0, 0, None)


def event(action, minute, kind, digest=None, status=None, attempt=None, n=0):
    return (action, START + timedelta(minutes=minute), n, kind, digest, status, attempt)


def write(spark, path, events):
    spark.createDataFrame(events, A.EVENTS).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, stale=3600):
    stream = spark.readStream.schema(A.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    A.keep_states(stream, f"file://{tmp_path}/states", f"{tmp_path}/checkpoint", stale).awaitTermination()
    return {r["action_id"]: tuple(r)[1:] for r in A.current(spark, f"file://{tmp_path}/states").collect()}


def plainly(events, stale_ms, end_ms):
    """The same states, event by event, without the operator."""
    out = {}
    for action, at, n, kind, digest, status, attempt in sorted((e for e in events if e[0] is not None and e[1] is not None and e[3] is not None), key=lambda e: (e[1], e[2])):
        s = out.setdefault(action, {"status": None, "hash": None, "ok": False, "tries": 0, "n": 0, "last": None})
        ms = round((at - datetime(1970, 1, 1)).total_seconds() * 1000)
        if s["status"] == "running" and ms - s["last"] > stale_ms:
            s["status"] = "unknown"
        if kind == "comparison":
            if s["hash"] != digest:
                s["ok"] = False
            s["hash"] = digest
        if kind == "approval" and digest is not None and digest == s["hash"]:
            s["ok"] = True
        if kind == "edit":
            s["hash"], s["ok"] = None, False
        if kind == "transition":
            s["status"] = status or s["status"]
            s["tries"] += attempt is True
        s["n"] += 1
        s["last"] = ms
    for s in out.values():
        if s["status"] == "running" and end_ms - s["last"] > stale_ms:
            s["status"] = "unknown"
    return {a: tuple(s.values()) for a, s in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_restarts_and_batches_do_not_change_the_result(spark, tmp_path, seed):
    r = random.Random(seed)
    events, batches = [], 3
    for b in range(batches):
        part = [
            event(r.choice([None, *range(6)]) if r.random() < 0.1 else r.randrange(6), b * 400 + r.randrange(400), r.choice(["comparison", "approval", "edit", "transition", None]), r.choice([1, 2, None]), r.choice(["running", "failed", None]), r.choice([True, False, None]), n=b * 100 + k)
            for k in range(50)
        ]
        events += part
        write(spark, f"{tmp_path}/events", part)
        got = run(spark, tmp_path)
    end = max(round((e[1] - datetime(1970, 1, 1)).total_seconds() * 1000) for e in events if e[0] is not None and e[3] is not None)
    assert got == plainly(events, 3_600_000, end)


def test_a_timer_marks_what_nobody_finished(spark, tmp_path):
    write(spark, f"{tmp_path}/events", [event(1, 0, "transition", None, "running", True), event(2, 30, "transition", None, "running", True)])
    assert {a: s[0] for a, s in run(spark, tmp_path).items()} == {1: "running", 2: "running"}
    write(spark, f"{tmp_path}/events", [event(3, 70, "transition", None, "planned", False)])
    assert {a: s[0] for a, s in run(spark, tmp_path).items()} == {1: "unknown", 2: "running", 3: "planned"}
    write(spark, f"{tmp_path}/events", [event(2, 80, "transition", None, "succeeded", False), event(1, 81, "approval", 5)])
    got = run(spark, tmp_path)
    assert got[1][0] == "unknown" and got[2][0] == "succeeded" and got[2][3] == 1


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    write(spark, f"{tmp_path}/events", [event(1, 0, "comparison", 7), event(1, 1, "approval", 7)])
    before = run(spark, tmp_path)
    root = f"file://{tmp_path}/states"
    schema = spark.createDataFrame([], f"{A.OUT}, batch long").schema
    commits.append(commits.snapshot(spark, root, schema).drop("_version"), root)
    assert {r["action_id"]: tuple(r)[1:] for r in A.current(spark, root).collect()} == before and before[1][:3] == (None, 7, True)
    assert run(spark, tmp_path) == before


def test_fold_of_ties_and_nulls():
    rows = pd.DataFrame([(0, "comparison", None, None, None), (0, "approval", None, None, None), (1, "transition", None, None, True), (2, "other", None, None, None)], columns=["ms", "kind", "hash", "status", "attempt"]).astype(object)
    assert A.folded(NEW, rows, 10) == (None, None, False, 1, 4, 2)


def test_states_share_buckets(spark, tmp_path, monkeypatch):
    """Python is called and state kept by bucket, not by action; long hashes stay exact beside null ones, timers hold for each action."""
    monkeypatch.setattr(A, "BUCKETS", 8, raising=False)
    big, events = 2**62, []
    for b in range(2):
        part = [e for a in range(300) for e in (event(a, b * 300 + a % 5, "comparison", big + a, n=1), event(a, b * 300 + a % 5, "approval", big + a + a % 2, n=2), event(a, b * 300 + 6, "transition", None, "running" if (a + b) % 3 else None, True, n=3))]
        part = [e for e in part if b == 0 or e[0] % 4]
        events += part
        write(spark, f"{tmp_path}/events", part)
        stream = spark.readStream.schema(A.EVENTS).parquet(f"{tmp_path}/events")
        query = A.keep_states(stream, f"file://{tmp_path}/states", f"{tmp_path}/checkpoint", 3600)
        query.awaitTermination()
    assert {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]} == {8}
    end = max(round((e[1] - datetime(1970, 1, 1)).total_seconds() * 1000) for e in events)
    got = {r["action_id"]: tuple(r)[1:] for r in A.current(spark, f"file://{tmp_path}/states").collect()}
    assert got == plainly(events, 3_600_000, end)
    assert {s[0] for s in got.values()} == {None, "running", "unknown"} and {s[2] for s in got.values()} == {True, False}
