"""The workflow stream: however its rows are cut into runs, and when a run is repeated."""

import os
import time

import pandas as pd

from corpusloom.plans import streams
from corpusloom.streaming.workflow import ROW, Workflow, run_workflow

SF, DAY = "/root/testdata/sf0.001", 86_400_000


def test_cuts_into_runs_change_nothing(spark, monkeypatch):
    found = []
    for parts in (1, 4):
        monkeypatch.setattr(streams, "PARTS", parts)
        found.append(sorted(map(repr, streams.attention_workflow(spark, SF).collect())))
    assert found[0] == found[1] and any("reopened" in r and "seq=-1" in r for r in found[0])


def test_a_snooze_ends_without_another_row_of_its_subject(spark, tmp_path):
    run = lambda: run_workflow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    def put(part, *rows):
        full = [(slug, at, seq, kind, snapshot, True, revision, until, note) for slug, at, seq, kind, snapshot, revision, until, note in rows]
        df = spark.createDataFrame(full, "slug string, at long, seq long, kind string, snapshot string, fresh boolean, revision long, until long, note string")
        df.selectExpr("slug", "timestamp_millis(at) as ts", "at", "seq", "kind", "snapshot", "fresh", "revision", "until", "note").to(spark.createDataFrame([], ROW).schema).write.parquet(f"{tmp_path}/in/{part}")

    put(0, ("a", DAY, 1, "seen", "x", None, None, None), ("a", DAY + 10, 2, "snooze", "x", 1, 2 * DAY, None), ("b", DAY + 20, 3, "decided", None, None, None, "n"))
    run()
    run()  # nothing new: nothing is told twice
    table = lambda: sorted((r.slug, r.at, r.seq, r.revision, r.workflow, r.event, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    first = [("a", DAY, 1, 1, "done", None, None), ("a", DAY + 10, 2, 2, "snoozed", "snoozed", None), ("b", DAY + 20, 3, None, None, "refused", "unknown-subject")]
    assert table() == first
    put(1, ("c", 3 * DAY, 4, "seen", "y", None, None, None))
    run()
    assert table() == sorted([*first, ("a", 2 * DAY, -1, 3, "open", "reopened", None), ("c", 3 * DAY, 4, 1, "done", None, None)])
    put(2, ("a", 4 * DAY, 5, "decided", "x", 3, None, " "), ("a", 4 * DAY, 6, "decided", "x", 3, None, "why"), ("a", 4 * DAY, 7, "reopen", "x", 3, None, None))
    run()
    assert [r[3:] for r in table() if r[2] >= 5] == [(3, "open", "refused", "note-required"), (4, "done", "reviewed", "decided"), (4, "done", "refused", "stale-revision")]


def test_a_subject_reads_its_state_once_and_writes_it_if_it_changed():
    calls = []

    class State:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    flow = Workflow()
    flow.state, flow.handle = State(), None
    seen = pd.DataFrame([(1, 1, "seen", "x", False, -1, -1, None)], columns=["at", "seq", "kind", "snapshot", "fresh", "revision", "until", "note"])
    told = [next(flow.handleInputRows(("s",), iter([rows]), None)) for rows in (seen, seen.assign(at=2), seen.assign(at=3, snapshot="y"))]
    assert [len(t) for t in told] == [1, 0, 1] and flow.state.held == ("y", 2, "open", -1)
    assert calls == ["get", "update", "get", "get", "update"]


def test_many_subjects_are_folded_together_and_a_repeated_batch_is_kept_once(spark, tmp_path):
    """A subject costs what its rows cost: forty thousand of them take seconds, also over the ends of Arrow batches."""
    run = lambda: run_workflow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    one = "concat('s', id % 40000) as slug, timestamp_millis(at) as ts, at, id as seq, kind, 'x' as snapshot, false as fresh, cast(null as long) as revision, until, 'why' as note"
    put = lambda part, rows: spark.sql(f"select {one} from ({rows})").write.parquet(f"{tmp_path}/in/{part}")
    put(0, f"select id, {DAY} + id as at, if(id < 40000, 'seen', 'snooze') as kind, if(id < 40000, null, {3 * DAY}) as until from range(80000)")
    begin = time.monotonic()
    run()
    assert time.monotonic() - begin < 40
    put(1, f"select id, {4 * DAY} + id as at, 'acted' as kind, cast(null as long) as until from range(40)")
    run()
    told = lambda: {tuple(r)[:4]: r.n for r in spark.read.parquet(f"{tmp_path}/out").groupBy("event", "workflow", "revision", "outcome").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    want = {(None, "open", 1, None): 40_000, ("snoozed", "snoozed", 2, None): 40_000, ("reopened", "open", 3, None): 40_000, ("reviewed", "done", 4, "acted"): 40}
    assert told() == want
    # As if the run had failed before it said that its batch was done.
    for name in ("1", ".1.crc"):
        os.remove(tmp_path / "checkpoint" / "commits" / name)
    run()
    assert told() == want
