"""Attention with readers' actions as a stream: state by subject, snoozes that end by a timer, results in a table."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "snapshot string, revision long, workflow string, until long"
#: A row of the stream: ``kind`` is seen, or what a reader does; times in milliseconds, ``ts`` is ``at`` as a timestamp.
ROW = "slug string, ts timestamp, at long, seq long, kind string, snapshot string, fresh boolean, revision long, until long, note string"
OUTPUT = "slug string, at long, seq long, snapshot string, revision long, workflow string, event string, outcome string"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: What a batch's fold gives: rows to tell, each subject's state after it (``until`` is only the state's), and the latest time seen (``mark``).
FOLDED = f"what string, {OUTPUT}, until long"
FOLDED_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in FOLDED.split(", ")])

#: Outcomes of a review, those that need a note, and the longest snooze.
OUTCOMES, WITH_NOTE, MOST_SNOOZE = ("understood", "decided", "acted", "no-action"), ("understood", "decided"), 365 * 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Row(NamedTuple):
    """A row to fold; ``place`` is 0 for a state from before, with ``kind`` as its workflow, and 1 for a row of the stream."""

    slug: str
    place: int
    at: int
    seq: int
    kind: str
    snapshot: str | None
    fresh: bool | None
    revision: int
    until: int
    note: str | None


def woken(slug: str, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
    """The state at ``now`` and what is told if a snooze has ended by then."""
    snapshot, revision, workflow, until = state
    if workflow != "snoozed" or until > now:
        return state, []
    return (snapshot, revision + 1, "open", -1), [(slug, until, -1, snapshot, revision + 1, "open", "reopened", None)]


def applied(state: tuple | None, row) -> tuple[tuple | None, str | None, str | None, bool]:
    """(state, event, outcome, whether to tell) after one row."""
    if row.kind == "seen":
        if state is None:
            return (row.snapshot, 1, "done" if row.fresh else "open", -1), None, None, True
        if row.snapshot != state[0]:
            return (row.snapshot, state[1] + 1, "open", -1), "source-reopened", None, True
        return state, None, None, False
    refused = (
        "unknown-subject" if state is None else "stale-snapshot" if row.snapshot is not None and row.snapshot != state[0] else "stale-revision" if row.revision >= 0 and row.revision != state[1]
        else "unknown-action" if row.kind not in ("snooze", "reopen", *OUTCOMES) else "note-required" if row.kind in WITH_NOTE and not (row.note or "").strip()
        else "past" if row.kind == "snooze" and row.until <= row.at else "too-long" if row.kind == "snooze" and row.until - row.at > MOST_SNOOZE else None
    )
    if refused:
        return state, "refused", refused, True
    snapshot, revision, _, _ = state
    if row.kind == "snooze":
        return (snapshot, revision + 1, "snoozed", int(row.until)), "snoozed", None, True
    if row.kind == "reopen":
        return (snapshot, revision + 1, "open", -1), "reopened", None, True
    return (snapshot, revision + 1, "done", -1), "reviewed", row.kind, True


class Workflow(StatefulProcessor):
    """Revision and workflow of each subject.

    Seen first, a subject is open, or done if fresh, with revision 1 and no event. Another snapshot opens
    it again. A reader's action must name the current snapshot and revision (null isn't checked), or it is refused and says why. A snooze
    ends at its time: by a timer, or when the next row of the subject is later, whichever comes first, with the same result. So
    results don't depend on how rows are cut into batches, if a subject's rows come in order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("workflow", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # Each call to the state's store is a round trip for a subject, so it is read once, and written only if it changed.
        before, parts, out = self.state.get(), list(rows), []
        state = before
        for row in (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(["at", "seq"], kind="stable").itertuples():
            if state is not None:
                state, ended = woken(key[0], state, row.at)
                out += ended
            state, event, outcome, told = applied(state, row)
            if event == "snoozed":
                self.handle.registerTimer(state[3])
            if told:
                out.append((key[0], row.at, row.seq, *(state[:3] if state else (None, None, None)), event, outcome))
        if state is not None and state != before:
            self.state.update(state)
        yield pd.DataFrame(out, columns=COLUMNS).astype({"revision": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, state = [], self.state.get()
        if state is not None:
            state, out = woken(key[0], state, expiredTimerInfo.getExpiryTimeInMs())
            if out:
                self.state.update(state)
        yield pd.DataFrame(out, columns=COLUMNS).astype({"revision": "Int64"})

    def close(self) -> None:
        pass


def workflow_stream(rows: DataFrame, by_event_time: bool = True) -> DataFrame:
    """Changes (slug, at, seq, snapshot, revision, workflow, event, outcome) from a stream of ROW; seq is -1 where a snooze ended.

    Timers go by the stream's own time, or by the clock where readers wait for them.
    """
    timed = rows.na.fill({"revision": -1, "until": -1})
    if by_event_time:
        timed = timed.withWatermark("ts", "0 seconds")
    return timed.groupBy("slug").transformWithStateInPandas(Workflow(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime" if by_event_time else "ProcessingTime")


def folded(mark: int, size: int = 50_000):
    """A fold of Row tuples that come by subject, each subject's state first, then its rows in order: FOLDED, up to the time ``mark``.

    Subjects may go on over the ends of Arrow batches, so one subject's state and about ``size`` rows to give are all that is held.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOLDED_SCHEMA, strict=True)], schema=FOLDED_SCHEMA)
        rows, out = (Row._make(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), []
        for slug, own in groupby(rows, key=lambda r: r.slug):
            state = None
            for row in own:
                if not row.place:
                    state = (row.snapshot, row.revision, row.kind, row.until)
                    continue
                if state is not None:
                    state, ended = woken(slug, state, row.at)
                    out += [("told", *e, None) for e in ended]
                state, event, outcome, told = applied(state, row)
                if told:
                    out.append(("told", slug, row.at, row.seq, *(state[:3] if state else (None, None, None)), event, outcome, None))
                if len(out) >= size:
                    yield packed(out)
                    out = []
            if state is not None:
                state, ended = woken(slug, state, mark)
                out += [("told", *e, None) for e in ended]
                out.append(("state", slug, None, None, *state[:3], None, None, state[3]))
        if out:
            yield packed(out)

    return fold


def run_workflow(spark: SparkSession, folder: str, out: str, checkpoint: str, by_event_time: bool = True) -> None:
    """Process the files of ROW in ``folder`` that were not yet processed into the Parquet table ``out``.

    What was done, the state and its timers are kept in ``checkpoint``, so the next call goes on where this one, or one that
    failed, ended; each batch is kept once. By event time a batch's subjects are folded many in a task,
    from the states that the batch before it left, as a call to a state's store for each subject costs more than its rows do: a batch's fold is
    written beside the checkpoint by its number, and what is told as that batch's part (column ``batch``) of ``out``, in place of what a run that failed left.
    """
    source = spark.readStream.schema(ROW).option("recursiveFileLookup", "true").parquet(folder)
    if by_event_time:
        at = lambda number: f"{checkpoint}/folds/{number}"

        def keep(batch: DataFrame, number: int) -> None:
            session = batch.sparkSession
            before = session.read.schema(FOLDED).parquet(at(number - 1)) if number else session.createDataFrame([], FOLDED)
            marks = before.where("what = 'mark'").select("at").union(batch.select("at"))
            mark = marks.agg(F.max("at")).first()[0]
            if mark is None:
                mark = -1
            states = before.where("what = 'state'").select("slug", F.lit(0).alias("place"), "at", "seq", F.col("workflow").alias("kind"), "snapshot", F.lit(None).cast("boolean").alias("fresh"), "revision", "until", F.lit(None).cast("string").alias("note"))
            rows = batch.na.fill({"revision": -1, "until": -1}).withColumn("place", F.lit(1)).select(*Row._fields)
            ordered = states.unionByName(rows).repartition("slug").sortWithinPartitions("slug", "place", "at", "seq")
            latest = session.range(1).select(F.lit("mark").alias("what"), F.lit(mark).cast("long").alias("at"))
            ordered.mapInArrow(folded(mark), FOLDED).unionByName(latest, allowMissingColumns=True).write.mode("overwrite").parquet(at(number))
            told = session.read.schema(FOLDED).parquet(at(number)).where("what = 'told'").select(*COLUMNS, F.lit(number).alias("batch"))
            told.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)

        source.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        query = workflow_stream(source, by_event_time).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
