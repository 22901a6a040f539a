"""Attention as a stream: keyed state per subject, a change feed, and windowed activity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "snapshot string, revision long, workflow string"
OUTPUT = "slug string, snapshot string, revision long, workflow string, event string"


class Attention(StatefulProcessor):
    """Latest snapshot, revision and workflow of each subject; a changed snapshot reopens it.

    Rows of one subject in a micro-batch are taken in order of ``seq``. First sight is revision 1:
    done if fresh, else open, without an event. A row with the same snapshot changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attention", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        out = []
        current = self.state.get() if self.state.exists() else None
        for row in pd.concat(rows).sort_values("seq", kind="stable").itertuples():
            if current is None:
                current = (row.snapshot, 1, "done" if row.fresh else "open")
                out.append((key[0], *current, None))
            elif row.snapshot != current[0]:
                current = (row.snapshot, current[1] + 1, "open")
                out.append((key[0], *current, "source-reopened"))
        if current is not None:
            self.state.update(current)
        yield pd.DataFrame(out, columns=["slug", "snapshot", "revision", "workflow", "event"])

    def close(self) -> None:
        pass


def attention_stream(seen: DataFrame) -> DataFrame:
    """State changes of subjects from a stream of (slug, snapshot, fresh, seq); needs the RocksDB state store."""
    return seen.groupBy("slug").transformWithStateInPandas(Attention(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def change_feed(states: DataFrame, key: str = "slug", digest: str = "snapshot", within: str = "10 minutes") -> DataFrame:
    """Rows whose (key, digest) was not seen within the watermark on ``ts``: one notice a change, repeats are dropped."""
    return states.withWatermark("ts", within).dropDuplicatesWithinWatermark([key, digest])


def activity(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each event type in windows, late rows up to the watermark counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").alias("day"), "event_type", "n", "value")
