"""Attention: which subjects need a look, from snapshots over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(states: DataFrame, seen: DataFrame, now) -> DataFrame:
    """Next state of each subject (slug, snapshot, revision, workflow, event) from stored ``states`` and what is ``seen`` now.

    First sight: done if fresh, else open, revision 1, no event. Another snapshot: open, revision
    + 1, ``source-reopened``. Snoozed without a deadline ahead: open, revision + 1, ``reopened``.
    Freshness never closes work. Subjects no longer seen keep their state.
    """
    s = states.select("slug", F.col("snapshot").alias("old_snapshot"), "revision", "workflow", "snoozed_until")
    j = seen.select("slug", "snapshot", "fresh").join(s, "slug", "full")
    first = F.col("revision").isNull()
    changed = F.col("snapshot").isNotNull() & (F.col("snapshot") != F.col("old_snapshot"))
    woken = (F.col("workflow") == "snoozed") & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now))
    event = F.when(first, F.lit(None).cast("string")).when(changed, "source-reopened").when(woken, "reopened")
    return j.select(
        "slug",
        F.coalesce("snapshot", "old_snapshot").alias("snapshot"),
        F.when(first, F.lit(1)).when(changed | woken, F.col("revision") + 1).otherwise(F.col("revision")).cast("long").alias("revision"),
        F.when(first, F.when(F.col("fresh"), "done").otherwise("open")).when(changed | woken, "open").otherwise(F.col("workflow")).alias("workflow"),
        event.alias("event"),
    )


def act(states: DataFrame, actions: DataFrame) -> DataFrame:
    """Outcome of each action (slug, snapshot, revision, outcome, note): applied, or why not.

    An action must name the current snapshot and revision; ``understood`` and ``decided`` need a note.
    """
    s = states.select("slug", F.col("snapshot").alias("now_snapshot"), F.col("revision").alias("now_revision"))
    result = (
        F.when(F.col("now_revision").isNull(), "unknown-subject")
        .when(F.col("snapshot") != F.col("now_snapshot"), "stale-snapshot")
        .when(F.col("revision") != F.col("now_revision"), "stale-revision")
        .when(F.col("outcome").isin("understood", "decided") & (F.trim(F.coalesce("note", F.lit(""))) == ""), "note-required")
        .otherwise("applied")
    )
    return actions.join(s, "slug", "left").select("slug", "revision", "outcome", result.alias("result"))


def revisions(snapshots: DataFrame, key: str, order: list[str], snapshot: str) -> DataFrame:
    """(key, snapshots, revision, reopened): replay of a subject's snapshots; each change of snapshot is a revision and a reopening."""
    before = F.lag(snapshot).over(Window.partitionBy(key).orderBy(*order))
    marked = snapshots.withColumn("_change", (before.isNotNull() & (before != F.col(snapshot))).cast("long"))
    return marked.groupBy(key).agg(F.count("*").alias("snapshots"), (F.sum("_change") + 1).alias("revision"), F.sum("_change").alias("reopened"))


def bucket(workflow, snoozed_until, now):
    """open, snoozed, reviewed or baseline."""
    return F.when(workflow == "open", "open").when((workflow == "snoozed") & (snoozed_until > now), "snoozed").when(workflow == "snoozed", "open").when(workflow == "done", "reviewed").otherwise("baseline")


def ordered_items(items: DataFrame) -> DataFrame:
    """``items`` (slug, workflow, place) with their rank: open, snoozed, done, and in each as they came. Pages of concepts are few, so one task ranks them."""
    by = F.when(F.col("workflow") == "open", 0).when(F.col("workflow") == "snoozed", 1).otherwise(2)
    return items.withColumn("rank", F.row_number().over(Window.orderBy(by, "place")))


def health(documents: DataFrame, concepts: DataFrame, broken: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row of counters: documents (path, status) but the root, concept pages (status), broken references and orphans."""
    of = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    d = documents.where("path <> ''").agg(of("outdated", "documents_outdated"), of("missing", "documents_missing"), of("ignored", "documents_ignored"), F.count("*").alias("documents"))
    c = concepts.agg(of("fresh", "concepts_fresh"), of("outdated", "concepts_outdated"), of("broken-source", "concepts_broken"), F.count("*").alias("concepts"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return d.crossJoin(c).crossJoin(one(broken, "broken_references")).crossJoin(one(orphans, "orphans"))  # single rows
