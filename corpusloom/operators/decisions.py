"""Append-only decision logs folded to effective state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chained(rows: DataFrame, ledger: str, order: str, payload: list[str]) -> DataFrame:
    """(ledger, order, digest, previous, intact): each row's digest, and whether a stored link to the row before holds.

    The digest covers the row's own payload; ``previous`` is the digest of the row before in its ledger, null for the first.
    """
    digest = F.sha2(F.concat_ws("\0", ledger, order, *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in payload]), 256)
    w = Window.partitionBy(ledger).orderBy(order)
    return rows.withColumn("digest", digest).withColumn("previous", F.lag("digest").over(w)).select(ledger, order, "digest", "previous")


def broken_links(chain: DataFrame, ledger: str, order: str) -> DataFrame:
    """Rows whose stored ``previous`` is not the digest of the row before; the first must have none."""
    before = F.lag("digest").over(Window.partitionBy(ledger).orderBy(order))
    return chain.withColumn("expected", before).where(~F.col("previous").eqNullSafe(F.col("expected"))).select(ledger, order, "previous", "expected")


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key by ``order``: an aggregate, so a key of any length is reduced before it is shuffled."""
    columns = events.columns
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_e")).select("_e.*")


def expiry_state(expires: Column, now: Column, warning_days: int) -> Column:
    """expired at or after the deadline, warning within the last days before it, else active; null without a deadline."""
    return (
        F.when(expires.isNull(), F.lit(None).cast("string"))
        .when(expires <= now, "expired")
        .when(expires <= now + F.expr(f"INTERVAL {warning_days} DAYS"), "warning")
        .otherwise("active")
    )


#: Actions that close a finding, and those that carry to the next occurrence.
CLOSING = ["remediated", "false-positive", "superseded"]
CARRIED = ["accepted-risk", "separate-design"]


def effective_state(findings: DataFrame, blocking: list[str], require_disposition: bool = True) -> DataFrame:
    """Effective state of findings without reconciliations: adds disposition, derivation, lifecycle, blocks.

    Input: finding, current (occurrences now), action (the last event's, or null), on_current
    (whether that event is about a current occurrence), context_current, expired, compatible.
    """
    n, e, on, ok = F.col("current"), F.col("action"), F.col("on_current"), F.col("context_current") & ~F.col("expired")
    direct = on | (n == 0)
    derivation = (
        F.when(e.isNull(), "implicit-open")
        .when(on & (n > 1), "reconciliation-conflict")
        .when(direct & ~ok, "carry-invalidated")
        .when(direct, "explicit-event")
        .when(e.isin(CLOSING), "automatic-reopen")
        .when(e.isin(CARRIED) & ~F.col("compatible"), "carry-invalidated")
        .otherwise("carried")
    )
    d = F.col("derivation")
    disposition = F.when(d.isin("implicit-open", "reconciliation-conflict", "carry-invalidated"), "open").when(d == "automatic-reopen", "reopened").otherwise(e)
    lifecycle = (
        F.when(d == "implicit-open", F.when(n > 0, "new").otherwise("unknown"))
        .when(d == "reconciliation-conflict", "unknown")
        .when(d == "automatic-reopen", "reopened")
        .when(d == "carry-invalidated", F.when(n > 0, "persisting").otherwise("unknown"))
        .when((d == "explicit-event") & (e == "remediated") & (n == 0), "resolved")
        .when(e == "reopened", "reopened")
        .when((d == "explicit-event") & e.isin("false-positive", "superseded"), "unknown")
        .otherwise(F.when(n > 0, "persisting").otherwise("unknown"))
    )
    policy = F.col("disposition").isin(list(blocking)) | (F.col("disposition") == "reopened") | ((F.col("disposition") == "open") & F.lit(require_disposition))
    blocks = F.when(d.isin("reconciliation-conflict", "carry-invalidated", "automatic-reopen"), True).when((d == "implicit-open"), (n > 0) & policy).when((d == "carried") & F.col("disposition").isin("open", "reopened"), True).otherwise(policy)
    return findings.withColumn("derivation", derivation).withColumn("disposition", disposition).withColumn("lifecycle", lifecycle).withColumn("blocks", blocks)


def identity_conflicts(ids: DataFrame) -> DataFrame:
    """(problem, key, n) from (id, digest): an id with equal rows is a duplicate, with different digests a collision; a digest under two ids an alias."""
    by_id = ids.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("digests"))
    by_digest = ids.groupBy("digest").agg(F.count_distinct("id").alias("n"))
    problem = F.when(F.col("digests") > 1, "collision").otherwise("duplicate")
    return by_id.where("n > 1").select(problem.alias("problem"), F.col("id").alias("key"), "n").unionByName(by_digest.where("n > 1").select(F.lit("alias").alias("problem"), F.col("digest").alias("key"), "n"))


def review_sufficiency(reviews: DataFrame, least: int) -> DataFrame:
    """(subject, approvals, sufficient): distinct approving reviewers who are neither actor nor owner."""
    fair = (F.col("approves")) & ~F.col("reviewer").eqNullSafe(F.col("actor")) & ~F.col("reviewer").eqNullSafe(F.col("owner"))
    return reviews.groupBy("subject").agg(F.count_distinct(F.when(fair, F.col("reviewer"))).alias("approvals")).withColumn("sufficient", F.col("approvals") >= least)
