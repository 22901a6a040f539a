"""Current ledgers beside their histories, and how findings are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger_states(current: DataFrame, histories: DataFrame) -> DataFrame:
    """(slug, state) of current ledgers (slug, observation) and histories (slug, place from 0, observation).

    ``current``: the ledger is the last entry; ``history-ahead``: one entry follows it, or there is no ledger yet and one entry; ``history-missing``;
    ``mismatch``: no entry is the ledger's, or more than one follows; ``history-without-current``: several entries and no ledger.
    """
    h = histories.groupBy("slug").agg(F.count("*").alias("entries"))
    at = current.join(histories.select("slug", "observation", "place"), ["slug", "observation"], "left").groupBy("slug").agg(F.max("place").alias("place"))
    both = at.withColumn("has_current", F.lit(True)).join(h, "slug", "full")
    trailing = F.col("entries") - F.col("place") - 1
    state = (
        F.when(F.col("has_current").isNull(), F.when(F.col("entries") == 1, "history-ahead").otherwise("history-without-current")).when(F.col("entries").isNull(), "history-missing")
        .when(F.col("place").isNull() | (trailing > 1), "mismatch").when(trailing == 1, "history-ahead").otherwise("current")
    )
    return both.select("slug", state.alias("state"))


def finding_rows(findings: DataFrame, states: DataFrame) -> DataFrame:
    """(finding, status, lifecycle, blocking, derivation, policy_drift) of findings by their effective states; one without a state is unknown, and blocks.

    An accepted risk whose time is over is ``expired``; one that no longer holds for another reason has drifted from the policy.
    """
    s = states.select("finding", "disposition", "lifecycle", "blocking", "derivation", "expiry_state")
    joined = findings.select("finding").distinct().join(s, "finding", "left")
    invalidated = F.col("derivation") == "carry-invalidated"
    expired = invalidated & (F.col("expiry_state") == "expired")
    status = F.when(F.col("derivation").isNull(), "unknown").when(expired, "expired").when(F.col("disposition") == "accepted-risk", "accepted").otherwise(F.col("disposition"))
    return joined.select(
        "finding", status.alias("status"), F.coalesce("lifecycle", F.lit("unknown")).alias("lifecycle"), F.coalesce("blocking", F.lit(True)).alias("blocking"), F.coalesce("derivation", F.lit("decision-state-unavailable")).alias("derivation"),
        F.coalesce(invalidated & (F.col("expiry_state") != "expired"), F.lit(False)).alias("policy_drift"),
    )


def ordered_findings(rows: DataFrame, groups: list[list[str]], severities: list[str], unit: str) -> DataFrame:
    """``rows`` (unit, finding, status, severity, title) with ``group`` and ``rank`` in their unit: groups of statuses in order, in them the worst severity first, then title."""
    group, severity = F.lit(len(groups)), F.lit(len(severities))
    for i, names in reversed(list(enumerate(groups))):
        group = F.when(F.col("status").isin(names), i).otherwise(group)
    for i, name in reversed(list(enumerate(severities))):
        severity = F.when(F.col("severity") == name, i).otherwise(severity)
    return rows.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy(unit).orderBy("group", severity, "title", "finding")))
