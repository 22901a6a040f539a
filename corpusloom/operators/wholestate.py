"""The whole state in a few rows: coverage in sixteen counters, findings by severity, and a gate over areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("fresh", "missing", "stale", "invalid")


def coverage_counters(entries: DataFrame, invalid_ledgers: DataFrame, first: str = "security", second: str = "test", unknown_is_missing: bool = True) -> DataFrame:
    """One row of counters over entries (path, kind, domains: map of domain to status), a row for each path.

    tracked, excluded, unclassified, conflicted; of review entries those that need each domain, by status, and those that need both; and ``invalid_ledgers``.
    A status that isn't known counts as missing where the report is made, and as none where it is read (``unknown_is_missing`` false).
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    review = F.col("kind") == "review"
    needs = lambda d: review & F.coalesce(F.map_contains_key("domains", F.lit(d)), F.lit(False))
    status = lambda d: F.try_element_at("domains", F.lit(d))

    def of(domain: str, s: str):
        same = F.coalesce(status(domain) == s, F.lit(False))
        if s == "missing" and unknown_is_missing:
            same = ~F.coalesce(status(domain).isin("fresh", "stale", "invalid"), F.lit(False))
        return F.count_if(needs(domain) & same).alias(f"{domain}_{s}")

    counters = entries.agg(
        F.count("*").alias("tracked"), *[c for d in (first, second) for c in (F.count_if(needs(d)).alias(f"{d}_required"), *[of(d, s) for s in STATUSES])], F.count_if(needs(first) & needs(second)).alias("dual_required"),
        kind("excluded").alias("excluded"), kind("unclassified").alias("unclassified"), kind("conflict").alias("conflicted"),
    )
    return counters.crossJoin(invalid_ledgers.agg(F.count("*").alias("invalid_ledgers")))  # two single rows


def open_by_severity(findings: DataFrame, order: list[str]) -> DataFrame:
    """(domain, open, highest, counts: map of severity to how many) of findings (domain, severity, open); severities from the worst on, those without any left out."""
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    each = findings.where("open").groupBy("domain", "severity").agg(F.count("*").alias("n")).withColumn("rank", rank)
    listed = F.array_sort(F.collect_list(F.struct("rank", "severity", "n")))
    return each.groupBy("domain").agg(F.sum("n").alias("open"), F.min_by("severity", "rank").alias("highest"), F.map_from_entries(F.transform(listed, lambda e: F.struct(e["severity"], e["n"]))).alias("counts"))


def finding_total(findings: DataFrame, key: str, most: int = 2**53 - 1) -> DataFrame:
    """(key, findings, overflow) of rows with a count of their own (null: one): sums in decimals, so that what passes ``most`` is told, not wrapped."""
    total = F.sum(F.coalesce("count", F.lit(1)).cast("decimal(38,0)"))
    return findings.groupBy(key).agg(F.when(total <= most, total.cast("long")).alias("findings"), (total > most).alias("overflow"))


def gate(diagnostics: DataFrame, areas: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """(area, errors, passes) for each area and ``all``: an area passes without diagnostics (area, code), but for those allowed (area, code)."""
    held = diagnostics if allowed is None else diagnostics.join(allowed.distinct(), ["area", "code"], "left_anti")
    counts = held.groupBy("area").agg(F.count("*").alias("errors"))
    known = diagnostics.sparkSession.createDataFrame([(a,) for a in areas], "area string")
    rows = known.join(counts, "area", "left").select("area", F.coalesce("errors", F.lit(0)).alias("errors"))
    both = rows.unionByName(rows.agg(F.lit("all").alias("area"), F.sum("errors").alias("errors")))
    return both.withColumn("passes", F.col("errors") == 0)
