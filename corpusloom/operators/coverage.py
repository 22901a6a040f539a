"""Declared policy, evidence and coverage: classification, evidence joins, roll-ups, verdicts, queues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import selected


@dataclass(frozen=True)
class Rule:
    """One rule of a policy: paths by glob, and the domains that must review them, or why they are excluded."""

    id: str
    include: list[str]
    domains: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    excluded: bool = False


@dataclass(frozen=True)
class Unit:
    domain: str
    slug: str
    include: list[str]
    exclude: list[str] = field(default_factory=list)


def matched(path: Column, rules: list[Rule] | list[Unit], name) -> Column:
    """Names of the rules that match, in their order. The policy is a list of literals, so this is one projection."""
    hits = F.array(*[F.when(selected(path, r.include, r.exclude), F.lit(name(r))) for r in rules]) if rules else F.array().cast("array<string>")
    return F.filter(hits, lambda h: h.isNotNull())


def classify(inventory: DataFrame, rules: list[Rule], units: list[Unit], hazardous: Column | None = None) -> DataFrame:
    """(path, classification, reason, rules, domains), the first that holds:

    no rule: unclassified; two exclusions, or one beside a domain rule: conflict; one exclusion:
    conflict if the path is hazardous, else excluded; else every domain needs exactly one owning
    unit: review, or conflict.
    """
    path = F.col("path")
    excluding = {r.id for r in rules if r.excluded}
    named = inventory.select("path", matched(path, rules, lambda r: r.id).alias("rules"), (hazardous if hazardous is not None else F.lit(False)).alias("hazard"))
    n_excluded = F.size(F.filter("rules", lambda r: r.isin(list(excluding)))) if excluding else F.lit(0)
    domains = F.array_sort(F.array_distinct(F.flatten(F.transform("rules", lambda r: _lookup({x.id: x.domains for x in rules}, r)))))
    owners = {d: F.size(matched(path, [u for u in units if u.domain == d], lambda u: u.slug)) for d in sorted({d for r in rules for d in r.domains})}
    unowned = F.array(*[F.when(F.array_contains("domains", d) & (n != 1), F.lit(d)) for d, n in owners.items()]) if owners else F.array().cast("array<string>")
    of = named.withColumns({"n_excluded": n_excluded, "domains": domains}).withColumn("unowned", F.filter(unowned, lambda d: d.isNotNull()))
    reason = (
        F.when(F.size("rules") == 0, "unclassified")
        .when((F.col("n_excluded") > 1) | ((F.col("n_excluded") == 1) & (F.size("domains") > 0)), "rule-conflict")
        .when((F.col("n_excluded") == 1) & F.col("hazard"), "unsafe-exclusion")
        .when(F.col("n_excluded") == 1, "excluded")
        .when(F.size("unowned") > 0, "unit-conflict")
        .otherwise("review")
    )
    classification = F.when(F.col("reason").isin("rule-conflict", "unsafe-exclusion", "unit-conflict"), "conflict").otherwise(F.col("reason"))
    return of.withColumn("reason", reason).select("path", classification.alias("classification"), "reason", "rules", "domains")


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    out = F.array().cast("array<string>")
    for k, values in table.items():
        out = F.when(key == k, F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")).otherwise(out)
    return out


def evidence_status(required: DataFrame, units: DataFrame, receipts: DataFrame) -> DataFrame:
    """(domain, unit, path, status) of each required (domain, unit, path, blob, deleted), the first that holds:

    more than one registered unit: invalid; none, or its rules not accepted: missing; no receipt
    that is reviewed, fully read and has a blob: missing; deleted, or another blob: stale; else
    fresh. ``units`` are (domain, unit, accepted), ``receipts`` (domain, unit, path, blob,
    reviewed, full_read); of several receipts for one key the one that would pass counts.
    """
    registered = units.groupBy("domain", "unit").agg(F.count("*").alias("n_units"), F.bool_and("accepted").alias("accepted"))
    good = receipts.where("reviewed and full_read and blob is not null").groupBy("domain", "unit", "path").agg(F.collect_set("blob").alias("blobs"))
    joined = required.join(registered, ["domain", "unit"], "left").join(good, ["domain", "unit", "path"], "left")
    status = (
        F.when(F.col("n_units") > 1, "invalid")
        .when(F.col("n_units").isNull() | ~F.col("accepted"), "missing")
        .when(F.col("blobs").isNull(), "missing")
        .when(F.col("deleted") | ~F.array_contains("blobs", F.col("blob")), "stale")
        .otherwise("fresh")
    )
    return joined.select("domain", "unit", "path", status.alias("status"))


STATES = ("fresh", "missing", "stale", "invalid")


def coverage_summary(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each state, required (their sum) and gaps (all but fresh), by ``by``."""
    return evidence.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES], F.count("*").alias("required"), F.count_if(F.col("status") != "fresh").alias("gaps"))


def unit_state(report: str = "current") -> Column:
    """Coverage state of a unit from its counters; a report that is missing or invalid leaves it unknown."""
    if report in ("missing", "invalid"):
        return F.lit("unknown")
    return (
        F.when(F.col("invalid") > 0, "invalid")
        .when((F.col("missing") > 0) | (F.col("stale") > 0) | F.lit(report == "stale"), "gap")
        .when(F.col("required") == 0, "gap" if report == "current" else "unknown")
        .when(F.col("fresh") == F.col("required"), "fresh")
        .otherwise("gap")
    )


def verdict(summary: DataFrame, errors: Column) -> DataFrame:
    """One row: invalid if there are errors, incomplete if there are gaps, else complete."""
    return summary.agg(F.sum(errors).alias("errors"), F.sum("gaps").alias("gaps")).select(
        "errors", "gaps", F.when(F.col("errors") > 0, "invalid").when(F.col("gaps") > 0, "incomplete").otherwise("complete").alias("verdict"))


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in a fixed order, those not in it last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, i).otherwise(out)
    return out


def risk_summary(findings: DataFrame, by: str, severities: list[str]) -> DataFrame:
    """(by, open, accepted, separate, worst): tallies by disposition and the worst severity among the open."""
    of = lambda s: F.count_if(F.col("disposition") == s)
    worst = F.min(F.when(F.col("disposition") == "open", rank_of(F.col("severity"), severities)))
    return findings.groupBy(by).agg(of("open").alias("open"), of("accepted-risk").alias("accepted"), of("separate-design").alias("separate"), worst.alias("_w")).select(
        by, "open", "accepted", "separate", F.get(F.array(*[F.lit(s) for s in severities]), F.col("_w")).alias("worst"))


def action_queue(gaps: DataFrame, findings: DataFrame, severities: list[str], top: int) -> DataFrame:
    """The first ``top`` actions: coverage gaps by (path, unit), then open findings by (severity, title, id)."""
    a = gaps.select(F.lit(0).alias("kind"), F.lit(0).alias("rank"), F.col("path").alias("name"), F.col("unit").alias("id"))
    b = findings.where("disposition = 'open'").select(F.lit(1).alias("kind"), rank_of(F.col("severity"), severities).alias("rank"), F.col("title").alias("name"), F.col("id"))
    return a.unionByName(b).orderBy("kind", "rank", "name", "id").limit(top)


def interval_cover(reads: DataFrame, by: list[str]) -> DataFrame:
    """(by, covered): how far reads (start, end, both inclusive, from 1) cover without a gap from the first line."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gapped = reads.withColumn("gap", F.col("start") > F.coalesce(reach, F.lit(0)) + 1)
    broken = F.max(F.col("gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return gapped.withColumn("broken", broken).groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("broken") == 0, F.col("end"))), F.lit(0)).alias("covered"))
