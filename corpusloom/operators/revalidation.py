"""A coverage report held against what is there now: claims of fresh evidence, and whether the report still stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _wrong(rows: DataFrame, code: str, slug=None) -> DataFrame:
    return rows.select("path", "domain", (F.lit(None).cast("string") if slug is None else slug).alias("slug"), F.lit(code).alias("code"))


def claim_errors(claims: DataFrame, assigned: DataFrame, current: DataFrame, units: DataFrame, receipts: DataFrame, accepted: list[str] | None = None) -> DataFrame:
    """(path, domain, slug, code): what is wrong with claims (path, domain, status, ledgers, blob) of evidence.

    A ``missing`` claim names no ledger (``evidence-ledgers``). A ``fresh`` one names some, and only the unit that the path is assigned
    (path, domain, unit) to (``wrong-unit-ledger``); its blob is the current one (path, blob) (``fresh-evidence``); each ledger is one registered unit
    (domain, slug, version, ruleset, ruleset_digest): else ``cross-domain-ledger``, ``unknown-ledger`` or ``ambiguous-ledger``; and one
    of them has a receipt (domain, slug, path, blob, reviewed, full_read) that reviewed all of this blob, under an accepted ruleset
    (``fresh-evidence``). Without a list of ``accepted`` rulesets version 2 is accepted; with one, version 3 needs a digest as well. Units that no path
    is assigned to are ``unit-assignment``. For each claim, the first check that fails is told, and of its ledgers each.
    """
    named = claims.withColumn("ledgers", F.array_distinct(F.coalesce("ledgers", F.array().cast("array<string>"))))
    some = F.size("ledgers") > 0
    missing = _wrong(named.where((F.col("status") == "missing") & some), "evidence-ledgers")
    fresh = named.where("status = 'fresh'")
    empty = _wrong(fresh.where(~some), "evidence-ledgers")
    owned = fresh.where(some).join(assigned.select("path", "domain", "unit").distinct(), ["path", "domain"], "left")
    own = F.col("unit").isNotNull() & F.forall("ledgers", lambda s: s == F.col("unit"))
    foreign = _wrong(owned.where(~F.coalesce(own, F.lit(False))), "wrong-unit-ledger", F.col("unit"))
    right = owned.where(own).join(current.select("path", F.col("blob").alias("now")), "path", "left")
    same = F.coalesce(F.col("blob") == F.col("now"), F.lit(False))
    drifted = _wrong(right.where(~same), "fresh-evidence")

    known = units.groupBy("domain", "slug").agg(F.count("*").alias("n"), F.any_value("version").alias("version"), F.any_value("ruleset").alias("ruleset"), F.any_value("ruleset_digest").alias("ruleset_digest"))
    elsewhere = units.select("slug", F.col("domain").alias("other")).distinct()
    each = right.where(same).select("path", "domain", "blob", F.explode("ledgers").alias("slug")).join(known, ["domain", "slug"], "left")
    unregistered = each.where("n is null")
    crossing = unregistered.join(elsewhere, "slug", "left_semi")
    unknown = unregistered.join(elsewhere, "slug", "left_anti")
    several = each.where("n > 1")
    if accepted is None:
        accepts = F.col("version") == 2
    else:
        digested = F.coalesce(F.regexp_like("ruleset_digest", F.lit("^sha256:[0-9a-f]{64}$")), F.lit(False))
        accepts = F.coalesce(F.col("ruleset").isin(accepted), F.lit(False)) & ((F.col("version") != 3) | digested) & (F.col("version") != 1)
    read = receipts.where("reviewed and full_read").select("domain", "slug", "path", "blob").distinct()
    matched = each.where(F.col("n") == 1).where(accepts).join(read, ["domain", "slug", "path", "blob"], "left_semi").select("path", "domain").distinct()
    unmatched = _wrong(each.select("path", "domain").distinct().join(matched, ["path", "domain"], "left_anti"), "fresh-evidence")
    idle = units.select("domain", "slug").distinct().join(assigned.select("domain", F.col("unit").alias("slug")).distinct(), ["domain", "slug"], "left_anti")
    unassigned = idle.select(F.lit(None).cast("string").alias("path"), "domain", "slug", F.lit("unit-assignment").alias("code"))
    parts = [empty, foreign, drifted, _wrong(crossing, "cross-domain-ledger", F.col("slug")), _wrong(unknown, "unknown-ledger", F.col("slug")), _wrong(several, "ambiguous-ledger", F.col("slug")), unmatched, unassigned]
    out = missing
    for part in parts:
        out = out.unionByName(part)
    return out


def report_state(present: bool, drift: DataFrame, same_inventory: bool, same_policy: bool, classification_errors: DataFrame, evidence_errors: DataFrame) -> DataFrame:
    """One row (state, code, errors) of a report, by the first check that fails: missing; an inventory hash that differs though nothing drifted; drift, which makes it
    stale; another policy; classification that policy doesn't give; evidence. What fails but drift makes it invalid; else it is current.
    """
    of = lambda df, name: df.agg(F.count("*").alias(name))
    counts = of(drift, "drift").crossJoin(of(classification_errors, "classification")).crossJoin(of(evidence_errors, "evidence"))  # three rows of one count each
    code = (
        F.when(F.lit(not present), "missing").when((F.col("drift") == 0) & F.lit(not same_inventory), "inventory-hash").when(F.col("drift") > 0, "inventory-drift")
        .when(F.lit(not same_policy), "policy-drift").when(F.col("classification") > 0, "classification").when(F.col("evidence") > 0, "evidence")
    )
    errors = F.when(F.col("code") == "classification", F.col("classification")).when(F.col("code") == "evidence", F.col("evidence")).when(F.col("code") == "inventory-drift", F.col("drift")).when(F.col("code").isNotNull(), 1).otherwise(0)
    state = F.when(F.col("code") == "missing", "missing").when(F.col("code") == "inventory-drift", "stale").when(F.col("code").isNotNull(), "invalid").otherwise("current")
    return counts.withColumn("code", code).select(state.alias("state"), "code", errors.cast("long").alias("errors"))
