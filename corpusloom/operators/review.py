"""Review evidence: who owns a file, which receipts count, how findings add up.

All inputs are relations of rows; nulls in a key match nothing, repeated rows count as often as
they occur unless a docstring says otherwise, and an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.coverage import rank_of


def first_of(rows: DataFrame, by: list[str], value: str, most: int, name: str) -> DataFrame:
    """(by, name): the first ``most`` values of each group in order; ranks are cut in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    kept = rows.select(*by, value).withColumn("_k", rank).where(F.col("_k") <= most)
    return kept.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def partial_units(owned: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(unit, uncovered, first): units of the run with owned files (unit, path) that it did not review (unit, path)."""
    left = owned.join(reviewed.select("unit").distinct(), "unit", "left_semi").join(reviewed.select("unit", "path"), ["unit", "path"], "left_anti")
    return left.groupBy("unit").agg(F.count("*").alias("uncovered")).join(first_of(left, ["unit"], "path", 3, "first"), "unit")


def ownership_errors(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(path, domain, unit, problem, other) of claims whose unit is not registered in their domain: cross-domain, naming another, or unregistered."""
    strangers = claims.join(units.select("domain", "unit").distinct(), ["domain", "unit"], "left_anti")
    others = units.groupBy("unit").agg(F.min("domain").alias("other"))
    problem = F.when(F.col("other").isNull(), "unregistered").otherwise("cross-domain")
    return strangers.join(others, "unit", "left").select("path", "domain", "unit", problem.alias("problem"), "other")


def classification_mismatch(reported: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem) of two classifications (path, rules, kind): other rules as a set, another kind, or a path in one only."""
    a = reported.select("path", F.array_sort("rules").alias("a_rules"), F.col("kind").alias("a_kind"), F.lit(True).alias("a"))
    b = expected.select("path", F.array_sort(F.array_distinct("rules")).alias("b_rules"), F.col("kind").alias("b_kind"), F.lit(True).alias("b"))
    problem = (
        F.when(F.col("a").isNull(), "unreported").when(F.col("b").isNull(), "unexpected")
        .when(~F.col("a_rules").eqNullSafe(F.col("b_rules")), "rules").when(~F.col("a_kind").eqNullSafe(F.col("b_kind")), "kind")
    )
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def scope_status(scope: DataFrame, inventory: DataFrame, findings: DataFrame) -> DataFrame:
    """(slug, files, missing, changed, status, findings_with_drift) of ledgers' files (slug, path, blob).

    A file is missing without an inventory row and changed if both hashes are known and differ;
    any of these makes the ledger stale. Findings (slug, paths, n) count when one of their paths
    drifted; the count is null for a stale ledger that has no hashes of single files.
    """
    joined = scope.join(inventory.select("path", F.col("blob").alias("now")), "path", "left")
    drift = F.when(F.col("now").isNull(), "missing").when(F.col("blob") != F.col("now"), "changed")
    rows = joined.select("slug", "path", "blob", drift.alias("drift"))
    ledgers = rows.groupBy("slug").agg(
        F.count("*").alias("files"), F.count_if(F.col("drift") == "missing").alias("missing"), F.count_if(F.col("drift") == "changed").alias("changed"), F.bool_or(F.col("blob").isNotNull()).alias("hashed"))
    each = findings.select("slug", "id", "n", F.explode(F.array_distinct("paths")).alias("path"))
    hit = each.join(rows.where("drift is not null").select("slug", "path").distinct(), ["slug", "path"], "left_semi").select("slug", "id", "n").distinct()
    drifted = hit.groupBy("slug").agg(F.sum("n").alias("n"))
    stale = (F.col("missing") > 0) | (F.col("changed") > 0)
    return ledgers.join(drifted, "slug", "left").select(
        "slug", "files", "missing", "changed", F.when(stale, "stale").otherwise("fresh").alias("status"), F.when(~stale | F.col("hashed"), F.coalesce("n", F.lit(0))).alias("findings_with_drift"))


def accepted_ledgers(claims: DataFrame, ledger_files: DataFrame) -> DataFrame:
    """(slug): ledgers that a fresh claim (path, blob, status, ledgers) names and that hold that very blob, unless stale (slug, path, blob, stale)."""
    named = claims.where("status = 'fresh' and blob is not null").select("path", "blob", F.explode("ledgers").alias("slug"))
    return ledger_files.where(~F.col("stale")).join(named, ["slug", "path", "blob"], "left_semi").select("slug").distinct()


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of relations of one shape in which the earliest that has a key gives its row; within one, the least row."""
    columns = parts[0].columns
    rows = [p.select(*columns).withColumn("_source", F.lit(i)) for i, p in enumerate(parts)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union.groupBy(key).agg(F.min(F.struct("_source", *[c for c in columns if c != key])).alias("_r")).select(key, *[f"_r.{c}" for c in columns if c != key])


def occurrence_receipts(locations: DataFrame, receipts: DataFrame) -> DataFrame:
    """(occurrence, locations, exact, reviewed, closure_eligible) of (occurrence, path, blob) over receipts (path, blob, reviewed).

    Eligible to be closed if every location has a receipt of its very blob that was reviewed.
    """
    best = receipts.groupBy("path", "blob").agg(F.bool_or("reviewed").alias("was_reviewed"))
    joined = locations.select("occurrence", "path", "blob").distinct().join(best, ["path", "blob"], "left")
    counts = joined.groupBy("occurrence").agg(F.count("*").alias("locations"), F.count("was_reviewed").alias("exact"), F.count_if("was_reviewed").alias("reviewed"))
    return counts.withColumn("closure_eligible", F.col("reviewed") == F.col("locations"))


def sole_owners(receipts: DataFrame) -> DataFrame:
    """(path, blob, slug) of receipts (slug, path, blob) that belong to exactly one slug."""
    owners = receipts.groupBy("path", "blob").agg(F.min("slug").alias("slug"), F.max("slug").alias("_other"))
    return owners.where("slug = _other").drop("_other")


def carried_forward(prior: DataFrame, now: DataFrame, identity: Column) -> DataFrame:
    """(path, slug): receipts of an earlier run (slug, path, blob, lines, findings, named) that still hold.

    ``identity`` says whether a row's reviewer is the present one. Only one of its receipts may claim
    the path; blob and lines must be those of ``now`` (path, blob, lines), and the receipt's number
    of findings the number that names the path.
    """
    usable = prior.where(identity)
    single = usable.groupBy("path").agg(F.count("*").alias("_claims")).where("_claims = 1").select("path")
    same = now.select("path", "blob", "lines").distinct()
    return usable.where("findings = named").join(single, "path", "left_semi").join(same, ["path", "blob", "lines"], "left_semi").select("path", "slug")


def paired_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(call, problem) of tool calls (call, tool) and results (call, error): unanswered, unasked, failed, repeated; ok otherwise."""
    a = calls.groupBy("call").agg(F.count("*").alias("asked"))
    b = results.groupBy("call").agg(F.count("*").alias("answers"), F.bool_or("error").alias("failed"))
    problem = (
        F.when(F.col("asked").isNull(), "unasked").when(F.col("answers").isNull(), "unanswered")
        .when((F.col("asked") > 1) | (F.col("answers") > 1), "repeated").when(F.col("failed"), "failed").otherwise("ok")
    )
    return a.join(b, "call", "full").select("call", problem.alias("problem"))


def synthesis_errors(targets: DataFrame, produced: DataFrame) -> DataFrame:
    """(path, problem): a synthesis (path, digest) must have each target (path, digest, carried) once and carried ones unchanged."""
    a = targets.select("path", F.col("digest").alias("was"), "carried")
    b = produced.groupBy("path").agg(F.count("*").alias("n"), F.min("digest").alias("digest"))
    problem = (
        F.when(F.col("carried").isNull(), "not-a-target").when(F.col("n").isNull(), "uncovered").when(F.col("n") > 1, "repeated")
        .when(F.col("carried") & ~F.col("digest").eqNullSafe(F.col("was")), "carried-changed")
    )
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def identity_errors(summary: DataFrame, parts: list[str], whole: str) -> DataFrame:
    """Rows of a summary whose parts don't add up to the whole, with the ``difference``."""
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    return summary.withColumn("difference", F.col(whole) - total).where("difference <> 0")


def domain_totals(units: DataFrame, drift: DataFrame, stale: Column) -> DataFrame:
    """(domain, required, fresh, gaps, open) of units; where the report is stale, gaps are at least the drift (domain, n), and one."""
    sums = units.groupBy("domain").agg(*[F.sum(c).alias(c) for c in ("required", "fresh", "gaps", "open")])
    known = sums.join(drift.groupBy("domain").agg(F.sum("n").alias("_drift")), "domain", "left")
    gaps = F.when(stale, F.greatest("gaps", F.coalesce("_drift", F.lit(0)), F.lit(1))).otherwise(F.col("gaps"))
    return known.select("domain", "required", "fresh", gaps.alias("gaps"), "open")


#: The states of a finding in a portfolio that count as open.
OPEN_STATES = ["open", "expired", "reopened"]


def portfolio(findings: DataFrame) -> DataFrame:
    """(unit, status, findings, open): tallies of each unit and status, of each unit (status null) and of all (both null)."""
    return findings.rollup("unit", "status").agg(F.count("*").alias("findings"), F.count_if(F.col("status").isin(OPEN_STATES)).alias("open"))


def blocking_groups(findings: DataFrame, most: int = 40) -> DataFrame:
    """(derivation, blocking, ids): how many findings block by each derivation, with the first ``most`` ids."""
    blocking = findings.where("blocks")
    return blocking.groupBy("derivation").agg(F.count("*").alias("blocking")).join(first_of(blocking, ["derivation"], "id", most, "ids"), "derivation")


def finding_counts(findings: DataFrame, by: str) -> DataFrame:
    """(by, total, valid): sum of the findings' own counts, one where none is given; not valid if a given count is negative."""
    n = F.when(F.col("n") >= 0, F.col("n")).otherwise(1)
    return findings.groupBy(by).agg(F.sum(n).alias("total"), F.bool_and(F.coalesce(F.col("n") >= 0, F.lit(True))).alias("valid"))


def tallies(findings: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n): how often each value of each column occurs; one pass over the findings."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    return findings.select(F.explode(pairs).alias("p")).groupBy("p.name", "p.value").agg(F.count("*").alias("n"))


def path_outcomes(paths: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row (passed, failed, missing) for a list of paths and outcomes (path, passed); a path that ever passed has passed."""
    best = outcomes.groupBy("path").agg(F.bool_or("passed").alias("passed"))
    joined = paths.select("path").distinct().join(best, "path", "left")
    return joined.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("missing"))


def tool_use(calls: DataFrame, session: str, tool: str, classes: dict[str, list[str]]) -> DataFrame:
    """(session, one count for each class of tools, other)."""
    known = [t for tools in classes.values() for t in tools]
    return calls.groupBy(session).agg(*[F.count_if(F.col(tool).isin(tools)).alias(name) for name, tools in classes.items()], F.count_if(~F.col(tool).isin(known)).alias("other"))


#: What can become of a reviewed surface.
DISPOSITIONS = ["reported", "no_issue_found", "rejected", "not_applicable", "needs_follow_up"]


def surface_state(surfaces: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, total, one count for each disposition, state): unknown, gap or covered.

    ``units`` are (unit, completeness, deferred); a unit without surfaces has zeros.
    """
    counts = surfaces.groupBy("unit").agg(F.count("*").alias("total"), *[F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS])
    joined = units.join(counts, "unit", "left").fillna(0, ["total", *DISPOSITIONS])
    gap = (F.col("completeness") == "partial") | (F.col("deferred") > 0) | (F.col("needs_follow_up") > 0)
    state = F.when(F.col("completeness") == "unknown", "unknown").when(gap, "gap").otherwise("covered")
    return joined.select("unit", "total", *DISPOSITIONS, state.alias("state"))


def units_by_severity(units: DataFrame, findings: DataFrame, order: list[str], stale_first: bool = False) -> DataFrame:
    """(slug, stale, worst): units (slug, stale), by the worst rank of their findings, then slug; stale ones first if asked."""
    worst = findings.groupBy("slug").agg(F.min(rank_of(F.col("severity"), order)).alias("worst"))
    joined = units.join(worst, "slug", "left").fillna(len(order), ["worst"]).select("slug", "stale", "worst")
    return joined.orderBy(*([F.desc("stale")] if stale_first else []), "worst", "slug")


#: Order of the coverage states of units.
COVERAGE_ORDER = ["invalid", "unknown", "gap", "fresh"]


def unit_rows(units: DataFrame, severities: list[str]) -> DataFrame:
    """Units (slug, title, state, worst) by coverage state, worst open severity (none last), title, slug."""
    return units.orderBy(rank_of(F.col("state"), COVERAGE_ORDER), rank_of(F.col("worst"), severities), "title", "slug")


def recent_units(units: DataFrame) -> DataFrame:
    """Accepted units (slug, scanned, accepted), latest scan first, those without a time last, then slug."""
    return units.where("accepted").orderBy(F.col("scanned").desc_nulls_last(), "slug")


def diagnostics(rows: DataFrame) -> DataFrame:
    """Distinct (path, code, message) by path (none first), code, message."""
    return rows.select("path", "code", "message").distinct().orderBy(F.coalesce("path", F.lit("")), "code", "message")


def gap_rows(evidence: DataFrame, orphans: DataFrame) -> DataFrame:
    """(path, unit, status) of orphan gaps and of unit files, without the fresh and the unknown, by path and unit."""
    both = orphans.select("path", "unit", "status").unionByName(evidence.select("path", "unit", "status"))
    return both.where(~F.col("status").isin("fresh", "unknown")).orderBy("path", "unit")


def finding_cards(findings: DataFrame, scope: DataFrame, order: list[str]) -> DataFrame:
    """(path, severity, rank, findings): one card for each page in scope, its findings (id, severity, paths) by severity."""
    each = findings.select("id", "severity", F.explode(F.array_distinct("paths")).alias("path"))
    return each.join(scope.select("path").distinct(), "path", "left_semi").groupBy("path", "severity").agg(F.count("*").alias("findings")).withColumn("rank", rank_of(F.col("severity"), order))


def judged_findings(findings: DataFrame, scope: DataFrame, severities: list[str]) -> DataFrame:
    """(id, accepted, reason) of produced findings (id, title, severity, paths): the first reason against one, or none.

    A finding needs a title, a known severity, and at least one location in scope (path).
    """
    located = findings.select("id", F.explode("paths").alias("path")).join(scope.select("path").distinct(), "path", "left_semi").select("id").distinct().withColumn("located", F.lit(True))
    reason = (
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "no-title").when(~F.coalesce(F.col("severity").isin(severities), F.lit(False)), "unknown-severity")
        .when(F.col("located").isNull(), "out-of-scope")
    )
    return findings.join(located, "id", "left").select("id", reason.isNull().alias("accepted"), reason.alias("reason"))


def first_claims(findings: DataFrame, fingerprint: str, order: list[str]) -> DataFrame:
    """The first finding of each fingerprint by ``order``; an aggregate, so a common fingerprint is reduced before the shuffle."""
    return findings.groupBy(fingerprint).agg(F.min(F.struct(*order, *[c for c in findings.columns if c not in (*order, fingerprint)])).alias("_f")).select(fingerprint, "_f.*")


def chunks(rows: DataFrame, by: str, order: list[str], path: str, size: int) -> DataFrame:
    """(by, chunk, rows, files): rows of each group in order, cut into chunks of ``size``, with their distinct files."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("chunk", F.floor(place / size)).groupBy(by, "chunk").agg(F.count("*").alias("rows"), F.count_distinct(path).alias("files"))
