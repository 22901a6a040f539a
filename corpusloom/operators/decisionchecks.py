"""Decision events against the occurrences and observations that they name; each rule that is broken is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context_kinds(events: DataFrame, occurrences: DataFrame, observations: DataFrame) -> DataFrame:
    """(event, kind): how an event's review context fits the occurrence that it is about.

    Events: (event, ledger, finding, occurrence, observation, bindings, ruleset, digest), bindings as an array of ``path:blob``.
    Occurrences: (occurrence, finding, ledger, observation, bindings, paths, eligible, ruleset, digest). Observations: (observation, slug, ruleset, digest, exact).
    ``exact``: the occurrence can be closed, and observation, bindings and ruleset are its own. ``migration``: it can't, the ruleset is its own, both observations
    are exact ones of the ledger under that ruleset, and the context binds just its paths. Else ``invalid``, also without an occurrence.
    """
    o = occurrences.select("occurrence", F.col("finding").alias("o_finding"), F.col("ledger").alias("o_ledger"), F.col("observation").alias("o_observation"), F.col("bindings").alias("o_bindings"), "paths", "eligible", F.col("ruleset").alias("o_ruleset"), F.col("digest").alias("o_digest"))
    sound = lambda name: observations.where("exact").select(F.col("observation").alias(f"{name}_observation_id"), F.col("slug").alias(f"{name}_slug"), F.col("ruleset").alias(f"{name}_ruleset"), F.col("digest").alias(f"{name}_digest"))
    joined = events.join(o, "occurrence", "left").join(sound("at"), F.col("o_observation") == F.col("at_observation_id"), "left").join(sound("in"), F.col("observation") == F.col("in_observation_id"), "left")
    ruled = F.col("o_ruleset").isNotNull() & (F.col("ruleset") == F.col("o_ruleset")) & (F.col("digest") == F.col("o_digest"))
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    exact = F.col("eligible") & ruled & (F.col("observation") == F.col("o_observation")) & same("bindings", "o_bindings")
    fits = lambda n: (F.col(f"{n}_slug") == F.col("o_ledger")) & (F.col(f"{n}_ruleset") == F.col("o_ruleset")) & (F.col(f"{n}_digest") == F.col("o_digest"))
    paths = F.transform("bindings", lambda b: F.regexp_replace(b, ":[^:]*$", ""))
    migration = ~F.col("eligible") & ruled & fits("at") & fits("in") & same(paths, "paths")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return joined.select("event", F.when(yes(exact), "exact").when(yes(migration), "migration").otherwise("invalid").alias("kind"))


def event_errors(events: DataFrame, occurrences: DataFrame, findings: DataFrame, observations: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(event, code): events that name what is not there.

    Codes: ``duplicate-event`` (an id in two entries), ``unknown-occurrence`` (none, or of another finding), ``wrong-ledger`` (not that of the occurrence and of its finding (finding, ledger)),
    ``unknown-observation``, ``unknown-binding`` (a ``path:blob`` that its observation didn't review (observation, binding)), ``invalid-context``.
    """
    base = events.select("event", "ledger", "finding", "occurrence", "observation", "bindings")
    o = occurrences.select("occurrence", F.col("finding").alias("o_finding"), F.col("ledger").alias("o_ledger"))
    f = findings.select("finding", F.col("ledger").alias("f_ledger"))
    found = base.join(o, "occurrence", "left").join(f, "finding", "left")
    known = F.coalesce(F.col("o_finding") == F.col("finding"), F.lit(False))
    home = F.coalesce((F.col("o_ledger") == F.col("ledger")) & (F.col("f_ledger") == F.col("ledger")), F.lit(False))
    told = lambda rows, code: rows.select("event", F.lit(code).alias("code")).distinct()
    repeated = events.groupBy("event").count().where("count > 1")
    nowhere = base.join(observations.select("observation").distinct(), "observation", "left_anti")
    bound = base.join(observations.select("observation").distinct(), "observation", "left_semi").select("event", "observation", F.explode("bindings").alias("binding"))
    unbound = bound.join(reviewed.select("observation", "binding").distinct(), ["observation", "binding"], "left_anti")
    kinds = context_kinds(events, occurrences, observations).where("kind = 'invalid'")
    parts = [(found.where(~known), "unknown-occurrence"), (found.where(known & ~home), "wrong-ledger"), (nowhere, "unknown-observation"), (unbound, "unknown-binding"), (kinds, "invalid-context")]
    out = told(repeated, "duplicate-event")
    for rows, code in parts:
        out = out.unionByName(told(rows, code))
    return out


def alias_errors(aliases: DataFrame) -> DataFrame:
    """(scheme, value, problem, findings): aliases (scheme, value, finding) that are given twice: ``duplicate`` by one finding, ``conflicting`` by several."""
    owners = aliases.groupBy("scheme", "value").agg(F.count("*").alias("n"), F.count_distinct("finding").alias("findings"))
    return owners.where("n > 1").select("scheme", "value", F.when(F.col("findings") > 1, "conflicting").otherwise("duplicate").alias("problem"), "findings")
