"""Translations beside the units that they were made from, and what is shown: translated where all of a unit is, else the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What makes a translation invalid, not only incomplete.
INVALID = ["duplicate-unit", "unknown-unit", "too-many-findings", "invalid-text", "duplicate-finding", "unknown-finding"]


def judged_units(units: DataFrame, translations: DataFrame) -> DataFrame:
    """(domain, slug, code) of every unit on either side, by the first that holds.

    Units: (domain, slug, source_digest, digests: of its findings). Translations: (domain, slug, source_digest, title, findings: array of (source_digest, title)). Codes:
    ``duplicate-unit``, ``unknown-unit``, ``too-many-findings``, ``invalid-text`` (an empty title), ``duplicate-finding``, ``stale-unit`` (made of other content), ``unknown-finding``,
    ``missing-finding``, ``missing-unit``, else ``verified``.
    """
    t = translations.groupBy("domain", "slug").agg(F.count("*").alias("n"), F.any_value(F.struct("source_digest", "title", "findings")).alias("t"))
    s = units.select("domain", "slug", F.col("source_digest").alias("now"), "digests", F.lit(True).alias("known"))
    joined = t.join(s, ["domain", "slug"], "full")
    findings = F.coalesce("t.findings", F.array().cast(translations.schema["findings"].dataType))
    named = F.transform(findings, lambda f: f["source_digest"])
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    own = F.coalesce("digests", F.array().cast("array<string>"))
    code = (
        F.when(F.col("n").isNull(), "missing-unit").when(F.col("n") > 1, "duplicate-unit").when(F.col("known").isNull(), "unknown-unit").when(F.size(findings) > F.size(own), "too-many-findings")
        .when(blank(F.col("t.title")) | F.exists(findings, lambda f: blank(f["title"])), "invalid-text").when(F.size(F.array_distinct(named)) < F.size(named), "duplicate-finding")
        .when(~F.coalesce(F.col("t.source_digest") == F.col("now"), F.lit(False)), "stale-unit").when(F.size(F.array_except(named, own)) > 0, "unknown-finding").when(F.size(F.array_except(own, named)) > 0, "missing-finding").otherwise("verified")
    )
    return joined.select("domain", "slug", code.alias("code"))


def translation_state(judged: DataFrame) -> DataFrame:
    """One row (state, verified, open): ``invalid`` if one unit is, else ``incomplete`` or ``complete``."""
    invalid, done = F.count_if(F.col("code").isin(INVALID)), F.count_if(F.col("code") == "verified")
    state = F.when(invalid > 0, "invalid").when(F.count("*") > done, "incomplete").otherwise("complete")
    return judged.agg(state.alias("state"), done.alias("verified"), (F.count("*") - done).alias("open"))


def overlaid(findings: DataFrame, titles: DataFrame, translations: DataFrame, judged: DataFrame) -> DataFrame:
    """(domain, slug, place, unit_title, title, translated): what is shown of findings (domain, slug, place, digest, title) of units (domain, slug, title).

    A unit is translated as a whole, where it is verified and the translation isn't invalid elsewhere, or stays as it is. Findings meet their translation by digest.
    """
    usable = judged.where("code = 'verified'").select("domain", "slug").join(translation_state(judged).where("state <> 'invalid'").select(F.lit(True).alias("usable")))  # one row
    own = translations.join(usable, ["domain", "slug"])
    units = own.select("domain", "slug", F.col("title").alias("t_unit"))
    texts = own.select("domain", "slug", F.explode("findings").alias("f")).select("domain", "slug", F.col("f.source_digest").alias("digest"), F.col("f.title").alias("t_title"))
    shown = findings.join(titles.select("domain", "slug", F.col("title").alias("s_unit")), ["domain", "slug"]).join(units, ["domain", "slug"], "left").join(texts, ["domain", "slug", "digest"], "left")
    return shown.select("domain", "slug", "place", F.coalesce("t_unit", "s_unit").alias("unit_title"), F.coalesce("t_title", "title").alias("title"), F.col("t_unit").isNotNull().alias("translated"))
