"""Globs against paths by an index, so that each glob meets the paths that share its literal part, not all paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import ancestors, basename, glob_regex

MAGIC = re.compile(r"[*?\[{]")


def index_key(glob: str) -> tuple[str, str]:
    """(kind, key) by which a glob is looked up: the directory that its literal segments name, or the whole path; else the literal name, else the ending, of its last segment.

    A glob without any of these is of kind ``any`` and meets every path.
    """
    segments = glob.split("/")
    literal = next((i for i, s in enumerate(segments) if MAGIC.search(s)), len(segments))
    if literal:
        return "dir", "/".join(segments[:literal])
    last = segments[-1]
    if not MAGIC.search(last):
        return "name", last
    ending = re.search(r"\.[^.*?\[\]{}]+$", last)
    return ("ending", ending[0]) if ending else ("any", "")


def _indexed(globs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in globs:
        yield pd.DataFrame([(*index_key(g), glob_regex(g)) for g in batch], columns=["kind", "key", "regex"], dtype=object)


def glob_index(globs: DataFrame) -> DataFrame:
    """``globs`` (glob, and any other columns) with kind, key and regex; a glob of another dialect is refused."""
    index = F.pandas_udf(_indexed, "kind string, key string, regex string")
    return globs.where("glob is not null").withColumn("_i", index("glob")).select(*globs.columns, "_i.*")


def path_keys(path: Column) -> Column:
    """All (kind, key) by which a path can be found."""
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    above = F.filter(F.concat(ancestors(path), F.array(path)), lambda p: p != "")
    ending = F.regexp_extract(basename(path), r"(\.[^.]+)$", 1)
    others = F.array(entry("name", basename(path)), F.when(ending != "", entry("ending", ending)), entry("any", F.lit("")))
    return F.array_compact(F.concat(F.transform(above, lambda p: entry("dir", p)), others))


def matches(paths: DataFrame, globs: DataFrame, path: str = "path") -> DataFrame:
    """Rows of ``globs`` (glob, and other columns) beside each distinct path that they match.

    Keys are joined, then each candidate is held against its pattern. Keys that no glob has are dropped before the
    shuffle where the globs are few.
    """
    index = glob_index(globs)
    keyed = paths.select(F.col(path).alias("path")).where("path is not null").distinct().select("path", F.explode(path_keys(F.col("path"))).alias("k"))
    found = keyed.select("path", "k.kind", "k.key").join(index, ["kind", "key"]).where(F.expr("regexp_like(path, regex)"))
    return found.drop("kind", "key", "regex")


def owned(paths: DataFrame, units: DataFrame, key: list[str], include: str = "include", exclude: str = "exclude") -> DataFrame:
    """(key columns, path): distinct paths that one of a unit's includes matches and none of its excludes; both are arrays of globs."""
    hit = matches(paths, units.select(*key, F.explode(include).alias("glob"))).select(*key, "path").distinct()
    out = matches(paths, units.select(*key, F.explode(exclude).alias("glob"))).select(*key, "path").distinct()
    return hit.join(out, [*key, "path"], "left_anti")


def review_targets(paths: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, path, role): a unit's own paths as ``target``, and the others that its context globs name as ``context``."""
    own = owned(paths, units, key)
    context = matches(paths, units.select(*key, F.explode("context").alias("glob"))).select(*key, "path").distinct()
    return own.withColumn("role", F.lit("target")).unionByName(context.join(own, [*key, "path"], "left_anti").withColumn("role", F.lit("context")))


def assign_paths(historical: DataFrame, current: DataFrame, receipts: DataFrame, assignments: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each historical path to the one assignment (id, domain, unit, include) that matches it: (id, domain, unit, path), and what is wrong: (path, code, id).

    Codes: ``unmapped`` and ``ambiguous`` paths, ``empty`` assignments, ``current-overlap`` and ``receipt-overlap`` where an
    assignment matches what is not history, ``unknown-unit`` where units (domain, slug) lack its own.
    """
    globs = assignments.select("id", F.explode("include").alias("glob"))
    pairs = lambda paths: matches(paths, globs).select("path", "id").distinct()
    found = historical.select("path").distinct().join(pairs(historical), "path", "left").groupBy("path").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    one = found.where("n = 1").join(assignments.select("id", "domain", "unit"), "id").select("id", "domain", "unit", "path")
    none = F.lit(None).cast("string")
    wrong = found.where("n <> 1").select("path", F.when(F.col("n") == 0, "unmapped").otherwise("ambiguous").alias("code"), none.alias("id"))
    empty = assignments.select("id").join(one.select("id"), "id", "left_anti").select(none.alias("path"), F.lit("empty").alias("code"), "id")
    overlaps = [pairs(p).select("path", F.lit(code).alias("code"), "id") for p, code in ((current, "current-overlap"), (receipts, "receipt-overlap"))]
    unknown = assignments.join(units.select("domain", F.col("slug").alias("unit")).distinct(), ["domain", "unit"], "left_anti").select(none.alias("path"), F.lit("unknown-unit").alias("code"), "id")
    return one, wrong.unionByName(empty).unionByName(overlaps[0]).unionByName(overlaps[1]).unionByName(unknown)
