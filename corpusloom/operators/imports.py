"""Imports of program files: specifiers, what they resolve to, package roots, and edges that cross a subtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import ancestors, parent

#: What an import looks like, which files have imports, and the endings that are tried.
SPECIFIER = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"']+)["']"""
CODE_FILE = r"\.[cm]?[jt]sx?$"
ENDINGS = [".ts", ".tsx", ".js", ".mjs", ".cjs", ".jsx"]
INDEXES = ["/index.ts", "/index.tsx", "/index.js"]


def specifiers(text: Column) -> Column:
    """What a file's imports, exports and requires name, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPECIFIER), F.lit(1))


def normalized(path: Column) -> Column:
    """A relative path without empty segments, ``.`` and inner ``..``; null if it leads above the root, empty for the root."""
    def step(open_: Column, segment: Column) -> Column:
        up = (F.size(open_) > 0) & (F.coalesce(F.get(open_, F.size(open_) - 1), F.lit("..")) != "..")
        return F.when(segment.isin("", "."), open_).when((segment == "..") & up, F.slice(open_, F.lit(1), F.size(open_) - 1)).otherwise(F.array_append(open_, segment))

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    # Longer names that begin with two dots lead nowhere either, as the first two signs are what is looked at.
    joined = F.array_join(folded, "/")
    return F.when(~joined.startswith(".."), joined)


def candidates(path: Column) -> Column:
    """Files that a resolved specifier can mean, the first that exists counts."""
    as_source = F.array(F.regexp_replace(path, r"\.([cm]?)js$", ".$1ts"), F.regexp_replace(path, r"\.js$", ".tsx"))
    with_ending = F.array(*[F.concat(path, F.lit(e)) for e in [*ENDINGS, *INDEXES]])
    more = F.when(F.regexp_like(path, F.lit(r"\.[cm]?js$")), as_source).when(~F.regexp_like(path, F.lit(r"\.\w+$")), with_ending).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(path), more)


def package_name(specifier: Column) -> Column:
    """The package of a specifier: its first segment, or the first two of a scoped one."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def import_edges(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(src, dst): distinct imports between files (path, text), and from files to package roots (name, root).

    A specifier with a dot first is a path beside the file; of its candidates the first that is a file is meant. Any
    other names a package. What resolves to nothing, or to the file itself, is no edge. Each candidate is one row of an
    equi-join with the paths; of a name that several roots have, the greatest counts, as the last manifest does.
    """
    code = files.where(F.regexp_like("path", F.lit(CODE_FILE)))
    named = code.select("path", F.explode(F.array_distinct(specifiers(F.col("text")))).alias("spec"))
    beside = named.where(F.col("spec").startswith(".")).select("path", "spec", normalized(F.concat(parent(F.col("path")), F.lit("/"), F.col("spec"))).alias("to")).where("to is not null")
    tried = beside.select("path", "spec", F.posexplode(candidates(F.col("to"))).alias("rank", "dst"))
    hits = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst").groupBy("path", "spec").agg(F.min_by("dst", "rank").alias("dst")).select("path", "dst")
    roots = packages.groupBy("name").agg(F.max("root").alias("dst"))
    outer = named.where(~F.col("spec").startswith(".")).select("path", package_name(F.col("spec")).alias("name")).join(roots, "name").select("path", "dst")
    return hits.union(outer).where("path <> dst").select(F.col("path").alias("src"), "dst").distinct()


def _group(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, group): the nearest package root that is the path or above it, else its first segment."""
    above = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("root")).where("root <> ''")
    nearest = above.join(packages.select("root").distinct(), "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(nearest, "path", "left").select("path", F.coalesce("root", F.substring_index("path", "/", 1)).alias("group"))


def relations(nodes: DataFrame, edges: DataFrame, packages: DataFrame) -> DataFrame:
    """(node, direction, other): what a file or directory of ``nodes`` (path, type) uses, and what uses it, from outside its subtree.

    A file names the other file; a directory the other's package group, unless that is its own. Others that are no nodes are
    left out. An edge is one row for each directory that holds just one of its ends, so it takes as many rows as paths are deep.
    """
    known = nodes.where("path <> ''").select("path", F.col("type") == "file").toDF("path", "is_file").distinct()
    up = lambda c: F.filter(F.concat(ancestors(F.col(c)), F.array(c)), lambda p: p != "")
    outgoing = edges.select(F.explode(F.array_except(up("src"), up("dst"))).alias("path"), F.col("dst").alias("end"), F.lit("uses").alias("direction"))
    incoming = edges.select(F.explode(F.array_except(up("dst"), up("src"))).alias("path"), F.col("src").alias("end"), F.lit("used-by").alias("direction"))
    ends = edges.select(F.col("src").alias("path")).union(edges.select("dst")).union(known.select("path"))
    groups = _group(ends, packages)
    crossing = outgoing.union(incoming).distinct().join(known, "path")
    grouped = crossing.join(groups.select(F.col("path").alias("end"), F.col("group").alias("end_group")), "end").join(groups, "path")
    other = F.when(F.col("is_file"), F.col("end")).when(F.col("end_group") != F.col("group"), F.col("end_group"))
    found = grouped.select(F.col("path").alias("node"), "direction", other.alias("other")).where("other is not null and other <> node").distinct()
    return found.join(known.select(F.col("path").alias("other")), "other", "left_semi").select("node", "direction", "other")
