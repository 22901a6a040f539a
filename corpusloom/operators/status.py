"""The rest of a corpus's status: edited moves, sizes of changes, reading order, concept pages, reports.

Paths have no leading slash and the root is the empty path. Nulls in a key match nothing, an
empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import ancestors, basename, parent


def ignored_directories(ignored: DataFrame, directories: DataFrame) -> DataFrame:
    """(path): directories above ignored files that hold no scanned file; the root is never one."""
    above = ignored.select(F.explode(ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()
    return above.join(directories.select("path"), "path", "left_anti")


def edited_moves(orphaned: DataFrame, missing: DataFrame, renames: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """(source, target, similarity): orphans (path, anchor) that a diff since their anchor renamed to a missing path.

    ``renames`` are (anchor, source, target, similarity). What exact moves ``claimed`` (source, target) takes no part. A target goes
    to the anchor whose first orphan comes first, in it to the first source; a source that a diff renames twice to the first of its targets.
    """
    if claimed is not None:
        orphaned = orphaned.join(claimed.select(F.col("source").alias("path")), "path", "left_anti")
        missing = missing.join(claimed.select(F.col("target").alias("path")), "path", "left_anti")
    places = orphaned.groupBy("anchor").agg(F.min("path").alias("place"))
    known = renames.join(orphaned.select("anchor", F.col("path").alias("source")).distinct(), ["anchor", "source"], "left_semi")
    known = known.join(missing.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    one = known.groupBy("anchor", "source").agg(F.min(F.struct("target", "similarity")).alias("t")).select("anchor", "source", "t.*").join(places, "anchor")
    first = F.min(F.struct("place", "anchor", "source", "similarity")).alias("m")
    return one.groupBy("target").agg(first).select("m.source", "target", "m.similarity")


def voted_moves(orphan_directories: DataFrame, moves: DataFrame, missing_directories: DataFrame) -> DataFrame:
    """(source_dir, target_dir, votes): where the files below an orphan directory (path) went with their way below it unchanged.

    Of each directory only the target with most votes is tried, ties to the one whose first file
    comes first; it must be missing (path), and goes to the first directory that asks.
    """
    above = moves.select("source", "target", F.explode(ancestors(F.col("source"))).alias("source_dir")).where("source_dir <> ''")
    above = above.join(orphan_directories.select(F.col("path").alias("source_dir")).distinct(), "source_dir", "left_semi")
    below = F.expr("substring(source, length(source_dir) + 1)")
    kept = above.withColumn("below", below).where(F.expr("endswith(target, below)"))
    voted = kept.groupBy("source_dir", F.expr("substring(target, 1, length(target) - length(below))").alias("target_dir")).agg(F.count("*").alias("votes"), F.min("source").alias("first"))
    best = voted.groupBy("source_dir").agg(F.min(F.struct((-F.col("votes")).alias("n"), "first", "target_dir")).alias("b")).select("source_dir", "b.target_dir", (-F.col("b.n")).alias("votes"))
    found = best.join(missing_directories.select(F.col("path").alias("target_dir")).distinct(), "target_dir", "left_semi")
    return found.groupBy("target_dir").agg(F.min(F.struct("source_dir", "votes")).alias("s")).select("s.source_dir", "target_dir", "s.votes")


def change_sizes(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, added, removed, files) of outdated entries (path, type, anchor) over changes since an anchor (anchor, path, added, removed).

    A file counts its own change, a directory all below it, the root all; a binary change (null) counts as none.
    """
    spread = changes.select("anchor", F.col("path").alias("file"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"), F.explode(F.array_union(ancestors(F.col("path")), F.array("path"))).alias("path"))
    summed = spread.groupBy("anchor", "path").agg(
        F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("files"),
        *[F.sum(F.when(F.col("file") == F.col("path"), F.col(c))).alias(f"own_{c}") for c in ("added", "removed")], F.count_if(F.col("file") == F.col("path")).alias("own_files"))
    joined = entries.join(summed, ["anchor", "path"])
    of = lambda c: F.when(F.col("type") == "file", F.col(f"own_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("path", of("added"), of("removed"), of("files")).where("files > 0")


def children(paths: DataFrame) -> DataFrame:
    """(dir, name): immediate children of each directory of the paths, files and directories alike."""
    all_paths = paths.select(F.explode(F.array_union(ancestors(F.col("path")), F.array("path"))).alias("path")).where("path <> ''").distinct()
    return all_paths.select(parent(F.col("path")).alias("dir"), basename(F.col("path")).alias("name"))


def reading_order_errors(orders: DataFrame, paths: DataFrame) -> DataFrame:
    """(dir, name, suggestion): names in a directory's reading order (dir, name) that are no child of it; a child that differs in case is suggested."""
    kids = children(paths)
    near = kids.groupBy("dir", F.lower("name").alias("low")).agg(F.min("name").alias("suggestion"))
    broken = orders.join(kids, ["dir", "name"], "left_anti").withColumn("low", F.lower("name"))
    return broken.join(near, ["dir", "low"], "left").select("dir", "name", "suggestion")


def concept_status(concepts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(slug, status, hash, broken, snapshot) of concept pages (slug, sources, hash) over (path, type, blob).

    The hash is the SHA-1 of the sources' blobs in the order declared, null where one is broken;
    the snapshot, a SHA-256 of each source's type and blob or ``missing``, is there always. A
    page's sources are a list in its head, so they are few.
    """
    each = concepts.select("slug", F.col("hash").alias("stored"), F.posexplode_outer("sources").alias("place", "path"))
    found = each.join(inventory.select("path", "type", "blob"), "path", "left")
    record = F.struct(F.col("path").alias("source"), F.when(F.col("blob").isNull(), "missing").otherwise(F.concat_ws(":", "type", "blob")).alias("digest"))
    rows = found.groupBy("slug", "stored").agg(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("place", record.alias("record"), "blob")))).alias("rows"))
    blobs, records = F.col("rows")["blob"], F.col("rows")["record"]
    broken = F.filter("rows", lambda r: r["blob"].isNull())["record"]["source"]
    now = F.when(F.size(broken) == 0, F.sha1(F.array_join(blobs, "")))
    status = F.when(F.size("broken") > 0, "broken-source").when(F.col("stored") == F.col("hash"), "fresh").otherwise("outdated")
    judged = rows.select("slug", "stored", now.alias("hash"), broken.alias("broken"), F.sha2(F.concat(F.to_json(records), F.lit("\n")), 256).alias("snapshot"))
    return judged.select("slug", status.alias("status"), "hash", "broken", "snapshot")


def concept_counts(status: DataFrame) -> DataFrame:
    """One row: total, fresh, outdated and broken concept pages."""
    of = lambda s: F.count_if(F.col("status") == s)
    return status.agg(F.count("*").alias("total"), of("fresh").alias("fresh"), of("outdated").alias("outdated"), of("broken-source").alias("broken"))


def united(*paths: DataFrame) -> DataFrame:
    """Distinct paths of several lists, null left out: tracked and untracked files, or all that changed for one concept."""
    union = paths[0].select("path")
    for p in paths[1:]:
        union = union.union(p.select("path"))
    return union.where("path is not null").distinct()


def new_dirty(before: DataFrame, after: DataFrame, allowed: str) -> DataFrame:
    """Distinct dirty paths that were clean before and lie outside the allowed prefix."""
    return after.select("path").distinct().join(before.select("path"), "path", "left_anti").where(~F.col("path").startswith(allowed))


def report_changes(before: DataFrame, after: DataFrame, measure: str) -> DataFrame:
    """(path, change, before, after) of two reports (path, blob, measure): added, removed, or changed where both blobs are known and differ."""
    a = before.select("path", F.col("blob").alias("old"), F.col(measure).alias("before"), F.lit(True).alias("a"))
    b = after.select("path", F.col("blob").alias("new"), F.col(measure).alias("after"), F.lit(True).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change"), "before", "after").where("change is not null")


def trend_rows(changes: DataFrame, top: int = 10, step: float = 1.0) -> DataFrame:
    """(direction, rank, path, delta, n): the ``top`` improved and worsened by at least ``step``, most first, beside how many there are."""
    delta = F.col("after") - F.col("before")
    moved = changes.where("change = 'changed'").select("path", delta.alias("delta"), F.when(delta >= step, "improved").when(delta <= -step, "worsened").alias("direction")).where("direction is not null")
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.abs("delta").desc(), "path"))
    counts = moved.groupBy("direction").agg(F.count("*").alias("n"))
    return moved.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(counts), "direction")


def nearest_base(paths: DataFrame, bases: DataFrame) -> DataFrame:
    """(path, base): the longest base (path) that is the path or a directory above it, the root where there is none."""
    above = paths.select("path", F.explode(F.array_union(ancestors(F.col("path")), F.array("path"))).alias("base"))
    hits = above.join(bases.select(F.col("path").alias("base")).distinct(), "base", "left_semi")
    best = hits.groupBy("path").agg(F.max_by("base", F.length("base")).alias("base"))
    return paths.select("path").distinct().join(best, "path", "left").fillna("", ["base"])


def preorder(nodes: DataFrame) -> DataFrame:
    """(path, key) of a tree's nodes (path, place): keys in order give each parent before its children, siblings by place, then path.

    Each node is joined with the nodes above it, so the key is made of their places; no task holds a directory's children.
    Steps are joined by U+0001, which comes before all signs of names, so that a name is not cut by one that goes on.
    """
    step = lambda path, place: F.concat(F.lpad(place.cast("string"), 12, "0"), F.lit(" "), basename(path))
    steps = nodes.select(F.col("path").alias("above"), step(F.col("path"), F.col("place")).alias("step"))
    spread = nodes.select("path", F.posexplode(F.filter(F.array_union(ancestors(F.col("path")), F.array("path")), lambda p: p != "")).alias("depth", "above"))
    joined = spread.join(steps, "above")
    return joined.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("depth", "step")))["step"], "\u0001").alias("key"))


def first_files(ordered: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, first): the file of each directory's subtree that comes first by ``ordered`` (path, key)."""
    keyed = ordered.join(files.select("path").distinct(), "path", "left_semi")
    return keyed.select("path", "key", F.explode(ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.min_by("path", "key").alias("first"))


def without_glob(path: Column) -> Column:
    """A reference without a trailing slash, then without ``/*`` or ``*``, then without ``-*``; null if another star is left."""
    # The three endings.
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/$", ""), r"/?\*$", ""), r"-\*$", "")
    return F.when(~F.contains(bare, F.lit("*")), bare)


def search_bases(base: Column) -> Column:
    """Where a reference is looked for: each directory from ``base`` up, then the root, each followed by its ``src``."""
    up = F.filter(F.reverse(F.array_union(ancestors(base), F.array(base))), lambda p: p != "")
    return F.concat(F.flatten(F.transform(up, lambda p: F.array(p, F.concat(p, F.lit("/src"))))), F.array(F.lit(""), F.lit("src")))
