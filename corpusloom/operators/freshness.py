"""Are descriptions still true of what they describe: freshness, orphans, moves, hashes of directories and scopes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import ancestors, basename, parent
from corpusloom.operators.scopes import list_digests


def note_status(inventory: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, blob, hash, status): ``missing`` without a note, ``fresh`` if hashes agree, else ``outdated``; an unstamped note is outdated."""
    noted = notes.select("path", "hash", F.lit(True).alias("noted"))
    status = F.when(F.col("noted").isNull(), "missing").when(F.col("blob") == F.col("hash"), "fresh").otherwise("outdated")
    return inventory.select("path", "blob").join(noted, "path", "left").select("path", "blob", "hash", status.alias("status"))


def orphans(inventory: DataFrame, notes: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Notes without an inventory row, unless their path is ignored."""
    left = notes.join(inventory.select("path"), "path", "left_anti")
    return left.join(ignored.select("path"), "path", "left_anti") if ignored is not None else left


def status_counts(status: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of fresh, outdated, missing, moved and ignored; total leaves the ignored out."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.groupBy(*by).agg(*[of(s) for s in ("fresh", "outdated", "missing", "moved", "ignored")], F.count_if(F.col("status") != "ignored").alias("total"))


def _claims(sources: list[str], targets: list[str]) -> list[tuple[str, str]]:
    """Sources in order each take, of the targets still free, one with the longest common suffix of segments, the least path of these.

    Targets stand in a trie of their segments from the end; every node keeps its targets in order
    and how many are free, so a claim walks as deep as the paths are.
    """
    root: dict = {"free": 0, "first": 0, "paths": [], "below": {}}
    lines: dict[str, list[dict]] = {}
    for target in targets:
        node, line = root, [root]
        for segment in reversed(target.split("/")):
            node = node["below"].setdefault(segment, {"free": 0, "first": 0, "paths": [], "below": {}})
            line.append(node)
        lines[target] = line
        for node in line:
            node["paths"].append(target)
            node["free"] += 1
    found, claimed = [], set()
    for source in sources:
        if not root["free"]:
            break
        node = root
        for segment in reversed(source.split("/")):
            below = node["below"].get(segment)
            if below is None or not below["free"]:
                break
            node = below
        while node["paths"][node["first"]] in claimed:
            node["first"] += 1
        target = node["paths"][node["first"]]
        claimed.add(target)
        for node in lines[target]:
            node["free"] -= 1
        found.append((source, target))
    return found


def exact_moves(orphaned: DataFrame, missing: DataFrame) -> DataFrame:
    """(source, target): an orphan's note goes to a missing path of the same blob, one to one.

    Orphans are taken in the order of their paths; each takes the free path that shares the
    longest suffix of segments with it, ties to the least path. As a claim depends on those before it,
    the paths of one blob that both sides hold are settled in one task, which holds these paths and
    nothing else. A path that has several blobs counts with the least of them.
    """
    def of(df: DataFrame, path: str, blob: str) -> DataFrame:
        return df.where(F.col(blob).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.min(blob).alias("blob"))

    sources, targets = of(orphaned, "path", "hash"), of(missing, "path", "blob").withColumnRenamed("blob", "of_blob")
    sources = sources.join(targets.select(F.col("of_blob").alias("blob")).distinct(), "blob", "left_semi")
    schema = pa.schema([("source", pa.string()), ("target", pa.string())])

    def settled(sources: pa.Table, targets: pa.Table) -> pa.Table:
        order = lambda t: sorted(t.column("path").to_pylist(), key=lambda p: p.encode("utf-16-be"))
        found = _claims(order(sources), order(targets)) if len(sources) else []
        return pa.table({"source": [s for s, _ in found], "target": [t for _, t in found]}, schema=schema)

    return sources.groupBy("blob").cogroup(targets.groupBy("of_blob")).applyInArrow(settled, "source string, target string")


def directory_moves(moves: DataFrame, least: int = 1) -> DataFrame:
    """(source_dir, target_dir, votes): where most moved children of a directory went; ties go to the smaller path."""
    voted = moves.groupBy(parent(F.col("source")).alias("source_dir"), parent(F.col("target")).alias("target_dir")).agg(F.count("*").alias("votes"))
    best = F.max_by(F.struct("target_dir", "votes"), F.struct("votes", F.col("target_dir")))
    return voted.where(F.col("source_dir") != F.col("target_dir")).groupBy("source_dir").agg(best.alias("b")).select("source_dir", "b.target_dir", "b.votes").where(F.col("votes") >= least)


def with_moves(status: DataFrame, moves: DataFrame) -> DataFrame:
    """``missing`` paths that are the target of a move become ``moved``."""
    targets = moves.select(F.col("target").alias("path"), F.lit(True).alias("is_target")).distinct()
    return status.join(targets, "path", "left").withColumn("status", F.when((F.col("status") == "missing") & F.col("is_target"), "moved").otherwise(F.col("status"))).drop("is_target")


def directory_hashes(inventory: DataFrame) -> DataFrame:
    """(dir, hash): SHA-1 of the lines ``F name hash`` and ``D name`` of a directory's immediate children, by name.

    A directory's children are hashed as they pass, in order, so one of any size takes no memory.
    """
    child = lambda *line: [basename(F.col("path")).alias("name"), F.concat_ws(" ", *line).alias("line")]
    files = inventory.select(parent(F.col("path")).alias("dir"), *child(F.lit("F"), basename(F.col("path")), F.col("blob")))
    dirs = inventory.select(F.explode(ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()
    below = dirs.select(parent(F.col("path")).alias("dir"), *child(F.lit("D"), basename(F.col("path"))))
    return list_digests(files.union(below), "dir", F.col("name"), "", "", "line", "\n", "sha1", "").select("dir", F.col("digest").alias("hash"))


def scope_hashes(inventory: DataFrame, scope: str) -> DataFrame:
    """(scope, files, hash): SHA-1 of the sorted lines ``blob  path`` of each scope, ended by a line feed; a scope's lines are hashed as they pass."""
    lines = inventory.select(scope, F.concat("blob", F.lit("  "), "path").alias("line"))
    return list_digests(lines, scope, F.col("line"), "", "\n", "line", "\n", "sha1", "").select(scope, F.col("n").alias("files"), F.col("digest").alias("hash"))


def tree_rollup(status: DataFrame) -> DataFrame:
    """(dir, total, fresh, outdated, missing): counts of all paths below each directory; the root is the empty path."""
    up = status.select(F.explode(ancestors(F.col("path"))).alias("dir"), "status")
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return up.groupBy("dir").agg(F.count("*").alias("total"), of("fresh"), of("outdated"), of("missing"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two inventories (path, blob): added, removed or changed; equal rows are left out."""
    a, b = before.select("path", F.col("blob").alias("old")), after.select("path", F.col("blob").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def trend(before: DataFrame, after: DataFrame, measure: str, step: float = 1.0) -> DataFrame:
    """One row: paths whose content changed, and of these how many got better or worse by at least ``step``."""
    a = before.select("path", F.col("blob").alias("old_blob"), F.col(measure).alias("old"))
    b = after.select("path", "blob", F.col(measure).alias("new"))
    delta = F.col("new") - F.col("old")
    changed = a.join(b, "path").where("old_blob <> blob")
    return changed.agg(F.count("*").alias("changed"), F.count_if(delta >= step).alias("improved"), F.count_if(delta <= -step).alias("worsened"))
