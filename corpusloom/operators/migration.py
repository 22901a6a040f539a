"""Notes that follow their files: new paths, headings, stamps, and the names of moved paths in all notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tables import written


def final_targets(moves: DataFrame) -> DataFrame:
    """(source, target) of moves (source, target, place), each path once: where a name ends if the moves are applied in order of place, so a later move takes on what an earlier one gave."""
    first = moves.groupBy("source").agg(F.min_by(F.struct("target", "place"), "place").alias("m")).select("source", "m.target", "m.place")
    now = written(first, "moves")
    while True:
        later = first.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("place").alias("next_place"))
        joined = now.join(later, "target", "left").withColumn("goes", F.coalesce(F.col("next_place") > F.col("place"), F.lit(False)))
        then = written(joined.select("source", F.when(F.col("goes"), F.col("next")).otherwise(F.col("target")).alias("target"), F.when(F.col("goes"), F.col("next_place")).otherwise(F.col("place")).alias("place"), "goes"), "moves")
        # Places only grow, so there is an end.
        if then.where("goes").isEmpty():
            return then.select("source", "target")
        now = then.drop("goes")


def _escaped(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def renamed_in_text(notes: DataFrame, names: DataFrame) -> DataFrame:
    """(path, body, renamed) of notes (path, body): every name between two backticks that is a source of ``names`` (source, target) is its target.

    Names are joined by equality; notes without one keep their body and are not put together anew.
    """
    parts = notes.select("path", F.posexplode(F.split(F.coalesce("body", F.lit("")), "`", -1)).alias("at", "part"), F.size(F.split(F.coalesce("body", F.lit("")), "`", -1)).alias("n"))
    hits = parts.where("at > 0 and at < n - 1").join(names.select(F.col("source").alias("part"), "target"), "part").groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("part", "target"))).alias("names"), F.count("*").alias("renamed"))
    joined = notes.select("path", "body").join(hits, "path", "left")
    pieces = F.split("body", "`", -1)
    put = F.array_join(F.transform(pieces, lambda p, i: F.when((i > 0) & (i < F.size(pieces) - 1), F.coalesce(F.try_element_at("names", p), p)).otherwise(p)), "`")
    return joined.select("path", F.when(F.col("names").isNull(), F.col("body")).otherwise(put).alias("body"), F.coalesce("renamed", F.lit(0)).alias("renamed"))


def migrated_notes(notes: DataFrame, moves: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, moved_from, hash, body, renamed) of notes (path, hash, body) after moves (source, target, similarity, place).

    A moved note has its new path, and its first line ``# old path`` names it; if the content was the same (similarity 100) it is stamped with the inventory's
    (path, blob) hash, else it keeps its old one, which leaves it outdated. Then moved paths between backticks are renamed in all notes.
    """
    went = moves.groupBy("source").agg(F.min_by(F.struct("target", "similarity"), "place").alias("m")).select(F.col("source").alias("path"), "m.target", "m.similarity")
    placed = notes.join(went, "path", "left").join(inventory.select(F.col("path").alias("target"), F.col("blob").alias("now")), "target", "left")
    old = F.concat(F.lit("(?m)^# "), _escaped(F.col("path")), F.lit("$"))
    at = F.when(F.col("target").isNotNull(), F.regexp_instr("body", old)).otherwise(0)
    headed = F.when(at > 0, F.concat(F.substring(F.col("body"), F.lit(1), at - 1), F.lit("# "), F.col("target"), F.substring(F.col("body"), at + F.length("path") + 2, F.length("body")))).otherwise(F.col("body"))
    stamp = F.when((F.col("similarity") == 100) & F.col("now").isNotNull(), F.col("now")).otherwise(F.col("hash"))
    moved = written(placed.select(F.coalesce("target", "path").alias("path"), F.when(F.col("target").isNotNull(), F.col("path")).alias("moved_from"), stamp.alias("hash"), headed.alias("body")), "migrated")
    return moved.drop("body").join(renamed_in_text(moved, final_targets(moves)), "path")
