"""Paths named in notes as inline code: whether they exist from where the note stands, and what they may be now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import basename, parent
from corpusloom.functions.text import inline_code
from corpusloom.operators.status import search_bases, without_glob


def is_pathlike(text: Column) -> Column:
    """Whether inline code names a path: no signs of code, a slash or the ending of a script, no dotted directories, not only plain words."""
    like = lambda pattern: F.regexp_like(text, F.lit(pattern))
    # The patterns of what is and isn't a path.
    code = like(r"[\s\"'$(){}<>\\]") | like(r"^[@\-#/~.]") | F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | text.startswith("node:") | ~like(r"^[\w./-]+$")
    dotted, words = like(r"\.[^/]*/"), like(r"^(?:[a-z]+/)*[a-z]+$")
    return ~code & F.when(F.contains(text, F.lit("/")), ~dotted & ~words).otherwise(like(r"\.[cm]?tsx?$"))


def possible_files(path: Column) -> Column:
    """The path, and the sources that a script's path, or one without an ending, can mean."""
    scripts = F.array(F.regexp_replace(path, r"\.([cm]?)js$", ".$1ts"), F.regexp_replace(path, r"\.js$", ".tsx"))
    bare = F.array(*[F.concat(path, F.lit(e)) for e in (".ts", ".tsx", ".js", "/index.ts")])
    more = F.when(F.regexp_like(path, F.lit(r"\.[cm]?js$")), scripts).when(~F.regexp_like(path, F.lit(r"\.\w+$")), bare).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(path), more)


def note_base(path: Column, kind: Column) -> Column:
    """The directory that a note's references start from: its own, or that of its file."""
    return F.when(kind == "dir", path).otherwise(parent(path))


def references(notes: DataFrame) -> DataFrame:
    """(path, base, ref, target): distinct references of notes (path, type, body) and what is looked for: without a slash at the end, and without a star there."""
    spans = notes.select("path", note_base(F.col("path"), F.col("type")).alias("base"), F.explode(F.array_distinct(F.transform(inline_code(F.coalesce("body", F.lit(""))), lambda s: F.trim(s)))).alias("ref"))
    named = spans.where(is_pathlike(F.col("ref"))).withColumn("target", without_glob(F.col("ref"))).where("target <> ''")
    return named.where(is_pathlike(F.col("target")) | F.col("ref").endswith("/"))


def broken_references(notes: DataFrame, inventory: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """(path, ref, suggestion): references that are found neither below the note's directory, nor one above it, nor their ``src``.

    ``inventory`` are the paths (path, type) of files and directories. A bare file name is found wherever a file has it. A suggestion is where a move (source, target) took one
    of the places looked at, the first in their order, else the only file of that name; for a bare name, where the first file of that name went.
    """
    refs = references(notes)
    bases = F.transform(search_bases(F.col("base")), lambda b: F.when(b == "", F.col("target")).otherwise(F.concat(b, F.lit("/"), F.col("target"))))
    places = refs.select("path", "ref", "target", F.posexplode(F.array_distinct(bases)).alias("rank", "place"))
    known = inventory.select("path").distinct()
    tried = places.select("path", "ref", F.explode(possible_files(F.col("place"))).alias("found")).distinct()
    there = tried.join(known.withColumnRenamed("path", "found"), "found").select("path", "ref").distinct()
    files = inventory.where("type = 'file'").select("path").distinct()
    named = files.groupBy(basename(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only"))
    bare = ~F.contains("target", F.lit("/"))
    left = refs.join(there, ["path", "ref"], "left_anti").withColumn("name", basename(F.col("target"))).join(named, "name", "left").where(~(bare & F.col("n").isNotNull()))
    only = F.when(F.col("n") == 1, F.col("only"))
    if moves is None:
        return left.select("path", "ref", F.when(~bare, only).alias("suggestion"))
    went = moves.groupBy("source").agg(F.min("target").alias("to"))
    formerly = places.join(went.withColumnRenamed("source", "place"), "place").groupBy("path", "ref").agg(F.min_by("to", "rank").alias("formerly"))
    by_name = moves.groupBy(basename(F.col("source")).alias("name")).agg(F.min_by("target", F.struct("source", "target")).alias("renamed"))
    joined = left.join(formerly, ["path", "ref"], "left").join(by_name, "name", "left")
    return joined.select("path", "ref", F.when(bare, F.col("renamed")).otherwise(F.coalesce("formerly", only)).alias("suggestion"))


def page_links(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, code, link): inline code that leads to another page (path): as it stands, beside the note, or one directory up, the first that is one."""
    base = note_base(F.col("path"), F.col("type"))
    spans = notes.select("path", base.alias("base"), F.explode(F.array_distinct(F.transform(inline_code(F.coalesce("body", F.lit(""))), lambda s: F.trim(s)))).alias("code")).where("code <> ''")
    stripped = F.regexp_replace(F.regexp_replace(F.regexp_replace("code", r"/$", ""), r"/?\*$", ""), r"-\*$", "")
    plain = spans.where(~F.regexp_like("code", F.lit(r"[\s`$(){}\"']"))).withColumn("target", stripped).where("target <> ''")
    beside = F.when(F.col("base") != "", F.concat("base", F.lit("/"), "target"))
    above = F.when(F.contains("base", F.lit("/")), F.concat(parent(F.col("base")), F.lit("/"), "target"))
    tried = plain.select("path", "code", F.posexplode(F.array(F.col("target"), beside, above)).alias("rank", "link")).where("link is not null and link <> path")
    return tried.join(pages.select(F.col("path").alias("link")).distinct(), "link", "left_semi").groupBy("path", "code").agg(F.min_by("link", "rank").alias("link"))
