"""Design detectors over program files: cycles and climbs of imports, escapes from types, markers that grew old, flags at a call's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import ancestors
from corpusloom.operators.graph import strong_components
from corpusloom.operators.history import marker_age

#: What escapes a type, in code and in comments, the marks of work put off, and a flag as the last of several parameters.
ESCAPES = [r"\bas\s+unknown\s+as\b", r"\bas\s+any\b", r":\s*any\b", r"\bRecord<\s*string\s*,\s*unknown\s*>"]
IGNORES, MARKER = r"@ts-ignore\b", r"\b(TODO|FIXME|HACK|XXX|KLUDGE)\b"
FLAG = r"\([^(){}]*,\s*([A-Za-z_$][\w$]*)(?:\?\s*:\s*boolean|\s*:\s*boolean\s*=\s*(?:true|false)|\s*=\s*(?:true|false))\s*,?\s*\)"


def import_cycles(edges: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(level, node, cycle): files, and packages, that import one another in a circle; the cycle has the least node's name.

    A file's package is the nearest root (root) above it; files without one take no part at that level.
    """
    found = strong_components(edges.where("src <> dst")).select(F.lit("module").alias("level"), F.col("node"), F.col("component").alias("cycle"))
    if packages is None:
        return found
    ends = edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct()
    above = ends.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("root"))
    owner = above.join(packages.select("root").distinct(), "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    lifted = edges.join(owner.toDF("src", "a"), "src").join(owner.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return found.unionByName(strong_components(lifted).select(F.lit("package").alias("level"), F.col("node"), F.col("component").alias("cycle")))


def layer_violations(edges: DataFrame, layers: list[list[str]]) -> DataFrame:
    """(src, dst, from_layer, to_layer): imports that climb: ``layers`` are lists of path prefixes, the topmost first, and a file may use its own and those below.

    Files outside all layers may use and be used by any. A layer's list is short, so its prefixes are literals.
    """
    def layer(path: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, prefixes in reversed(list(enumerate(layers))):
            for prefix in prefixes:
                out = F.when((path == prefix) | path.startswith(prefix.rstrip("/") + "/"), i).otherwise(out)
        return out

    placed = edges.select("src", "dst", layer(F.col("src")).alias("from_layer"), layer(F.col("dst")).alias("to_layer"))
    return placed.where("to_layer < from_layer")


def type_escapes(lines: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, escapes) of files (key, code, comment: arrays of lines) with ``least`` escapes or more; text in strings is none."""
    in_code = F.aggregate("code", F.lit(0), lambda n, s: n + sum((F.regexp_count(s, F.lit(p)) for p in ESCAPES), F.lit(0)))
    ignored = F.aggregate("comment", F.lit(0), lambda n, s: n + F.regexp_count(s, F.lit(IGNORES)))
    return lines.select(key, (in_code + ignored).alias("escapes")).where(F.col("escapes") >= least)


def markers(lines: DataFrame, key: str) -> DataFrame:
    """(key, line, marker): the first marker of each comment line."""
    each = lines.select(key, F.posexplode("comment").alias("at", "text")).where(F.regexp_like("text", F.lit(MARKER)))
    return each.select(key, (F.col("at") + 1).alias("line"), F.regexp_extract("text", MARKER, 1).alias("marker"))


def marker_ages(found: DataFrame, ages: DataFrame, key: str, now: Column, threshold_days: int = 180) -> DataFrame:
    """(key, markers, stale, recent, unknown, oldest) of each file with markers; ``ages`` are (key, line, changed), and a line that isn't there has no known age."""
    state = found.join(ages, [key, "line"], "left").withColumn("state", marker_age(F.col("changed"), now, threshold_days))
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    return state.groupBy(key).agg(F.count("*").alias("markers"), of("stale"), of("recent"), of("unknown"), F.min("changed").alias("oldest"))


def boolean_traps(lines: DataFrame, key: str) -> DataFrame:
    """(key, line, parameter): parameter lists on one line that end in an optional flag after another parameter; named members of an object are none."""
    each = lines.select(key, F.posexplode("code").alias("at", "text")).where(F.regexp_like("text", F.lit(FLAG)))
    return each.select(key, (F.col("at") + 1).alias("line"), F.regexp_extract("text", FLAG, 1).alias("parameter"))


def absence_mixing(lines: DataFrame, key: str) -> DataFrame:
    """(key, name, line): interfaces and types with both an optional member and one that may be null among their direct ones; what is nested has its own way."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("line"), F.lit(0).alias("base"), F.lit(False).alias("optional"), F.lit(False).alias("nullable"), F.array().cast("array<struct<name:string,line:int>>").alias("found"))
    head = r"\b(?:interface|type)\s+([A-Za-z_$][\w$]*)[^{]*\{"

    def step(a: Column, x: Column) -> Column:
        text = x["text"]
        signs = F.transform(F.regexp_extract_all(text, F.lit(r"[{}]"), F.lit(0)), lambda b: F.when(b == "{", 1).otherwise(-1))
        after = F.greatest(F.lit(0), F.aggregate(signs, a["depth"], lambda d, b: d + b))
        opens = a["name"].isNull() & F.regexp_like(text, F.lit(head))
        inside = a["name"].isNotNull() & (a["depth"] == a["base"] + 1)
        own = F.regexp_replace(F.when(opens, F.regexp_replace(text, rf"^.*?{head}", "")).otherwise(text), r"\{[^{}]*\}|\([^()]*\)", "")
        looks = inside | opens
        optional = F.when(opens, False).otherwise(a["optional"]) | (looks & F.regexp_like(own, F.lit(r"(?:^|[;,{\s])[\w$\"']+\?\s*:")))
        nullable = F.when(opens, False).otherwise(a["nullable"]) | (looks & F.regexp_like(own, F.lit(r":[^;]*\|\s*null\b|:\s*null\s*\|")))
        base = F.when(opens, a["depth"]).otherwise(a["base"])
        closes = (a["name"].isNotNull() | opens) & (after <= base)
        name = F.when(opens, F.regexp_extract(text, head, 1)).otherwise(a["name"])
        line = F.when(opens, x["line"]).otherwise(a["line"])
        both = closes & optional & nullable
        return F.struct(
            after.alias("depth"), F.when(~closes, name).alias("name"), line.alias("line"), base.alias("base"), (optional & ~closes).alias("optional"), (nullable & ~closes).alias("nullable"),
            F.when(both, F.array_append(a["found"], F.struct(name.alias("name"), line.alias("line")))).otherwise(a["found"]).alias("found"),
        )

    numbered = F.transform("code", lambda s, i: F.struct(s.alias("text"), (i + 1).alias("line")))
    found = lines.select(key, F.aggregate(numbered, start, step)["found"].alias("found"))
    return found.select(key, F.inline_outer("found")).where("name is not null")
