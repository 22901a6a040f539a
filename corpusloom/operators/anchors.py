"""Code anchors in notes: links to lines of a source by what the lines say, and those that no longer lead anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a line that defines a name begins with, lines that only import, and the scheme of an anchor.
DEFINES = r"(?:function|class|interface|type|enum|const|let|var|def|fn)\s+"
IMPORTS, SCHEME = r"^\s*import\b", "code:"

#: A word's border by ASCII letters, digits and underscores alone, whatever else stands beside it.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

FENCE = r"(?m)^ {0,3}(?:```[^`\n]*$[\s\S]*?(?:^ {0,3}```+[ \t]*$|\z)|~~~.*$[\s\S]*?(?:^ {0,3}~~~+[ \t]*$|\z))"
INLINE = r"`+[^`\n]+`+"
#: A link or image whose target has no white space, or stands in angle brackets, with a title or without.
LINK = r"""!?\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*\]\([ \t]*(?:<[^<>\n]*>|(?:[^\s()<\\]|\\.|\([^\s()]*\))(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:[ \t]+(?:"[^"\n]*"|'[^'\n]*'))?[ \t]*\)"""
TARGET = r"""^!?\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*\]\([ \t]*<?([^\s<>]+?)>?(?:[ \t]+(?:"[^"\n]*"|'[^'\n]*'))?[ \t]*\)$"""


def find_line(lines: Column, marker: Column) -> Column:
    """The line, from 1, that a marker means: the first that defines it, else that has it as a word, else that has it at all; null for none.

    Lines that import are only looked at for definitions.
    """
    quoted = F.concat(F.lit(r"\Q"), F.replace(marker, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    own = lambda line: ~F.regexp_like(line, F.lit(IMPORTS))

    def of(having: Column) -> Column:
        first = lambda fits: F.get(F.filter(having, lambda h: fits(h["line"])), 0)["at"]
        defined = first(lambda line: F.regexp_like(line, F.concat(F.lit(EDGE + DEFINES), quoted, F.lit(EDGE))))
        word = first(lambda line: own(line) & F.regexp_like(line, F.concat(F.lit(EDGE), quoted, F.lit(EDGE))))
        return F.coalesce(defined, word, first(own))

    # A pattern made of a column is compiled for each line, so only lines that have the marker at all are held against it; they are found once.
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).cast("long").alias("at"), line.alias("line")))
    return F.transform(F.array(F.filter(numbered, lambda n: F.contains(n["line"], marker))), of)[0]


def anchor_parts(target: Column) -> Column:
    """(start, end) markers of a link target ``code:start..end``, decoded and trimmed, empty ones null; the struct is null for other targets."""
    raw = F.substring(target, F.lit(len(SCHEME) + 1), F.length(target))
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    parts = F.split(decoded, r"\.\.")
    of = lambda i: F.nullif(F.trim(F.get(parts, i)), F.lit(""))
    return F.when(target.startswith(SCHEME), F.struct(of(0).alias("start"), of(1).alias("end")))


def without_fenced(body: Column) -> Column:
    """A body with the lines of fenced blocks emptied, so that lines keep their numbers."""
    pieces = F.regexp_extract_all(body, F.lit(rf"{FENCE}|[^\n]*\n|[^\n]+"), F.lit(0))
    blank = lambda p: F.when(F.regexp_like(p, F.lit(r"^ {0,3}(```[^`\n]*(\n|$)|~~~)")), F.regexp_replace(p, r"[^\n]+", "")).otherwise(p)
    return F.array_join(F.transform(pieces, blank), "")


def code_links(notes: DataFrame) -> DataFrame:
    """(path, line, raw, start, end): links to code in notes (path, body), outside fenced blocks and inline code."""
    lines = notes.select("path", F.posexplode(F.split(without_fenced(F.coalesce("body", F.lit(""))), "\n", -1)).alias("at", "text")).where(F.contains("text", F.lit(f"]({SCHEME}")) | F.contains("text", F.lit(f"<{SCHEME}")))
    links = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all(F.regexp_replace("text", INLINE, ""), F.lit(LINK), F.lit(0))).alias("raw"))
    return links.select("path", "line", "raw", anchor_parts(F.regexp_extract("raw", TARGET, 1)).alias("a")).where("a is not null").select("path", "line", "raw", "a.start", "a.end")


def parse_failures(notes: DataFrame) -> DataFrame:
    """(path, line, anchor): lines that look like a link to code but, read alone, leave it as text: blanks in the target, inline code, indented code."""
    lines = notes.select("path", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n", -1)).alias("at", "text")).where(F.contains("text", F.lit(f"]({SCHEME}")))
    # Inline code stays as text; elsewhere what is a link goes.
    kept = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(rf"{INLINE}|[^`]+|`"), F.lit(0)), lambda p: F.when(F.regexp_like(p, F.lit(rf"^{INLINE}$")), p).otherwise(F.regexp_replace(p, LINK, ""))), "")
    left = F.contains(kept, F.lit(f"]({SCHEME}")) | F.regexp_like("text", F.lit(r"^(?: {4}|\t)"))
    return lines.where(left).select("path", (F.col("at") + 1).alias("line"), F.trim("text").alias("anchor"))


def anchor_findings(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, path, line, marker, anchor): ``parse`` failures, markers that no line has any more (``rot``), and ``missing-source`` of notes (path, type, body).

    Notes on directories have no source. Each marker is looked for once in its source (path, text), however often notes name it.
    """
    none = F.lit(None).cast("string")
    failures = parse_failures(notes).select(F.lit("parse").alias("kind"), "path", "line", none.alias("marker"), "anchor")
    files = notes.where("type <> 'dir'")
    missing = files.select("path").join(sources.select("path"), "path", "left_anti").select(F.lit("missing-source").alias("kind"), "path", F.lit(None).cast("int").alias("line"), none.alias("marker"), none.alias("anchor"))
    links = code_links(files)
    markers = links.select("path", "line", "raw", F.explode(F.array_compact(F.array("start", "end"))).alias("marker"))
    asked = markers.select("path", "marker").distinct().groupBy("path").agg(F.collect_list("marker").alias("markers"))
    found = asked.join(sources.select("path", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")), "path")
    gone = found.select("path", F.explode_outer(F.filter("markers", lambda m: find_line(F.col("lines"), m).isNull())).alias("marker")).where("marker is not null")
    rot = markers.join(gone, ["path", "marker"], "left_semi").select(F.lit("rot").alias("kind"), "path", "line", "marker", F.col("raw").alias("anchor"))
    return failures.unionByName(rot).unionByName(missing)


def finding_counts(findings: DataFrame) -> DataFrame:
    """One row: total, parse_failures, rot_markers, missing_sources."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return findings.agg(F.count("*").alias("total"), of("parse").alias("parse_failures"), of("rot").alias("rot_markers"), of("missing-source").alias("missing_sources"))
