"""Records of tools as text: index and status lines of a repository, rename and size lines of a diff, findings of linters, ratings in wide rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.prose import is_repository_path
from corpusloom.operators.freshness import scope_hashes

REGULAR_MODES = ("100644", "100755")
#: The forms of the lines.
INDEX, RENAME, SIZE = r"^([0-9]{6}) ([0-9a-f]+) ([0-3])\t([\s\S]*)$", r"^R(\d+)\t([^\t]+)\t(.+)$", r"^(\d+|-)\t(\d+|-)\t(.+)$"


def _folded(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in paths:
        yield batch.map(lambda p: None if p is None else unicodedata.normalize("NFC", p).lower())


def tracked_files(records: DataFrame, worktree: DataFrame, digits: int = 40) -> tuple[DataFrame, DataFrame]:
    """Index lines (place, record) beside the files that are there (path, blob, mode): the tracked files, and what is wrong.

    Files: (path, index_blob, current_blob, index_mode, current_mode, deleted). Problems: (path, code), the path null where it can't be read:
    ``malformed-record``, ``invalid-path``, ``duplicate-path`` (all but a path's first line), ``path-collision`` (paths that are one but for case
    or composition; the first of them stands), ``unmerged-entry``, ``invalid-object`` (not ``digits`` long), ``irregular-mode``, of these three the first; and for files ``mode-drift`` and ``deleted``.
    """
    part = lambda i: F.regexp_extract("record", INDEX, i)
    known = F.regexp_like("record", F.lit(INDEX))
    read = records.select("place", known.alias("known"), part(1).alias("mode"), part(2).alias("blob"), part(3).alias("stage"), part(4).alias("path"))
    none = F.lit(None).cast("string")
    told = lambda df, code, path=F.col("path"): df.select(path.alias("path"), F.lit(code).alias("code"))
    lines = read.where("known")
    safe = lines.where(is_repository_path(F.col("path")))
    numbered = safe.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("place")))
    first = numbered.where("nth = 1").withColumn("folded", F.pandas_udf(_folded, "string")("path"))
    owners = first.groupBy("folded").agg(F.min_by("path", "place").alias("owner"))
    problem = F.when(F.col("stage") != "0", "unmerged-entry").when(F.length("blob") != digits, "invalid-object").when(~F.col("mode").isin(*REGULAR_MODES), "irregular-mode")
    judged = first.withColumn("problem", problem)
    there = worktree.select("path", F.col("blob").alias("current_blob"), F.col("mode").alias("current_mode"))
    files = judged.where("problem is null").join(there, "path", "left").select("path", F.col("blob").alias("index_blob"), "current_blob", F.col("mode").alias("index_mode"), "current_mode", F.col("current_blob").isNull().alias("deleted"))
    problems = (
        told(read.where("not known"), "malformed-record", none).unionByName(told(lines.where(~is_repository_path(F.col("path"))), "invalid-path", none)).unionByName(told(numbered.where("nth > 1"), "duplicate-path"))
        .unionByName(told(first.join(owners, "folded").where("owner <> path"), "path-collision")).unionByName(judged.where("problem is not null").select("path", F.col("problem").alias("code")))
        .unionByName(told(files.where("current_mode <> index_mode"), "mode-drift")).unionByName(told(files.where("deleted"), "deleted"))
    )
    return files, problems


def renames(lines: DataFrame) -> DataFrame:
    """(anchor, source, target, similarity) of a diff's name lines (anchor, line); lines of other changes are left out."""
    found = lines.where(F.regexp_like("line", F.lit(RENAME)))
    part = lambda i: F.regexp_extract("line", RENAME, i)
    return found.select("anchor", part(2).alias("source"), part(3).alias("target"), part(1).cast("int").alias("similarity"))


def sizes(lines: DataFrame) -> DataFrame:
    """(anchor, path, added, removed) of a diff's size lines (anchor, line); 0 for binary files."""
    found = lines.where(F.regexp_like("line", F.lit(SIZE)))
    number = lambda i: F.coalesce(F.regexp_extract("line", SIZE, i).try_cast("long"), F.lit(0).cast("long"))
    return found.select("anchor", F.regexp_extract("line", SIZE, 3).alias("path"), number(1).alias("added"), number(2).alias("removed"))


def dirty_paths(raw: Column) -> Column:
    """Distinct paths of a status listing whose fields end in NUL: an entry is two signs, a blank and a path; a rename or copy is followed by the path it comes from."""
    # A rename and its origin are one match, so no field depends on those before it, and a long listing takes time in proportion.
    parts = F.regexp_extract_all(raw, F.lit(r"[RC][^\x00]{3,}\x00[^\x00]*|[^\x00]+"), F.lit(0))
    # Only a rename's match has a NUL in it.
    both = lambda p: F.array(F.substring_index(F.substring(p, F.lit(4), F.length(p)), "\0", 1), F.substring_index(p, "\0", -1))
    paths = lambda p: F.when(F.contains(p, F.lit("\0")), both(p)).when(F.length(p) >= 4, F.array(F.substring(p, F.lit(4), F.length(p)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(parts, paths)))


GENERIC = "struct<tool:string,findings:array<struct<path:string,line:int,category:string,title:string,evidence:string,fix:string,detector:string>>>"
LINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,line:int,message:string>>>>"
UNUSED = "struct<files:array<string>,issues:array<struct<file:string,exports:array<struct<symbol:string,line:int>>,types:array<struct<symbol:string,line:int>>>>>"


def generic_findings(reports: DataFrame, categories: list[str]) -> DataFrame:
    """(report, path, line, category, title, detector, kept) of any tool's reports (report, text): kept are findings with a safe path, a known category, a title and evidence."""
    parsed = reports.select("report", F.from_json("text", GENERIC).alias("r")).select("report", F.coalesce("r.tool", F.lit("external")).alias("tool"), F.explode("r.findings").alias("f"))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    kept = is_repository_path(F.col("f.path")) & F.coalesce(F.col("f.category").isin(categories), F.lit(False)) & filled(F.col("f.title")) & filled(F.col("f.evidence"))
    detector = F.concat_ws(":", "tool", F.nullif(F.col("f.detector"), F.lit("")))
    return parsed.select("report", "f.path", "f.line", "f.category", "f.title", detector.alias("detector"), kept.alias("kept"))


def lint_findings(reports: DataFrame, root: str, rules: dict[str, str]) -> DataFrame:
    """(report, path, line, category, title, detector, kept) of a linter's reports: kept are messages of files below ``root`` whose rule (key) stands for a category."""
    each = reports.select("report", F.explode(F.from_json("text", LINT)).alias("f")).select("report", F.col("f.filePath").alias("file"), F.explode("f.messages").alias("m"))
    base = root.rstrip("/") + "/"
    path = F.when(F.col("file").startswith(base), F.substring("file", len(base) + 1, 10_000)).otherwise(F.col("file"))
    category = F.lit(None).cast("string")
    for rule, name in rules.items():
        category = F.when(F.col("m.ruleId") == rule, name).otherwise(category)
    kept = category.isNotNull() & is_repository_path(path) & (F.coalesce("m.message", F.lit("")) != "")
    return each.select("report", path.alias("path"), "m.line", category.alias("category"), F.col("m.message").alias("title"), F.concat(F.lit("eslint:"), F.col("m.ruleId")).alias("detector"), kept.alias("kept"))


def unused_findings(reports: DataFrame) -> DataFrame:
    """The same of a dead-code tool's reports: files that nothing uses, and exports and types of files that are."""
    parsed = reports.select("report", F.from_json("text", UNUSED).alias("r"))
    row = lambda path, line, title, detector: [path.alias("path"), line.alias("line"), F.lit("dead-code").alias("category"), title.alias("title"), F.lit(f"knip:{detector}").alias("detector"), is_repository_path(path).alias("kept")]
    files = parsed.select("report", F.explode("r.files").alias("f")).select("report", *row(F.col("f"), F.lit(None).cast("int"), F.col("f"), "files"))
    issues = parsed.select("report", F.explode("r.issues").alias("i"))
    out = files
    for kind in ("exports", "types"):
        each = issues.select("report", F.col("i.file").alias("f"), F.explode(f"i.{kind}").alias("e"))
        out = out.unionByName(each.select("report", *row(F.col("f"), F.col("e.line"), F.col("e.symbol"), kind)))
    return out


def ingest_counts(found: DataFrame) -> DataFrame:
    """(report, accepted, dropped): nothing is left out uncounted."""
    return found.groupBy("report").agg(F.count_if("kept").alias("accepted"), F.count_if(~F.col("kept")).alias("dropped"))


def rated_snippets(rows: DataFrame, key: str, ratings: Column, skip: int = 0, low: float | None = None, high: float | None = None, least: int = 1) -> DataFrame:
    """(key, snippet, n, mean) of wide rows: a rater's line (key, and cells as an array), a cell for each snippet from cell ``skip`` on.

    Cells that are no number, zero, or outside ``low`` to ``high`` are no rating; snippets with fewer than ``least`` are left out. Cells are ratings of
    one snippet each, summed before they meet.
    """
    cells = rows.select(key, F.posexplode(ratings).alias("at", "cell")).where(F.col("at") >= skip)
    value = F.trim("cell").try_cast("double")
    fits = value.isNotNull() & ~F.isnan(value) & (value != 0)
    if low is not None:
        fits = fits & (value >= low)
    if high is not None:
        fits = fits & (value <= high)
    good = cells.where(fits).select(key, (F.col("at") - skip + 1).alias("snippet"), value.alias("value"))
    return good.groupBy(key, "snippet").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).where(F.col("n") >= least)


def legacy_scans(ledgers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledgers of single scans (slug, text as JSON), each taken whole or not at all: (slug, files, findings, scope_hash, scanned_at, problem), and the rows (slug, path, blob, severity, count) of the sound ones.

    A scan has a normal path, a blob of 40 hex digits and a whole number of findings from 0 on, and its path is named once. ``problem`` is the first scan's (from 1) that isn't so: ``path``, ``blob``, ``count`` or
    ``duplicate``, as ``3:blob``; ``no-scans`` without any. Sums that pass 2^53 - 1 are ``overflow``.
    """
    text = lambda v, key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    scans = ledgers.select("slug", F.try_variant_get(F.try_parse_json("text"), "$.scans", "array<variant>").alias("scans"))
    each = scans.select("slug", F.posexplode("scans").alias("at", "s"))
    number = F.try_variant_get("s", "$.finding_count", "double")
    is_number = ~F.coalesce(F.schema_of_variant(F.try_variant_get("s", "$.finding_count", "variant")).isin("STRING", "BOOLEAN"), F.lit(False))
    count = F.when(is_number & (number >= 0) & (number == F.floor(number)) & (number <= 2**53 - 1), number.cast("long"))
    s = F.col("s")
    read = each.select("slug", "at", text(s, "path").alias("path"), F.lower(text(s, "git_blob_sha1")).alias("blob"), count.alias("count"), F.coalesce(text(s, "max_severity"), F.lit("info")).alias("severity"), text(s, "scanned_at").alias("scanned_at"))
    nth = F.row_number().over(Window.partitionBy("slug", "path").orderBy("at"))
    wrong = F.when(~is_repository_path(F.col("path")), "path").when(~F.coalesce(F.regexp_like("blob", F.lit("^[0-9a-f]{40}$")), F.lit(False)), "blob").when(F.col("count").isNull(), "count").when(nth > 1, "duplicate")
    judged = read.withColumn("wrong", wrong)
    sums = judged.groupBy("slug").agg(
        F.count("*").alias("files"), F.sum(F.col("count").cast("decimal(38,0)")).alias("findings"), F.max("scanned_at").alias("scanned_at"),
        F.min(F.when(F.col("wrong").isNotNull(), F.struct("at", "wrong"))).alias("first"))
    problem = F.when(F.col("files").isNull(), "no-scans").when(F.col("first").isNotNull(), F.concat((F.col("first.at") + 1).cast("string"), F.lit(":"), F.col("first.wrong"))).when(F.col("findings") > 2**53 - 1, "overflow")
    of = ledgers.select("slug").join(sums, "slug", "left").withColumn("problem", problem)
    sound = of.where("problem is null").select("slug")
    rows = judged.join(sound, "slug", "left_semi").select("slug", "path", "blob", "severity", "count")
    hashes = scope_hashes(rows, "slug").select("slug", F.col("hash").alias("scope_hash"))
    fine = F.col("problem").isNull()
    whole = of.join(hashes, "slug", "left").select("slug", F.when(fine, F.col("files")).alias("files"), F.when(fine, F.col("findings").cast("long")).alias("findings"), "scope_hash", F.when(fine, F.col("scanned_at")).alias("scanned_at"), "problem")
    return whole, rows
