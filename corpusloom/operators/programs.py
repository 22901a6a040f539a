"""Program files: which are read, what is measured on their code, their functions, and code that repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.functions import text as T
from corpusloom.operators.tables import spread

#: Naming styles as ``naming_style`` tells them, as patterns of a line that is an identifier.
STYLES = {
    "camel": r"(?m)^_*(?![A-Z0-9]*_*$)[a-z0-9][A-Za-z0-9$]+_*$",
    "snake": r"(?m)^_*(?=[a-z0-9_]*[a-z])[a-z0-9]+_[a-z0-9_]*[a-z0-9]_*$",
    "pascal": r"(?m)^_*[A-Z][A-Z0-9$]*[a-z][A-Za-z0-9$]*_*$",
    "upper": r"(?m)^_*[A-Z0-9][A-Z0-9_]*[A-Z0-9]_*$",
}


def read_state(path: Column, text: Column, most_bytes: int = 512 << 10, looked_at: int = 8 << 10) -> Column:
    """``read``, or why a file isn't: ``not-code`` by its ending or a zero character near its start, ``large``."""
    zero = F.locate("\0", text)
    return (
        F.when(C.family_of(path).isNull() | text.isNull(), "not-code").when(F.octet_length(text) > most_bytes, "large")
        .when((zero > 0) & (F.octet_length(F.substring(text, F.lit(1), zero - 1)) < looked_at), "not-code").otherwise("read")
    )


def with_lines(files: DataFrame, key: str, family: str, text: str = "text") -> DataFrame:
    """(key, raw, code, comment): a file's lines, their code without strings, and their comments."""
    text_of = F.coalesce(F.col(text), F.lit(""))
    parts = spread(files).select(key, F.split(text_of, "\n", -1).alias("raw"), C.masked(text_of, C.FAMILIES[family]).alias("m"))
    return parts.select(key, "raw", F.col("m.code").alias("code"), F.col("m.comment").alias("comment"))


def functions(files: DataFrame, key: str, family: str, text: str = "text", most: int = 500) -> DataFrame:
    """A row for each function of each file: (key, name, line, lines, max_line_len, max_nesting, branches, comment_lines)."""
    found = with_lines(files, key, family, text).select(key, C.function_regions(F.col("raw"), F.col("code"), F.col("comment"), C.FAMILIES[family], most).alias("f"))
    # The inner form would have Spark look for empty arrays first, and so find the functions twice.
    return found.select(key, F.inline_outer("f")).where("line is not null")


def largest_functions(found: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The ``top`` functions by lines, then nesting; ties by file and line."""
    return found.orderBy(F.desc("lines"), F.desc("max_nesting"), key, "line").limit(top)


def _count(lines: str, fits) -> Column:
    return F.size(F.filter(lines, fits))


def _part(n: Column, of: str) -> Column:
    """A share that is 0 where there is nothing to share."""
    return F.when(F.col(of) > 0, n / F.col(of)).otherwise(F.lit(0.0))


def _looks_commented_out(comment: Column) -> Column:
    trimmed = F.regexp_replace(comment, rf"^[{C.BLANK}]+|[{C.BLANK}]+$", "")
    return (comment != "") & C.is_filled(comment) & ~F.regexp_like(F.regexp_replace(trimmed, C.COMMENT_MARK, ""), F.lit(C.NO_CODE)) & F.regexp_like(trimmed, F.lit(C.LOOKS_LIKE_CODE))


def file_features(files: DataFrame, key: str, family: str, text: str = "text") -> DataFrame:
    """A file's vector, one row each, from one pass over its lines; nothing is shuffled.

    Lines and their lengths (quantile q of n sorted lengths is the one at floor(q * n), from 0),
    shares of blank, comment, inline-comment and commented-out lines, depth, branches in 100 code
    lines, identifiers that are no keywords with their naming style, entropy and volume of
    the tokens of code without strings, words that comments share with names near them
    (null without such words), re-exports, and the largest function. Shares of nothing are 0.
    """
    fam = C.FAMILIES[family]
    lines = with_lines(files, key, family, text)
    # A pattern that can't cross a line's end is looked for in all lines at once; what is done line by line is only done where it can matter.
    code_text, filled = F.array_join("code", "\n"), C.FILLED + r"[^\n]*"
    said = F.filter(F.arrays_zip("code", "comment"), lambda x: (x["comment"] != "") & C.is_filled(x["comment"]))
    depth = C.deepest_brace(F.col("code")) if fam.braces else C.deepest_indent(F.col("code")) if fam.triple else F.lit(0)
    first = lines.select(
        key, F.size("raw").alias("lines"), F.sort_array(F.transform(F.filter("raw", C.is_filled), F.length)).alias("lengths"), F.regexp_count(code_text, F.lit(filled)).alias("code_lines"),
        F.transform(said, lambda x: C.is_filled(x["code"])).alias("beside_code"),
        _count("comment", _looks_commented_out).alias("commented_out"), depth.alias("max_nesting"), F.regexp_count(code_text, F.lit(T.BRANCHES)).alias("branches"),
        _count("code", lambda s: s.contains("export") & F.regexp_like(s, F.lit(C.REEXPORT))).alias("reexports"),
        C.own_names(code_text).alias("names"), F.sort_array(T.tokens(code_text)).alias("tokens"),
        C.coherence(F.col("code"), F.col("comment")).alias("coherence"),
        C.function_regions(F.col("raw"), F.col("code"), F.col("comment"), fam).alias("functions"),
    )
    second = first.withColumns({
        "non_blank": F.size("lengths"), "n_tokens": F.size("tokens"), "runs": C.run_lengths(F.col("tokens")), "n_names": F.size("names"),
        "mean": F.when(F.size("lengths") > 0, F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x) / F.size("lengths")).otherwise(F.lit(0.0)),
        "named": F.array_join("names", "\n"), "inline": _count("beside_code", lambda beside: beside),
    })
    third = second.withColumns({
        "comment_only": F.size("beside_code") - F.col("inline"),
        "sd": F.when(F.col("non_blank") > 0, F.sqrt(F.aggregate("lengths", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("non_blank"))).otherwise(F.lit(0.0)),
        "by_style": F.array(*[F.struct(F.regexp_count("named", F.lit(pattern)).alias("n"), F.lit(-i).alias("place"), F.lit(style).alias("style")) for i, (style, pattern) in enumerate(STYLES.items())]),
    })
    at = lambda q: F.coalesce(F.get("lengths", F.least(F.col("non_blank") - 1, F.floor(F.col("non_blank") * q)).cast("int")), F.lit(0))
    top = F.array_max("by_style")
    styled = F.aggregate("by_style", F.lit(0), lambda n, s: n + s["n"])
    most = lambda field: F.coalesce(F.array_max(F.transform("functions", lambda f: f[field])), F.lit(0))
    return third.select(
        key, "lines", F.col("non_blank").alias("non_blank_lines"), "code_lines",
        _part(F.col("lines") - F.col("non_blank"), "lines").alias("blank_ratio"), _part(F.col("comment_only"), "non_blank").alias("comment_ratio"),
        _part(F.col("inline"), "code_lines").alias("inline_comment_ratio"), _part(F.col("commented_out"), "non_blank").alias("commented_out_ratio"),
        F.col("mean").alias("line_len_mean"), F.col("sd").alias("line_len_sd"), at(0.5).alias("line_len_p50"), at(0.95).alias("line_len_p95"), F.coalesce(F.array_max("lengths"), F.lit(0)).alias("line_len_max"),
        "max_nesting", _part(100.0 * F.col("branches"), "code_lines").alias("branches_per_100"),
        F.col("n_names").alias("identifiers"), _part(F.length("named") - F.greatest(F.lit(0), F.col("n_names") - 1), "n_names").alias("ident_avg_len"),
        _part(F.regexp_count("named", F.lit(r"(?<![^\n])[^\n]{1,2}(?![^\n])")), "n_names").alias("ident_short_ratio"),
        top["style"].alias("dominant_style"), F.when(styled > 0, top["n"] / styled).otherwise(F.lit(0.0)).alias("dominant_share"),
        F.when(F.col("n_tokens") > 0, F.log2("n_tokens") - F.col("runs.bits") / F.col("n_tokens")).otherwise(F.lit(0.0)).alias("token_entropy"),
        _part(F.col("n_tokens") * F.log2(F.greatest(F.lit(2), F.col("runs.distinct"))), "code_lines").alias("halstead_per_line"),
        F.try_divide("coherence.hits", "coherence.words").alias("comment_coherence"), _part(F.col("reexports"), "code_lines").alias("barrel_ratio"),
        F.size("functions").alias("functions"), most("lines").alias("fn_lines_max"), most("max_nesting").alias("fn_nesting_max"),
    )


def repeated_code(files: DataFrame, key: str, family: str, text: str = "text", size: int = 4, least: int = 8, least_chars: int = 25) -> DataFrame:
    """(key, shingles, repeated, dup_ratio): distinct shingles of ``size`` lines of code, and how many occur elsewhere or twice here.

    Lines are code without strings, white space as one space, of ``least_chars`` or more; the ratio is
    null under ``least`` distinct shingles. Shingles are 64-bit hashes, summed by (hash,
    file) before files meet; then only those that repeat come back to their files.
    """
    lines = with_lines(files, key, family, text)
    normal = F.filter(F.transform("code", lambda s: F.trim(F.regexp_replace(s, r"[\s\x0B]+", " "))), lambda s: F.length(s) >= least_chars)
    of = lines.select(key, normal.alias("l")).select(key, F.when(F.size("l") >= size, F.transform(F.sequence(F.lit(1), F.size("l") - size + 1), lambda i: F.xxhash64(F.array_join(F.slice("l", i, F.lit(size)), "\n")))).alias("h"))
    sizes = of.select(key, F.coalesce(F.size(F.array_distinct("h")), F.lit(0)).alias("shingles"))
    # The inner form would have Spark look for empty arrays first, and so make the shingles twice.
    here = of.select(key, F.explode_outer("h").alias("h")).where("h is not null").groupBy("h", key).agg(F.count("*").alias("n"))
    again = here.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h")
    hits = here.join(again, "h", "left_semi").groupBy(key).agg(F.count("*").alias("repeated"))
    marked = sizes.join(hits, key, "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
    return marked.select(key, "shingles", "repeated", F.when(F.col("shingles") >= least, F.col("repeated") / F.col("shingles")).alias("dup_ratio"))
