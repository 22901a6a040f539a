"""Readability features of documents, corpus norms, outliers, duplication and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.code import run_lengths
from corpusloom.functions.stats import ratio, z_scores
from corpusloom.operators.tables import spread, written


def line_lengths(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distribution of the lengths of non-blank lines: mean, population sd, p50, p95, max; 0 without lines.

    The quantile q of n sorted lengths is the one at index floor(q * n), from 0, or the last.
    """
    lengths = F.array_sort(F.transform(T.filled(T.lines(F.col("text"))), F.length))
    of = docs.select(key, lengths.alias("v")).withColumn("n", F.size("v"))
    at = lambda i: F.coalesce(F.get("v", i.cast("int")), F.lit(0))
    rank = lambda q: at(F.least(F.col("n") - 1, F.floor(F.col("n") * q)))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    with_mean = of.withColumn("mean", F.when(F.col("n") > 0, mean).otherwise(0.0))
    sd = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n"))
    return with_mean.select(key, F.col("n").alias("lines"), "mean", F.when(F.col("n") > 0, sd).otherwise(0.0).alias("sd"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), at(F.col("n") - 1).alias("max"))


def token_features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens, distinct tokens, entropy in bits, and volume a line: tokens * log2(max(2, distinct)) over non-blank lines.

    A document's tokens are sorted and their runs counted where the document is.
    """
    of = spread(docs.select(key, "text")).select(key, F.size(T.filled(T.lines(F.col("text")))).alias("code_lines"), F.array_sort(T.tokens(F.col("text"))).alias("t"))
    counted = of.select(key, "code_lines", F.size("t").cast("long").alias("tokens"), run_lengths(F.col("t")).alias("r"))
    sums = counted.select(key, "code_lines", "tokens", F.col("r.distinct").cast("long").alias("distinct_tokens"), "r.bits")
    entropy = F.when(F.col("tokens") > 0, F.log2("tokens") - F.col("bits") / F.col("tokens")).otherwise(0.0)
    volume = F.col("tokens") * F.log2(F.greatest(F.lit(2), F.col("distinct_tokens")))
    return sums.select(key, "tokens", "distinct_tokens", entropy.alias("entropy"), ratio(volume, F.col("code_lines")).alias("halstead_per_line"))


def identifier_stats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Count, mean length, share of at most two characters, the most common naming style and its share."""
    found = docs.select(key, F.explode(F.regexp_extract_all("text", F.lit(T.IDENTIFIER), F.lit(0))).alias("name"))
    styled = found.withColumn("style", T.naming_style(F.col("name")))
    by_style = styled.groupBy(key, "style").agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("chars"), F.count_if(F.length("name") <= 2).alias("short"))
    n = F.sum("n")
    return by_style.groupBy(key).agg(
        n.alias("identifiers"), (F.sum("chars") / n).alias("avg_length"), (F.sum("short") / n).alias("short_ratio"),
        F.max_by("style", F.struct("n", "style")).alias("style"), (F.max("n") / n).alias("style_share"),
    )


def line_ratios(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shares of blank, comment and list lines, branches in 100 non-blank lines; null where there are no lines to share."""
    of = docs.select(key, T.lines(F.col("text")).alias("all"), F.col("text").alias("text")).withColumn("filled", T.filled(F.col("all")))
    share = lambda pattern: ratio(F.size(F.filter("filled", lambda s: F.regexp_like(s, F.lit(pattern)))), F.size("filled"))
    return of.select(
        key,
        ratio(F.size("all") - F.size("filled"), F.size("all")).alias("blank_ratio"),
        share(r"^\s*(?:#|//|/\*|\*)").alias("comment_ratio"),
        share(r"^\s*(?:[-*+]|[0-9]+\.)\s").alias("list_ratio"),
        ratio(100.0 * F.regexp_count(F.coalesce("text", F.lit("")), F.lit(T.BRANCHES)), F.size("filled")).alias("branches_per_100"),
    )


def outliers(features: DataFrame, metrics: list[str], low: list[str] = (), least: float = 2.0) -> DataFrame:
    """Rows (keys, metric, value, z) in the metric's tail: z >= least, or z <= -least for those in ``low``."""
    is_low = F.col("metric").isin(list(low))
    return z_scores(features, metrics).where(F.when(is_low, -F.col("z")).otherwise(F.col("z")) >= least)


def top_outliers(found: DataFrame, n: int = 10, key: str = "doc_id", low: list[str] = ()) -> DataFrame:
    """The n strongest of each metric, ties by key."""
    strength = F.when(F.col("metric").isin(list(low)), F.col("z")).otherwise(-F.col("z"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(strength, key))).where(F.col("rank") <= n)


def composite(features: DataFrame, key: str, plus: list[str], minus: list[str]) -> DataFrame:
    """(key, composite): sum of z-scores, those of ``minus`` negated; an sd of 0 counts as 1, null values as the mean."""
    metrics = [*plus, *minus]
    features = written(features, "measures")
    norms = features.agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_sd") for m in metrics])
    z = lambda m: F.coalesce((F.col(m) - F.col(f"{m}_mean")) / F.when(F.col(f"{m}_sd") > 0, F.col(f"{m}_sd")).otherwise(1.0), F.lit(0.0))
    total = sum((z(m) for m in plus), F.lit(0.0)) - sum((z(m) for m in minus), F.lit(0.0))
    # One row of norms.
    return features.join(F.broadcast(norms)).select(key, total.alias("composite"))


def duplicate_ratio(docs: DataFrame, key: str = "doc_id", size: int = 4, least: int = 8, least_chars: int = 25) -> DataFrame:
    """(key, shingles, repeated, dup_ratio): distinct shingles of ``size`` trimmed lines of ``least_chars`` or more, and how many occur elsewhere or twice here.

    The ratio is null under ``least`` distinct shingles. Shingles are summed by (hash, document)
    before documents meet, so a shingle that everything shares is a count, not a group.
    """
    normal = F.filter(F.transform(T.lines(F.col("text")), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) >= least_chars)
    of = spread(docs.select(key, "text")).select(key, normal.alias("l"))
    each = F.when(F.size("l") >= size, F.transform(F.sequence(F.lit(1), F.size("l") - size + 1), lambda i: F.xxhash64(F.array_join(F.slice("l", i, F.lit(size)), "\n"))))
    # The inner form, or a filter on the size, would have Spark compute the lines again below, for each shingle.
    shingled = of.select(key, each.alias("h")).select(key, F.explode_outer("h").alias("h")).where("h is not null")
    here = shingled.groupBy("h", key).agg(F.count("*").alias("n"))
    everywhere = here.groupBy("h").agg(F.sum("n").alias("total"))
    marked = here.join(everywhere, "h")
    sums = marked.groupBy(key).agg(F.count("*").alias("shingles"), F.count_if(F.col("total") > 1).alias("repeated"))
    return sums.select(key, "shingles", "repeated", F.when(F.col("shingles") >= least, F.col("repeated") / F.col("shingles")).alias("dup_ratio"))


def longest_lines(docs: DataFrame, key: str = "doc_id", each: int = 3, top: int = 20) -> DataFrame:
    """The longest ``each`` lines of a document, of these the ``top`` overall: (key, line, length)."""
    lengths = F.transform(T.lines(F.col("text")), lambda s, i: F.struct((-F.length(s)).alias("minus"), (i + 1).alias("line")))
    best = F.slice(F.array_sort(lengths), 1, each)
    of = docs.select(key, F.explode(best).alias("b")).select(key, "b.line", (-F.col("b.minus")).alias("length"))
    return of.orderBy(F.desc("length"), key, "line").limit(top)


def group_rollup(scored: DataFrame, by: str, measure: str, key: str, low: float, least: int = 5) -> DataFrame:
    """(by, count, mean, low, worst) of groups of ``least`` rows or more; worst has the lowest measure, ties by key."""
    return scored.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(measure).alias("mean"), F.count_if(F.col(measure) <= low).alias("low"),
        F.min_by(key, F.struct(measure, key)).alias("worst"),
    ).where(F.col("n") >= least)


def tercile_sample(docs: DataFrame, group: str, measure: str, key: str, picks: int) -> DataFrame:
    """``picks`` evenly spaced rows of each third of each group, by measure and key: (group, key, stratum, place).

    Thirds and places come from one window a group and measure; picks are at place
    floor((i + 0.5) * n / picks) of a third of n rows.
    """
    w = Window.partitionBy(group).orderBy(measure, key)
    third = docs.withColumn("stratum", F.ntile(3).over(w))
    inner = Window.partitionBy(group, "stratum")
    placed = third.withColumn("place", F.row_number().over(inner.orderBy(measure, key)) - 1).withColumn("n", F.count("*").over(inner))
    i = F.floor(F.col("place") * picks / F.col("n"))
    hit = F.array_contains(F.transform(F.array(i - 1, i, i + 1), lambda j: F.when((j >= 0) & (j < picks), F.floor((j + 0.5) * F.col("n") / picks))), F.col("place").cast("long"))
    return placed.where(hit).select(group, key, "stratum", "place")


def _quotas(target: int, sizes: list[int]) -> list[int]:
    """How many of three strata to take: a third each, what is left to the first, last and middle in turn, no more than there are."""
    turns = [0, 2, 1]
    quotas = [target // 3] * 3
    for i in range(target % 3):
        quotas[turns[i]] += 1
    quotas = [min(q, n) for q, n in zip(quotas, sizes, strict=True)]
    while sum(quotas) < target and any(q < n for q, n in zip(quotas, sizes, strict=True)):
        for i in turns:
            if quotas[i] < sizes[i] and sum(quotas) < target:
                quotas[i] += 1
    return quotas


def _evenly(n: int, count: int) -> list[int]:
    """``count`` places from 0 to ``n`` - 1, the first and the last among them; the middle one alone."""
    if count >= n:
        return list(range(n))
    if count == 1:
        return [(n - 1) // 2]
    return [int((2 * i * (n - 1) + count - 1) // (2 * (count - 1))) for i in range(count)]


def stratified_sample(rows: DataFrame, measure: str, key: str, target: int) -> DataFrame:
    """(place, stratum, key, measure): ``target`` rows, evenly spaced in the lowest, middle and highest third by measure and key.

    Thirds end at ceil(n / 3) and ceil(2n / 3). A row's place among all is its place in its range plus the
    rows of the ranges before, so no task sorts the table; what meets is one count a range, and the picks.
    """
    order = [F.col(measure), F.col(key)]
    ranged = rows.where(F.col(measure).isNotNull()).select(key, measure).repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: a range keeps its number, and rows their places in it.
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranked")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    n = placed.count()
    target = min(target, n)
    cuts = [0, -(-n // 3), -(-2 * n // 3), n]
    sizes = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    picks = [(cuts[s] + p, s) for s, q in enumerate(_quotas(target, sizes)) if q for p in _evenly(sizes[s], q)]
    wanted = rows.sparkSession.createDataFrame(picks, "place long, stratum int")
    numbered = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    return numbered.join(wanted, "place").select("place", "stratum", key, measure)
