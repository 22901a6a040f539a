"""Terms and where they are mentioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import bold_terms

WORDS = r"[\p{L}\p{N}]+"


def mentions(docs: DataFrame, terms: DataFrame, key: str = "doc_id", longest: int = 4) -> DataFrame:
    """(key, term, n): whole-word mentions of terms (term, alias: lower case, at most ``longest`` words), longest first.

    Words are numbered, and each run of up to ``longest`` words is joined with the aliases by
    equality; a mention inside a longer one, or beginning in it, is left out. Nothing is matched
    text by term.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORDS), F.lit(0))
    # Each word takes the next ones with it, so no row holds the whole text.
    ahead = F.arrays_zip(F.col("w").alias("w0"), *[F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))).alias(f"w{k}") for k in range(1, longest)])
    each = docs.select(key, words.alias("w")).select(key, F.posexplode(ahead).alias("at", "r"))
    runs = [F.struct(F.lit(k + 1).alias("k"), F.concat_ws(" ", *[f"r.w{i}" for i in range(k + 1)]).alias("alias"), F.col(f"r.w{k}").isNotNull().alias("whole")) for k in range(longest)]
    found = each.select(key, "at", F.explode(F.array(*runs)).alias("r")).where("r.whole").select(key, "at", "r.k", "r.alias").join(terms.select("term", "alias"), "alias")
    hits = found.groupBy(key, "at").agg(F.max_by("term", F.struct("k", "term")).alias("term"), F.max("k").alias("k"))
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "k", "term"))).alias("h"))
    # The hits of one document, left to right; one that begins before the last kept one ends is skipped.
    kept = F.aggregate("h", F.struct(F.lit(0).alias("until"), F.array().cast("array<string>").alias("terms")), lambda a, x: F.when(x["at"] < a["until"], a).otherwise(F.struct((x["at"] + x["k"]).alias("until"), F.concat(a["terms"], F.array(x["term"])).alias("terms"))))["terms"]
    return listed.select(key, F.explode(kept).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def dead_terms(terms: DataFrame, found: DataFrame) -> DataFrame:
    """Terms that no document mentions."""
    return terms.select("term").distinct().join(found.select("term").distinct(), "term", "left_anti")


def _bold(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.explode(bold_terms(F.col("text"))).alias("t")).select(key, F.lower("t").alias("term")).distinct()


def candidates(docs: DataFrame, known: DataFrame, least: int, key: str = "doc_id") -> DataFrame:
    """Bold terms of ``least`` documents or more that are not known names, with their first document; case is ignored."""
    spans = _bold(docs, key)
    df = spans.groupBy("term").agg(F.count("*").alias("documents"), F.min(key).alias("first_doc")).where(F.col("documents") >= least)
    return df.join(known.select(F.lower("alias").alias("term")).distinct(), "term", "left_anti")


def ranked_candidates(docs: DataFrame, known: DataFrame, least: int, key: str = "doc_id", first: int = 5, top: int = 40) -> DataFrame:
    """(rank, term, documents, firsts) of the ``top`` candidates: most documents first, then term, each with its ``first`` documents in order."""
    spans = _bold(docs, key)
    best = candidates(docs, known, least, key).orderBy(F.desc("documents"), "term").limit(top)
    # A limit by rank is applied in each task before the shuffle, so a term of all documents sends few.
    early = spans.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy(key))).where(F.col("_n") <= first)
    firsts = early.groupBy("term").agg(F.sort_array(F.collect_list(key)).alias("firsts"))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("documents"), "term")))
    return ranked.join(firsts, "term").select("rank", "term", "documents", "firsts")
