"""The training-data pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each stage's
result as Parquet in the shared folder and reads it as the next one's docs. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, table, written
from corpusloom.llm.linededup import dedup_lines
from corpusloom.llm.mixing import mix_sources, row_key
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.setjoin import shingle_components
from corpusloom.llm.toxicity import fit_toxicity, is_held_out, toxicity_score


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns under names that no stage uses itself."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``_plain`` under their first names."""
    return df.select(*[F.col(c if c in ("doc_id", "text") else f"other{i}").alias(c) for i, c in enumerate(columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled rows that are not held out, does not reject.

    Cases: null and empty texts are scored as texts without words, repeated rows alike; a null
    doc_id has no label; an empty table gives none; other columns pass unread.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~is_held_out())
    model = fit_toxicity(docs, labels)
    return docs.where(toxicity_score(F.col("text"), model) < 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that had words and has none left goes.

    Cases: null and empty texts stay as they are; repeated rows share one fate, as they name one
    place; other columns pass, also those that the operator has for its counts.
    """
    words_left = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(WORD))
    return _named(dedup_lines(_plain(docs)).where((F.col("n_dropped") == 0) | words_left), docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows (five-word shingles, similarity 0.8) the one with the least doc_id, null last.

    Rows have keys of their own, in the order of doc_id, so repeated and null ids don't matter.

    Cases: rows without words link with nothing and stay; of repeated rows one stays; an empty
    table gives none; other columns pass.
    """
    rows = _plain(docs)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "pipeline-rows")
    components = shingle_components(rows.select(F.col("place").alias("doc_id"), "text"), words=5, similarity=(8, 10))
    keep = components.where("doc_id = component_id").select(F.col("doc_id").alias("place"))
    return _named(rows.join(keep, "place", "left_semi"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that each source's words come near its target.

    Cases: documents without words are never taken; a null source is a source, ordered last; of
    rows that agree in doc_id, source and text, one stands for all in its other columns; an empty
    table gives none; other columns pass.
    """
    mixed = mix_sources(docs).groupBy("row_key").agg(F.sum("copies").cast("int").alias("times")).where("times > 0")
    keyed = docs.select(row_key("doc_id", "source", "text").alias("row_key"), F.struct(*docs.columns).alias("row"))
    taken = keyed.join(mixed, "row_key").dropDuplicates(["row_key"])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids.

    Cases: a document that the mix took twice is two documents here; null and empty texts are an
    end of document; an empty table gives none.
    """
    return pack_documents(docs, window=2048)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Compression, iterated joins, seeded draws and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
