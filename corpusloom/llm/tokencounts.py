"""Token counts of documents through a cache of digests, so that only texts not seen before are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import text_bytes
from corpusloom.llm.tokens import json_tokenizer, piece_tokenizer, tokenizer_digest

CACHE = "digest binary, n_tokens long, tokenizer string"


def cached_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) that the cache in folder ``cache`` has for one tokenizer's digest; a folder that isn't there is empty.

    A run that was repeated, or two at a time, can append a digest twice, with the same count: it is given once. Grouped
    by both columns, so that a join by the digest is dealt anew and Spark can split its hot keys.
    """
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens").distinct()


def count_tokens(docs: DataFrame, cache: str, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Tokens of each row's whole text: (doc_id, n_bytes, n_tokens, over_limit).

    A text's key is the SHA-256 of its UTF-8 bytes (null is the empty text; any other
    normalisation could change its tokens) together with the digest of the tokenizer's version.
    Keys are made distinct, each partition its own first, so a text with many copies is sent once a partition
    and encoded once; those that the Parquet table in ``cache`` lacks are encoded and their counts appended to the
    table, and every row gets its count by a join. The append is one Spark write: lost tasks are run
    again, and if the job ends early, the next call encodes what is missing.
    Special strings inside texts are treated as the library's default; nothing is added or cut.

    Cases: null and empty texts have no bytes and no tokens; a null doc_id stays null; repeated rows
    each get their row; texts of any length are encoded whole; an empty table gives no rows;
    other columns are not read.
    """
    spark, tokenizer = docs.sparkSession, tokenizer_digest(vocabulary)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text_bytes("text"), 256)).alias("digest"))
    known = cached_counts(spark, cache, tokenizer)
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary.endswith(".model")
        model = piece_tokenizer(vocabulary) if pieces else json_tokenizer(vocabulary, plain=False)
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            counts = [len(model.encode(t)) if pieces else len(model.encode(t, add_special_tokens=False).ids) for t in texts]
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "n_tokens": pa.array(counts, pa.int64())})

    new = misses.mapInArrow(counted, "digest binary, n_tokens long")
    new.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").parquet(cache)
    sizes = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # Rows of one text are many, counts one each: a hot digest is split by Spark's skew join.
    counts = sizes.join(cached_counts(spark, cache, tokenizer).hint("merge"), "digest")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
