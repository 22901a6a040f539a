"""Queries of the training-data operators, with DuckDB SQL where that can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.alignment import align_tokens
from corpusloom.llm.ann import nearest_vectors
from corpusloom.llm.audio import audio_column
from corpusloom.llm.common import shared_dir, table
from corpusloom.llm.linededup import dedup_lines
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.oracle import ORACLE_SQL  # noqa: F401
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.phrases import mine_phrases
from corpusloom.llm.secrets import secret_report
from corpusloom.llm.setjoin import shingle_components
from corpusloom.llm.sharding import shard_documents
from corpusloom.llm.tokencounts import count_tokens
from corpusloom.llm.toxicity import score_documents
from corpusloom.llm.urlfilter import judge_urls


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=16)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors, vectors.where(F.col("vec_id") % 100 == 0).select("vec_id"), k=10)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"), words=3, similarity=(9, 10))


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_column(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_clips",
        F.size("segments").alias("n_segments"),
        F.octet_length("tensors").cast("long").alias("tensor_bytes"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"), least=30, longest=4, covered=(80, 100), top=2000)


def op12_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a new cache, so that each run counts all distinct texts."""
    return count_tokens(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-counts/{uuid.uuid4().hex}", limit=4096)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))[0]


QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_ann": op5_ann,
    "op6_jaccard": op6_jaccard,
    "op7_urlfilter": op7_urlfilter,
    "op8_linededup": op8_linededup,
    "op9_toxicity": op9_toxicity,
    "op10_audio": op10_audio,
    "op11_phrases": op11_phrases,
    "op12_tokencounts": op12_tokencounts,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}
