"""Readers: the driver tables, text corpora as inventories, notes with front matter, JSON ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.hashing import content_sha1
from corpusloom.functions.text import front_matter, front_matter_map


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, blob, size) of the text files under ``root``, of any size; files with a NUL in their first 8 KiB are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    binary = F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00")
    base = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.where(~binary).select(F.substring(path, F.length(base) + 1, F.length(path)).alias("path"), content_sha1(F.col("content")).alias("blob"), F.col("length").alias("size"))


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash, fields, body) of Markdown notes: front matter as a map, ``path`` and ``hash`` taken from it."""
    raw = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    parts = raw.select(front_matter(F.col("value")).alias("p"))
    fields = parts.select(front_matter_map(F.col("p.head")).alias("fields"), F.col("p.body").alias("body"))
    return fields.select(F.try_element_at("fields", F.lit("path")).alias("path"), F.try_element_at("fields", F.lit("hash")).alias("hash"), "fields", "body")


def write_notes(df: DataFrame, out: str) -> None:
    """Notes back as JSON lines, one file a partition."""
    df.write.mode("errorifexists").json(out)


RECEIPT = "domain string, unit string, path string, blob string, reviewed boolean, full_read boolean"


def ledgers(spark: SparkSession, root: str) -> DataFrame:
    """Receipts of JSON ledgers; rows that do not parse to the declared fields are in ``_corrupt``."""
    return spark.read.schema(RECEIPT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(root)
