"""Published tables: replaced as a whole in one step, written only if they differ, and memos that grow by what is new."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointer(spark: SparkSession, folder: str) -> str | None:
    fs, path = _fs(spark, f"{folder}/current.json")
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(f"{folder}/current.json", wholetext=True).first()[0])["version"]


def published(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    """The table that the folder's pointer names; None if nothing was published."""
    version = _pointer(spark, folder)
    if version is None:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{version}")


def publish(df: DataFrame, folder: str, partition_by: list[str] = ()) -> str:
    """Write ``df`` as the folder's new version, and point to it by one rename; returns the version.

    Readers see the old table or the new one, never parts; what the new one doesn't have, such as the card of a page that is gone, is gone with the old. A
    job that is lost before the rename leaves a version that nobody reads.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{folder}/{version}")
    fs, pointer = _fs(spark, f"{folder}/current.json")
    _, staged = _fs(spark, f"{folder}/{version}.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    overwrite[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, pointer, overwrite)
    return version


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same columns and the same rows, as often."""
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def regenerate(make: Callable[[], DataFrame], inputs: Callable[[], object], folder: str, attempts: int = 3) -> str:
    """Publish what ``make`` gives if it differs from what is published: ``unchanged`` or ``written``; ``unstable`` if ``inputs`` (any value that changes with them) kept changing meanwhile.

    The inputs are looked at before and after, so that a report never stands for inputs that it wasn't made of; a write is read back and compared.
    """
    for _ in range(attempts):
        before, made = inputs(), make()
        old = published(made.sparkSession, folder)
        if old is not None and same_rows(made, old):
            if inputs() == before:
                return "unchanged"
            continue
        publish(made, folder)
        if inputs() == before and same_rows(made, published(made.sparkSession, folder)):
            return "written"
    return "unstable"


def hashes_of(paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, blob, state) of a list of paths: ``hashed``, ``failed`` where the inventory has it without a blob, ``missing``."""
    known = inventory.select("path", "blob", F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "missing").when(F.col("blob").isNull(), "failed").otherwise("hashed")
    return paths.select("path").where("path is not null").distinct().join(known, "path", "left").select("path", "blob", state.alias("state"))


def memoized(files: DataFrame, folder: str, compute, result: str) -> DataFrame:
    """(path, value) of files (path, blob, text): ``compute`` of the text, taken from the memo in ``folder`` for blobs that it has, and stored for those it hasn't.

    ``result`` is the value's type. New blobs are distinct before their texts are sent. An append that is repeated stores a blob twice, with one value.
    """
    spark, schema = files.sparkSession, f"blob string, value {result}"

    def stored() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(folder).dropDuplicates(["blob"])
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    new = files.where("blob is not null").groupBy("blob").agg(F.first("text").alias("text")).join(stored().select("blob"), "blob", "left_anti")
    new.select("blob", compute(F.col("text")).cast(result).alias("value")).write.mode("append").parquet(folder)
    return files.select("path", "blob").join(stored(), "blob", "left").select("path", "value")
