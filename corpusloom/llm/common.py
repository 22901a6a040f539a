"""What the operators share: reading tables, writing intermediate tables, text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class of Java and RE2 regular expressions.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing in a local session, as in tests, a temporary folder is set;
    on a cluster executors would write such a folder on their own disks, so there it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's setting to delete a query's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: what follows reads the table, so a lost executor costs no more than
    the tasks it was running, and random or order-dependent columns keep one value. Shuffle files
    of the session's queries are deleted as each ends, since a long chain of tables would
    otherwise hold those of many on disk. Texts in these tables are what is largest, so they are
    packed with zstd.
    """
    spark = df.sparkSession
    spark.conf.set(CLEANUP, "true")
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(col: Column | str) -> Column:
    """UTF-8 bytes of a text; of null, none."""
    col = F.col(col) if isinstance(col, str) else col
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
