"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import shuffle_partitions, text_bytes, written


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Cut ``docs`` (doc_id, text), in order of doc_id, into contiguous shards of equal bytes.

    The rows are ranged by (doc_id, CRC, size, place in the input), so that even a doc_id that a
    third of the rows repeats is spread. Each range adds up its sizes; the running sum over these
    totals (one row a range) is where a range begins; a row's global prefix sum is that plus the
    running sum within its range. A row goes to the shard in which the middle of its bytes lies,
    so each shard is within half of its two border documents of the equal target.

    Only doc_id, size and CRC are shuffled, never text. Size is the text's UTF-8 bytes plus 1.

    Cases: null text counts as empty; null doc_ids come last; repeated rows are all kept, and
    which of them takes which slot makes no difference; an empty table gives no rows; other
    columns of the input are not used. Shards may be empty if there are fewer rows than shards.
    """
    spark = docs.sparkSession
    data = text_bytes("text")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "place"]
    ranged = written(
        narrow.repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")),
        "shard-ranges",
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # One row a range, hence at most spark.sql.shuffle.partitions rows: safe in one task and as a broadcast.
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(every).alias("total"),
    )
    within = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(F.broadcast(starts), "part")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(within))
        .withColumn("row", F.col("rows_before") + F.count("*").over(within) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * end - size) * {n_shards}L) div (2 * total)")).cast("int"))
    )
    # At most n_shards rows.
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
