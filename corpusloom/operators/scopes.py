"""Digests of scopes and inventories: lists of any length are hashed as they stream by, in order, never gathered."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.canonical import canonical_json, canonical_row, digest, sorted_texts, utf16_order


def list_digests(rows: DataFrame, group: str, order: Column, before: str, after: str, text: str = "json", between: str = ",", algorithm: str = "sha256", prefix: str = "sha256:") -> DataFrame:
    """(group, n, digest): digest of ``before``, the group's texts in order, joined by ``between``, and ``after``; ``prefix`` and hex digits.

    A group's rows pass through one task sorted, a batch at a time; memory doesn't grow with the group.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, sha = None, 0, None

        def done() -> pa.RecordBatch:
            sha.update(after.encode())
            return pa.RecordBatch.from_pydict({"group": pa.array([own], pa.string()), "n": pa.array([n], pa.int64()), "digest": pa.array([prefix + sha.hexdigest()], pa.string())})

        for batch in batches:
            for key, text in zip(batch.column("group").to_pylist(), batch.column("text"), strict=True):
                if sha is None or key != own:
                    if sha is not None:
                        yield done()
                    own, n, sha = key, 0, hashlib.new(algorithm, before.encode())
                if n:
                    sha.update(between.encode())
                sha.update(text.as_buffer())
                n += 1
        if sha is not None:
            yield done()

    keyed = rows.select(F.col(group).cast("string").alias("group"), order.alias("_order"), F.col(text).alias("text"))
    streamed = keyed.repartition("group").sortWithinPartitions("group", "_order", "text").select("group", "text").mapInArrow(hashed, "group string, n long, digest string")
    return streamed.withColumnRenamed("group", group)


def inventory_digests(files: DataFrame, scope: str, namespace: str = "exact-inventory/v1") -> DataFrame:
    """(scope, files, repeated, digest) of files (scope, path, blob, status, outcome, findings, receipts).

    The digest is that of the canonical object of the files by path, each with its sorted lists, and the namespace. A scope in which
    a path is repeated has no digest.
    """
    json = canonical_row(path=F.col("path"), blob=F.col("blob"), status=F.col("status"), outcome=F.col("outcome"), findingOccurrenceIds=sorted_texts(F.col("findings")), receiptRefs=sorted_texts(F.col("receipts")))
    rows = files.select(scope, "path", json["json"].alias("json"))
    found = list_digests(rows, scope, utf16_order(F.col("path")), '{"files":[', f'],"namespace":"{namespace}"}}')
    repeated = files.groupBy(scope, "path").count().groupBy(scope).agg(F.count_if(F.col("count") > 1).alias("repeated"))
    joined = found.join(repeated.withColumn(scope, F.col(scope).cast("string")), scope)
    return joined.select(scope, F.col("n").alias("files"), "repeated", F.when(F.col("repeated") == 0, F.col("digest")).alias("digest"))


def scope_result_hash(mode: Column, include: Column, exclude: Column, inventory_digest: Column, namespace: str = "exact-scope-result/v1") -> Column:
    """Digest of a scope's mode, patterns (in order) and the digest of its inventory."""
    return digest(canonical_row(namespace=F.lit(namespace), mode=mode, includePaths=sorted_texts(include), excludePaths=sorted_texts(exclude), inventoryDigest=inventory_digest)["json"])


def source_digest(body: Column) -> Column:
    """Hex SHA-256 of a JSON body's canonical text and a line feed, as translations name their sources."""
    return F.sha2(F.concat(canonical_json(body)["json"], F.lit("\n")), 256)
