"""Published tables and memos: replaced whole, unchanged ones left, inputs that change meanwhile."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import sinks as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), "page string, n int")


def test_a_new_version_replaces_all_of_the_old(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/cards"
    assert S.published(spark, folder) is None
    S.publish(table(spark, ("a", 1), ("b", 2)), folder, ["page"])
    first = S.published(spark, folder)
    assert rows(first.select("page", "n")) == [("a", 1), ("b", 2)]
    S.publish(table(spark, ("a", 3)), folder, ["page"])
    assert rows(S.published(spark, folder).select("page", "n")) == [("a", 3)]
    assert rows(first.select("page", "n")) == [("a", 1), ("b", 2)]  # a reader of the old one isn't disturbed
    bad = table(spark, ("a", 0)).select("page", F.raise_error(F.lit("lost")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        S.publish(bad, folder, ["page"])
    assert rows(S.published(spark, folder).select("page", "n")) == [("a", 3)]


def test_only_what_differs_is_written(spark, tmp_path):
    folder, inputs = f"file://{tmp_path}/report", {"n": 1}
    make = lambda: table(spark, ("a", inputs["n"]), ("a", inputs["n"]))
    look = lambda: dict(inputs)
    assert S.regenerate(make, look, folder) == "written"
    version = S._pointer(spark, folder)
    assert S.regenerate(make, look, folder) == "unchanged" and S._pointer(spark, folder) == version
    assert S.regenerate(lambda: table(spark, ("a", 1)), look, folder) == "written"  # one row less of two that are equal
    calls = []

    def moving():
        calls.append(1)
        return len(calls) if len(calls) < 4 else 4

    assert S.regenerate(make, moving, folder) == "unchanged"
    restless = iter(range(100))
    assert S.regenerate(make, lambda: next(restless), folder) == "unstable"


def test_hashes_of_a_list(spark):
    inventory = spark.createDataFrame([("a", "1"), ("b", None)], "path string, blob string")
    assert rows(S.hashes_of(spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "path string"), inventory)) == [("a", "1", "hashed"), ("b", None, "failed"), ("c", None, "missing")]


def test_a_memo_computes_each_blob_once(spark, tmp_path):
    folder = f"file://{tmp_path}/memo"
    files = spark.createDataFrame([("p", "1", "x"), ("q", "1", "x"), ("r", "2", "yy"), ("s", None, "z")], "path string, blob string, text string")
    assert rows(S.memoized(files, folder, F.length, "int")) == [("p", 1), ("q", 1), ("r", 2), ("s", None)]
    # What the memo has isn't computed again: another function shows in new blobs only.
    more = files.union(spark.createDataFrame([("t", "3", "abc")], files.schema))
    assert rows(S.memoized(more, folder, lambda c: F.length(c) + 100, "int")) == [("p", 1), ("q", 1), ("r", 2), ("s", None), ("t", 103)]
    spark.read.parquet(folder).write.mode("append").parquet(f"{folder}2")
    spark.read.parquet(folder).write.mode("append").parquet(f"{folder}2")
    assert S.memoized(more, f"{folder}2", F.length, "int").count() == 5 and spark.read.parquet(folder).count() == 3
