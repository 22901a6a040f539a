import zlib

from corpusloom.llm.sharding import shard_documents

SCHEMA = "doc_id long, text string"


def test_contiguous_and_balanced(spark):
    rows = [(k * 7 % 500, "é" * (k % 90)) for k in range(500)] + [(None, None), (None, "x"), (3, ""), (3, "")]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), n_shards=16).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [(r.doc_id is None, r.doc_id or 0) for r in order]
    assert ids == sorted(ids)
    for shard in range(16):
        own = [r for r in order if r.shard == shard]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 16) <= longest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_one_id_holds_all_rows(spark):
    rows = [(1, "same")] * 300
    got = shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), n_shards=4).collect()
    counts = [sum(r.shard == s for r in got) for s in range(4)]
    assert max(counts) - min(counts) <= 1


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shard_documents(empty).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, "b")], SCHEMA + ", size int, shard string")
    assert [(r.size, r.shard, r.slot) for r in shard_documents(clash, 2).collect()] == [(2, 1, 0)]


def test_prefix_sums_against_plain_ones(spark):
    """Each row's shard, recomputed by a running sum in one list; one text is half of all bytes."""
    rows = [(k, "x" * (k * 37 % 211)) for k in range(700)] + [(350, "y" * 70_000), (None, "z"), (None, None)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), n_shards=16).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    total, end, wanted = sum(len(t or "") + 1 for _, t in rows), 0, []
    for doc_id, text in order:
        size = len(text or "") + 1
        end += size
        wanted.append((doc_id, size, min(15, (2 * end - size) * 16 // (2 * total))))
    assert sorted(map(str, ((r.doc_id, r.size, r.shard) for r in got))) == sorted(map(str, wanted))
