import random
import struct

import corpus_pipeline
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.packing import encoder
from corpusloom.llm.toxicity import fit_toxicity, is_held_out


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    near = text("a") + " more"
    rows = [(1, text("a")), (1, text("b")), (2, near), (None, text("a")), (None, text("c")), (None, text("c")), (3, text("b")), (None, text("d")), (4, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.jaccard_join(spark, docs, "").collect()
    assert sorted((r.text, r.doc_id or 0) for r in got) == sorted([(text("a"), 1), (text("b"), 1), (text("c"), 0), (text("d"), 4)])


COLUMNS = "doc_id long, text string, source string, row_key string, n_dropped int, place string, row string, times int"


def rows_of(spark, rows):
    """Documents with columns of names that stages use themselves, null in some rows."""
    return spark.createDataFrame([(d, t, s, f"k{i}", i, None if i % 2 else "p", "r", None) for i, (d, t, s) in enumerate(rows)], COLUMNS).repartition(3)


def extras(row):
    return row.row_key, row.n_dropped, row.place, row.row, row.times


def labels_at(tmp_path, spark, labels):
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_toxicity_keeps_what_the_model_does_not_reject(spark, tmp_path):
    rows = [(k, f"{'you awful fool of a clown' if k % 3 == 0 else 'a pleasant day by the sea'} and word{k % 17} again {k}", "a") for k in range(300)]
    rows += [(None, None, None), (None, "", None), (400, "you awful fool of a clown " * 3000, "a"), (1, rows[1][1], "a")]
    docs = rows_of(spark, rows)
    sf = labels_at(tmp_path, spark, [(k, int(k % 3 == 0), None) for k in range(300)] + [(None, 1, 1), (2, None, 0)])
    got = corpus_pipeline.toxicity(spark, docs, sf)
    assert got.columns == docs.columns
    held = spark.read.parquet(f"{sf}/labels.parquet").where(~is_held_out())
    model = fit_toxicity(docs, held)
    wanted = [r for r in docs.collect() if model.score([r.text])[0] < 0.5]
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted))
    kept = {r.doc_id for r in got.collect() if r.doc_id is not None}
    assert all(k in kept for k in range(300) if k % 3) and not any(k in kept for k in range(0, 300, 3)) and 400 not in kept
    assert corpus_pipeline.toxicity(spark, docs.limit(0), sf).count() == 0


def test_line_dedup_keeps_documents_with_words(spark):
    line, other = "one two three four five six seven eight", "one two three four five SIX seven nine"
    rows = [(1, line, "a"), (2, line, "a"), (2, line, "a"), (3, f"{line}\nmore", "b"), (4, other, None), (5, "", "a"), (6, None, "a"), (None, f"more\n{line}", None), (7, " \n", "a")]
    docs = rows_of(spark, rows)
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert got.columns == docs.columns
    before = {r.row_key: r for r in docs.collect()}
    found = {r.row_key: r.text for r in got.collect()}
    assert all(extras(r) == extras(before[r.row_key]) for r in got.collect())
    # the second 'more' of row 7 is the same line as row 3's; row 4 is one edit from row 1
    assert found == {"k0": line, "k3": "more", "k5": "", "k6": None, "k8": " \n"}
    assert corpus_pipeline.line_dedup(spark, docs.limit(0), "").count() == 0


def test_jaccard_join_passes_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = rows_of(spark, [(2, text, "a"), (1, text + " more", None), (3, None, None), (4, "", "b"), (None, None, None), (5, "x", "a"), (6, "X", "a")])
    got = corpus_pipeline.jaccard_join(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.row_key for r in got.collect()} == {"k1", "k2", "k3", "k4", "k5"}
    assert corpus_pipeline.jaccard_join(spark, docs.limit(0), "").count() == 0


def test_mixing_takes_documents_as_often_as_the_mix_says(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "b", "c", None])) for k in range(400)]
    rows += [(None, None, "a"), (None, "", None), (7, rows[7][1], rows[7][2]), (None, "x y z", "b"), (None, "x y z", "b"), (900, "long " * 9000, "a")]
    docs = rows_of(spark, rows)
    got = corpus_pipeline.mixing(spark, docs, "")
    assert got.columns == docs.columns
    wanted, taken = {}, {}
    for r in mix_sources(docs).collect():
        wanted[r.doc_id, r.source, r.size] = wanted.get((r.doc_id, r.source, r.size), 0) + r.copies
    before = {r.row_key: r for r in docs.collect()}
    for r in got.collect():
        taken[r.doc_id, r.source, len((r.text or "").split())] = taken.get((r.doc_id, r.source, len((r.text or "").split())), 0) + 1
        assert extras(r) == extras(before[r.row_key]) and r.text == before[r.row_key].text
    assert taken == {k: v for k, v in wanted.items() if v}
    assert corpus_pipeline.mixing(spark, docs.limit(0), "").count() == 0


def test_packing_holds_each_token_once(spark):
    docs = rows_of(spark, [(1, "one two three. " * 900, "a"), (2, None, None), (None, "", "b"), (3, "x", "a"), (3, "x", "a")])
    got = corpus_pipeline.packing(spark, docs, "").collect()
    enc = encoder("byte_bpe_50k.tiktoken")
    wanted = sorted([*enc.encode(r.text or "", allowed_special="all"), 1] for r in docs.collect())
    docs_found, seen = [], {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == seen.get(p.sequence_id, 0) and len(p.ids) == 4 * p.length
        seen[p.sequence_id] = p.offset + p.length
        ids = list(struct.unpack(f"<{p.length}I", p.ids))
        if p.start == 0:
            docs_found.append(ids)
        else:
            docs_found[-1].extend(ids)
    assert sorted(docs_found) == wanted and max(seen.values()) <= 2048
    assert corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0


def test_whole_run(spark):
    """Each stage's rows come from its predecessor's; the last holds each token once."""
    docs = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert pieces and {p.doc_id for p in pieces} <= docs
    ends = {}
    for p in pieces:
        ends[p.sequence_id] = max(ends.get(p.sequence_id, 0), p.offset + p.length)
    assert sum(p.length for p in pieces) == sum(ends.values()) and sum(p.doc_tokens for p in pieces if p.start == 0) == sum(p.length for p in pieces)
