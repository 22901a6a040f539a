import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm.toxicity import QUANTILES, Meter, calibrate, dictionaries, features, normalised, score_documents, windows

SF = "/root/testdata/sf0.1"


def test_windows_cover_the_text():
    for data in (b"", b"  ", b"one", b"one two " * 50, b"x" * 500, b"a " + b"y" * 200 + b" b"):
        parts = windows(data)
        text = b" " + data.strip(b" ") + b" "
        joined = parts[0] + b"".join(p[1:] for p in parts[1:]) if parts else b""
        assert joined == (text if data.strip(b" ") else b"")
        assert all(len(p) <= 58 for p in parts)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marked = score_documents(docs, labels.select("doc_id", "toxic")).join(labels.where("toxic is not null"), "doc_id")
    held = marked.where("held_out").select("toxic", "predicted", "score").collect()
    assert len(held) > 100
    right = sum(r.toxic == r.predicted for r in held) / len(held)
    toxic = [r.score for r in held if r.toxic]
    clean = [r.score for r in held if not r.toxic]
    area = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    print(f"held out: {len(held)} rows, accuracy {right:.3f}, area under the curve {area:.3f}")
    assert right > 0.93 and area > 0.92


def test_features_against_plain_compression():
    """The lengths are those of a compressor that is made anew for each window; thresholds are quantiles of the other folds."""
    texts = [f"{'you awful fool of a clown' if k % 3 == 0 else 'a pleasant day by the sea'} and word{k % 17} again {k}" for k in range(300)]
    toxic = [int(k % 3 == 0) for k in range(300)]
    contents = dictionaries([t for t, v in zip(texts, toxic) if v], [t for t, v in zip(texts, toxic) if not v])
    assert contents[0] != contents[1] and contents[1][: len(contents[0]) // 2] == contents[0][: len(contents[0]) // 2]
    parameters = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
    size = lambda w, c: len(zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(c.rjust(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(w))
    meter = Meter(contents)
    for text in (*texts[:20], "", None):
        shorter = [size(w, contents[0]) - size(w, contents[1]) for w in windows(normalised(text or ""))]
        assert meter.shorter(text).tolist() == shorter
        if shorter:
            got = features(np.array(shorter, dtype=float), [0.0, 1.0, 2.0, 3.0, 4.0])
            assert got[0] == pytest.approx(sum(shorter) / len(shorter)) and got[1] == max(shorter)
            assert got[-6:-1] == [sum(x > t for x in shorter) / len(shorter) for t in (0, 1, 2, 3, 4)]
    model = calibrate(texts, toxic)
    assert len(model.thresholds) == len(QUANTILES) and model.thresholds == sorted(model.thresholds)
    assert sum((s >= 0.5) == v for s, v in zip(model.score(texts), toxic)) > 290


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", None), (2, "word " * 20_000, "y"), (2, "word " * 20_000, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    got = score_documents(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id: r.held_out for r in got} == {d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 0 for d in (1, None, 2)}
    assert score_documents(docs.where(F.lit(False)), labels).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(k, f"{'awful' if k % 2 else 'pleasant'} words number {k}") for k in range(200)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(200)]
    turned = [(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in labels]
    first, second = ({r.doc_id: r.score for r in score_documents(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert first == pytest.approx(second, abs=0)
