import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from corpusloom.llm.common import table
from corpusloom.llm.tokencounts import cached_counts, count_tokens
from corpusloom.llm.tokens import byte_bpe_ids, tokenizer_digest

SCHEMA = "doc_id long, text string, digest string, n_tokens string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def plain(rows, model, limit=4096):
    out = []
    for doc_id, text in rows:
        n = len(model.encode(text or ""))
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(out, key=repr)


def test_counts_of_all_documents(spark, model, tmp_path):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, count_tokens(docs, f"file://{tmp_path}/cache").collect()), key=repr) == plain(rows, model)


def test_cases(spark, model, tmp_path):
    texts = [None, "", " ", "a", "<s>a</s><unk>", "▁a", "\x00é\U0001f9ff", "word " * 4096, "x" * 300_000, " " * 2_000_000, "same", "same", "same"]
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = count_tokens(docs, f"file://{tmp_path}/cache")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, model)
    assert any(r.over_limit for r in got.collect())


def test_empty_table(spark, tmp_path):
    assert count_tokens(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/cache").count() == 0


def test_only_misses_are_encoded_and_appended(spark, model, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = spark.createDataFrame([(i, f"text {i % 5}") for i in range(50)], "doc_id long, text string")
    count_tokens(first, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 5
    # Counts that only the cache can have show that its texts aren't encoded again.
    other = f"file://{tmp_path}/other"
    stored.withColumn("n_tokens", stored.n_tokens + 1000).write.parquet(other)
    both = first.union(spark.createDataFrame([(50, "a new text"), (51, "a new text")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in count_tokens(both, other).collect()}
    assert got[0] == len(model.encode("text 0")) + 1000 and got[50] == got[51] == len(model.encode("a new text"))
    assert spark.read.parquet(other).count() == 6


def test_a_digest_appended_twice_counts_once(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    count_tokens(docs, cache).collect()
    spark.read.parquet(cache).write.mode("append").parquet(f"file://{tmp_path}/twice")
    spark.read.parquet(cache).write.mode("append").parquet(f"file://{tmp_path}/twice")
    assert count_tokens(docs, f"file://{tmp_path}/twice").count() == 2


def test_another_tokenizer_has_its_own_counts(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    text = "Ein längerer Text, <|endoftext|> and more"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pieces = count_tokens(docs, cache).first().n_tokens
    units = count_tokens(docs, cache, "byte_bpe_50k.json").first().n_tokens
    reference = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert units == len(reference.encode(text, add_special_tokens=False).ids) != pieces
    assert tokenizer_digest("byte_bpe_50k.json") != tokenizer_digest("piece_bpe_32k.model")
    assert cached_counts(spark, cache, tokenizer_digest("byte_bpe_50k.json")).count() == 1


def test_byte_ids_are_those_of_the_library():
    reference = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    reference.encode_special_tokens = True
    rng = random.Random(5)
    marks = ["".join(rng.choices(" \n\tab.,'1é<|>", k=200)) for _ in range(50)]
    signs = [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    runs = [u * 2_000_000 for u in (" ", "\n", "\t", "a", "!")] + ["x" + " " * 1_500_000 + "y"]
    for text in [*marks, *signs, *runs, "a <|endoftext|> b", ""]:
        assert byte_bpe_ids(text, "byte_bpe_50k.tiktoken", added=False).tolist() == reference.encode(text, add_special_tokens=False).ids
    reference.encode_special_tokens = False
    text = "a <|endoftext|> b" + " " * 1_500_000
    assert byte_bpe_ids(text, "byte_bpe_50k.tiktoken").tolist() == reference.encode(text, add_special_tokens=False).ids
