import itertools
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers

from corpusloom.llm.packing import END_OF_DOCUMENT, pack_documents, window_cuts
from corpusloom.llm.tokens import encoder

SCHEMA = "doc_id long, text string"


def all_cuts(ends, penalties, window):
    """The least cost of all choices of cuts."""
    best = None
    inner = range(len(ends) - 1)
    for k in range(len(ends)):
        for chosen in itertools.combinations(inner, k):
            places = [0, *(ends[i] for i in chosen), ends[-1]]
            lengths = np.diff(places)
            if (lengths <= window).all():
                cost = sum(window - n for n in lengths) + sum(penalties[i] for i in chosen) + penalties[-1]
                best = cost if best is None else min(best, cost)
    return best


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        gaps = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 11))]
        ends, window = np.cumsum(gaps), rng.randrange(8, 15)
        penalties = np.array([rng.choice([0.0, 1.0, 4.0]) for _ in gaps])
        cuts = window_cuts(ends, penalties, window)
        places = [0, *ends[cuts]]
        assert places[-1] == ends[-1] and max(np.diff(places)) <= window
        cost = sum(window - n for n in np.diff(places)) + penalties[cuts].sum()
        assert cost == all_cuts(ends.tolist(), penalties, window)


def check_pieces(rows, pieces, window):
    reference = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc_id, text in rows:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, END_OF_DOCUMENT]
        at = 0
        found = []
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and len(p.ids) == 4 * p.length
            found += np.frombuffer(bytes(p.ids), "<u4").tolist()
            at += p.length
        assert found == ids
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
    return len(by_sequence)


def test_each_token_is_in_one_piece(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta.", "it's", "naïve", "日本語。", "😀", "\n\n", "  ", "x" * 40, "12345", "end!"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(400)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "no sentence end " * 4000), (103, " \t\r\n　 ")]
    pieces = pack_documents(spark.createDataFrame(rows, SCHEMA).coalesce(2), window=256).collect()
    n = check_pieces(rows, pieces, 256)
    assert sum(p.length for p in pieces) / (n * 256) > 0.9


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None)]
    pieces = pack_documents(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", start int, ids string")).collect()
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in pieces) == [(0, 2), (0, 2), (1, 1), (1, 1)]
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_added_tokens_in_texts(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext |> x.<|endoftext|>\ny" * 50)]
    pieces = pack_documents(spark.createDataFrame(rows, SCHEMA), window=64).collect()
    check_pieces(rows, pieces, 64)


def test_ids_are_those_of_the_json_vocabulary():
    """All texts of sf0.1, encoded by the JSON vocabulary's own library."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()] + ["a <|endoftext|> b"]
    named, ours = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), encoder("byte_bpe_50k.tiktoken")
    for start in range(0, len(texts), 1000):
        part = texts[start : start + 1000]
        assert [e.ids for e in named.encode_batch(part, add_special_tokens=False)] == ours.encode_batch(part, allowed_special="all")


def test_long_runs_of_one_character(spark):
    """Runs that the fast encoder's pattern can't cross are encoded by the library."""
    rows = [(k, u * 2_000_000) for k, u in enumerate((" ", "\t", "\n", "a", "!"))] + [(9, "x" + " " * 1_200_000 + "y <|endoftext|> z")]
    check_pieces(rows, pack_documents(spark.createDataFrame(rows, SCHEMA), 2048).collect(), 2048)
