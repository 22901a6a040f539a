import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from tokenizers import pre_tokenizers

from corpusloom.llm import alignment
from corpusloom.llm.alignment import align_tokens, components
from corpusloom.llm.common import table

SCHEMA = "doc_id long, text string, chunk long, places string, n_a long"
NONE = (0, 0, 0, 0, 0, 0, "")


def byte_chars():
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    table = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    assert set(table) == set(pre_tokenizers.ByteLevel.alphabet())
    return table


@pytest.fixture(scope="module")
def encoders():
    a = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    chars = byte_chars()

    def first(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in ids]

    def second(text):
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in pieces]

    return first, second


def plain(rows, encoders):
    """Every overlapping pair token by token, groups by walking to common ends."""
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (f(text) for f in encoders) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append((doc_id, None))
            continue
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, data in tokens:
                own.append((at, at + len(data), i))
                at += len(data)
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in own if start <= s and e <= end) for own in spans))
            start = end
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        counts.update(links)
        found.append((doc_id, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, *NONE))
        else:
            n_a, n_b, n_groups, links, digest = x
            out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=repr), counts


def test_union_find_finds_components():
    rng = random.Random(7)
    for _ in range(100):
        n, m = rng.randrange(1, 12), rng.randrange(1, 12)
        edges = [(rng.randrange(n), rng.randrange(m)) for _ in range(rng.randrange(0, 20))]
        own = list(range(n + m))
        for _ in range(n + m):
            for u, v in edges:
                own[u] = own[n + v] = min(own[u], own[n + v])
        u, v = (np.array([e[k] for e in edges], np.int32) for k in (0, 1))
        assert components(u, v, n, m).tolist() == own


def test_equals_plain_on_documents(spark, encoders):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, counts = plain(rows, encoders)
    got, pairs = align_tokens(docs)
    assert len(rows) > 100 and sorted(map(tuple, got.collect()), key=repr) == want
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == counts


TEXTS = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> <s>", "▁a", "a ▁ b", "\x00\x01é\U0001f9ff日本語", "same text, same text", "same text, same text", "wörter " * 60, "x" * 500, "\n\t\r\n" * 30, "Ein Satz. Noch einer!"]
ROWS = [((1 << 60) + i if i % 4 else None, t) for i, t in enumerate(TEXTS)]


def test_cases(spark, encoders):
    docs = spark.createDataFrame([(*r, 5, "clash", 7) for r in ROWS], SCHEMA).repartition(2)
    got, _ = align_tokens(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(ROWS, encoders)[0]


@pytest.mark.parametrize("segment", [16, 64, 300])
def test_small_segments_and_chunks(encoders, monkeypatch, segment):
    """Workers import the module anew, so the partition's work is called here."""
    monkeypatch.setattr(alignment, "SEGMENT_BYTES", segment)
    aligner, found, pairs = alignment._Aligner("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", 0), [], Counter()
    sums = Counter()
    for r in ROWS:
        aligner.add(r[0], r[1] or "")
        if aligner.held >= 2 * segment or r is ROWS[-1]:
            out = aligner.rows().to_pydict()
            n = len(out["chunk"]) - 1
            found += [tuple(out[c][i] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")) for i in range(n)]
            for i in range(n):
                places, times = (np.frombuffer(out[c][i], "<i4") for c in ("places", "times"))
                for place, t in zip(places, times, strict=True):  # a document has a pair once a segment
                    pairs[divmod(out["keys"][n][place], 32000)] += int(t)
            sums.update({divmod(key, 32000): total for key, total in zip(out["keys"][n], out["sums"][n], strict=True)})
    want, counts = plain(ROWS, encoders)
    assert sorted(found, key=repr) == [(*w[:5], w[7]) for w in want] and pairs == sums == counts


def test_segments_do_not_change_results(encoders, monkeypatch):
    """A long document in parts, as in one."""
    text = "Some words, einige Wörter; algunas palabras. " * 300
    rows = []
    for size in (100, 1 << 21):
        monkeypatch.setattr(alignment, "SEGMENT_BYTES", size)
        aligner = alignment._Aligner("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", 0)
        aligner.add(1, text)
        out = aligner.rows().to_pydict()
        rows.append([out[n][0] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")] + [dict(zip(out["keys"][1], out["sums"][1], strict=True))])
    assert rows[0] == rows[1]


def test_empty_table(spark):
    got, pairs = align_tokens(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and pairs.count() == 0
