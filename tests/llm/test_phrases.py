import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import phrases
from corpusloom.llm.phrases import Bitmaps, longer_phrases, mine_phrases, phrase_counts

SCHEMA = "doc_id long, text string, lang string, words string, chunk long, n long"


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)) if w]


def counted(rows, longest=4):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return counts, totals


def plain(rows, least, top, longest=4):
    counts, totals = counted(rows, longest)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in totals:
        kept = []
        for (own, words), a in candidates.items():
            if own != lang:
                continue
            inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))  # noqa: E731, B023
            if any(o == lang and len(w) > len(words) and inside(w) and 100 * f >= 80 * a for (o, w), f in candidates.items()):
                continue
            cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def prose(rng, n, vocabulary):
    signs = [" ", " ", " ", " ", "\t", ". ", ", ", "\n", "  ", "\x0b", "? "]
    return "".join(rng.choice(vocabulary) + rng.choice(signs) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "a", "b", "Ärger", "ärger", "日本", "x'y", "\x1f", "é", "of", "one"]
    rows = [(prose(rng, rng.randrange(0, 200), vocabulary[: rng.randrange(3, 12)]), rng.choice(["en", "de", None, "und", ""])) for _ in range(60)]
    rows += [(None, "en"), ("", "de"), (" .,;\n", None), ("again and again", "fr")] + [("copied line of words, copied line of words", "en")] * 20
    got = mine_phrases(documents(spark, rows).repartition(5), least=10, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 10, 25)


def test_small_chunks_and_batches_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(prose(rng, 400, ["to", "be", "or", "not", "that", "is"]), "en") for _ in range(10)]
    text = prose(rng, 300, ["long", "text", "of", "it"])
    rows.append((text, "en"))
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 100)
    monkeypatch.setattr(phrases, "PART_BYTES", 64)
    assert b"".join(phrases._parts(text)) == text.encode().translate(phrases.FOLD) and len(list(phrases._parts(text))) > 5
    counts, _ = counted(rows)
    found, totals = phrase_counts(documents(spark, rows), least=5)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == {k: n for k, n in counts.items() if n >= 5}
    assert totals.first().n == sum(len(w) for t, _ in rows for w in pieces_of(t))


def test_bitmaps_across_blocks(monkeypatch):
    monkeypatch.setattr(phrases, "BATCH", 3)
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(-1, 4, n)
        want = Counter(tuple(map(int, codes[i : i + 3])) for i in range(n - 2) if (codes[i : i + 3] >= 0).all())
        every = np.array([(a, b) for a in range(4) for b in range(4)])
        rows, counts = longer_phrases(codes, 4, every)
        assert dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == want
        assert int(np.bitwise_count(Bitmaps(codes, 4).bits).sum()) == (codes >= 0).sum()


def test_ties_and_an_overlapping_phrase(spark):
    """One word repeated: occurrences overlap, and a phrase covered by a longer one goes."""
    rows = [("go " * 100, "en"), ("p q. " * 40 + "r s. " * 40, "de")]
    got = sorted(map(tuple, mine_phrases(documents(spark, rows), least=30, top=2).collect()))
    assert got == plain(rows, 30, 2)
    assert [r[2] for r in got] == ["p q", "r s", "go go go go"]


def test_empty_table(spark):
    assert mine_phrases(documents(spark, [("x", "en")]).limit(0)).count() == 0


def test_what_is_left_of_chunks_is_counted_together(spark, monkeypatch):
    """Eight chunks share a passage: each of its phrases of four words has one row, not one a chunk."""
    made, level = {}, phrases._level

    def counting(rows, least, length):
        made[length] = rows.count()
        return level(rows, least, length)

    monkeypatch.setattr(phrases, "_level", counting)
    rows = [(f"one two three four five. seldom{i} one two three. four five six{i}", "en") for i in range(40)]
    found, _ = phrase_counts(documents(spark, rows).repartitionByRange(8, "doc_id"))
    counts, _ = counted(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == {k: n for k, n in counts.items() if n >= 30}
    assert made[4] == 2


def test_runs_hold_the_phrases_whose_parts_are_frequent_and_no_others():
    from corpusloom.llm.phrases import runs_of

    codes = np.array([0, 1, 2, 3, -1, 4, 1, 2, 3, 0, 1, 2, 4, 3])
    frequent = np.array([(0, 1, 2), (1, 2, 3), (3, 0, 1), (2, 4, 3)])
    assert runs_of(codes, 5, frequent).tolist() == [0, 1, 2, 3, -1, 3, 0, 1, 2, -1]
    assert runs_of(codes, 5, np.array([[0], [1], [2]])).tolist() == [0, 1, 2, -1, 1, 2, -1, 0, 1, 2, -1]
    assert not len(runs_of(codes, 5, np.array([(0, 1, 2)]))) and not len(runs_of(codes[:0], 5, frequent))
