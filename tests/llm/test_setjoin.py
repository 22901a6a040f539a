import random
import re

import pytest

from corpusloom.llm.setjoin import shingle_components

SCHEMA = "doc_id long, text string"


def brute(rows, words, num, den):
    """Sizes and components by all pairs of sets."""
    sets = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((str(d), len(s), str(least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed, n, edits, length):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, length))] for _ in range(6)]
    rows = []
    for k in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((k, " ".join(text).upper() if k % 7 == 0 else "\n".join(text)))
    return rows


@pytest.mark.parametrize(("words", "num", "den", "edits", "length"), [(3, 9, 10, 3, 150), (5, 8, 10, 6, 200), (1, 1, 2, 8, 20)])
def test_against_all_pairs(spark, words, num, den, edits, length):
    rows = near_copies(words, 140, edits, length)
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (None, rows[3][1]), (None, rows[3][1]), (906, "É"), (907, "é")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", component_id string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in shingle_components(df, words, (num, den)).collect())
    assert got == brute(rows, words, num, den)


def test_empty(spark):
    assert shingle_components(spark.createDataFrame([], SCHEMA)).count() == 0
