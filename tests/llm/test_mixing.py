import random
import re

import numpy as np
import pytest

from corpusloom.llm import mixing
from corpusloom.llm.mixing import mix_sources, pivot

SCHEMA = "doc_id long, text string, source string"


def expected_targets(sizes, weights=(5, 2, 1), most=3.0):
    """Water filling, round by round: sources above their cap are fixed there, the rest share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        rest = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def corpus(seed, n=3000):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", None, "Z", ""]
    return [(k, " ".join(["word"] * min(2000, int(rng.paretovariate(0.9) * 5))), "a" if rng.random() < 0.4 else rng.choice(sources)) for k in range(n)]


def test_targets_and_taken_words(spark):
    rows = corpus(1)
    got = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text))
    wanted = expected_targets(sizes)
    for source, target in wanted.items():
        own = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(target) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)


def test_reruns_agree(spark):
    rows = corpus(2, 800)
    runs = [{(r.doc_id, r.taken) for r in mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()} for n in (2, 7)]
    assert runs[0] == runs[1]


def test_pivot_keeps_words_and_means():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 50, 40).astype(float)
    total, runs = np.zeros(40), 4000
    for _ in range(runs):
        p = np.full(40, 0.3)
        left = pivot(size, p, rng.random(40))
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != left)
        assert (p * size).sum() == pytest.approx((size * 0.3).sum())
        total += p
    assert np.abs(total / runs - 0.3).max() < 0.05


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, "a"), (None, "x y", None), (None, "x y", None), (2, " \t", "a")]
    got = mix_sources(spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", size int")).collect()
    assert len(got) == 4 and all(r.taken == 0 for r in got if r.source == "a")
    assert {r.target for r in got if r.source is None} == {4.0}
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_are_many_groups_and_the_tree_has_levels(spark, monkeypatch):
    """A third of the rows is one row, again and again; with a small fan-in the tree has several levels."""
    monkeypatch.setattr(mixing, "FAN_IN", 16)
    monkeypatch.setattr(mixing, "REPEATS", 8)
    rng = random.Random(3)
    rows = [(7, "same words here", "a")] * 700 + [(k, " ".join(["w"] * rng.randrange(1, 30)), rng.choice("abc")) for k in range(100, 1500)]
    rows += [(5000, "long " * 20_000, "c")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(frame.repartition(6)).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in "abc"}
    for source, target in expected_targets(sizes).items():
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - target) <= (20_000 if source == "c" else 30)
    assert len({r.row_key for r in got if r.doc_id == 7}) == 1
    again = mix_sources(frame.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
