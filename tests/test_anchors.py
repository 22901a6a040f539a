"""Anchors and consensus against plain loops."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import anchors as A
from corpusloom.operators import consensus as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lines_by_rank(spark):
    lines = ["import run from 'x'", "rerun()", "a.run + 1", "function run2() {", "def run(x):", "éfoo foo", "x.y(z)", "xaybz", "const a.b = 1", "import const q = 1"]
    cases = {"run": 5, "rerun": 2, "foo": 6, "x.y": 7, "y(z": 7, "gone": None, "un + ": 3, "a.b": 9, "q": 10, "rerun()": 2, "\\E": None}
    df = spark.createDataFrame([(lines, m) for m in cases], "l array<string>, m string").select("m", A.find_line(F.col("l"), F.col("m")).alias("at"))
    assert {r.m: r["at"] for r in df.collect()} == cases


def test_links_fences_and_failures(spark):
    body = "[a](code:one..two) ![i](<code:th%20ree>) `[x](code:no)`\n```ts\n[b](code:fenced)\n```\n[c](code:bad target) [d](code:f(x) 'title')\n    [e](code:indented)\n~~~\n[f](code:x)\n[g](http://code:y)"
    notes = spark.createDataFrame([("n", body), ("m", None)], "path string, body string")
    assert rows(A.code_links(notes).select("line", "start", "end")) == sorted([(1, "one", "two"), (1, "th ree", None), (5, "f(x)", None), (6, "indented", None)], key=repr)
    assert rows(A.parse_failures(notes).select("line")) == [(1,), (5,), (6,)]


def test_findings_of_notes_on_files_and_directories(spark):
    notes = spark.createDataFrame([("a", "file", "[x](code:here..gone) [x](code:gone)"), ("b", "file", "[x](code:here)"), ("d", "dir", "[x](code:none)"), ("e", "file", "")], "path string, type string, body string")
    sources = spark.createDataFrame([("a", "here"), ("e", None)], "path string, text string")
    found = A.anchor_findings(notes, sources)
    assert rows(found) == sorted([("rot", "a", 1, "gone", "[x](code:here..gone)"), ("rot", "a", 1, "gone", "[x](code:gone)"), ("missing-source", "b", None, None, None)], key=repr)
    assert tuple(A.finding_counts(found).first()) == (3, 0, 2, 1)
    assert A.anchor_findings(notes.limit(0), sources).count() == 0


def dice(a, b):
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else 0.0


def test_pairs_and_representatives(spark):
    rng = random.Random(5)
    base = ["the same sentence again", "aaaaaaaaaaaa", "another one that differs", "x", "", "ab"]
    flagged = []
    for k in range(160):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            if text:
                text[rng.randrange(len(text))] = rng.choice("abcx ")
        flagged.append((k % 3, rng.randrange(4), k, "".join(text)))
    for above in (0.3, 0.6, 0.9):
        df = spark.createDataFrame(flagged, "group int, reader int, key int, sentence string")
        want = [(g, a, b) for g, _, a, s in flagged for h, _, b, t in flagged if g == h and a <= b and dice(s, t) > above]
        assert [r[:3] for r in rows(S.similar_pairs(df, "group", "key", "sentence", above))] == sorted(want, key=repr)
        chosen = []
        for g in range(3):
            own, kept = [f for f in flagged if f[0] == g], []
            for _, _, key, s in own:
                near = [(r, k) for _, r, k, t in own if dice(s, t) > above]
                if len({r for r, _ in near}) >= 3 and not any(dice(s, t) > above for t in kept):
                    kept.append(s)
                    chosen.append((str(g), str(key), len({r for r, _ in near}), len(near)))
        assert rows(S.consensus(df, above, 3)) == sorted(chosen, key=repr) and chosen


def test_pairs_are_one_by_keys_alone(spark):
    """Candidates meet at each bigram that they share, so the sets of both must not pass through the step that makes a pair one."""
    df = spark.createDataFrame([(1, k, f"one sentence of many words {k}") for k in range(6)], "group long, key long, sentence string")
    pairs = S.similar_pairs(df, "group", "key", "sentence", 0.55)
    steps = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [group" in line]
    assert steps and not any("s_a" in line or "s_b" in line for line in steps)
    assert pairs.count() == 21


def test_long_texts_are_compared_whole(spark):
    """Texts that begin alike and go on differently, or the other way round; a group with few texts and one with many give what a plain loop does, in one cell or many."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghé\U0001f600日本") for _ in range(5))
    tails = [" ".join(word() for _ in range(rng.choice([20, 60, 150]))) for _ in range(6)]
    flagged = [(g, k % 4, k, "the same first line\n" * (k % 2) + rng.choice(tails)[rng.randrange(20):]) for g, n in ((1, 12), (2, 300)) for k in range(n)]
    flagged = [(g, r, k, s if g == 1 else s[-30:]) for g, r, k, s in flagged]
    df = spark.createDataFrame(flagged, "group int, reader int, key int, sentence string")
    texts = {(g, k): s for g, _, k, s in flagged}
    want = [(g, a, b) for g, a in texts for h, b in texts if g == h and a <= b and dice(texts[g, a], texts[g, b]) > 0.55]
    for together in (1_000_000, 400):
        assert [r[:3] for r in rows(S.similar_pairs(df, "group", "key", "sentence", 0.55, together))] == sorted(want, key=repr)
    assert {len([w for w in want if w[0] == g]) for g in (1, 2)} & {0, 78, 45150} == set()


def test_queries_look_at_whole_texts(spark, tmp_path):
    """Forty documents with one first line, of which the last ten go on with another text, are not all alike; their notes' whole bodies count."""
    from corpusloom.plans import anchors, panels

    text = lambda k: "one line that all texts begin with, longer than sixty characters in all\n" + ("xyz " * 400 if k >= 30 else "abc " * 400) + ("\n见文末" if k == 1 else "")
    spark.createDataFrame([(k, text(k)) for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(r.a, r.b) for r in anchors.similar_sentences(spark, str(tmp_path)).collect()}
    assert pairs == {(a, b) for a in range(40) for b in range(a, 40) if (a < 30) == (b < 30)}
    assert [r.flags for r in sorted(anchors.consensus_sentences(spark, str(tmp_path)).collect(), key=lambda r: int(r.key))] == [30, 10]
    (found,) = panels.panel_reasons(spark, str(tmp_path)).collect()
    assert found.unclear == 2 and "about-itself" in found.reasons.split(",") and "paragraphs" in found.reasons.split(",")


def test_markers_in_many_lines(spark):
    """Only lines that have a marker are held against its patterns: a million others take seconds."""
    text = "\n".join(f"line {i} of words" for i in range(1_000_000)) + "\nconst found = 1\n"
    df = spark.createDataFrame([(text,)], "text string").select(F.split("text", "\n", -1).alias("lines"))
    begin = time.monotonic()
    found = df.select(*[A.find_line(F.col("lines"), F.lit(m)).alias(m) for m in ("found", "nowhere", "999999", "const")]).collect()[0]
    assert tuple(found) == (1_000_001, None, 1_000_000, 1_000_001) and time.monotonic() - begin < 20
