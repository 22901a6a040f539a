import random
import re

from pyspark.sql import functions as F

from corpusloom.llm.linededup import dedup_lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[i:], b[i:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:]


def brute(rows, min_words=8):
    """Texts that stay, by the definition: all pairs of lines."""
    places = {}
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            words = re.sub(r"[ \t\x0b-\r]+", " ", line.lower()).strip(" ").split(" ")
            if words != [""]:
                place = (doc_id is None, doc_id or 0, pos)
                places.setdefault(tuple(words), []).append(place)
    order = sorted(places, key=lambda w: min(places[w]))
    drop = set()
    for k, words in enumerate(order):
        near = len(words) >= min_words and any(len(other) >= min_words and one_edit(words, other) for other in order[:k])
        drop |= set(places[words]) if near else set(places[words]) - {min(places[words])}
    return {(d, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d is None, d or 0, p) not in drop)) for d, t in rows}


def edited(rng, words, vocabulary):
    words, kind, i = list(words) or ["w"], rng.randrange(4), rng.randrange(len(words) or 1)
    if kind == 0:
        words[i] = rng.choice(vocabulary)
    elif kind == 1:
        words.insert(i, rng.choice(vocabulary))
    elif kind == 2:
        del words[i]
    return words


def test_against_all_pairs(spark):
    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 7, 8, 9, 10, 15, 16, 40, 255, 256, 257, 2100]))] for _ in range(40)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(bases)
            for _ in range(rng.randrange(3)):
                words = edited(rng, words, vocabulary)
            lines.append((" " * rng.randrange(1, 3)).join(words).upper() if rng.random() < 0.3 else " ".join(words))
        rows.append((d if d else None, "\n".join(lines)))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "one text"), (1004, "ONE  text\nand another")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.text) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_long_insides_use_running_sums(spark):
    words = [f"w{i}" for i in range(2600)]
    changed, shorter, far = list(words), words[:1300] + words[1301:], list(words)
    changed[1290] = "other"
    far[10] = far[2000] = "other"
    rows = [(k, " ".join(w)) for k, w in enumerate((words, changed, shorter, far))]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0}


def test_very_long_insides(spark):
    # places beyond what 64-bit sums of plain products would hold with 32-bit hashes
    words = [f"{k % 9973}" for k in range(60_000)]
    changed = words[:31_000] + ["other"] + words[31_001:]
    rows = [(0, " ".join(words)), (1, " ".join(changed)), (2, " ".join(words[:-1])), (3, " ".join(reversed(words)))]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0}


def test_other_columns_and_empty(spark):
    line = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, line, "a", 7), (2, line, None, None), (2, line, None, None)], "doc_id long, text string, n_lines string, extra int")
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped, r.extra) for r in dedup_lines(df).collect()}
    assert got == {(1, line, 1, 0, 7), (2, "", 1, 1, None)}
    assert dedup_lines(df.where(F.lit(False))).count() == 0
