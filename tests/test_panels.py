"""Panels, rounds and batches against plain loops."""

import random
from statistics import median

from corpusloom.operators import panels as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_batches(paths, most):
    groups = {}
    for p in sorted(paths):
        groups.setdefault(p.split("/")[-1], []).append(p)
    held = [[] for _ in range(-(-len(paths) // most))]
    for group in sorted(groups.values(), key=lambda g: (-len(g), g[0])):
        for p in group:
            name, directory = p.split("/")[-1], p.rpartition("/")[0]
            named = lambda b: any(q.split("/")[-1] == name for q in b)  # noqa: B023, E731
            near = lambda b: any(q.rpartition("/")[0] == directory for q in b)  # noqa: B023, E731
            for allowed in (lambda b: not named(b) and not near(b), lambda b: not named(b), lambda b: True):
                open_ = [b for b in held if len(b) < most and allowed(b)]
                if open_:
                    min(open_, key=len).append(p)
                    break
    return {p: i for i, b in enumerate(held) for p in b}


def test_batches(spark):
    rng = random.Random(6)
    files, want = [], []
    for u in range(30):
        paths = {f"d{rng.randrange(4)}/f{rng.randrange(6)}" for _ in range(rng.randrange(1, 25))} | {"top"}
        files += [(f"u{u}", p) for p in paths]
        want += [(f"u{u}", p, b) for p, b in plain_batches(paths, 4).items()]
    assert rows(P.batches(spark.createDataFrame(files + files[:3], "unit string, path string"), 4)) == sorted(want, key=repr)


def test_reasons_of_a_panel(spark):
    callout = '<div class="callout">a hard sentence in a callout'
    notes = spark.createDataFrame([("good", "short"), ("bad", "见文末\n```mermaid\n```\n" + "x" * 400 + callout), ("hub", "```mermaid\n```")], "note string, body string")
    readers = [("good", r, 4.0, True, 1.0) for r in range(3)] + [("bad", r, float(r), r != 1, None) for r in range(3)] + [("hub", 0, 5.0, None, 2.0)]
    readers = spark.createDataFrame(readers, "note string, reader int, overall double, retells boolean, concreteness double")
    sections = spark.createDataFrame([("bad", 0, "one", 1.0), ("bad", 1, "one", 2.0), ("bad", 0, "two", 5.0), ("good", 0, "进阶细节", 0.0), ("good", 0, "a", 3.0)], "note string, reader int, section string, score double")
    flagged = [("bad", 0, 1, "this sentence is not clear"), ("bad", 1, 2, "this sentence is not so clear"), ("bad", 2, 3, "another one"), ("bad", 0, 4, "a hard sentence in a callout"), ("bad", 1, 5, "a hard sentence in a callout"), ("good", 0, 6, "mine alone")]
    flagged = spark.createDataFrame(flagged, "note string, reader int, key int, sentence string")
    claims = spark.createDataFrame([("bad", "unsupported"), ("bad", "misleading"), ("good", "fine")], "note string, verdict string")
    found = {r.note: r for r in P.panel_reasons(notes, readers, sections, flagged, claims, P.Limits(unclear=0)).collect()}
    assert found["good"].reasons == [] and found["good"].unclear == 0 and found["good"].worst_section == "a"
    assert found["bad"].reasons == ["unclear", "section", "overall", "retell", "unsupported", "misleading", "paragraphs", "about-itself"] and found["bad"].unclear == 1
    assert found["hub"].reasons == ["concreteness"] and found["hub"].readers == 1


def test_the_best_round(spark):
    rng = random.Random(4)
    readings, rounds, want = [], [], []
    for page in range(40):
        judged = []
        for k in range(3):
            audience, other, unsupported = rng.choice(["general", "dev"]), rng.choice([0, 0, 1]), rng.choice([0, 0, 0, 1])
            own = [(rng.randrange(7), rng.randrange(5), rng.random() < 0.8) for _ in range(3)]
            readings += [(page, k, r, float(u), float(b), t) for r, (u, b, t) in enumerate(own)]
            rounds.append((page, k, audience, other, unsupported))
            u, b = median(x[0] for x in own), median(x[1] for x in own)
            reasons = other + (u > (5 if audience == "general" else 4)) + (b > (4 if audience == "general" else 3)) + (sum(x[2] for x in own) < 2) + (unsupported > 0)
            judged.append((reasons, float(reasons * 2 + u + b * 2 + unsupported * 3)))
        passing = [k for k, (n, _) in enumerate(judged) if not n]
        best = passing[0] if passing else min(range(3), key=lambda k: (judged[k][1], k))  # noqa: B023
        want += [(page, k, n == 0, n, p, k == best) for k, (n, p) in enumerate(judged)]
    frames = spark.createDataFrame(readings, "page int, round int, reader int, unclear double, breaks double, retells boolean"), spark.createDataFrame(rounds, "page int, round int, audience string, other_reasons int, unsupported int")
    assert rows(P.best_rounds(*frames, {"general": 5, "dev": 4}, {"general": 4, "dev": 3})) == sorted(want, key=repr)


def test_explained_again(spark):
    long = "the cache is a table that " + "x" * 300
    notes = spark.createDataFrame([("a/b", long + "\n\nno"), ("home/x", long), ("home", long), ("homex", long), ("c", "cache\n\n" + long), ("d", "the cache\n\n\n" + "y" * 400), ("e", None)], "path string, body string")
    found = P.explained_again(notes, [P.Concept("cache", r"\bcache\b", "home", True), P.Concept("file", "table", "a/b", False)], 240, "is a")
    assert rows(found.select("concept", "path", "paragraphs")) == [("cache", "a/b", 1), ("cache", "c", 2), ("cache", "homex", 1), ("file", "c", 1), ("file", "home", 1), ("file", "home/x", 1), ("file", "homex", 1)]
    assert P.explained_again(notes, []).count() == 0
