"""Small tables on which the rules of status, review and history differ from simpler ones."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import history as H
from corpusloom.operators import review as R
from corpusloom.operators import status as S
from corpusloom.operators.readingorder import AUXILIARY, reading_order


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_voted_moves_keep_the_way_below(spark):
    moves = spark.createDataFrame([("a/x/1", "b/x/1"), ("a/x/2", "b/x/2"), ("a/y", "c/y"), ("a/z", "d/other")], "source string, target string")
    dirs = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert rows(S.voted_moves(dirs("a", "a/x"), moves, dirs("b", "b/x", "c"))) == [("a", "b", 2), ("a/x", "b/x", 2)]
    # Only the target with most votes is tried.
    assert rows(S.voted_moves(dirs("a"), moves, dirs("c"))) == []
    assert rows(S.voted_moves(dirs("none"), moves, dirs("b"))) == []


def test_edited_moves_claim_once(spark):
    orphans = spark.createDataFrame([("o1", "a"), ("o2", "a"), ("o3", None)], "path string, anchor string")
    renames = spark.createDataFrame([("a", "o1", "t", 90), ("a", "o2", "t", 95), ("b", "o3", "u", 80)], "anchor string, source string, target string, similarity int")
    missing = spark.createDataFrame([("t",), ("u",)], "path string")
    assert rows(S.edited_moves(orphans, missing, renames)) == [("o1", "t", 90)]


def test_change_sizes_of_files_directories_root(spark):
    changes = spark.createDataFrame([("k", "a/b", 1, 2), ("k", "a", 10, None), ("l", "a/b", 5, 5)], "anchor string, path string, added int, removed int")
    entries = spark.createDataFrame([("a", "file", "k"), ("a", "dir", "k"), ("", "dir", "k"), ("a/b", "file", "l"), ("c", "file", "k")], "path string, type string, anchor string")
    assert rows(S.change_sizes(entries, changes)) == sorted([("a", 10, 0, 1), ("a", 11, 2, 2), ("", 11, 2, 2), ("a/b", 5, 5, 1)], key=repr)


def test_concepts_without_sources(spark):
    concepts = spark.createDataFrame([("c", [], None), ("d", ["p", "q"], None)], "slug string, sources array<string>, hash string")
    inventory = spark.createDataFrame([("p", "file", "1")], "path string, type string, blob string")
    found = {r.slug: (r.status, r.broken) for r in S.concept_status(concepts, inventory).collect()}
    assert found == {"c": ("outdated", []), "d": ("broken-source", ["q"])}


def test_preorder_puts_parents_first(spark):
    nodes = spark.createDataFrame([("b", 1), ("a", 2), ("b/z", 1), ("b/y", 2), ("b/z/k", 1)], "path string, place int")
    assert [r.path for r in S.preorder(nodes).orderBy("key").collect()] == ["b", "b/z", "b/z/k", "b/y", "a"]


def test_preorder_of_names_that_go_on(spark):
    nodes = spark.createDataFrame([("a", 1), ("a/x", 1), ("a-b", 1), ("a b", 1), ("a/x/y", 1)], "path string, place int")
    assert [r.path for r in S.preorder(nodes).orderBy("key").collect()] == ["a", "a/x", "a/x/y", "a b", "a-b"]


def test_contested_targets_go_by_the_first_orphan_of_the_anchor(spark):
    orphaned = spark.createDataFrame([("m", "z"), ("n", "b"), ("k", "c"), ("q", "c")], "path string, anchor string")
    missing = spark.createDataFrame([("t",), ("u",), ("v",)], "path string")
    renames = spark.createDataFrame([("z", "m", "t", 90), ("b", "n", "t", 80), ("c", "q", "u", 70), ("c", "k", "u", 60), ("b", "n", "gone", 99)], "anchor string, source string, target string, similarity int")
    assert rows(S.edited_moves(orphaned, missing, renames)) == [("k", "u", 60), ("m", "t", 90)]
    claimed = spark.createDataFrame([("m", "v"), ("k", "w")], "source string, target string")
    assert rows(S.edited_moves(orphaned, missing, renames, claimed)) == [("n", "t", 80), ("q", "u", 70)]


def test_proposals_are_judged_in_turn(spark):
    rng = random.Random(8)
    confirmed, proposed, want = [], [], []
    for w in range(60):
        ends = lambda: (f"{w}-{rng.randrange(6)}", f"{w}-{rng.randrange(6)}")  # noqa: B023, E731
        confirmed += [tuple(sorted(ends())) for _ in range(2)]
        proposed += [(w * 100 + k, rng.randrange(5), *ends()) for k in range(8)]
    onward = {}
    for a, b in confirmed:
        onward.setdefault(a, set()).add(b)
    for event, _, src, dst in sorted(proposed, key=lambda p: (p[1], p[0])):
        seen, ways = set(), [dst]
        while ways:
            node = ways.pop()
            if node not in seen:
                seen.add(node)
                ways += onward.get(node, ())
        if src in seen:
            want.append((event, src, dst, "cyclic"))
        else:
            onward.setdefault(src, set()).add(dst)
    frames = spark.createDataFrame(confirmed, "src string, dst string"), spark.createDataFrame(proposed, "event long, place long, src string, dst string")
    assert rows(H.cyclic_in_turn(*frames)) == sorted(want, key=repr) and len(want) > 50
    assert {r[3] for r in rows(H.cyclic_in_turn(*frames, most_edges=0))} == {"oversized"}


def plain_order(children, edges):
    """Every pick looks at all that are left."""
    aux = lambda c: bool(re.search(AUXILIARY, c[0]))
    head = [c[0] for c in sorted((c for c in children if c[2] is not None), key=lambda c: (c[2], c[0]))]
    rest = {c[0]: c for c in children if c[2] is None}
    uses = {(a, b) for a, b in edges if a != b and a in rest and b in rest and not aux(rest[a])}
    waits = {n: sum(b == n for _, b in uses) for n in rest}
    out, left = head, set(rest)
    while left:
        pick = min(left, key=lambda n: (waits[n] > 0, aux(rest[n]), -sum(a == n for a, _ in uses), not rest[n][1], n))
        left.remove(pick)
        out.append(pick)
        for a, b in uses:
            if a == pick:
                waits[b] -= 1
    return out


def test_reading_order_with_cycles_ties_and_auxiliary_names(spark):
    rng = random.Random(9)
    names = ["a", "b", "c", "d", "e", "tests", "x.test.ts", "scripts", "fixtures-1", "main", "Zed", "é"]
    children, edges, want = [], [], []
    for w in range(80):
        own = [(n, rng.random() < 0.4, rng.randrange(3) if rng.random() < 0.15 else None) for n in rng.sample(names, rng.randrange(1, 12))]
        links = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(0, 25))}
        children += [(f"d{w}", *c) for c in own]
        edges += [(f"d{w}", *e) for e in links]
        want += [(f"d{w}", n, k) for k, n in enumerate(plain_order(own, links))]
    found = reading_order(spark.createDataFrame(children, "dir string, name string, is_dir boolean, head int"), spark.createDataFrame(edges, "dir string, src string, dst string"))
    assert rows(found) == sorted(want, key=repr)


def test_without_glob(spark):
    df = spark.createDataFrame([("a/",), ("a/*",), ("a-*",), ("a-**",), ("a/*/b",)], "p string").select(S.without_glob(F.col("p")).alias("p"))
    assert [r.p for r in df.collect()] == ["a", "a", "a-", "a", None]


def test_domain_totals_never_say_covered_when_stale(spark):
    units = spark.createDataFrame([("x", 4, 4, 0, 1), ("y", 4, 4, 0, 0)], "domain string, required int, fresh int, gaps int, open int")
    drift = spark.createDataFrame([("y", 7)], "domain string, n int")
    assert rows(R.domain_totals(units, drift, F.lit(True)).select("domain", "gaps")) == [("x", 1), ("y", 7)]


def test_retirements_and_closures(spark):
    e = "event int, path string, blob string, place int, reason string, supersedes int"
    events = [(1, "p", "b", 1, "staged-deletion", None), (2, "p", "b", 2, "deleted", 1), (3, "p", "b", 3, "deleted", None), (4, "q", "b", 1, "deleted", 9), (5, "r", "b", 1, "staged-deletion", None), (6, "r", "b", 2, "superseded", None)]
    assert [r[0] for r in rows(H.retirement_errors(spark.createDataFrame(events, e)))] == [3, 4, 6]
    c = "event int, finding string, place int, action string, supersedes int"
    events = [(1, "f", 1, "remediated", None), (2, "f", 2, "open", None), (3, "f", 3, "accepted-risk", 1), (4, "g", 1, "remediated", None), (5, "g", 2, "reopened", 4), (6, "h", 1, "reopened", None), (7, "h", 2, "remediated", 6)]
    assert [r[0] for r in rows(H.closure_errors(spark.createDataFrame(events, c)))] == [3, 7]


def test_cycles(spark):
    confirmed = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    proposed = spark.createDataFrame([(10, 3, 1), (11, 1, 3), (12, 4, 4), (13, 2, 1)], "event int, src int, dst int")
    assert [r[0] for r in rows(H.cyclic_edges(confirmed, proposed))] == [10, 12, 13]


def test_instants(spark):
    texts = ["2024-02-29T00:00:00Z", "2023-02-29T00:00:00Z", "2024-04-31T00:00:00Z", "0000-01-01T00:00:00Z", "2024-01-01T00:00:00", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(H.rfc3339(F.col("t")).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, False, False, False, False, False, False]


def test_boundaries_of_null_and_empty(spark):
    df = spark.createDataFrame([([1], [2]), ([], [2]), (None, [2]), ([1, 1], [2]), ([1], [1, 2])], "b array<int>, a array<int>")
    assert [r.p for r in df.select(H.boundary_problem(F.col("b"), F.col("a")).alias("p")).collect()] == [None, "empty", "empty", "repeated", "shared"]
