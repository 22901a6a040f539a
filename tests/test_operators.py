import hashlib
import random

from pyspark.sql import functions as F

from corpusloom.operators import attention, coverage, decisions, freshness, glossary, graph, textfeatures
from corpusloom.sources import text_inventory
from corpusloom.streaming import attention_stream


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_status_of_missing_fresh_and_unstamped(spark):
    inv = frame(spark, "path string, blob string", ("a", "1"), ("b", "2"), ("c", "3"))
    notes = frame(spark, "path string, hash string", ("a", "1"), ("b", None), ("z", "9"))
    assert pairs(freshness.note_status(inv, notes).select("path", "status")) == [("a", "fresh"), ("b", "outdated"), ("c", "missing")]
    assert pairs(freshness.orphans(inv, notes)) == [("z", "9")]


def test_moves_prefer_the_longest_suffix(spark):
    orphaned = frame(spark, "path string, hash string", ("old/x/f.md", "1"), ("old/g.md", "1"))
    missing = frame(spark, "path string, blob string", ("new/x/f.md", "1"), ("new/f.md", "1"), ("q", "2"))
    assert pairs(freshness.exact_moves(orphaned, missing)) == [("old/g.md", "new/f.md"), ("old/x/f.md", "new/x/f.md")]


def test_moves_are_claimed_in_the_order_of_the_orphans(spark):
    rng = random.Random(2)
    path = lambda top: "/".join([top, *rng.choices("xyz", k=rng.randrange(3)), rng.choice(["f.md", "g.md"])])
    orphaned = sorted({(f"{path(f'old{k}')}", rng.choice("12")) for k in range(40)} | {(f"o/{k:02}/same.md", "3") for k in range(30)} | {("twice/f.md", "1"), ("twice/f.md", "2")})
    missing = sorted({(f"{path(f'new{k}')}", rng.choice("12")) for k in range(40)} | {(f"n/{k:02}/same.md", "3") for k in range(30)} | {(f"n/00/{k:02}.md", "3") for k in range(5)})
    orphaned = list(dict(sorted(orphaned, reverse=True)).items())
    orphaned += [("a/x/f", "9"), ("b/y/f", "9"), ("only/here", "8")]
    missing += [("c/y/f", "9"), ("d/z/f", "9")]
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a.split("/")[::-1], b.split("/")[::-1])) if x != y), min(a.count("/"), b.count("/")) + 1)
    wanted, used = [], set()
    for s, h in sorted(orphaned):
        free = [(-shared(s, t), t) for t, b in missing if b == h and t not in used]
        if free:
            used.add(min(free)[1])
            wanted.append((s, min(free)[1]))
    twice = [("twice/f.md", "2")]  # of a path with two blobs the least counts
    found = pairs(freshness.exact_moves(frame(spark, "path string, hash string", *orphaned, *twice), frame(spark, "path string, blob string", *missing)))
    assert found == sorted(wanted)
    # The first orphan takes the least of its ties, even where another shares more with that path.
    assert ("a/x/f", "c/y/f") in found and ("b/y/f", "d/z/f") in found


def test_evidence_precedence(spark):
    req = frame(spark, "domain string, unit string, path string, blob string, deleted boolean", *[("d", u, p, "1", x) for u, p, x in [("u", "ok", False), ("u", "old", False), ("u", "gone", True), ("u", "unread", False), ("twice", "ok", False), ("none", "ok", False)]])
    units = frame(spark, "domain string, unit string, accepted boolean", ("d", "u", True), ("d", "twice", True), ("d", "twice", True))
    rec = frame(spark, "domain string, unit string, path string, blob string, reviewed boolean, full_read boolean", ("d", "u", "ok", "1", True, True), ("d", "u", "old", "0", True, True), ("d", "u", "gone", "1", True, True), ("d", "u", "unread", "1", True, False))
    got = {(r["unit"], r["path"]): r["status"] for r in coverage.evidence_status(req, units, rec).collect()}
    assert got == {("u", "ok"): "fresh", ("u", "old"): "stale", ("u", "gone"): "stale", ("u", "unread"): "missing", ("twice", "ok"): "invalid", ("none", "ok"): "missing"}


def test_reads_with_a_gap_cover_up_to_it(spark):
    reads = frame(spark, "f string, start int, end int", ("a", 1, 5), ("a", 6, 9), ("a", 12, 20), ("b", 2, 9), ("c", 1, 9), ("c", 3, 4), ("c", 10, 12))
    assert pairs(coverage.interval_cover(reads, ["f"])) == [("a", 9), ("b", 0), ("c", 12)]


def test_cycles_components_and_waves(spark):
    edges = frame(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"))
    assert pairs(graph.strong_components(edges)) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert pairs(graph.components(edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    needs = frame(spark, "src string, dst string", ("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"))
    assert pairs(graph.waves(frame(spark, "node string", ("a",), ("b",), ("c",), ("d",)), needs)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_long_ways_and_rings_are_followed_to_their_end(spark):
    chain = spark.range(52).selectExpr("id as src", "id + 1 as dst")
    assert graph.reachability(chain, frame(spark, "node long", (0,))).agg(F.count("*"), F.max("hops")).first()[:] == (52, 52)
    ring = spark.range(105).selectExpr("id as src", "(id + 1) % 105 as dst")
    assert {tuple(r) for r in graph.strong_components(ring).collect()} == {(k, 0) for k in range(105)}


def test_strong_components_against_mutual_reach(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(52)}
    reach = {n: {b for a, b in edges if a == n} for n in range(40)}
    for _ in range(40):
        reach = {n: to | {x for t in to for x in reach[t]} for n, to in reach.items()}
    wanted = {(n, min(m for m in reach[n] if n in reach[m])) for n in range(40) if n in reach[n]}
    assert {tuple(r) for r in graph.strong_components(frame(spark, "src int, dst int", *sorted(edges))).collect()} == wanted


def test_sibling_edges_part_where_paths_do(spark):
    edges = frame(spark, "src string, dst string", ("p/a/1", "p/b/2"), ("p/a/3", "p/b/2"), ("p/a/1", "p/a/1"))
    assert pairs(graph.sibling_edges(edges)) == [("p", "a", "b", 2)]


def test_effective_states(spark):
    schema = "finding string, current int, action string, on_current boolean, context_current boolean, expired boolean, compatible boolean"
    cases = [
        (("new", 1, None, False, True, False, False), ("open", "implicit-open", "new", True)),
        (("none", 0, None, False, True, False, False), ("open", "implicit-open", "unknown", False)),
        (("two", 2, "remediated", True, True, False, False), ("open", "reconciliation-conflict", "unknown", True)),
        (("done", 0, "remediated", False, True, False, False), ("remediated", "explicit-event", "resolved", False)),
        (("late", 0, "remediated", False, True, True, False), ("open", "carry-invalidated", "unknown", True)),
        (("back", 1, "false-positive", False, True, False, False), ("reopened", "automatic-reopen", "reopened", True)),
        (("kept", 1, "accepted-risk", False, True, False, True), ("accepted-risk", "carried", "persisting", False)),
        (("lost", 1, "accepted-risk", False, True, False, False), ("open", "carry-invalidated", "persisting", True)),
        (("still", 1, "reopened", False, True, False, False), ("reopened", "carried", "reopened", True)),
    ]
    got = decisions.effective_state(frame(spark, schema, *[c for c, _ in cases]), blocking=[])
    assert {r["finding"]: (r["disposition"], r["derivation"], r["lifecycle"], r["blocks"]) for r in got.collect()} == {c[0]: want for c, want in cases}


def test_chain_breaks_where_a_link_was_changed(spark):
    log = frame(spark, "ledger string, i int, body string", ("x", 0, "a"), ("x", 1, "b"), ("x", 2, "c"))
    chain = decisions.chained(log, "ledger", "i", ["body"])
    assert decisions.broken_links(chain, "ledger", "i").count() == 0
    assert [r["i"] for r in decisions.broken_links(chain.withColumn("previous", F.when(F.col("i") == 2, "zz").otherwise(F.col("previous"))), "ledger", "i").collect()] == [2]


def test_attention_reopens_and_refuses_stale_actions(spark):
    states = spark.sql("select * from values ('a', 's1', 1L, 'done', null), ('b', 's1', 2L, 'snoozed', timestamp'2020-01-01'), ('c', 's1', 1L, 'snoozed', timestamp'2999-01-01') t(slug, snapshot, revision, workflow, snoozed_until)")
    seen = frame(spark, "slug string, snapshot string, fresh boolean", ("a", "s2", True), ("b", "s1", True), ("c", "s1", False), ("n", "s1", True), ("m", "s1", False))
    got = {r["slug"]: (r["revision"], r["workflow"], r["event"]) for r in attention.reconcile(states, seen, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": (2, "open", "source-reopened"), "b": (3, "open", "reopened"), "c": (1, "snoozed", None), "n": (1, "done", None), "m": (1, "open", None)}
    actions = frame(spark, "slug string, snapshot string, revision long, outcome string, note string", ("a", "s1", 1, "decided", "n"), ("a", "s0", 1, "decided", "n"), ("b", "s1", 1, "decided", "n"), ("c", "s1", 1, "decided", " "), ("q", "s", 1, "x", ""))
    assert [r["result"] for r in attention.act(states, actions).orderBy("slug", F.desc("snapshot")).collect()] == ["applied", "stale-snapshot", "stale-revision", "note-required", "unknown-subject"]


def test_longer_terms_hide_shorter_ones(spark):
    docs = frame(spark, "doc_id long, text string", (1, "The access token, tokens and L114; access control token"), (2, None))
    terms = frame(spark, "term string, alias string", ("token", "token"), ("access token", "access token"), ("l1", "l1"))
    found = glossary.mentions(docs, terms)
    assert pairs(found) == [(1, "access token", 1), (1, "token", 1)]
    assert pairs(glossary.dead_terms(terms, found)) == [("l1",)]


def test_attention_stream_keeps_state_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "slug string, snapshot string, fresh boolean, seq long"
    for i, rows in enumerate([[("a", "s1", True, 1), ("b", "s1", False, 2)], [("a", "s1", True, 3), ("a", "s2", True, 4)]]):
        frame(spark, schema, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        if i == 0:
            query = lambda: attention_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        query().awaitTermination()
    got = sorted((r["slug"], r["revision"], r["workflow"], r["event"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, "done", None), ("a", 2, "open", "source-reopened"), ("b", 1, "open", None)]


def test_directory_children_are_in_the_order_of_names(spark):
    """A file ``b`` comes before a directory ``z``, whatever their sorts."""
    inv = spark.createDataFrame([("b", "2"), ("z/y", "3")], "path string, blob string")
    got = {r.dir: r.hash for r in freshness.directory_hashes(inv).collect()}
    assert got[""] == hashlib.sha1(b"F b 2\nD z").hexdigest()


def test_quantiles_take_the_upper_of_two_middles(spark):
    docs = spark.createDataFrame([(1, "a\nbb\nccc\ndddd"), (2, " \n"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lines, r.mean, r.p50, r.p95, r.max) for r in textfeatures.line_lengths(docs).collect()}
    assert got == {1: (4, 2.5, 3, 4, 4), 2: (0, 0.0, 0, 0, 0), 3: (0, 0.0, 0, 0, 0)}


def test_short_lines_make_no_shingles(spark):
    line = "a line of twenty-five chars"
    docs = spark.createDataFrame([(1, "\n".join([line, "short"] * 4)), (2, "\n".join([line.upper()] * 4)), (3, "\n".join([line] * 4))], "doc_id long, text string")
    got = {r.doc_id: (r.shingles, r.repeated) for r in textfeatures.duplicate_ratio(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (1, 1)}


def test_waves_of_a_chain_and_of_a_cycle(spark):
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node int")
    chain = spark.createDataFrame([(k + 1, k) for k in range(9)] + [(11, 3), (5, 99)], "src int, dst int")
    assert pairs(graph.waves(nodes, chain)) == sorted([(k, k) for k in range(10)] + [(10, 0), (11, 4)])
    try:
        graph.waves(nodes, chain.union(spark.createDataFrame([(2, 4)], chain.schema)))
        raise AssertionError("a cycle has no waves")
    except ValueError:
        pass


def test_inventory_hashes_bytes_of_any_size(spark, tmp_path):
    files = {"a.txt": b"caf\xe9", "big.txt": b"x" * 600_000, "binary": b"a\0b"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.blob, r.size) for r in text_inventory(spark, str(tmp_path)).collect()}
    assert got == {n: (hashlib.sha1(b"blob %d\0" % len(d) + d).hexdigest(), len(d)) for n, d in files.items() if n != "binary"}


def test_mentions_hold_no_whole_text_a_word(spark):
    """A text of 60,000 words: its words are rows, and no row holds them all again."""
    docs = spark.createDataFrame([(1, "a bb ccc " * 20_000)], "doc_id long, text string")
    terms = spark.createDataFrame([("t", "bb ccc"), ("u", "ccc"), ("v", "ccc a bb ccc")], "term string, alias string")
    found = glossary.mentions(docs, terms)
    made = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode" in line]
    assert made and all("), [1], false" in line or "), [0], false" in line for line in made), made
    assert pairs(found) == [(1, "t", 20_000)]


def test_components_hand_on_less_each_round(spark, monkeypatch):
    """Long ways whose nodes are in order: the tables of all rounds are a few times the edges, and repeated edges, loops and lone nodes change nothing."""
    rows, keep = [], graph.written

    def counted(df, name):
        out = keep(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    n = 3000
    ways = spark.range(n).selectExpr("id as src", "if(id % 1000 = 999, id, id + 1) as dst")
    got = {r.node: r.component for r in graph.components(ways.union(ways).union(spark.createDataFrame([(-5, -5), (7, 3)], "src long, dst long"))).collect()}
    assert got == {k: k // 1000 * 1000 for k in range(n)} | {-5: -5}
    assert sum(rows) < 12 * n
    assert graph.components(ways.limit(0)).count() == 0
