"""Notes that follow moves in chains, and ledgers beside their histories."""

from corpusloom.operators import migration as M
from corpusloom.operators import portfolio as L


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names_end_where_later_moves_take_them(spark):
    moves = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("x", "y", 2), ("y", "z", 1), ("p", "q", 1), ("q", "p", 2), ("a", "no", 9)], "source string, target string, place long")
    assert rows(M.final_targets(moves)) == [("a", "d"), ("b", "d"), ("c", "d"), ("p", "p"), ("q", "p"), ("x", "y"), ("y", "z")]


def test_moved_notes(spark):
    body = "# a\n# a\ntext `a` `b` a `x`\n`.*`"
    notes = spark.createDataFrame([("a", "h", body), ("b", "h2", "`a``"), ("c.+", None, "#  c.+\n# c.+"), ("d", "h4", None)], "path string, hash string, body string")
    moves = spark.createDataFrame([("a", "n/a", 100, 1), ("c.+", "n/c", 80, 2), ("gone", "n/g", 100, 3)], "source string, target string, similarity int, place long")
    inventory = spark.createDataFrame([("n/a", "new"), ("n/c", "newer")], "path string, blob string")
    found = {r.path: (r.moved_from, r["hash"], r.body, r.renamed) for r in M.migrated_notes(notes, moves, inventory).collect()}
    assert found == {"n/a": ("a", "new", "# n/a\n# a\ntext `n/a` `b` a `x`\n`.*`", 1), "b": (None, "h2", "`n/a``", 1), "n/c": ("c.+", None, "#  c.+\n# n/c", 0), "d": (None, "h4", None, 0)}


def test_ledgers_and_histories(spark):
    current = spark.createDataFrame([("now", 2), ("ahead", 1), ("far", 1), ("other", 9), ("none", 1)], "slug string, observation int")
    histories = [(s, i, o) for s, os in {"now": [1, 2], "ahead": [1, 2], "far": [1, 2, 3], "other": [1], "first": [1], "lost": [1, 2]}.items() for i, o in enumerate(os)]
    found = L.ledger_states(current, spark.createDataFrame(histories, "slug string, place int, observation int"))
    assert rows(found) == [("ahead", "history-ahead"), ("far", "mismatch"), ("first", "history-ahead"), ("lost", "history-without-current"), ("none", "history-missing"), ("now", "current"), ("other", "mismatch")]
