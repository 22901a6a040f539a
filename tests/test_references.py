"""What counts as a path in inline code, and where references lead."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import references as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CASES = {
    "src/a.ts": True, "a.ts": True, "a.mjs": False, "a.cts": True, "a.tsx": True, "a.py": False, "and/or": False, "a/b/c": False, "a/B/c": True, "a/b1": True, "a/b.c": True, "a.b/c": False, "/abs/x1": False,
    "./x1/y": False, "~/x1": False, "@scope/x1": False, "x@y/z1": False, "http://x/1": False, "node:fs/x1": False, "a b/c1": False, "f(x)/y1": False, "a/{b}/c1": False, "a/b1/": True, "a/é1": False, "-x/1": False, "": False,
}


def test_what_is_a_path(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "t string").select("t", R.is_pathlike(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == CASES


@pytest.fixture
def tree(spark):
    rows = [("pkg/src/a1.ts", "file"), ("pkg/src/b/index.ts", "file"), ("pkg", "dir"), ("pkg/src", "dir"), ("pkg/src/b", "dir"), ("other/only1.ts", "file"), ("x/two.ts", "file"), ("y/two.ts", "file")]
    return spark.createDataFrame(rows, "path string, type string")


def test_broken_references(spark, tree):
    body = "`pkg/src/a1.js` `a1.ts` `src/a1` `src/b2` `./x1` `b/x1` `only1.ts` `gone/only1.ts` `gone/two.ts` `old/z1.ts` `z9.ts` `src/b/*` ` src/b2 `\n```\n`in/fence1`\n```"
    notes = spark.createDataFrame([("pkg/src/a1.ts", "file", body), ("pkg", "dir", "`src/a1.ts` `b/index.ts` `a/*/b1`"), ("n", "file", None)], "path string, type string, body string")
    moves = spark.createDataFrame([("pkg/old/z1.ts", "new/z1.ts"), ("old/z1.ts", "other/z1.ts"), ("q/z9.ts", "r/z8.ts"), ("p/z9.ts", "r/z7.ts")], "source string, target string")
    want = [("src/b2", None), ("b/x1", None), ("gone/only1.ts", "other/only1.ts"), ("gone/two.ts", None), ("old/z1.ts", "new/z1.ts"), ("z9.ts", "r/z7.ts")]
    found = R.broken_references(notes, tree, moves)
    assert rows(found.where("path like '%.ts'").select("ref", "suggestion")) == sorted(want, key=repr)
    assert rows(found.where("path = 'pkg'").select("ref")) == []
    plain = dict(want) | {"old/z1.ts": None, "z9.ts": None}
    assert rows(R.broken_references(notes, tree).where("path like '%.ts'").select("ref", "suggestion")) == sorted(plain.items(), key=repr)


def test_page_links(spark, tree):
    notes = spark.createDataFrame([("pkg/src/a1.ts", "file", "`a1.ts` `b/` `pkg/src` `src/a1.ts` `two.ts` `b-*` `x y` `src/*`"), ("pkg", "dir", "`src/a1.ts` `pkg`")], "path string, type string, body string")
    assert rows(R.page_links(notes, tree)) == [("pkg", "src/a1.ts", "pkg/src/a1.ts"), ("pkg/src/a1.ts", "b/", "pkg/src/b"), ("pkg/src/a1.ts", "pkg/src", "pkg/src"), ("pkg/src/a1.ts", "src/*", "pkg/src")]
