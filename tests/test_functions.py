import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hashing, paths, stats, text


def values(spark, data, *columns):
    return [r[0] if len(r) == 1 else tuple(r) for r in spark.createDataFrame(data, "a string, b string").select(*columns).collect()]


def test_blob_hashes_and_ids(spark):
    a = F.col("a")
    for s, sha1, sha256, none in [(r[0], *r[1:]) for r in values(spark, [("é\n", None), ("", None)], a, hashing.blob_sha1(a), hashing.blob_sha256(a), hashing.blob_sha1(F.col("b")))]:
        data = b"blob %d\0" % len(s.encode()) + s.encode()
        assert (sha1, sha256, none) == (hashlib.sha1(data).hexdigest(), hashlib.sha256(data).hexdigest(), None)
    assert values(spark, [("x", "y")], hashing.stable_id("f-", "tag", a, F.col("b"))) == ["f-" + hashlib.sha256(b"tag\0x\0y").hexdigest()[:24]]


def test_fnv1a(spark):
    def fnv(data):
        h = 2166136261
        for byte in data:
            h = (h ^ byte) * 16777619 % 2**32
        return h

    words = ["", "a", "foobar", "ä→"]
    assert values(spark, [(w, None) for w in words], hashing.fnv1a32(F.col("a"))) == [fnv([int.from_bytes(u[i : i + 2], "big") for i in range(0, len(u), 2)]) for u in (w.encode("utf-16-be") for w in words)]


@pytest.mark.parametrize("glob, path, hit", [("src/**", "src/a/b.ts", True), ("*.md", "a/b.md", False), ("**/*.md", "b.md", True), ("a/{b,c}?.x", "a/c1.x", True), ("[!a]*", "abc", False), ("a.b", "axb", False)])
def test_globs(spark, glob, path, hit):
    assert values(spark, [(path, None)], paths.matches_any(F.col("a"), [glob])) == [hit]


def test_unknown_globs_are_refused():
    with pytest.raises(ValueError):
        paths.glob_regex("@(a|b)")


def test_ignore_rules_last_match_wins(spark):
    rows = [("build/x", None), ("keep/build/y", None), ("src/z", None)]
    assert values(spark, rows, paths.ignored(F.col("a"), ["build", "!keep/build"])) == [True, False, False]


def test_paths(spark):
    a = F.col("a")
    assert values(spark, [("x/y/z", None)], paths.ancestors(a)) == [["", "x", "x/y"]]
    assert values(spark, [("p/q/r", "z/q/r"), ("r", "q/r"), ("s", "r")], paths.suffix_score(a, F.col("b"))) == [2, 1, 0]
    assert [tuple(r) for r in values(spark, [("a.ts:12", None), ("a.ts#f", None), ("a.ts:0", None)], paths.location(a))] == [("a.ts", 12, None), ("a.ts", None, "f"), ("a.ts:0", None, None)]


def test_text_pieces(spark):
    a = F.col("a")
    assert values(spark, [("see `x/y.ts`\n```\n`no`\n```\n`z`", None)], text.inline_code(a)) == [["x/y.ts", "z"]]
    assert values(spark, [("**Term,** and **1**", None)], text.bold_terms(a)) == [["Term"]]
    assert values(spark, [("parseHTTPRequest2fast", None)], text.identifier_words(a, ["fast"])) == [["parse", "http", "request"]]
    assert values(spark, [("---\npath: a\nhash: h\n---\nbody", None)], text.front_matter_map(text.front_matter(a)["head"])) == [{"path": "a", "hash": "h"}]
    assert values(spark, [(w, None) for w in ("A_B", "aB", "Ab", "a_b", "A_b", "x", "_x_", "__", "ab", "_aB", "A$")], text.naming_style(a)) == [
        "upper", "camel", "pascal", "snake", "mixed", "other", "other", "other", "camel", "camel", "other"]


def test_rank_correlation_needs_variance(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "x int, y int")
    assert stats.spearman(df, "x", "y").first()["rho"] is None
    df = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (None, 9)], "x int, y int")
    row = stats.spearman(df, "x", "y").first()
    assert row["n"] == 3 and row["rho"] == pytest.approx(0.8660254)


def test_entropy(spark):
    assert values(spark, [("aabb", None), ("", None)], stats.entropy(F.filter(F.split("a", ""), lambda c: c != ""))) == [1.0, 0.0]
