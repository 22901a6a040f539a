"""Records of tools on small cases."""

import hashlib
import time

from pyspark.sql import functions as F

from corpusloom.sources import records as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_legacy_ledgers_are_taken_whole_or_not(spark):
    a, b = "a" * 40, "B" * 40
    scan = lambda path, blob, n, more="": f'{{"path":"{path}","git_blob_sha1":"{blob}","finding_count":{n}{more}}}'
    texts = {
        "good": f'{{"scans":[{scan("x", a, 2, chr(44) + chr(34) + "max_severity" + chr(34) + ":" + chr(34) + "high" + chr(34))},{scan("a/y", b, 0)}]}}', "path": f'{{"scans":[{scan("x", a, 1)},{scan("../y", "no", 1)}]}}', "blob": f'{{"scans":[{scan("x", "a", 1)}]}}',
        "count": f'{{"scans":[{scan("x", a, 1.5)}]}}', "text": f'{{"scans":[{scan("x", a, chr(34) + "1" + chr(34))}]}}', "twice": f'{{"scans":[{scan("x", a, 1)},{scan("y", a, 1)},{scan("x", a, 1)}]}}', "none": '{"scans":[]}', "other": '{"a":1}', "broken": "{", "null": None,
        "much": '{"scans":[' + ",".join(scan(f"p{i}", a, 9007199254740991) for i in range(2)) + "]}",
    }
    whole, found = R.legacy_scans(spark.createDataFrame(list(texts.items()), "slug string, text string"))
    got = {r.slug: (r.files, r.findings, r.problem) for r in whole.collect()}
    assert got == {"good": (2, 2, None), "path": (None, None, "2:path"), "blob": (None, None, "1:blob"), "count": (None, None, "1:count"), "text": (None, None, "1:count"), "twice": (None, None, "3:duplicate"), **{s: (None, None, "no-scans") for s in ("none", "other", "broken", "null")}, "much": (None, None, "overflow")}
    assert rows(found) == [("good", "a/y", b.lower(), "info", 0), ("good", "x", a, "high", 2)]
    assert whole.where("slug = 'good'").first().scope_hash == hashlib.sha1(f"{a}  x\n{b.lower()}  a/y\n".encode()).hexdigest()


def test_dirty_paths(spark):
    raw = " M a\0R  new\0README old\0?? x y\0C  c\0R from\0 \0 D gone\0 M a\0"
    assert spark.createDataFrame([(raw,), ("",)], "t string").select(R.dirty_paths(F.col("t")).alias("p")).collect()[0].p == ["a", "new", "README old", "x y", "c", "R from", "gone"]


def test_long_listing(spark):
    """A listing takes time in proportion to its fields: 300,000 of them in seconds."""
    raw = "".join(f"R  new{i}\0old{i}\0" for i in range(150_000))
    begin = time.monotonic()
    paths = spark.createDataFrame([(raw,)], "t string").select(R.dirty_paths(F.col("t")).alias("p")).select(F.size("p").alias("n"), F.col("p")[299_999].alias("last")).collect()[0]
    assert (paths.n, paths.last) == (300_000, "old149999") and time.monotonic() - begin < 30


def test_tracked_files(spark):
    blob = "a" * 40
    records = [f"100644 {blob} 0\tA.txt", f"100644 {blob} 0\ta.txt", f"100755 {blob} 0\tb", f"100644 {blob} 2\tm", f"100644 {blob} 3\tm", f"120000 {blob} 0\tl", f"100644 {blob[1:]} 0\ts", "junk", f"100644 {blob} 0\t../x", f"100644 {blob} 0\té", f"100644 {blob} 0\té", f"100644 {blob} 0\tgone"]
    there = spark.createDataFrame([("A.txt", "1", "100644"), ("a.txt", "2", "100644"), ("b", "3", "100644"), ("é", "4", "100644"), ("é", "5", "100644")], "path string, blob string, mode string")
    files, problems = R.tracked_files(spark.createDataFrame(list(enumerate(records)), "place long, record string"), there)
    assert sorted(r.path for r in files.collect()) == sorted(["A.txt", "a.txt", "b", "é", "é", "gone"])
    assert rows(problems) == sorted([(None, "invalid-path"), (None, "malformed-record"), ("a.txt", "path-collision"), ("b", "mode-drift"), ("gone", "deleted"), ("l", "irregular-mode"), ("m", "duplicate-path"), ("m", "unmerged-entry"), ("s", "invalid-object"), ("é", "path-collision")], key=repr)
