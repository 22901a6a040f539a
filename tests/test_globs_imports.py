"""Globs by index and imports, against plain loops."""

import posixpath
import random
import re

from pyspark.sql import functions as F

from corpusloom.functions.paths import glob_regex
from corpusloom.operators import globs as G
from corpusloom.operators import imports as I


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_index_finds_what_every_pair_finds(spark):
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "src", "x.ts", "y.test.ts", "z", ".hidden", "a.b"])
    paths = sorted({"/".join(part() for _ in range(rng.randrange(1, 5))) for _ in range(300)})
    bit = lambda: rng.choice(["*", "**", "a", "src", "?", "[ab]", "{a,src}", "*.ts", "x.*", "*.test.ts", "[!a]*", "*.{ts,b}"])
    globs = sorted({"/".join(bit() for _ in range(rng.randrange(1, 4))) for _ in range(150)} | {p for p in paths[:10]} | {"**", "*"})
    want = [(g, p) for g in globs for p in paths if re.match(glob_regex(g), p)]
    got = G.matches(spark.createDataFrame([(p,) for p in [*paths, *paths[:5], None]], "path string"), spark.createDataFrame([(g,) for g in globs], "glob string")).select("glob", "path")
    assert rows(got) == sorted(want, key=repr) and len(want) > 500
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert [G.index_key(g) for g in ("src/a/*.ts", "src/a/x", "**/x.ts", "*/?.test.ts", "**", "*.{a,b}")] == [("dir", "src/a"), ("dir", "src/a/x"), ("name", "x.ts"), ("ending", ".ts"), ("any", ""), ("any", "")]


def test_no_paths_and_no_globs(spark):
    none = spark.createDataFrame([], "path string"), spark.createDataFrame([], "glob string")
    some = spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("a",)], "glob string")
    assert [G.matches(p, g).count() for p, g in ((none[0], some[1]), (some[0], none[1]), some)] == [0, 0, 1]


def test_normalized_paths(spark):
    texts = ["a/./b", "a//b/../c", "../a", "a/../..", "a/..", "", ".", "./../a/..", "a/b/../../c/d/..", "..x/a", "a/..x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string").select("id", I.normalized(F.col("p")).alias("p")).orderBy("id")
    plain = ["" if p == "." else p for p in map(posixpath.normpath, texts)]
    assert [r.p for r in df.collect()] == [None if p.startswith("..") else p for p in plain]


def test_specifiers_and_candidates(spark):
    text = "import a from 'x';import\"./y\"\nimport('z') require( \"w/v\" ) from`no` export {q} from './q'; important 'no'"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(I.specifiers(F.col("t"))).first()[0] == ["x", "./y", "z", "w/v", "./q"]
    of = lambda p: spark.createDataFrame([(p,)], "p string").select(I.candidates(F.col("p"))).first()[0]
    assert of("a/b.mjs") == ["a/b.mjs", "a/b.mts", "a/b.mjs"] and of("a.js") == ["a.js", "a.ts", "a.tsx"] and of("a.css") == ["a.css"]
    assert of("a/b")[:3] == ["a/b", "a/b.ts", "a/b.tsx"] and of("a/b")[-1] == "a/b/index.js" and len(of("a/b")) == 10


def test_the_first_candidate_counts(spark):
    files = [("p/a.ts", "import './b'; import './c.js'; import '../../up'; import 'own/deep'; import './a'"), ("p/b.tsx", ""), ("p/b/index.ts", ""), ("p/c.tsx", ""), ("p/c.ts", ""), ("p/n.md", "import './b'")]
    packages = spark.createDataFrame([("own", "lib"), ("own", "lib2"), ("own/deep", "no")], "name string, root string")
    assert rows(I.import_edges(spark.createDataFrame(files, "path string, text string"), packages)) == [("p/a.ts", "lib2"), ("p/a.ts", "p/b.tsx"), ("p/a.ts", "p/c.ts")]
