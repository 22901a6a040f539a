"""Program text against plain walks over characters and lines."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.functions import text
from corpusloom.operators import programs as P


def walked(text, family):
    """Code and comment of each line, character by character."""
    code, comment, i = [""], [""], 0

    def put(piece, into):
        for c in piece:
            if c == "\n":
                code.append("")
                comment.append("")
            elif into is not None:
                into[-1] += c

    while i < len(text):
        mark = next((m for m in family.line if text.startswith(m, i)), None)
        if mark is not None:
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            put(text[i:end], comment)
            i = end
            continue
        block = next(((b, e) for b, e in family.block if text.startswith(b, i)), None)
        if block is not None:
            end = text.find(block[1], i + len(block[0]))
            end = len(text) if end < 0 else end + len(block[1])
            put(text[i:end], comment)
            i = end
            continue
        if family.triple and text[i : i + 3] in ("'''", '"""'):
            end = i + 3
            while end < len(text) and not text.startswith(text[i : i + 3], end):
                end += 2 if text[end] == "\\" else 1
            end = min(end + 3, len(text))
            put("''", code)
            put(text[i:end], None)
            i = end
            continue
        if text[i] in family.quotes:
            q, j = text[i], i + 1
            spans = q in family.spanning
            while j < len(text) and text[j] != q and (spans or text[j] != "\n"):
                j += 2 if text[j] == "\\" and (spans or text[j + 1 : j + 2] != "\n") else 1
            end = min(j + 1 if j < len(text) and text[j] == q else j, len(text))
            put("''", code)
            put(text[i:end], None)
            i = end
            continue
        put(text[i], code)
        i += 1
    return code, comment


@pytest.mark.parametrize("name", sorted(C.FAMILIES))
def test_masked_against_walk(spark, name):
    rng = random.Random(name)
    bits = ["a", "b ", "\n", "\n", "'", '"', "`", "\\", "//", "/*", "*/", "#", "--", "--[[", "]]", "{-", "-}", "<!--", "-->", "=begin", "=end", "'''", '"""', "x = 1"]
    texts = ["", "\n", None, "/", "'", "é 'ü\\", "a" * 200_000, '"' + "y" * 200_000 + '"', *["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", C.masked(F.col("text"), C.FAMILIES[name]).alias("m")).collect()
    for r in rows:
        assert (list(r.m.code), list(r.m.comment)) == walked(texts[r.id] or "", C.FAMILIES[name]), texts[r.id]


def indent(lines):
    stack, most = [], 0
    for line in lines:
        if not line.strip():
            continue
        w = len(line[: len(line) - len(line.lstrip(" \t"))].replace("\t", "    "))
        while stack and stack[-1] >= w:
            stack.pop()
        stack.append(w)
        most = max(most, len(stack) - 1)
    return most


def braces(lines):
    depth, most = 0, 0
    for line in lines:
        most = max(most, depth)
        for c in line:
            depth = max(0, depth + {"{": 1, "}": -1}.get(c, 0))
    return most


def test_depths_against_walk(spark):
    rng = random.Random(5)
    cases = [[""], ["a"], *[["".join(rng.choices("  \t{}a", k=rng.randrange(8))) for _ in range(rng.randrange(1, 30))] for _ in range(200)]]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, code array<string>").select("id", C.deepest_indent(F.col("code")).alias("i"), C.deepest_brace(F.col("code")).alias("b")).collect()
    for r in rows:
        filled = [line for line in cases[r.id]]
        assert (r.i, r.b) == (indent(filled), braces(filled)), cases[r.id]


def test_coherence_looks_two_lines_around(spark):
    code = ["readFile()", "", "", "", "x = open_socket"]
    comment = ["", "", "// reads the file, file", "", "/* socket */"]
    df = spark.createDataFrame([(code, comment), ([""], [""])], "code array<string>, comment array<string>")
    found = [r.c.asDict() for r in df.select(C.coherence(F.col("code"), F.col("comment")).alias("c")).collect()]
    assert found == [{"words": 3, "hits": 2}, {"words": 0, "hits": 0}]


def test_a_backslash_hides_a_quote_in_triple_quotes(spark):
    long = '"""' + 'a\\"b' * 30_000 + '"""'
    cases = ['x = """a\\"""b""" # c', "x = '''a\\\nb'''y # d", 'x = """ "" \\" "" # no', long + " # e", "'" + "\\'" * 50_000 + "' # f"]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string").select("id", C.masked(F.col("text"), C.FAMILIES["python"]).alias("m")).orderBy("id")
    assert [(r.m.code, r.m.comment) for r in df.collect()] == [(["x = '' "], ["# c"]), (["x = ''", "y "], ["", "# d"]), (["x = ''"], [""]), (["'' "], ["# e"]), (["'' "], ["# f"])]


def test_functions_open_to_the_end_and_beside_one_another(spark):
    text = "function a(x) {\n  if (x) {\n  }\n}\nfunction b() { return 1 }\nconst c = (y) => {\n  function d(z) {\n }\n"
    files = spark.createDataFrame([(1, text), (2, "def f(x):\n    if x:\n\n        y\nz\ndef g(): pass\ndef h():\n\n"), (3, "if (x) {\n}"), (4, None)], "id int, text string")
    of = lambda family: [tuple(r)[:4] + (r.max_nesting, r.branches) for r in P.functions(files, "id", family).orderBy("id", "line").collect()]
    # b closes on its own line, so its region runs on to where the depth has risen and come back: the file's end here.
    assert of("c") == [(1, "a", 1, 4, 2, 1), (1, "b", 5, 5, 2, 0)]
    assert of("python") == [(2, "f", 1, 4, 1, 1), (2, "h", 7, 3, 0, 0)]
    assert P.functions(files, "id", "c", most=1).count() == 1


def test_sections(spark):
    texts = ["a\nb\n# c\nd\n", "# a", "", None, "x\n#\n#"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", C.sections(F.col("text")).alias("s"))
    assert {r.id: r.s for r in df.collect()} == {0: [2, 3], 1: [1], 2: [1], 3: [1], 4: [1, 1, 1]}


def test_families_of_endings(spark):
    df = spark.createDataFrame([("a/b.TSX",), ("c.py",), ("d.txt",), ("e",)], "path string").select(C.family_of(F.col("path")).alias("f"))
    assert [r.f for r in df.collect()] == ["c", "python", None, None]


def test_styles_runs_and_names_of_a_whole_text(spark):
    """Patterns over all names of a text tell the styles that each name has by itself, runs are counts, and no comment or function walks over the whole text."""
    rng = random.Random(5)
    names = sorted({rng.choice("aZ_$") + "".join(rng.choice("abAZ_$1") for _ in range(rng.randrange(6))) for _ in range(1500)})
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    told = rows.select("n", text.naming_style(F.col("n")).alias("style"), *[F.regexp_count("n", F.lit(p)).alias(s) for s, p in P.STYLES.items()]).collect()
    assert all(r[s] == (r.style == s) for r in told for s in P.STYLES) and {r.style for r in told} >= set(P.STYLES)
    values = sorted(rng.choice(["a", "aa", "b", "if", "é", "==", "1.5"]) for _ in range(400)) + ["z"]
    got = spark.createDataFrame([(sorted(values),), ([],)], "v array<string>").select(C.run_lengths(F.col("v")).alias("r")).collect()
    assert [r.r.distinct for r in got] == [len(set(values)), 0]
    assert got[0].r.bits == pytest.approx(sum(n * math.log2(n) for n in Counter(values).values())) and got[1].r.bits == 0
    whole = spark.createDataFrame([(1, "if foo9if 9while Kelvin fooBar # foo\n")], "k int, text string")
    assert [r.names for r in P.with_lines(whole, "k", "python").select(C.own_names(F.array_join("code", "\n")).alias("names")).collect()] == [["foo9if", "Kelvin", "fooBar"]]
    assert "slice(" not in P.file_features(whole, "k", "python")._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_of_every_function(spark):
    """The largest function comes after 1,700 others; lists of functions end where their caller says."""
    braced = "".join(f"function f{i}(x) {{\n  y\n}}\n" for i in range(1700)) + "function last(x) {\n" + "  if (y) {\n" * 3 + "  z\n" * 9 + "}\n" * 4
    indented = "".join(f"def f{i}(x):\n    y\n" for i in range(1700)) + "def last(x):\n" + "    y\n" * 8 + "            z\n"
    for family, text, lines, nesting in (("c", braced, 17, 4), ("python", indented, 11, 2)):
        files = spark.createDataFrame([(1, text), (2, text[: text.index("f500(")]), (3, "")], "k int, text string")
        found = {r.k: (r.functions, r.fn_lines_max, r.fn_nesting_max) for r in P.file_features(files, "k", family).collect()}
        assert found[1] == (1701, lines, nesting) and found[2][0] == 500 and found[3] == (0, 0, 0), (family, found)
        assert [P.functions(files.where("k = 1"), "k", family, most=most).count() for most in (1, 500, 501, 1200, 5000)] == [1, 500, 501, 1200, 1701]


def test_the_sql_of_features_has_no_cap_and_that_of_lists_has():
    from corpusloom.plans import code

    sql = code.ORACLE_SQL
    assert all("< 500" not in sql[q] for q in ("txt3_file_features", "txt3_python_features"))
    assert all("< 500" in sql[q] for q in ("txt2_functions", "txt2_indented_functions", "srt4_largest_functions"))
