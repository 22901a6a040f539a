"""Labels, states, exclusions and prose lints on small cases."""

from pyspark.sql import functions as F

from corpusloom.functions import prose as S
from corpusloom.operators import presentation as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hazards_in_their_order(spark):
    cases = {"yarn.lock": False, "sub/Cargo.lock": False, ".env": True, "x/.env.test": True, "x.env": False, ".github/workflows/a.md": True, "docs/agents.md": False, "Dockerfile.dev": True, "a.schema.json": True, "schema.json": True, "x-schema.json": True, "xschema.json": False, "jest.unit.json": True, "k.PEM": True, ".ts": False, "a.txt": False, "a.": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", P.is_hazardous(F.col("p"), F.lit(None).cast("string")).alias("h"), P.is_hazardous(F.col("p"), F.lit("100644"), F.lit("100755")).alias("x"))
    got = df.collect()
    assert {r.p: r.h for r in got} == cases and all(r.x for r in got)


def test_states_and_labels(spark):
    of = lambda *v: spark.range(1).select(P.file_status(*[F.lit(x) for x in v]).alias("s")).first().s
    assert of("invalid", "review", True, "fresh") == "unknown" and of("stale", "review", True, "fresh") == "stale" and of("stale", "review", True, "missing") == "missing"
    assert of("current", "conflict", True, "fresh") == "conflict" and of("current", "review", False, "fresh") == "unknown" and of("current", "review", True, None) == "missing"
    label = lambda *v: tuple(spark.range(1).select(P.risk_label(*[F.lit(x) for x in v], "info").alias("r")).first().r)
    assert label(1, "high", 0, 0) == ("open", "1 open (high)") and label(3, None, 0, 0) == ("open", "3 open (highest info)")
    assert label(0, None, 1, 2) == ("retained", "1 accepted risk, 2 separate design") and label(0, "x", 0, 0)[0] == "none"


def test_exact_exclusions_have_an_owner(spark):
    of = lambda glob, owner, *ex: spark.range(1).select(P.is_exact_exclusion(F.lit("a/b"), F.array(F.lit(glob)), F.array(*map(F.lit, ex)) if ex else F.array().cast("array<string>"), F.lit(owner)).alias("x")).first().x
    assert of("a/b", "me") and not of("a/*", "me") and not of("a/b", "") and not of("a/b", None) and not of("a/b", "me", "c")


def test_ledgers_are_stamped_where_nothing_drifted(spark):
    inventory = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, blob string")
    good = P.scope_hashes(inventory.withColumn("s", F.lit("x")), "s").first()["hash"]
    ledgers = spark.createDataFrame([("ok", ["b", "a"], good), ("old", ["a"], good), ("gone", ["a", "b", "c"], good), ("none", [], None)], "slug string, files array<string>, scope_hash string")
    assert rows(P.stamped_ledgers(ledgers, inventory)) == [("gone", "drifted"), ("none", "drifted"), ("ok", "stamped"), ("old", "drifted")]
    names = spark.createDataFrame([("ok",), ("no",)], "slug string")
    assert rows(P.stamped_ledgers(ledgers, inventory, names)) == [("no", "not-found"), ("ok", "stamped")]


def test_prose(spark):
    body = "# T。。。。\n" + "x" * 130 + "\n- " + "y" * 121 + "\n一。二。三。\n```\n" + "z" * 200 + "\n```\n三个步骤：甲、乙、丙\n比如 A（1）、B（2）、C（3）\nA（1）、B（2）、C（3）\n见文末\n" + '<div class="callout">\n' + "w" * 200
    r = spark.createDataFrame([(body,)], "b string").select(S.long_paragraphs(F.col("b"), 120, 2).alias("l"), S.lines_about_itself(F.col("b")).alias("a"), S.hidden_lists(F.col("b")).alias("h"), S.is_flat(F.col("b")).alias("f")).first()
    assert [tuple(x) for x in r.l] == [(False, 130, 0), (True, 121, 0), (False, 6, 3)]
    assert r.a == ["见文末"] and r.h == ["三个步骤：甲、乙、丙", "A（1）、B（2）、C（3）"] and r.f is False
    paths = {"a/b": True, "a": True, "": False, "/a": False, "a/": False, "a//b": False, "./a": False, "a/..": False, "a/...": True, "..a": True, "C:/x": False, "c:": False, "a\\b": False, "a\0b": False}
    assert {r.p: r.v for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.is_repository_path(F.col("p")).alias("v")).collect()} == paths
