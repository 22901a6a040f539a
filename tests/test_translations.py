"""Translations by unit, and what is shown of them."""

from corpusloom.operators import translations as T

UNITS, TRANSLATIONS = "domain string, slug string, source_digest string, digests array<string>", "domain string, slug string, source_digest string, title string, findings array<struct<source_digest:string,title:string>>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark, slugs=None):
    units = {s: ["1", "2"] for s in ("ok", "stale", "part", "extra", "twice", "blank", "none", "many", "double")} | {"empty": []}
    two = [("1", "eins"), ("2", "zwei")]
    made = [("ok", "n", "OK", two), ("stale", "o", "S", two), ("part", "n", "P", two[:1]), ("extra", "n", "E", [("1", "a"), ("3", "b")]), ("twice", "n", "T", two), ("twice", "n", "T", two), ("blank", "n", " ", two), ("many", "n", "M", [*two, ("3", "c")]), ("double", "n", "D", [("1", "a"), ("1", "b")]), ("unknown", "n", "U", []), ("empty", "n", "leer", [])]
    keep = lambda s: slugs is None or s in slugs
    return spark.createDataFrame([("d", s, "n", f) for s, f in units.items() if keep(s)], UNITS), spark.createDataFrame([("d", *m) for m in made if keep(m[0])], TRANSLATIONS)


def test_codes(spark):
    judged = T.judged_units(*frames(spark))
    want = {"ok": "verified", "stale": "stale-unit", "part": "missing-finding", "extra": "unknown-finding", "twice": "duplicate-unit", "blank": "invalid-text", "none": "missing-unit", "many": "too-many-findings", "double": "duplicate-finding", "unknown": "unknown-unit", "empty": "verified"}
    assert {r.slug: r.code for r in judged.collect()} == want
    assert tuple(T.translation_state(judged).first()) == ("invalid", 2, 9)
    some = T.judged_units(*frames(spark, ("ok", "stale", "none")))
    assert tuple(T.translation_state(some).first()) == ("incomplete", 1, 2) and tuple(T.translation_state(T.judged_units(*frames(spark, ("ok", "empty")))).first())[0] == "complete"


def test_a_unit_is_shown_whole_or_not(spark):
    units, made = frames(spark, ("ok", "part"))
    findings = spark.createDataFrame([("d", s, i, str(i + 1), t) for s in ("ok", "part") for i, t in enumerate(("one", "two"))], "domain string, slug string, place int, digest string, title string")
    titles = spark.createDataFrame([("d", "ok", "Fine"), ("d", "part", "Part")], "domain string, slug string, title string")
    shown = T.overlaid(findings, titles, made, T.judged_units(units, made))
    assert rows(shown) == [("d", "ok", 0, "OK", "eins", True), ("d", "ok", 1, "OK", "zwei", True), ("d", "part", 0, "Part", "one", False), ("d", "part", 1, "Part", "two", False)]
    units, made = frames(spark, ("ok", "part", "unknown"))
    assert not any(r.translated for r in T.overlaid(findings, titles, made, T.judged_units(units, made)).collect())
