"""Detectors, raw texts and claims on small cases, each beside one that must not fire."""

from pyspark.sql import functions as F

from corpusloom.operators import decisionchecks as D
from corpusloom.operators import detectors as X
from corpusloom.operators import programs as P
from corpusloom.operators import revalidation as V
from corpusloom.sources import ledger_texts as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(spark, *texts):
    return P.with_lines(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "c")


def test_absence_mixing_looks_at_direct_members(spark):
    mixed = "interface A {\n  a?: string\n  b: string | null\n}"
    nested = "interface B {\n  a?: string\n  b: { c: string | null }\n  d: {\n    e: null | number\n  }\n}"
    one = "type C = {\n  a: string | null\n  b: number\n}\ntype D = { x?: 1; y: 2 | null }\ninterface E { x?: 1 }"
    in_text = "interface F {\n  a?: string // b: string | null\n  s: '| null'\n}\nconst x = { a: null | 1 }"
    both = "export interface G {\n  f(x?: string): void\n  readonly a?: {\n    q?: 1\n  }\n  z: Map<string, number> | null;\n}\ninterface H {\n  a?: 1\n}"
    found = X.absence_mixing(files(spark, mixed, nested, one, in_text, both), "id")
    assert rows(found) == [(0, "A", 1), (2, "D", 5), (4, "G", 1)]


def test_flags_after_other_parameters(spark):
    text = "\n".join(["function a(x, y?: boolean) {", "function b(flag = true) {}", "const c = (q: string, deep: boolean = false) => 1", "f({ a, b = true }: Props)", "g(x, { deep = true })", "h(x, y: boolean)", "i(a, 'x, y = true')", "j(a, b = true, c)"])
    assert rows(X.boolean_traps(files(spark, text), "id")) == [(0, 1, "y"), (0, 3, "deep")]


def test_three_escapes_make_a_cluster(spark):
    cluster = "let x = y as any\nlet z: any = 1 as unknown as string"
    single, string = "let x = y as any", "let x = 'as any as any as any'"
    ignored = "// @ts-ignore\n// @ts-ignore\nlet a: Record<string, unknown>"
    assert rows(X.type_escapes(files(spark, cluster, single, string, ignored), "id")) == [(0, 3), (3, 3)]


def test_markers_in_comments_only(spark):
    found = X.markers(files(spark, "let TODO = 1 // FIXME and HACK\nconst s = 'XXX'\n/* KLUDGE\nTODOS TODO */"), "id")
    assert rows(found) == [(0, 1, "FIXME"), (0, 3, "KLUDGE"), (0, 4, "TODO")]


def test_layers_and_cycles(spark):
    edges = spark.createDataFrame([("ui/a", "core/b"), ("core/b", "ui/c"), ("core/b", "lib/x"), ("ui/a", "ui/c"), ("out/z", "ui/a"), ("uix/a", "core/b"), ("core/q", "core/b"), ("core/b", "core/q")], "src string, dst string")
    assert rows(X.layer_violations(edges, [["ui"], ["core"], ["lib/x"]])) == [("core/b", "ui/c", 1, 0)]
    packages = spark.createDataFrame([("ui",), ("core",), ("lib",)], "root string")
    assert rows(X.import_cycles(edges, packages)) == [("module", "core/b", "core/b"), ("module", "core/q", "core/b"), ("package", "core", "core"), ("package", "ui", "core")]


def test_notes_without_a_head_and_with_a_list(spark):
    raw = [("a/b.ts.md", "---\nhash: h\norder: [1, \"x\", null, \"y\"]\ndirty: true\n---\nbody"), ("__dir__.md", "no head"), ("d/__dir__.md", None), ("x__dir__.md", "---\nhash:\n---"), ("n.txt", "x"), ("e.md", "---\norder: {}\n---\n\n---\nhash: z\n---\n")]
    found = {r.path: (r.type, r.hash, r.dirty, r.reading_order, r.body) for r in T.notes(spark.createDataFrame(raw, "file string, text string")).collect()}
    assert found == {"a/b.ts": ("file", "h", True, ["x", "y"], "body"), "": ("dir", None, False, None, "no head"), "d": ("dir", None, False, None, ""), "x__dir__": ("file", "", False, None, ""), "e": ("file", None, False, None, "\n---\nhash: z\n---\n")}


def test_glossary_entries(spark):
    text = "intro\n## One\naliases： a、b , \ntext ## not\n归属: `src/x` \nmore\n##  Two \n## \n\n## 三\n别名: 3"
    found = rows(T.glossary(spark.createDataFrame([(1, text), (2, None), (3, "## ")], "id int, text string"), "id"))
    assert [r[2:] for r in found] == [("One", ["a", "b"], "text ## not\n\nmore", "src/x"), ("Two", [], "", None), ("三", ["3"], "", None)]


def test_claims(spark):
    claims = [("ok", "d", "fresh", ["u"], "1"), ("none", "d", "fresh", [], "1"), ("kept", "d", "missing", ["u"], None), ("gone", "d", "missing", None, None), ("other", "d", "fresh", ["w"], "1"), ("old", "d", "fresh", ["u"], "0"), ("unread", "d", "fresh", ["u"], "1"), ("cross", "d", "fresh", ["only"], "1"), ("twice", "d", "fresh", ["two"], "1"), ("stale", "d", "stale", [], None), ("lost", "d", "fresh", ["no"], "1")]
    paths = [c[0] for c in claims]
    assigned = [(p, "d", {"cross": "only", "twice": "two", "lost": "no"}.get(p, "u")) for p in paths]
    units = [("d", "u", 2, "r", None), ("e", "only", 2, "r", None), ("d", "two", 2, "r", None), ("d", "two", 2, "r", None), ("d", "idle", 2, "r", None)]
    receipts = [("d", "u", p, "1", True, p != "unread") for p in ("ok", "unread", "old")]
    frames = [spark.createDataFrame(r, s) for r, s in ((claims, "path string, domain string, status string, ledgers array<string>, blob string"), (assigned, "path string, domain string, unit string"), ([(p, "1") for p in paths], "path string, blob string"), (units, "domain string, slug string, version int, ruleset string, ruleset_digest string"), (receipts, "domain string, slug string, path string, blob string, reviewed boolean, full_read boolean"))]
    want = [("none", None, "evidence-ledgers"), ("kept", None, "evidence-ledgers"), ("other", "u", "wrong-unit-ledger"), ("old", None, "fresh-evidence"), ("unread", None, "fresh-evidence"), ("cross", "only", "cross-domain-ledger"), ("cross", None, "fresh-evidence"), ("twice", "two", "ambiguous-ledger"), ("twice", None, "fresh-evidence"), ("lost", "no", "unknown-ledger"), ("lost", None, "fresh-evidence"), (None, "idle", "unit-assignment"), (None, "only", "unit-assignment")]
    found = V.claim_errors(*frames)
    assert rows(found.select("path", "slug", "code")) == sorted(want, key=repr)
    # Without a digest no version 3 is accepted, and version 2 only under the rulesets that are.
    assert ("ok", None, "fresh-evidence") in rows(V.claim_errors(*frames, accepted=["q"]).select("path", "slug", "code"))
    none = found.limit(0)
    state = lambda *a: tuple(V.report_state(*a).first())
    assert state(True, none, True, True, none, none) == ("current", None, 0) and state(False, none, True, True, none, none) == ("missing", "missing", 1)
    assert state(True, found, False, True, none, found)[:2] == ("stale", "inventory-drift") and state(True, none, False, True, none, none)[:2] == ("invalid", "inventory-hash")
    assert state(True, none, True, False, none, found)[:2] == ("invalid", "policy-drift") and state(True, none, True, True, none, found) == ("invalid", "evidence", len(want))


def test_aliases(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "a", 1), ("s", "b", 1), ("s", "b", 2), ("t", "b", 1)], "scheme string, value string, finding int")
    assert rows(D.alias_errors(df)) == [("s", "a", "duplicate", 1), ("s", "b", "conflicting", 2)]


def test_units_for_translation(spark):
    registered = spark.createDataFrame([("d", "a", "A"), ("d", "b", "B"), ("d", "c", "C"), ("d", "c", "C")], "domain string, slug string, title string")
    ledgers = spark.createDataFrame([("d", "a", "A", ['{"x":1.0}', '{"x":2}']), ("d", "b", "B2", []), ("e", "z", "Z", ['{"a":1,"b":2}', '{"b":2, "a":1}']), ("e", "y", "Y", ["{"])], "domain string, slug string, title string, findings array<string>")
    found = {r.slug: (r.title, r.findings, r.problem, r.source_digest is None) for r in T.translation_units(registered, ledgers).collect()}
    assert found == {"a": ("A", 2, None, False), "b": ("B2", 0, "title-differs", True), "c": ("C", 0, "duplicate-unit", True), "z": ("Z", 2, "duplicate-findings", True), "y": ("Y", 1, "no-canonical-form", True)}


def test_read_states(spark):
    df = spark.createDataFrame([("a.ts", "x"), ("a", "x"), ("b.PY", "é" * 50), ("c.py", "x\0"), ("d.py", "x" * 20 + "\0"), ("e.sql", None)], "p string, t string")
    assert [r.s for r in df.select(P.read_state(F.col("p"), F.col("t"), most_bytes=60, looked_at=10).alias("s")).collect()] == ["read", "not-code", "large", "not-code", "read", "not-code"]
