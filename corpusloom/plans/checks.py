"""Claims, decision contexts, detectors, and notes and glossaries out of raw texts, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.operators import decisionchecks as D
from corpusloom.operators import detectors as X
from corpusloom.operators import programs as P
from corpusloom.operators import revalidation as V
from corpusloom.operators import translations as R
from corpusloom.sources import ledger_texts as T
from corpusloom.sources import table

DIGEST = "sha256:" + "a" * 64


def _claims(spark, sf):
    """Orders as paths that their customer's segment must review in the unit of their priority; lines of them are receipts."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("domain")), "o_custkey")
    base = o.select(k.alias("k"), k.cast("string").alias("path"), "domain", F.substring("o_orderpriority", 1, 1).alias("unit"), (k % 5).cast("string").alias("blob"))
    k = F.col("k")
    status = F.when(k % 7 == 0, "missing").when(k % 7 == 1, "stale").otherwise("fresh")
    ledgers = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 13 == 0, F.array("unit", F.lit("9"))).when(k % 17 == 0, F.array(F.lit("2"))).when((k % 7 == 0) & (k % 3 > 0), F.lit(None).cast("array<string>")).otherwise(F.array("unit", "unit"))
    claims = base.select("path", "domain", status.alias("status"), ledgers.alias("ledgers"), F.when(k % 19 == 0, "old").otherwise(F.col("blob")).alias("blob"))
    assigned = base.where("k % 23 > 0").select("path", "domain", "unit")
    current = base.where("k % 29 > 0").select("path", "blob")
    kinds = base.select("domain", "unit").distinct().select("domain", F.col("unit").alias("slug"))
    held = kinds.where("slug <> '5' and not (slug = '4' and domain = 'BUILDING')")
    version = F.when(F.col("slug") == "1", 1).when(F.col("slug") == "2", 2).otherwise(3)
    units = held.select("domain", "slug", version.alias("version"), F.when(F.col("domain") == "MACHINERY", "other").otherwise("r").alias("ruleset"), F.when(F.col("domain") != "FURNITURE", DIGEST).alias("ruleset_digest"))
    units = units.unionByName(units.where("slug = '3' and domain = 'AUTOMOBILE'")).unionByName(units.limit(0)).unionByName(spark.createDataFrame([("BUILDING", "8", 2, "r", None)], units.schema))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_returnflag") != "R").alias("reviewed"), (F.col("l_linestatus") == "O").alias("full_read"))
    receipts = base.join(lines, "k").select("domain", F.col("unit").alias("slug"), "path", "blob", "reviewed", "full_read")
    return claims, assigned, current, units, receipts


def claim_errors(spark, sf):
    return V.claim_errors(*_claims(spark, sf), accepted=["r"])


def report_state(spark, sf):
    """The report of these claims, over an inventory that hasn't drifted."""
    errors = claim_errors(spark, sf)
    return V.report_state(True, errors.limit(0), True, True, errors.limit(0), errors)


def _decisions(spark, sf):
    """Events as decisions, orders as occurrences, customers as observations."""
    e, o, c = (table(spark, sf, n) for n in ("events", "orders", "customer"))
    k, ok, ck = F.col("event_id"), F.col("o_orderkey"), F.col("c_custkey")
    binding = lambda n, m: F.concat(F.lit("p"), (n % m).cast("string"), F.lit(":b"), (n % 3).cast("string"))
    observations = c.select(ck.alias("observation"), F.concat(F.lit("u"), ck % 4).alias("slug"), F.lit("r").alias("ruleset"), F.concat(F.lit("d"), ck % 2).alias("digest"), (ck % 5 > 0).alias("exact"))
    occurrences = o.select(
        ok.alias("occurrence"), (ok % 97).alias("finding"), F.concat(F.lit("u"), ok % 97 % 4).alias("ledger"), F.col("o_custkey").alias("observation"), F.array(binding(ok, 50), binding(ok + 1, 50)).alias("bindings"),
        F.array(F.concat(F.lit("p"), ok % 50), F.concat(F.lit("p"), (ok + 1) % 50)).alias("paths"), (ok % 3 > 0).alias("eligible"), F.when(ok % 41 > 0, "r").alias("ruleset"), F.concat(F.lit("d"), F.col("o_custkey") % 2).alias("digest"))
    findings = occurrences.select("finding", "ledger").distinct()
    n = k * 4 + F.when(k % 6 == 0, 2_000_000_000).otherwise(1)
    of = occurrences.select(F.col("occurrence").alias("o"), F.col("finding").alias("of"), F.col("ledger").alias("ol"), F.col("observation").alias("oo"), F.col("bindings").alias("ob"), F.col("digest").alias("od"))
    joined = e.select(k, n.alias("n")).join(of, F.col("n") == F.col("o"), "left")
    k = F.col("event_id")
    events = joined.select(
        F.when(k % 71 == 0, k - 1).otherwise(k).alias("event"), F.when(k % 8 == 1, "u0").otherwise(F.coalesce("ol", F.lit("u1"))).alias("ledger"), F.when(k % 10 == 3, -1).otherwise(F.coalesce("of", F.lit(5))).alias("finding"), F.col("n").alias("occurrence"),
        F.when(k % 9 == 4, k % 500 + 1).when(k % 9 == 5, -5).otherwise(F.coalesce("oo", F.lit(7))).alias("observation"), F.when(k % 7 == 5, F.array(F.lit("p1:x"))).otherwise(F.coalesce("ob", F.array().cast("array<string>"))).alias("bindings"),
        F.when(k % 11 == 2, "other").otherwise("r").alias("ruleset"), F.coalesce("od", F.lit("d0")).alias("digest"))
    reviewed = occurrences.select("observation", F.explode("bindings").alias("binding")).distinct()
    return events, occurrences, findings, observations, reviewed


def context_kinds(spark, sf):
    events, occurrences, _, observations, _ = _decisions(spark, sf)
    return D.context_kinds(events, occurrences, observations).groupBy("event", "kind").agg(F.count("*").alias("n"))


def event_errors(spark, sf):
    return D.event_errors(*_decisions(spark, sf))


def alias_errors(spark, sf):
    e = table(spark, sf, "events")
    return D.alias_errors(e.select(F.col("event_type").alias("scheme"), (F.col("event_id") % 701).alias("value"), (F.col("event_id") / 701 % 3).cast("int").alias("finding")).where("event_id % 3 = 0"))


SCRIPT = [(". ", ";\n"), (" the ", " as any "), (" of ", ": any = 'as any' // @ts-ignore TODO\n"), (" and ", " as unknown as "), (" in ", "\nfunction in(a, b?: boolean) {\n"), (" is ", "\n} // FIXME: XXX\n"), (" de ", "\nconst f = (x: Record<string, unknown>, y = false) => 1\n"), (" a ", "({ a, b = true }: P)")]


def _scripts(spark, sf):
    text = F.coalesce("text", F.lit(""))
    for old, new in SCRIPT:
        text = F.replace(text, F.lit(old), F.lit(new))
    return P.with_lines(table(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id", "c")


def type_escapes(spark, sf):
    return X.type_escapes(_scripts(spark, sf), "doc_id")


def boolean_traps(spark, sf):
    return X.boolean_traps(_scripts(spark, sf), "doc_id")


def old_markers(spark, sf):
    """Ages of lines by number; every fourth file has no history."""
    found = X.markers(_scripts(spark, sf), "doc_id")
    k = F.col("doc_id")
    ages = found.where(k % 4 > 0).select("doc_id", "line", F.date_sub(F.lit("2024-06-01").cast("date"), ((k + F.col("line")) * 37 % 400).cast("int")).alias("changed")).distinct()
    return X.marker_ages(found, ages, "doc_id", F.lit("2024-06-01").cast("date"))


def _links(spark, sf):
    """Parts of one order that follow one another import each other; brands are packages and layers."""
    path = F.concat(F.col("p_brand"), F.lit("/f"), (F.col("p_partkey") % 60).cast("string"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace(path, "#", "").alias("path"))
    lines = table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select("l_partkey", ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 50 + 1).alias("to"))
    return lines.join(parts.withColumnRenamed("path", "src"), "l_partkey").join(parts.toDF("to", "dst"), "to").where("src < dst or l_partkey % 9 = 0").select("src", "dst").distinct()


def layer_violations(spark, sf):
    return X.layer_violations(_links(spark, sf), [["Brand1", "Brand2/"], ["Brand3"], ["Brand4", "Brand5/f1"]])


def package_cycles(spark, sf):
    edges = _links(spark, sf)
    packages = edges.select(F.substring_index("src", "/", 1).alias("root")).union(edges.select(F.substring_index("dst", "/", 1))).distinct().where("root <> 'Brand5'")
    return X.import_cycles(edges, packages)


def _raw(spark, sf):
    k, first = F.col("doc_id"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return table(spark, sf, "documents").select(k, first.alias("first"), F.sha1(F.coalesce("text", F.lit(""))).alias("sha"), "source", "lang")


def raw_notes(spark, sf):
    k = F.col("doc_id")
    order = F.when(k % 6 == 0, 'order: ["b", 3, "a"]\n').when(k % 6 == 1, 'order: ["x"\n').otherwise("")
    head = F.concat(F.lit("---\r\nhash: "), F.when(k % 3 > 0, F.col("sha")).otherwise(""), F.lit("\nanchor:  \nbad line\nanchor: "), F.when(k % 5 > 0, "c1 ").otherwise(""), F.lit("\ndirty: "), F.when(k % 2 == 0, "true").otherwise("yes"), F.lit("\n"), order, F.lit("---\n"))
    text = F.when(k % 7 > 0, F.concat(head, "first")).otherwise(F.concat(F.lit(" "), head))
    file = F.when(k % 4 == 0, F.concat_ws("/", "source", k.cast("string"), F.lit("__dir__.md"))).when(k % 9 == 1, F.concat("source", F.lit("/"), k, F.lit(".txt"))).otherwise(F.concat("source", F.lit("/"), k, F.lit(".ts.md")))
    found = T.notes(_raw(spark, sf).select(file.alias("file"), text.alias("text")))
    return found.withColumn("reading_order", F.array_join("reading_order", ",")).withColumn("body", F.sha1("body"))


def raw_glossary(spark, sf):
    k = F.col("doc_id")
    text = F.concat(F.lit("# All\n## term"), k, F.lit(" \n"), F.when(k % 2 == 0, "aliases: a1, b2、 c3,,\n").otherwise(""), F.lit(" defined as "), "lang", F.lit("\n"), F.when(k % 3 == 0, F.concat(F.lit("home: `src/"), k, F.lit("`\n"))).otherwise(""), F.lit("\nmore\n##   \nsecond"), k, F.lit("\n## last"))
    found = T.glossary(_raw(spark, sf).select("doc_id", text.alias("text")), "doc_id")
    return found.withColumn("aliases", F.array_join("aliases", "|"))


def raw_pages(spark, sf):
    k = F.col("doc_id")
    head = F.concat(F.lit("---\ntitle: "), F.when(k % 3 > 0, F.concat(F.lit("T"), k)).otherwise(""), F.lit("\norder: "), F.when(k % 4 == 0, (k % 10).cast("string")).when(k % 4 == 1, "x").when(k % 4 == 2, "1.50").otherwise(""), F.lit("\naudience: "), F.when(k % 2 == 0, "general").otherwise("all"), F.lit('\nsources: ["a","b"]\nchapter: C\n---\nbody'))
    found = T.concept_pages(_raw(spark, sf).select(F.concat(F.lit("p"), k).alias("slug"), F.when(k % 5 > 0, head).alias("text")))
    return found.withColumn("sources", F.array_join("sources", ","))


def _translation_units(spark, sf):
    """Orders are units by key and status, their lines findings."""
    o, l = table(spark, sf, "orders").where("o_orderkey % 2 = 0"), table(spark, sf, "lineitem").where("l_orderkey % 2 = 0")  # noqa: E741
    k = F.col("o_orderkey")
    registered = o.where("o_orderkey % 5 > 0").select(F.col("o_orderstatus").alias("domain"), k.cast("string").alias("slug"), F.concat(F.lit("U"), k).alias("title"))
    registered = registered.unionByName(registered.where("slug % 31 = 0"))
    body = F.concat(F.lit('{ "title":"t'), (F.col("l_partkey") % 5).cast("string"), F.lit('", "fix": [1.0, '), F.col("l_linenumber") % 2, F.lit("]"), F.when(F.col("l_orderkey") % 37 == 0, "").otherwise("}"))
    findings = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(body).alias("findings"))
    ledgers = o.where("o_orderkey % 7 > 0").join(findings, "o_orderkey", "left").select(F.col("o_orderstatus").alias("domain"), k.cast("string").alias("slug"), F.concat(F.when(k % 11 == 0, "V").otherwise("U"), k).alias("title"), "findings")
    return T.translation_units(registered, ledgers)


def translation_units(spark, sf):
    return _translation_units(spark, sf).drop("digests")


def judged_translations(spark, sf):
    """Translations of the sound units: some missing, stale, twice, without a finding, with one too many or an unknown one, and some of no unit."""
    units = _translation_units(spark, sf).where("problem is null")
    n = F.col("slug").cast("int") / 2 % 9
    texts = F.transform("digests", lambda d: F.struct(d.alias("source_digest"), F.lit("t").alias("title")))
    other = F.array(F.struct(F.lit("x").alias("source_digest"), F.lit("t").alias("title")))
    findings = F.when(n == 3, F.slice(texts, F.lit(2), F.size(texts))).when(n == 4, F.concat(F.slice(texts, F.lit(2), F.size(texts)), other)).when(n == 5, F.concat(texts, other)).otherwise(texts)
    made = units.where(n > 0).select("domain", F.when(n == 6, F.concat(F.lit("no"), "slug")).otherwise(F.col("slug")).alias("slug"), F.when(n == 1, "old").otherwise(F.col("source_digest")).alias("source_digest"), F.when(n == 7, "").otherwise("T").alias("title"), findings.alias("findings"))
    return R.judged_units(units, made.unionByName(made.where("try_cast(slug as int) % 9 = 4")))


QUERIES = {
    "joi22_claim_errors": claim_errors, "fld4_report_state": report_state, "joi30_context_kinds": context_kinds, "fld6_event_errors": event_errors, "fld11_alias_errors": alias_errors,
    "txt12_type_escapes": type_escapes, "txt12_boolean_traps": boolean_traps, "agg39_marker_ages": old_markers, "txt12_layer_violations": layer_violations, "txt12_package_cycles": package_cycles,
    "src5_raw_notes": raw_notes, "src7_raw_glossary": raw_glossary, "src6_raw_pages": raw_pages, "fld24_translation_units": translation_units, "joi20_judged_translations": judged_translations,
}


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _lines_sql():
    """Code and comment of each line of the scripts, by the same cut into pieces as the library's."""
    text, family = "coalesce(text, '')", C.FAMILIES["c"]
    for old, new in SCRIPT:
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    ends, comment = r"regexp_replace(x, '[^\n]+', '', 'g')", "starts_with(x, '//') or starts_with(x, '/*')"
    quotes = " or ".join(f"starts_with(x, {_quoted(q)})" for q in family.quotes)
    return f"""t as (select doc_id, {text} as text from documents), p as (select doc_id, regexp_extract_all(text, {_quoted(C.piece_pattern(family).replace("*+", "*"))}) as pieces from t),
 m as (select doc_id, string_split(array_to_string(list_transform(pieces, lambda x: case when {comment} then {ends} when {quotes} then '''''' || {ends} else x end), ''), chr(10)) as code,
  string_split(array_to_string(list_transform(pieces, lambda x: case when {comment} then x else {ends} end), ''), chr(10)) as comment from p),
 l as (select doc_id, unnest(code) as code, unnest(comment) as comment, unnest(range(1, len(code) + 1)) as line from m)"""


CLAIMS = f"""b as (select o_orderkey as k, o_orderkey::varchar as path, c_mktsegment as domain, left(o_orderpriority, 1) as unit, (o_orderkey % 5)::varchar as blob from orders join customer on c_custkey = o_custkey),
 cl as (select *, case when k % 7 = 0 then 'missing' when k % 7 = 1 then 'stale' else 'fresh' end as status, case when k % 11 = 0 then []::varchar[] when k % 13 = 0 then [unit, '9'] when k % 17 = 0 then ['2'] when k % 7 = 0 and k % 3 > 0 then []::varchar[] else [unit] end as ls, case when k % 19 = 0 then 'old' else blob end as said from b),
 un as (select distinct domain, unit as slug from b where unit <> '5' and not (unit = '4' and domain = 'BUILDING') union all select 'BUILDING', '8' union all select distinct domain, unit from b where unit = '3' and domain = 'AUTOMOBILE'),
 rc as (select distinct l_orderkey as k from lineitem where l_returnflag <> 'R' and l_linestatus = 'O'),
 st as (select *, case when status = 'stale' then null when status = 'missing' then case when len(ls) > 0 then 'evidence-ledgers' end when len(ls) = 0 then 'evidence-ledgers' when k % 23 = 0 or ls <> [unit] then 'wrong-unit-ledger' when k % 29 = 0 or said <> blob then 'fresh-evidence' else 'ok' end as first from cl),
 ok as (select st.*, (select count(*) from un where un.domain = st.domain and un.slug = st.unit) as n, exists (select 1 from un where un.slug = st.unit) as elsewhere,
  unit = '2' and domain <> 'MACHINERY' or unit in ('3', '4', '5', '8') and domain not in ('MACHINERY', 'FURNITURE') as accepted, k in (select k from rc) as was_read from st where first = 'ok'),
 er as (select path, domain, case when first = 'wrong-unit-ledger' and k % 23 > 0 then unit end as slug, first as code from st where first <> 'ok'
  union all select path, domain, unit, case when n > 1 then 'ambiguous-ledger' when elsewhere then 'cross-domain-ledger' else 'unknown-ledger' end from ok where n <> 1
  union all select path, domain, null, 'fresh-evidence' from ok where not (n = 1 and accepted and was_read)
  union all select distinct null, domain, slug, 'unit-assignment' from un where not exists (select 1 from b where b.domain = un.domain and b.unit = un.slug and k % 23 > 0))"""
DECISIONS = """ob as (select c_custkey as id, 'u' || c_custkey % 4 as slug, 'd' || c_custkey % 2 as digest, c_custkey % 5 > 0 as exact from customer),
 oc as (select o_orderkey as id, o_orderkey % 97 as finding, 'u' || o_orderkey % 97 % 4 as ledger, o_custkey as obs, list_sort(list_distinct(['p' || o_orderkey % 50 || ':b' || o_orderkey % 3, 'p' || (o_orderkey + 1) % 50 || ':b' || (o_orderkey + 1) % 3])) as bs, list_sort(['p' || o_orderkey % 50, 'p' || (o_orderkey + 1) % 50]) as paths,
  o_orderkey % 3 > 0 as eligible, o_orderkey % 41 > 0 as ruled, 'd' || o_custkey % 2 as digest from orders),
 ev as (select case when event_id % 71 = 0 then event_id - 1 else event_id end as event, case when event_id % 8 = 1 then 'u0' else coalesce(oc.ledger, 'u1') end as ledger, case when event_id % 10 = 3 then -1 else coalesce(oc.finding, 5) end as finding, oc.id as occ,
  case when event_id % 9 = 4 then event_id % 500 + 1 when event_id % 9 = 5 then -5 else coalesce(oc.obs, 7) end as obs, case when event_id % 7 = 5 then ['p1:x'] else coalesce(oc.bs, []) end as bs, event_id % 11 = 2 as other, coalesce(oc.digest, 'd0') as digest
  from events left join oc on oc.id = event_id * 4 + case when event_id % 6 = 0 then 2000000000 else 1 end),
 kd as (select ev.*, case when oc.id is null then 'invalid' when eligible and ruled and not other and ev.obs = oc.obs and ev.bs = oc.bs then 'exact'
  when not eligible and ruled and not other and exists (select 1 from ob where ob.id = oc.obs and exact and ob.slug = oc.ledger and ob.digest = oc.digest) and exists (select 1 from ob where ob.id = ev.obs and exact and ob.slug = oc.ledger and ob.digest = oc.digest)
   and list_sort(list_distinct(list_transform(ev.bs, lambda x: string_split(x, ':')[1]))) = oc.paths then 'migration' else 'invalid' end as kind from ev left join oc on oc.id = ev.occ)"""
ESCAPES_SQL = " + ".join(f"len(regexp_extract_all(code, {_quoted(p)}))" for p in X.ESCAPES) + f" + len(regexp_extract_all(comment, {_quoted(X.IGNORES)}))"
LINKED = """pt as (select p_partkey as k, replace(p_brand, '#', '') || '/f' || p_partkey % 60 as path from part), e as (select distinct a.path as src, b.path as dst from lineitem join pt a on a.k = l_partkey join pt b on b.k = (l_suppkey * 7 + l_partkey) % 50 + 1 where l_orderkey % 3 = 0 and (a.path < b.path or l_partkey % 9 = 0))"""


def _reach(name, edges):
    return f"{name}(a, b) as (select src, dst from {edges} union select {name}.a, x.dst from {name} join {edges} x on x.src = {name}.b)"


TRANSLATED = """o as (select o_orderkey as k, o_orderstatus as domain from orders where o_orderkey % 2 = 0), f as (select l_orderkey as k, '{"fix":[1,' || l_linenumber % 2 || '],"title":"t' || l_partkey % 5 || '"}' as body from lineitem where l_orderkey % 2 = 0),
 g as (select k, list_sort(list(sha256(body || chr(10)))) as ds, count(*) as n from f group by k), u as (select k, domain, 'U' || k as title from o where k % 5 > 0), l as (select o.k, domain, case when k % 11 = 0 then 'V' else 'U' end || k as title, coalesce(n, 0) as n, coalesce(ds, []) as ds from o left join g using (k) where k % 7 > 0),
 j as (select coalesce(u.k, l.k) as k, coalesce(u.domain, l.domain) as domain, coalesce(l.title, u.title) as title, coalesce(n, 0) as n, coalesce(case when l.k % 37 > 0 then ds end, []) as ds, case when u.k % 31 = 0 then 'duplicate-unit' when u.title <> l.title then 'title-differs' when l.k % 37 = 0 and n > 0 then 'no-canonical-form' when len(list_distinct(ds)) < len(ds) then 'duplicate-findings' end as problem from u full join l using (k))"""

ORACLE_SQL = {
    "joi20_judged_translations": f"""with {TRANSLATED}, s as (select domain, k, n, k // 2 % 9 as c from j where problem is null), m as (select domain, k::varchar as slug, case when c = 0 or c = 6 then 'missing-unit' when k % 9 = 4 then 'duplicate-unit' when c = 5 then 'too-many-findings' when c = 4 and n = 0 then 'too-many-findings'
  when c = 7 then 'invalid-text' when c = 1 then 'stale-unit' when c = 4 then 'unknown-finding' when c = 3 and n > 0 then 'missing-finding' else 'verified' end as code from s)
 select * from m union all select domain, 'no' || k, 'unknown-unit' from s where c = 6""",
    "joi22_claim_errors": f"with {CLAIMS} select * from er",
    "fld4_report_state": f"with {CLAIMS} select case when count(*) > 0 then 'invalid' else 'current' end as state, case when count(*) > 0 then 'evidence' end as code, count(*) as errors from er",
    "joi30_context_kinds": f"with {DECISIONS} select event, kind, count(*) as n from kd group by all",
    "fld6_event_errors": f"""with {DECISIONS}, rv as (select distinct obs, unnest(bs) as b from oc), bd as (select event, obs, unnest(bs) as b from ev where obs in (select id from ob))
 select event, 'duplicate-event' as code from ev group by event having count(*) > 1 union all select distinct event, 'unknown-occurrence' from ev left join oc on oc.id = ev.occ where oc.id is null or oc.finding <> ev.finding
 union all select distinct event, 'wrong-ledger' from ev join oc on oc.id = ev.occ where oc.finding = ev.finding and oc.ledger <> ev.ledger union all select distinct event, 'unknown-observation' from ev where obs not in (select id from ob)
 union all select distinct event, 'unknown-binding' from bd where not exists (select 1 from rv where rv.obs = bd.obs and rv.b = bd.b) union all select distinct event, 'invalid-context' from kd where kind = 'invalid'""",
    "fld11_alias_errors": "select event_type as scheme, event_id % 701 as value, case when count(distinct event_id // 701 % 3) > 1 then 'conflicting' else 'duplicate' end as problem, count(distinct event_id // 701 % 3) as findings from events where event_id % 3 = 0 group by 1, 2 having count(*) > 1",
    "txt12_type_escapes": f"with {_lines_sql()} select doc_id, sum({ESCAPES_SQL}) as escapes from l group by doc_id having sum({ESCAPES_SQL}) >= 3",
    "txt12_boolean_traps": f"with {_lines_sql()} select doc_id, line, regexp_extract(code, {_quoted(X.FLAG)}, 1) as parameter from l where regexp_matches(code, {_quoted(X.FLAG)})",
    "agg39_marker_ages": f"""with {_lines_sql()}, k as (select doc_id, line, case when doc_id % 4 > 0 then (doc_id + line) * 37 % 400 end as age from l where regexp_matches(comment, {_quoted(X.MARKER)}))
 select doc_id, count(*) as markers, count(*) filter (age >= 180) as stale, count(*) filter (age < 180) as recent, count(*) filter (age is null) as unknown, date '2024-06-01' - max(age)::int as oldest from k group by doc_id""",
    "txt12_layer_violations": f"""with {LINKED}, n as (select src, dst, list_transform([src, dst], lambda p: case when starts_with(p, 'Brand1/') or starts_with(p, 'Brand2/') then 0 when starts_with(p, 'Brand3/') then 1 when starts_with(p, 'Brand4/') or p = 'Brand5/f1' then 2 end) as ls from e)
 select src, dst, ls[1] as from_layer, ls[2] as to_layer from n where ls[2] < ls[1]""",
    "txt12_package_cycles": f"""with recursive {LINKED}, s as (select src, dst from e where src <> dst), {_reach('r', 's')}, pe as (select distinct string_split(src, '/')[1] as src, string_split(dst, '/')[1] as dst from e), q as (select * from pe where src <> dst and src <> 'Brand5' and dst <> 'Brand5'), {_reach('w', 'q')}
 select 'module' as level, x.a as node, min(x.b) as cycle from r x join r y on y.a = x.b and y.b = x.a group by x.a union all select 'package', x.a, min(x.b) from w x join w y on y.a = x.b and y.b = x.a group by x.a""",
    "src5_raw_notes": """with d as (select doc_id as k, source, string_split(coalesce(text, ''), chr(10))[1] as first, sha1(coalesce(text, '')) as sha from documents),
 h as (select *, '---' || chr(13) || chr(10) || 'hash: ' || case when k % 3 > 0 then sha else '' end || chr(10) || 'anchor:  ' || chr(10) || 'bad line' || chr(10) || 'anchor: ' || case when k % 5 > 0 then 'c1 ' else '' end || chr(10) || 'dirty: ' || case when k % 2 = 0 then 'true' else 'yes' end || chr(10)
  || case k % 6 when 0 then 'order: ["b", 3, "a"]' || chr(10) when 1 then 'order: ["x"' || chr(10) else '' end || '---' || chr(10) as head from d)
 select case when k % 4 = 0 then source || '/' || k else source || '/' || k || '.ts' end as path, case when k % 4 = 0 then 'dir' else 'file' end as type, case when k % 4 = 0 then source || '/' || k || '/__dir__.md' else source || '/' || k || '.ts.md' end as file,
  case when k % 7 > 0 then case when k % 3 > 0 then sha else '' end end as hash, case when k % 7 > 0 and k % 5 > 0 then 'c1' end as anchor, k % 7 > 0 and k % 2 = 0 as dirty, null as stamped, case when k % 7 > 0 and k % 6 = 0 then 'b,a' end as reading_order,
  sha1(case when k % 7 > 0 then first else ' ' || head end) as body from h where k % 4 = 0 or k % 9 <> 1""",
    "src7_raw_glossary": """select doc_id, 1 as place, 'term' || doc_id as term, case when doc_id % 2 = 0 then 'a1|b2|c3' else '' end as aliases, 'defined as ' || lang || chr(10) || case when doc_id % 3 = 0 then chr(10) else '' end || chr(10) || 'more' as definition, case when doc_id % 3 = 0 then 'src/' || doc_id end as home from documents
 union all select doc_id, 2, 'second' || doc_id, '', '', null from documents union all select doc_id, 3, 'last', '', '', null from documents""",
    "src6_raw_pages": """select 'p' || doc_id as slug, case when doc_id % 5 > 0 and doc_id % 3 > 0 then 'T' || doc_id else 'p' || doc_id end as title, case when doc_id % 5 > 0 and doc_id % 2 = 0 then 'general' else 'dev' end as audience, case when doc_id % 5 > 0 then 'a,b' else '' end as sources,
 case when doc_id % 5 = 0 then null when doc_id % 4 = 0 then doc_id % 10 when doc_id % 4 = 1 then null when doc_id % 4 = 2 then 1.5 else 0 end::double as place, case when doc_id % 5 > 0 then 'C' end as chapter, null as sources_hash, case when doc_id % 5 > 0 then 'body' else '' end as body from documents""",
    "fld24_translation_units": f"""with {TRANSLATED}
 select domain, k::varchar as slug, title, n as findings, case when problem is null then sha256('{{"domain":"' || domain || '","findingDigests":[' || array_to_string(list_transform(ds, lambda x: '"' || x || '"'), ',') || '],"slug":"' || k || '","title":"' || title || '"}}' || chr(10)) end as source_digest, problem from j""",
}
