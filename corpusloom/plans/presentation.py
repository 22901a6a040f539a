"""Labels, filters, gates, prose lints, stamps and identities over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import prose as S
from corpusloom.operators import presentation as P
from corpusloom.operators.freshness import scope_hashes
from corpusloom.plans.freshness import INV, inventory
from corpusloom.sources import table

NAMES = ["Makefile", "a.test.TS", ".env.local", "yarn.lock", "README.md", "x.config.json", "tsconfig.base.json", "Dockerfile.dev", "notes.txt", "key.pem", ".ts", "agents.md", "data.json", "my-schema.json", "pnpm-workspace.yaml", "a.b"]
GLOBS = ["**", "**/**", "**/*", "a/**", "**/{*,.*}", "{*,.*}", "*", "**/@(*)", "a/**/**", "x/y.ts"]
STATES, KINDS, EVIDENCE = ["missing", "invalid", "stale", "current"], ["review", "unclassified", "conflict", "excluded", "review"], ["fresh", "missing", "stale", "invalid", None]


def _pick(values, index):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def hazards(spark, sf):
    k = F.col("p_partkey")
    path = F.concat(_pick(["", "src/", ".github/workflows/", ".Agents-src/", "a.b/"], k % 5), _pick(NAMES, k % 16))
    return table(spark, sf, "part").select("p_partkey", path.alias("path"), P.is_hazardous(path, _pick(["100644", None, "100755"], F.floor(k / 80) % 3), F.lit("100644")).alias("hazardous"))


def exclusions(spark, sf):
    k = F.col("p_partkey")
    glob = _pick(GLOBS, k % 10)
    include = F.array(glob, F.when(k % 4 == 0, F.lit("x/y.ts")).otherwise("x/z"))
    exact = P.is_exact_exclusion(F.lit("x/y.ts"), include, F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), _pick(["me", "", None], k % 7 % 3))
    return table(spark, sf, "part").select("p_partkey", P.has_magic(glob).alias("magic"), P.is_universal(glob).alias("universal"), exact.alias("exact"))


def finding_paths(spark, sf):
    k = F.col("event_id")
    place = lambda n: F.concat(F.lit("src/"), n.cast("string"), F.when(n % 3 == 0, F.concat(F.lit(":"), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("#f:"), n.cast("string"))).otherwise(":x"))
    found = P.finding_paths(F.when(k % 2 == 0, place(k)), F.when(k % 5 == 0, place(k + 1)), lists=[F.array(place(k + 2), F.lit(None).cast("string")), F.when(k % 3 == 0, F.array(place(k + 4)))])
    return table(spark, sf, "events").select("event_id", F.array_join(found, ",").alias("paths"))


def file_states(spark, sf):
    k = F.col("o_orderkey")
    state, kind, evidence = _pick(STATES, k % 4), _pick(KINDS, F.floor(k / 4) % 5), _pick(EVIDENCE, F.floor(k / 20) % 5)
    return table(spark, sf, "orders").select("o_orderkey", P.file_status(state, kind, F.when(k % 13 > 0, k % 17 > 0), evidence).alias("status"))


def labels(spark, sf):
    k = F.col("o_orderkey")
    n = lambda m: (F.floor(k / m) % 4).cast("long")
    state, highest = _pick(["invalid", "unknown", "gap", "fresh"], k % 4), _pick(["high", "low", None], k % 3)
    risk = P.risk_label(n(5), highest, n(7), n(11), "info")
    outcome = P.outcome_label(k % 19 > 0, k % 17 == 0, _pick(["unknown", "invalid", "gap", "fresh", "fresh", "fresh"], k % 6), n(5), highest, k % 2 == 0, _pick(["complete", "incomplete", None], F.floor(k / 3) % 3))
    return table(spark, sf, "orders").select("o_orderkey", P.coverage_label(state, n(3) + 5, n(3), n(5), n(7), n(11)).alias("coverage"), risk["kind"].alias("kind"), risk["label"].alias("risk"), outcome.alias("outcome"))


def searched(spark, sf):
    return P.found_paths(inventory(spark, sf).select("path"), " C1/E")


def options(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("option"))
    order = spark.createDataFrame([(i, o) for i, o in enumerate(["purchase", "nothing", "view", "signup", "kept"])], "place int, option string")
    return P.visible_options(e.where("option <> 'signup'"), spark.createDataFrame([("kept",), ("other",)], "option string"), order)


def gate(spark, sf):
    k = F.col("event_id")
    found = table(spark, sf, "events").select("event_id", F.col("event_type").alias("detector"), _pick(["a", "b", "c"], k % 3).alias("category"), _pick(["high", "low", None], k % 5 % 3).alias("severity"))
    return P.failing(found, ["view", "b", "high"]).select("event_id")


def cards(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("page"), F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("metric"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("path"), ((F.col("l_partkey") * 37 + F.col("l_orderkey")) % 401 - 200).cast("double").alias("z"))  # noqa: E741
    return P.card_rows(l, "page", 30)


def stamps(spark, sf):
    inv = inventory(spark, sf)
    files = inv.where("doc_id % 3 > 0").groupBy("source").agg(F.collect_list("path").alias("files"))
    hashes = scope_hashes(inv.where("doc_id % 3 > 0"), "source").select("source", F.col("hash").alias("scope_hash"))
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    gone = F.when(n % 5 == 1, F.concat("files", F.array(F.lit("gone")))).otherwise(F.col("files"))
    ledgers = files.join(hashes, "source").select(F.col("source").alias("slug"), gone.alias("files"), F.when(n % 4 == 2, F.lit("old")).otherwise(F.col("scope_hash")).alias("scope_hash"))
    names = spark.createDataFrame([(f"src{i}",) for i in range(0, 30, 2)] + [("src4",)], "slug string")
    return P.stamped_ledgers(ledgers, inv, names)


PROSE = [(". ", "。\n"), (", ", "、"), (" the ", "）、（"), (" of ", "\n三个步骤：甲、"), (" and ", "！"), (" in ", "\n- "), (" de ", "\n## "), (" is ", "\n见文末 "), (" for ", " 比如 "), (" y ", '\n<div class="callout" x>\n'), (" to ", "\n```mermaid\n")]


def prose(spark, sf):
    text = F.coalesce("text", F.lit(""))
    for old, new in PROSE:
        text = F.replace(text, F.lit(old), F.lit(new))
    d = table(spark, sf, "documents").select("doc_id", text.alias("body"))
    long = S.long_paragraphs(F.col("body"), 120, 2)
    return d.select(
        "doc_id", F.size(long).alias("long"), F.size(F.filter(long, lambda m: m["is_item"])).alias("items"), F.coalesce(F.array_max(F.transform(long, lambda m: m["chars"])), F.lit(0)).alias("longest"),
        F.size(S.lines_about_itself(F.col("body"))).alias("about"), F.size(S.hidden_lists(F.col("body"))).alias("lists"), S.is_flat(F.col("body"), 20, 15).alias("flat"),
    )


def repository_paths(spark, sf):
    k = F.col("o_orderkey")
    path = F.concat(_pick(["", "/", "a/", "C:/", "a\\", "../"], k % 6), k.cast("string"), _pick(["", "/..", "/.x", "/.", "//b", "/...", "/..a"], F.floor(k / 6) % 7))
    return table(spark, sf, "orders").select("o_orderkey", S.is_repository_path(path).alias("valid"))


def identities(spark, sf):
    e = table(spark, sf, "events")
    mark = S.fingerprint("finding/v1", F.lit("repo"), F.col("event_type"), F.col("user_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    return e.select("event_id", mark.alias("fingerprint"), S.finding_id("f_", mark).alias("finding"))


def anchor_texts(spark, sf):
    lines = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(" \t\n  \n ")), "\n", -1)
    k = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", S.anchor_text(lines, (k % 5 + 1).cast("int"), (k % 5 + k % 4).cast("int")).alias("anchor"))


QUERIES = {
    "prj8_hazards": hazards, "prj9_exclusions": exclusions, "prj7_finding_paths": finding_paths, "prj16_file_states": file_states, "prj17_labels": labels, "prj19_search": searched, "prj20_options": options, "prj24_gate": gate,
    "srt15_cards": cards, "fld18_stamps": stamps, "str20_prose": prose, "str4_repository_paths": repository_paths, "hsh5_identities": identities, "str25_anchor_texts": anchor_texts,
}


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _listed(values):
    return "[" + ", ".join("null" if v is None else _quoted(v) for v in values) + "]"


def _in(values):
    return ", ".join(map(_quoted, values))


_TEXT = "coalesce(text, '')"
for _old, _new in PROSE:
    _TEXT = f"replace({_TEXT}, {_quoted(_old)}, {_quoted(_new)})"

ORACLE_SQL = {
    "prj8_hazards": f"""with p as (select p_partkey, (['', 'src/', '.github/workflows/', '.Agents-src/', 'a.b/'])[p_partkey % 5 + 1] || ({_listed(NAMES)})[p_partkey % 16 + 1] as path, p_partkey // 80 % 3 = 2 as runs from part), b as (select *, lower(path) as low, string_split(lower(path), '/')[-1] as base from p),
 x as (select *, case when strpos(substr(base, 2), '.') > 0 then '.' || string_split(base, '.')[-1] else '' end as ext from b)
 select p_partkey, path, runs or base not in ({_in(P.LOCKFILES)}) and (base = '.env' or starts_with(base, '.env.') or starts_with(low, '.agents-src/') or starts_with(low, '.github/workflows/') or ext not in ('.md', '.mdx') and (base in ({_in(P.OPERATIONAL)}) or base = 'dockerfile.dev' or base in ('tsconfig.base.json', 'x.config.json', 'my-schema.json') or ext in ({_in(P.RISKY_ENDINGS)}))) as hazardous from x""",
    "prj9_exclusions": f"""with g as (select p_partkey as k, ({_listed(GLOBS)})[p_partkey % 10 + 1] as g from part) select k as p_partkey, g <> 'x/y.ts' as magic, g in ('**', '**/**', '**/*', '**/{{*,.*}}', '{{*,.*}}', '**/@(*)') as universal, k % 7 % 3 = 0 and k % 3 <> 0 and (g = 'x/y.ts' or k % 4 = 0) as exact from g""",
    "prj7_finding_paths": """select event_id, array_to_string(list_filter([case when event_id % 2 = 0 then 'src/' || event_id || case when event_id % 3 = 2 then ':x' else '' end end, case when event_id % 5 = 0 then 'src/' || (event_id + 1) || case when (event_id + 1) % 3 = 2 then ':x' else '' end end,
 'src/' || (event_id + 2) || case when (event_id + 2) % 3 = 2 then ':x' else '' end, case when event_id % 3 = 0 then 'src/' || (event_id + 4) || case when (event_id + 4) % 3 = 2 then ':x' else '' end end], lambda x: x is not null), ',') as paths from events""",
    "prj16_file_states": f"""with s as (select o_orderkey as k, ({_listed(STATES)})[o_orderkey % 4 + 1] as s, ({_listed(KINDS)})[o_orderkey // 4 % 5 + 1] as c, ({_listed(EVIDENCE)})[o_orderkey // 20 % 5 + 1] as e from orders)
 select k as o_orderkey, case when s in ('missing', 'invalid') then 'unknown' when c in ('unclassified', 'conflict') then c when c = 'excluded' or k % 13 = 0 or k % 17 = 0 then 'unknown' when s = 'stale' and (e is null or e = 'fresh') then 'stale' else coalesce(e, 'missing') end as status from s""",
    "prj17_labels": """with n as (select o_orderkey as k, o_orderkey // 3 % 4 as a, o_orderkey // 5 % 4 as b, o_orderkey // 7 % 4 as c, o_orderkey // 11 % 4 as d, (['high', 'low', null])[o_orderkey % 3 + 1] as h, (['unknown', 'invalid', 'gap', 'fresh', 'fresh', 'fresh'])[o_orderkey % 6 + 1] as v from orders),
 p as (select *, array_to_string(list_filter([case when b > 0 then b || ' missing' end, case when c > 0 then c || ' stale' end, case when d > 0 then d || ' invalid' end], lambda x: x is not null), ', ') as gaps, array_to_string(list_filter([case when c > 0 then c || ' accepted risk' end, case when d > 0 then d || ' separate design' end], lambda x: x is not null), ', ') as kept from n)
 select k as o_orderkey, case k % 4 when 0 then case when d > 0 then d || ' invalid evidence' else 'invalid coverage' end when 1 then 'coverage unknown' when 2 then case when gaps = '' then '5 coverage gaps' else gaps end else a || '/' || (a + 5) || ' fresh' end as coverage,
 case when b > 0 then 'open' when kept <> '' then 'retained' else 'none' end as kind, case when b = 1 then '1 open (' || coalesce(h, 'info') || ')' when b > 1 then b || ' open (highest ' || coalesce(h, 'info') || ')' when kept <> '' then kept else 'No open findings recorded' end as risk,
 case when k % 19 = 0 then 'No completed audit evidence' when k % 17 = 0 then 'Stale audit evidence — re-audit needed' when v = 'unknown' then 'Coverage has not been established' when v = 'invalid' then 'Coverage invalid for this unit' when v = 'gap' then 'Coverage incomplete for this unit'
  when b > 0 then b || ' open findings' || coalesce(' (highest ' || h || ')', '') when k // 3 % 3 = 0 and k % 2 = 0 then 'No actionable findings' else 'Recorded audit evidence' end as outcome from p""",
    "prj19_search": f"with {INV} select path from inv where contains(lower(path), 'c1/e')",
    "prj20_options": "select option, place from (values (0, 'purchase'), (1, 'nothing'), (2, 'view'), (3, 'signup'), (4, 'kept')) t(place, option) where option in (select event_type from events where event_type <> 'signup') or option = 'kept'",
    "prj24_gate": "select event_id from events where event_type = 'view' or event_id % 3 = 1 or event_id % 5 % 3 = 0",
    "srt15_cards": "with l as (select l_suppkey % 5 as page, 'm' || l_linenumber % 3 as metric, l_orderkey || '-' || l_linenumber || '-' || l_partkey as path, ((l_partkey * 37 + l_orderkey) % 401 - 200)::double as z from lineitem) select *, row_number() over (partition by page order by abs(z) desc, metric, path, z) as rank from l qualify rank <= 30",
    "fld18_stamps": f"""with {INV}, s as (select distinct source as slug, regexp_extract(source, '([0-9]+)', 1)::int as n from inv where doc_id % 3 > 0), w as (select distinct 'src' || i as slug from range(0, 30, 2) t(i))
 select slug, case when n is null then 'not-found' when n % 5 = 1 or n % 4 = 2 then 'drifted' else 'stamped' end as result from w left join s using (slug)""",
    "str20_prose": f"""with t as (select doc_id, {_TEXT} as body from documents), o as (select doc_id, body, string_split(body, {_quoted(S.CALLOUT)})[1] as own from t),
 u as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(own, '```[\\s\\S]*?```', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) as t from o), b as (select doc_id, regexp_matches(t, {_quoted(S.ITEM)}) as item, case when regexp_matches(t, {_quoted(S.ITEM)}) then regexp_replace(t, {_quoted(S.ITEM + "+")}, '') else t end as t from u where not regexp_matches(t, {_quoted(S.NO_PARAGRAPH)})),
 g as (select doc_id, count(*) as n, count(*) filter (item) as items, max(length(t)) as longest from b where length(t) > 120 or len(regexp_extract_all(t, {_quoted(S.SENTENCE_END)})) > 2 group by doc_id),
 w as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(body, '```[\\s\\S]*?```', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) as t from t),
 a as (select doc_id, count(*) filter (regexp_matches(t, {_quoted(S.ABOUT_ITSELF)})) as about, count(*) filter (not regexp_matches(t, {_quoted(S.NO_LINE)}) and (regexp_matches(t, {_quoted(S.LISTED)}) or (not regexp_matches(t, {_quoted(S.EXAMPLES)}) and len(regexp_extract_all(t, '）、')) >= 2))) as lists from w group by doc_id),
 ln as (select doc_id, unnest(string_split(own, chr(10))) as l, unnest(range(1, len(string_split(own, chr(10))) + 1)) as i from o), hd as (select doc_id, i, regexp_matches(l, '^#{{2,4}} ')::int as h from ln), se as (select doc_id, h, sum(h) over (partition by doc_id order by i) as s from hd), sz as (select doc_id, s, count(*) filter (h = 0) as k, max(h) as h, count(*) as c from se group by doc_id, s),
 fl as (select doc_id, sum(c) as n, sum(h) as heads, max(k) as most from sz group by doc_id)
 select t.doc_id, coalesce(g.n, 0) as long, coalesce(items, 0) as items, coalesce(longest, 0) as longest, coalesce(about, 0) as about, coalesce(lists, 0) as lists, (contains(body, '```mermaid') or fl.n > 15) and (heads <= 2 or most > 20) as flat from t left join g using (doc_id) left join a using (doc_id) left join fl using (doc_id)""",
    "str4_repository_paths": "select o_orderkey, o_orderkey % 6 in (0, 2) and o_orderkey // 6 % 7 not in (1, 3, 4) as valid from orders",
    "hsh5_identities": """with f as (select event_id, 'finding/v1:sha256:' || sha256('finding/v1' || chr(0) || 'repo' || chr(0) || event_type || chr(0) || user_id || chr(0) || case when event_id % 3 = 0 then event_id::varchar else '' end) as fingerprint from events) select event_id, fingerprint, 'f_' || substr(sha256(fingerprint), 1, 24) as finding from f""",
    "str25_anchor_texts": """with l as (select doc_id, string_split(replace(coalesce(text, ''), '. ', ' ' || chr(9) || chr(10) || '  ' || chr(10) || ' '), chr(10)) as ls from documents)
 select doc_id, array_to_string(list_filter(list_transform(ls[doc_id % 5 + 1:doc_id % 5 + doc_id % 4], lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> ''), chr(10)) as anchor from l""",
}
