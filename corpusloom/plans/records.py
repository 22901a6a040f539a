"""Records of tools and the whole state, over ``documents``, ``orders``, ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import wholestate as W
from corpusloom.plans.freshness import INV, inventory
from corpusloom.sources import records as R
from corpusloom.sources import table


def _pick(values, index):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def _tracked(spark, sf):
    """Index lines of the inventory's files: some repeated, unmerged, of odd modes, short, unsafe or malformed, some that differ in case or composition only."""
    k, inv = F.col("doc_id"), inventory(spark, sf)
    path = F.when(k % 31 == 7, F.concat(F.lit("../"), "path")).when(k % 29 == 3, F.concat(F.lit("dup/"), F.floor(k / 58))).when(k % 23 == 5, F.concat(F.lit("Case/"), F.floor(k / 46), F.when(F.floor(k / 23) % 2 == 0, "É").otherwise("é"))).otherwise(F.col("path"))
    mode = _pick(["100644", "100755", "100644", "120000", "100644", "160000", "100644"], F.when(k % 13 == 1, k % 7).otherwise(0))
    record = F.concat(mode, F.lit(" "), F.when(k % 17 == 4, F.substring("blob", 1, 39)).otherwise(F.col("blob")), F.lit(" "), F.when(k % 19 == 6, k % 3 + 1).otherwise(0).cast("string"), F.when(k % 37 == 9, " ").otherwise("\t"), path)
    there = inv.where("doc_id % 11 > 0").select("path", F.when(k % 5 == 2, F.sha1("blob")).otherwise(F.col("blob")).alias("blob"), F.when(k % 41 == 8, "100755").otherwise("100644").alias("mode"))
    return R.tracked_files(inv.select(k.alias("place"), record.alias("record")), there)


def tracked_files(spark, sf):
    return _tracked(spark, sf)[0]


def tracked_problems(spark, sf):
    return _tracked(spark, sf)[1].groupBy("path", "code").agg(F.count("*").alias("n"))


def diff_lines(spark, sf):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, F.concat_ws("\t", F.concat(F.lit("R"), F.lpad((k % 100).cast("string"), 3, "0")), F.concat(F.lit("old/"), k), F.concat(F.lit("new name/"), k))).when(k % 4 == 1, F.concat_ws("\t", F.lit("M"), k)).when(k % 4 == 2, F.concat_ws("\t", k % 50, k % 7, F.concat(F.lit("f"), k))).otherwise(F.concat_ws("\t", F.lit("-"), F.lit("-"), k))
    lines = table(spark, sf, "orders").select((k % 9).alias("anchor"), line.alias("line"))
    r, s = R.renames(lines), R.sizes(lines)
    return r.select("anchor", "source", "target", "similarity", F.lit(None).cast("long").alias("added"), F.lit(None).cast("long").alias("removed")).unionByName(s.select("anchor", F.lit(None).cast("string").alias("source"), F.col("path").alias("target"), F.lit(None).cast("int").alias("similarity"), "added", "removed"))


def dirty_paths(spark, sf):
    k = F.col("o_orderkey")
    entry = F.concat(_pick([" M", "R ", "??", "C ", "A "], k % 5), F.lit(" a/"), k, F.when(k % 5 == 1, F.concat(F.lit("\0Ra/"), k)).when(k % 5 == 3, F.concat(F.lit("\0a/"), k - 1)).otherwise(""), F.lit("\0"))
    raw = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("c")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(k, entry.alias("e"))))["e"], "").alias("raw"))
    return raw.select("c", F.explode(R.dirty_paths(F.col("raw"))).alias("path"))


def ingested(spark, sf):
    """Reports of three kinds, one of each for every order, made of its lines."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    finding = text('{"path":"', _pick(["src/a", "../x", "b", ""], (k + n) % 4), '","line":', n, ',"category":"', _pick(["dead-code", "other", "magic"], (k + n) % 3), '","title":"', F.when(n % 5 == 0, " ").otherwise("t"), '","evidence":"e"', F.when(n % 2 == 0, ',"detector":"d"').otherwise(""), "}")
    message = text('{"ruleId":', F.when(n % 3 == 0, "null").otherwise(text('"', _pick(["no-any", "semi"], (k + n) % 2), '"')), ',"line":', n, ',"message":"m"}')
    export = text('{"symbol":"s', n, '","line":', n, "}")
    by = l.where("l_orderkey % 4 = 0").groupBy(k.alias("k")).agg(*[F.array_join(F.collect_list(e), ",").alias(c) for c, e in (("f", finding), ("m", message), ("e", export))])
    k = F.col("k")
    generic = by.select(k.alias("report"), text("{", F.when(k % 8 == 0, '"tool":"mine",').otherwise(""), '"findings":[', F.col("f"), "]}").alias("text"))
    lint = by.select(k.alias("report"), text('[{"filePath":"', F.when(k % 12 == 0, "/other/a.ts").otherwise("/repo/src/a.ts"), '","messages":[', F.col("m"), "]}]").alias("text"))
    unused = by.select(k.alias("report"), text('{"files":["o', k, '.ts"', F.when(k % 8 == 0, ',"/abs"').otherwise(""), '],"issues":[{"file":"a.ts","exports":[', F.col("e"), '],"types":[{"symbol":"T"}]}]}').alias("text"))
    found = R.generic_findings(generic, ["dead-code", "magic"]).withColumn("kind", F.lit("generic")).unionByName(R.lint_findings(lint, "/repo", {"no-any": "type-escape"}).withColumn("kind", F.lit("lint"))).unionByName(R.unused_findings(unused).withColumn("kind", F.lit("unused")))
    return found.groupBy("kind", "detector", "category", "path", "kept").agg(F.count("*").alias("n"), F.coalesce(F.sum("line"), F.lit(0)).alias("lines"))


def legacy_scans(spark, sf):
    """Twenty documents are the scans of one ledger; some scans are unsound, so their ledgers are not taken."""
    k = F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    path = F.when(k % 97 == 5, "../x").when(k % 79 < 2, text("same/", F.floor(k / 20))).otherwise(F.col("path"))
    scan = text('{"path":"', path, '","git_blob_sha1":"', F.when(k % 89 == 7, "abc").otherwise(F.col("blob")), '","finding_count":', F.when(k % 83 == 3, "1.5").otherwise((k % 4).cast("string")), F.when(k % 3 == 0, ',"scanned_at":"2024-01-0').otherwise(',"x":"'), k % 9 + 1, '"}')
    made = inventory(spark, sf).select(F.floor(k / 20).alias("slug"), k.alias("k"), scan.alias("scan")).groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "scan")))["scan"], ",").alias("scans"))
    ledgers = made.select("slug", F.when(F.col("slug") % 13 == 12, "{}").otherwise(text('{"scans":[', F.col("scans"), "]}")).alias("text"))
    return R.legacy_scans(ledgers)[0]


def rated(spark, sf):
    """Orders as raters, whose cells are made of their lines."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    cell = F.when(F.col("l_linenumber") % 5 == 4, "x").when(F.col("l_quantity") % 7 == 0, "0").otherwise((F.col("l_quantity") % 7).cast("string"))
    rows = l.groupBy(F.col("l_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", cell.alias("cell"))))["cell"].alias("cells")).select((F.col("l_orderkey") % 3).alias("set"), "cells")
    found = R.rated_snippets(rows, "set", F.col("cells"), skip=1, low=1, high=5, least=3)
    return found.withColumn("mean", F.round("mean", 6))


def _entries(spark, sf):
    k = F.col("o_orderkey")
    status = lambda m: _pick(["fresh", "missing", "stale", "invalid", "odd"], F.floor(k / m) % 5)
    domains = F.map_filter(F.create_map(F.lit("security"), F.when(k % 3 > 0, status(2)).otherwise("none"), F.lit("test"), F.when(k % 4 > 0, status(7)).otherwise("none")), lambda d, s: s != "none")
    return table(spark, sf, "orders").select(k.alias("path"), _pick(["review", "review", "excluded", "review", "unclassified", "conflict", "review"], k % 7).alias("kind"), domains.alias("domains"))


def counters(spark, sf):
    made = W.coverage_counters(_entries(spark, sf), table(spark, sf, "nation").where("n_regionkey = 1"))
    read = W.coverage_counters(_entries(spark, sf), table(spark, sf, "nation").where("n_regionkey = 1"), unknown_is_missing=False)
    return made.withColumn("at", F.lit("made")).unionByName(read.withColumn("at", F.lit("read")))


def severities(spark, sf):
    found = table(spark, sf, "lineitem").select(F.concat(F.lit("d"), F.col("l_suppkey") % 6).alias("domain"), _pick(["high", "low", "critical", "odd", "medium"], (F.col("l_partkey") + F.col("l_suppkey") % 6) % 5).alias("severity"), (F.col("l_linenumber") > 3).alias("open"))
    return W.open_by_severity(found, ["critical", "high", "medium", "low"]).withColumn("counts", F.to_json("counts"))


def totals(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("unit"), F.when(F.col("l_linenumber") > 2, F.when(F.col("l_orderkey") % 50 == 7, F.lit(9_000_000_000_000_000)).otherwise(F.col("l_partkey"))).alias("count"))
    return W.finding_total(rows, "unit")


def whole_gate(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("area"), F.concat(F.lit("c"), F.col("event_id") % 4).alias("code"))
    allowed = spark.createDataFrame([("view", f"c{i}") for i in range(4)] + [("click", "c1"), ("click", "c1")], "area string, code string")
    return W.gate(e, ["view", "click", "nothing"], allowed)


QUERIES = {
    "src4_tracked_files": tracked_files, "src4_tracked_problems": tracked_problems, "src22_diff_lines": diff_lines, "str22_dirty_paths": dirty_paths, "src19_ingested": ingested, "src21_rated_snippets": rated, "src18_legacy_scans": legacy_scans,
    "agg16_counters": counters, "agg22_severities": severities, "agg25_totals": totals, "fld15_gate": whole_gate,
}

TRACKED = f"""{INV}, r as (select doc_id as k, path as own, blob, case when doc_id % 31 = 7 then '../' || path when doc_id % 29 = 3 then 'dup/' || doc_id // 58 when doc_id % 23 = 5 then 'Case/' || doc_id // 46 || case when doc_id // 23 % 2 = 0 then chr(201) else 'e' || chr(769) end else path end as path,
  case when doc_id % 13 = 1 then (['100644', '100755', '100644', '120000', '100644', '160000', '100644'])[doc_id % 7 + 1] else '100644' end as mode, doc_id % 17 = 4 as short, doc_id % 19 = 6 as unmerged, doc_id % 37 = 9 as bad from inv),
 ok as (select *, row_number() over (partition by path order by k) as nth, case when starts_with(path, 'Case/') then split_part(path, '/', 2) end as c from r where not bad and k % 31 <> 7),
 f1 as (select *, case when c is not null then 'case/' || regexp_extract(c, '^([0-9]+)', 1) else lower(path) end as folded, case when unmerged then 'unmerged-entry' when short then 'invalid-object' when mode not in ('100644', '100755') then 'irregular-mode' end as problem from ok where nth = 1),
 th as (select path, case when doc_id % 5 = 2 then sha1(blob) else blob end as current_blob, case when doc_id % 41 = 8 then '100755' else '100644' end as current_mode from inv where doc_id % 11 > 0),
 fs as (select f1.path, blob as index_blob, current_blob, mode as index_mode, current_mode, current_blob is null as deleted from f1 left join th on th.path = f1.path where problem is null)"""
LINES = """l as (select l_orderkey as k, l_linenumber as n from lineitem where l_orderkey % 4 = 0)"""

ORACLE_SQL = {
    "src18_legacy_scans": f"""with {INV}, d as (select doc_id // 20 as slug, doc_id as k, blob, case when doc_id % 97 = 5 then '../x' when doc_id % 79 < 2 then 'same/' || doc_id // 20 else path end as path from inv where doc_id // 20 % 13 <> 12),
 n as (select *, row_number() over (partition by slug order by k) as at_, row_number() over (partition by slug, path order by k) as nth from d), w as (select *, case when k % 97 = 5 then 'path' when k % 89 = 7 then 'blob' when k % 83 = 3 then 'count' when nth > 1 then 'duplicate' end as wrong from n),
 g as (select slug, arg_min(at_ || ':' || wrong, at_) filter (wrong is not null) as problem, count(*) as files, sum(k % 4) as findings, sha1(string_agg(blob || '  ' || path, chr(10) order by blob || '  ' || path) || chr(10)) as h, max(case when k % 3 = 0 then '2024-01-0' || (k % 9 + 1) end) as scanned from w group by slug)
 select slug, case when problem is null then files end as files, case when problem is null then findings end as findings, case when problem is null then h end as scope_hash, case when problem is null then scanned end as scanned_at, problem from g
 union all select distinct doc_id // 20, null, null, null, null, 'no-scans' from documents where doc_id // 20 % 13 = 12""",
    "src4_tracked_files": f"with {TRACKED} select * from fs",
    "src4_tracked_problems": f"""with {TRACKED}, p as (select null as path, 'malformed-record' as code from r where bad union all select null, 'invalid-path' from r where not bad and k % 31 = 7 union all select path, 'duplicate-path' from ok where nth > 1
  union all select path, 'path-collision' from (select path, arg_min(path, k) over (partition by folded) as owner from f1) where owner <> path union all select path, problem from f1 where problem is not null union all select path, 'mode-drift' from fs where current_mode <> index_mode union all select path, 'deleted' from fs where deleted)
 select path, code, count(*) as n from p group by all""",
    "src22_diff_lines": """select o_orderkey % 9 as anchor, case when o_orderkey % 4 = 0 then 'old/' || o_orderkey end as source, case o_orderkey % 4 when 0 then 'new name/' || o_orderkey when 2 then 'f' || o_orderkey else o_orderkey::varchar end as target, case when o_orderkey % 4 = 0 then (o_orderkey % 100)::int end as similarity,
 case o_orderkey % 4 when 2 then o_orderkey % 50 when 3 then 0 end as added, case o_orderkey % 4 when 2 then o_orderkey % 7 when 3 then 0 end as removed from orders where o_orderkey % 4 <> 1""",
    "str22_dirty_paths": "select distinct o_custkey % 100 as c, unnest(list_filter(['a/' || o_orderkey, case o_orderkey % 5 when 1 then 'Ra/' || o_orderkey when 3 then 'a/' || (o_orderkey - 1) end], lambda x: x is not null)) as path from orders",
    "src19_ingested": f"""with {LINES}, g as (select 'generic' as kind, case when k % 8 = 0 then 'mine' else 'external' end || case when n % 2 = 0 then ':d' else '' end as detector, (['dead-code', 'other', 'magic'])[(k + n) % 3 + 1] as category, (['src/a', '../x', 'b', ''])[(k + n) % 4 + 1] as path, (k + n) % 4 in (0, 2) and (k + n) % 3 <> 1 and n % 5 <> 0 as kept, n as line from l),
 e as (select 'lint', case when n % 3 = 0 then null else 'eslint:' || (['no-any', 'semi'])[(k + n) % 2 + 1] end, case when n % 3 <> 0 and (k + n) % 2 = 0 then 'type-escape' end, case when k % 12 = 0 then '/other/a.ts' else 'src/a.ts' end, n % 3 <> 0 and (k + n) % 2 = 0 and k % 12 <> 0, n from l),
 o as (select distinct k from l), u as (select 'unused', 'knip:files', 'dead-code', unnest(case when k % 8 = 0 then ['o' || k || '.ts', '/abs'] else ['o' || k || '.ts'] end) as p, null::int as line from o),
 a as (select * from g union all select * from e union all select 'unused', 'knip:files', 'dead-code', p, p <> '/abs', null from u union all select 'unused', 'knip:exports', 'dead-code', 'a.ts', true, n from l union all select 'unused', 'knip:types', 'dead-code', 'a.ts', true, null from o)
 select kind, detector, category, path, kept, count(*) as n, coalesce(sum(line), 0) as lines from a group by all""",
    "src21_rated_snippets": """with c as (select l_orderkey, case when l_linenumber % 5 = 4 then null else l_quantity % 7 end as v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as pos from lineitem)
 select l_orderkey % 3 as "set", pos as snippet, count(*) as n, round(avg(v), 6) as mean from c where pos >= 1 and v between 1 and 5 group by all having count(*) >= 3""",
    "agg16_counters": """with e as (select o_orderkey as k, (['review', 'review', 'excluded', 'review', 'unclassified', 'conflict', 'review'])[o_orderkey % 7 + 1] as kind, o_orderkey % 3 > 0 as s, o_orderkey % 4 > 0 as t, (['fresh', 'missing', 'stale', 'invalid', 'odd'])[o_orderkey // 2 % 5 + 1] as ss, (['fresh', 'missing', 'stale', 'invalid', 'odd'])[o_orderkey // 7 % 5 + 1] as ts from orders), m as (select unnest(['made', 'read']) as who)
 select who as "at", count(*) as tracked, """ + ", ".join(f"count(*) filter (kind = 'review' and {f}) as {d}_required, " + ", ".join(f"count(*) filter (kind = 'review' and {f} and ({f}s = '{x}'" + (f" or who = 'made' and {f}s = 'odd'" if x == "missing" else "") + f")) as {d}_{x}" for x in W.STATUSES) for d, f in (("security", "s"), ("test", "t"))) + """,
 count(*) filter (kind = 'review' and s and t) as dual_required, count(*) filter (kind = 'excluded') as excluded, count(*) filter (kind = 'unclassified') as unclassified, count(*) filter (kind = 'conflict') as conflicted, (select count(*) from nation where n_regionkey = 1) as invalid_ledgers from e, m group by who""",
    "agg22_severities": """with f as (select 'd' || l_suppkey % 6 as domain, (['high', 'low', 'critical', 'odd', 'medium'])[(l_partkey + l_suppkey % 6) % 5 + 1] as severity from lineitem where l_linenumber > 3), g as (select domain, severity, count(*) as n, list_position(['critical', 'high', 'medium', 'low', 'odd'], severity) as r from f group by all)
 select domain, sum(n) as open, arg_min(severity, r) as highest, '{' || string_agg('"' || severity || '":' || n, ',' order by r) || '}' as counts from g group by domain""",
    "agg25_totals": "with r as (select l_orderkey % 50 as unit, case when l_linenumber > 2 then case when l_orderkey % 50 = 7 then 9000000000000000 else l_partkey end else 1 end::hugeint as c from lineitem) select unit, case when sum(c) <= 9007199254740991 then sum(c)::bigint end as findings, sum(c) > 9007199254740991 as overflow from r group by unit",
    "fld15_gate": """with a as (select unnest(['view', 'click', 'nothing']) as area), c as (select a.area, count(e.event_id) as errors from a left join events e on e.event_type = a.area and a.area <> 'view' and not (a.area = 'click' and e.event_id % 4 = 1) group by a.area), b as (select * from c union all select 'all', sum(errors) from c) select area, errors, errors = 0 as passes from b""",
}
