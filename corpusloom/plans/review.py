"""Review queries: orders stand for findings and files, lineitem for their locations and receipts, customer and part for units."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import review as O
from corpusloom.sources import table

SEVERITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _findings(spark, sf):
    """Each order is a finding of one of fifty units; its status is its disposition, its customer's number its fingerprint."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.concat(F.lit("u"), (F.col("o_custkey") % 50).cast("string")).alias("slug"), F.col("o_orderpriority").alias("severity"),
        F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("t"), (k % 97).cast("string"))).alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("fingerprint"),
        F.when(k % 3 == 0, k % 5).alias("n"), F.col("o_orderdate").alias("at"))


FINDINGS = """findings as (select o_orderkey as id, 'u' || (o_custkey % 50) as slug, o_orderpriority as severity, case when o_orderkey % 41 = 0 then '' else 't' || (o_orderkey % 97) end as title,
 o_orderstatus as status, o_custkey as fingerprint, case when o_orderkey % 3 = 0 then o_orderkey % 5 end as n, o_orderdate as "at" from orders)"""


def _locations(spark, sf):
    """Each line is a location of its order's finding: a part as the path, its supplier as the blob."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_suppkey").alias("blob"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))


LOCATIONS = "locations as (select l_orderkey as id, 'p' || l_partkey as path, l_suppkey as blob, l_linenumber as line, l_returnflag as flag from lineitem)"


def _inventory(spark, sf):
    return table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("blob"))


INVENTORY = "inventory as (select 'p' || p_partkey as path, p_size::bigint as blob from part where p_partkey % 7 <> 0)"


def _with_paths(spark, sf):
    """Findings with the list of their paths; an order has few lines."""
    paths = _locations(spark, sf).groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return _findings(spark, sf).join(paths, "id")


WITH_PATHS = f"{FINDINGS}, {LOCATIONS}, withpaths as (select f.*, paths from findings f join (select id, list_sort(list_distinct(list(path))) as paths from locations group by id) using (id))"


def joi19_partial_units(spark, sf):
    f = _findings(spark, sf)
    owned = f.where("status <> 'P'").select(F.col("slug").alias("unit"), F.col("id").cast("string").alias("path"))
    seen = f.where((F.col("id") % 4 != 0) & (F.col("fingerprint") % 50 < 20)).select(F.col("slug").alias("unit"), F.col("id").cast("string").alias("path"))
    return O.partial_units(owned, seen).withColumn("first", F.array_join("first", ","))


def joi23_unit_ownership(spark, sf):
    claims = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("domain"), F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("unit"))
    units = table(spark, sf, "supplier").where("s_nationkey % 4 <> 0").select(F.when(F.col("s_nationkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("domain"), F.concat(F.lit("u"), F.col("s_nationkey").cast("string")).alias("unit"))
    return O.ownership_errors(claims, units)


def joi24_classification_mismatch(spark, sf):
    d = table(spark, sf, "documents")
    rules = lambda a, b: F.array(F.concat(F.lit("l-"), a), F.concat(F.lit("s-"), b))
    reported = d.where("doc_id % 11 <> 1").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 6 == 0, F.array(F.concat(F.lit("l-"), "lang"))).otherwise(rules(F.col("lang"), F.col("source"))).alias("rules"), F.when(F.col("doc_id") % 9 == 0, "excluded").otherwise("review").alias("kind"))
    expected = d.where("doc_id % 13 <> 1").select(F.col("doc_id").alias("path"), F.reverse(rules(F.col("lang"), F.col("source"))).alias("rules"), F.lit("review").alias("kind"))
    return O.classification_mismatch(reported, expected)


def joi25_scope_status(spark, sf):
    parts = table(spark, sf, "part")
    scope = parts.where("p_partkey % 50 < 10 or p_partkey % 7 <> 0").select(
        F.concat(F.lit("u"), (F.col("p_partkey") % 50).cast("string")).alias("slug"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"),
        F.when(F.col("p_partkey") % 50 < 5, F.lit(None).cast("long")).when(F.col("p_partkey") % 50 < 30, F.col("p_size")).otherwise(F.col("p_size") + F.col("p_partkey") % 2).alias("blob"))
    f = _with_paths(spark, sf).select(F.concat(F.lit("u"), (F.col("id") % 50).cast("string")).alias("slug"), "id", "paths", F.coalesce("n", F.lit(1)).alias("n"))
    # A finding of a unit lies in that unit's files: parts are dealt by number, so shift each path to the unit.
    near = F.transform("paths", lambda p: F.concat(F.lit("p"), (F.floor(F.substring(p, 2, 20).cast("long") / 50) * 50 + F.col("id") % 50).cast("string")))
    return O.scope_status(scope, _inventory(spark, sf), f.withColumn("paths", near))


def joi26_accepted_ledgers(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("blob"), (F.col("p_partkey") % 300).alias("g"), F.col("p_partkey").alias("k"))
    claims = p.select("path", F.when(F.col("k") % 8 != 0, F.col("blob")).alias("blob"), F.when(F.col("k") % 5 == 0, "fresh").otherwise("stale").alias("status"), F.array(F.concat(F.lit("u"), F.col("g").cast("string")), F.concat(F.lit("u"), (F.col("g") + 1).cast("string"))).alias("ledgers"))
    held = p.select(F.concat(F.lit("u"), F.col("g").cast("string")).alias("slug"), "path", F.when(F.col("k") % 3 == 0, F.col("blob")).otherwise(F.col("blob") + 1).alias("blob"), (F.col("g") % 4 == 0).alias("stale"))
    return O.accepted_ledgers(claims, held)


def joi27_registered_units(spark, sf):
    a = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("title"))
    b = table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_name").alias("title"))
    return O.first_wins([a, b], "slug")


def joi28_occurrence_receipts(spark, sf):
    lines = _locations(spark, sf)
    receipts = lines.where("id % 3 <> 0").select("path", (F.col("blob") % 20).alias("blob"), (F.col("flag") != "R").alias("reviewed"))
    return O.occurrence_receipts(lines.select(F.col("id").alias("occurrence"), "path", (F.col("blob") % 20).alias("blob")), receipts)


def joi29_receipt_owners(spark, sf):
    lines = _locations(spark, sf)
    return O.sole_owners(lines.where("id % 6 = 0").select(F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("slug"), "path", (F.col("blob") % 5).alias("blob")))


def joi32_carried_forward(spark, sf):
    lines = _locations(spark, sf)
    prior = lines.select(F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("slug"), "path", (F.col("blob") % 3).alias("blob"), (F.col("line") % 2).alias("lines"), (F.col("id") % 3).alias("findings"), (F.col("id") % 2).alias("named"), (F.col("id") % 30 == 0).alias("same"))
    now = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 3).cast("long").alias("blob"), (F.col("p_partkey") % 2).alias("lines"))
    return O.carried_forward(prior, now, F.col("same"))


def joi42_tool_calls(spark, sf):
    e = table(spark, sf, "events")
    calls = e.where("event_type in ('click', 'view', 'purchase')").select((F.col("event_id") % 3000).alias("call"), F.col("event_type").alias("tool"))
    results = e.where("event_type in ('signup', 'error')").select(((F.col("event_id") * 7) % 3100).alias("call"), (F.col("event_type") == "error").alias("error"))
    return O.paired_calls(calls, results)


def joi43_synthesis(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha1(F.coalesce("text", F.lit(""))).alias("digest"))
    k = F.col("path")
    targets = d.where(k % 12 != 5).withColumn("carried", k % 2 == 0)
    produced = d.where(k % 10 != 3).withColumn("digest", F.when(k % 8 == 2, F.sha1("digest")).otherwise(F.col("digest")))
    return O.synthesis_errors(targets, produced.unionByName(produced.where(k % 14 == 0)))


def _summary(spark, sf):
    f = _findings(spark, sf)
    of = lambda s: F.count_if(F.col("status") == s)
    return f.groupBy("slug").agg(of("O").alias("open"), of("F").alias("done"), F.count("*").alias("required"))


def agg18_summary_identities(spark, sf):
    return O.identity_errors(_summary(spark, sf), ["open", "done"], "required")


def agg22_domain_totals(spark, sf):
    units = _summary(spark, sf).select(F.concat(F.lit("d"), (F.substring("slug", 2, 9).cast("long") % 4).cast("string")).alias("domain"), "required", F.col("done").alias("fresh"), (F.col("required") - F.col("done")).alias("gaps"), "open")
    drift = table(spark, sf, "customer").select(F.concat(F.lit("d"), (F.col("c_custkey") % 3).cast("string")).alias("domain"), (F.col("c_custkey") % 40).alias("n"))
    return O.domain_totals(units, drift, F.col("domain") != "d1")


def agg23_portfolio(spark, sf):
    f = _findings(spark, sf)
    status = F.when(F.col("status") == "O", "open").when(F.col("status") == "F", F.when(F.col("id") % 4 == 0, "expired").otherwise("accepted-risk")).otherwise(F.when(F.col("id") % 3 == 0, "reopened").otherwise("remediated"))
    return O.portfolio(f.select(F.col("slug").alias("unit"), status.alias("status")))


def agg24_blocking(spark, sf):
    f = _findings(spark, sf).select(F.col("severity").alias("derivation"), F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), (F.col("status") == "O").alias("blocks"))
    return O.blocking_groups(f).withColumn("ids", F.array_join("ids", ","))


def agg25_finding_counts(spark, sf):
    return O.finding_counts(_findings(spark, sf).withColumn("n", F.col("n") - 1), "slug")


def agg30_tallies(spark, sf):
    return O.tallies(_findings(spark, sf), ["severity", "status", "slug"])


def agg31_path_outcomes(spark, sf):
    return O.path_outcomes(table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path")), _locations(spark, sf).where("id % 9 = 0").select("path", (F.col("flag") == "A").alias("passed")))


def agg36_tool_use(spark, sf):
    return O.tool_use(table(spark, sf, "events"), "user_id", "event_type", {"write": ["purchase", "signup"], "shell": ["click"]})


def agg40_surfaces(spark, sf):
    k = F.col("id")
    surfaces = _findings(spark, sf).where("severity < '4'").select(F.col("slug").alias("unit"), F.get(F.array(*[F.lit(d) for d in O.DISPOSITIONS]), F.when((F.col("fingerprint") % 50 < 25) & (k % 5 == 4), 1).otherwise(k % 5).cast("int")).alias("disposition"))
    units = table(spark, sf, "customer").where("c_custkey < 60").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("unit"), F.when(F.col("c_custkey") % 5 == 0, "unknown").when(F.col("c_custkey") % 5 == 1, "partial").otherwise("complete").alias("completeness"), (F.col("c_custkey") % 3 % 2).alias("deferred"))
    return O.surface_state(surfaces, units)


def _units(spark, sf):
    return table(spark, sf, "customer").where("c_custkey < 60").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("slug"), (F.col("c_custkey") % 3 == 0).alias("stale"))


def srt6_units_by_severity(spark, sf):
    return O.units_by_severity(_units(spark, sf), _findings(spark, sf).where("id % 16 = 0"), SEVERITIES)


def srt7_tests_by_impact(spark, sf):
    return O.units_by_severity(_units(spark, sf), _findings(spark, sf).where("id % 16 = 0"), SEVERITIES[:3], stale_first=True)


def srt8_unit_rows(spark, sf):
    k = F.col("c_custkey")
    return O.unit_rows(table(spark, sf, "customer").select(F.col("c_name").alias("slug"), F.col("c_mktsegment").alias("title"), F.get(F.array(*[F.lit(s) for s in O.COVERAGE_ORDER]), (k % 4).cast("int")).alias("state"), F.when(k % 6 < 5, F.get(F.array(*[F.lit(s) for s in SEVERITIES]), (k % 6).cast("int"))).alias("worst")), SEVERITIES)


def srt10_recent_units(spark, sf):
    f = _findings(spark, sf)
    return O.recent_units(f.groupBy("slug").agg(F.max("at").alias("scanned"), (F.count("*") % 2 == 0).alias("accepted"))).select("slug", "scanned")


def srt14_diagnostics(spark, sf):
    f = _findings(spark, sf)
    return O.diagnostics(f.select(F.when(F.col("id") % 5 != 0, F.col("slug")).alias("path"), F.col("severity").alias("code"), F.col("status").alias("message")))


def fld26_gaps(spark, sf):
    f = _findings(spark, sf)
    status = F.when(F.col("status") == "F", "fresh").when(F.col("id") % 11 == 0, "unknown").when(F.col("status") == "O", "missing").otherwise("stale")
    rows = f.select(F.col("id").cast("string").alias("path"), F.col("slug").alias("unit"), status.alias("status"), (F.col("id") % 10 == 0).alias("orphan"))
    return O.gap_rows(rows.where("not orphan"), rows.where("orphan").withColumn("unit", F.lit("")))


def fld28_cards(spark, sf):
    return O.finding_cards(_with_paths(spark, sf), _inventory(spark, sf), SEVERITIES)


def fld29_judged_findings(spark, sf):
    return O.judged_findings(_with_paths(spark, sf), _inventory(spark, sf).where("blob < 30"), SEVERITIES[:4])


def win13_first_claims(spark, sf):
    return O.first_claims(_findings(spark, sf).select("fingerprint", "at", "id", "slug"), "fingerprint", ["at", "id"])


def win15_chunks(spark, sf):
    return O.chunks(_locations(spark, sf).select((F.col("blob")).alias("unit"), "id", "line", "path", "flag"), "unit", ["id", "line", "path", "flag"], "path", 16)


QUERIES = {name: plan for name, plan in list(globals().items()) if name.split("_")[0][-1:].isdigit()}

RANK = "case {c} " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(SEVERITIES)) + " else 5 end"
DISPOSITION = "case {k} " + " ".join(f"when {i} then '{d}'" for i, d in enumerate(O.DISPOSITIONS)) + " end"
UNITS = "units as (select 'u' || c_custkey as slug, c_custkey % 3 = 0 as stale from customer where c_custkey < 60)"
SUMMARY = f"{FINDINGS}, summary as (select slug, count(*) filter (status = 'O') as open, count(*) filter (status = 'F') as done, count(*) as required from findings group by slug)"

ORACLE_SQL = {
    "joi19_partial_units": f"""with {FINDINGS}, owned as (select slug as unit, id::varchar as path from findings where status <> 'P'), seen as (select slug as unit, id::varchar as path from findings where id % 4 <> 0 and fingerprint % 50 < 20),
 lost as (select * from owned where unit in (select unit from seen) and (unit, path) not in (select (unit, path) from seen)) select unit, count(*) as uncovered, array_to_string(list_slice(list_sort(list(path)), 1, 3), ',') as first from lost group by unit""",
    "joi23_unit_ownership": """with u as (select distinct case when s_nationkey % 2 = 0 then 'BUILDING' else 'MACHINERY' end as domain, 'u' || s_nationkey as unit from supplier where s_nationkey % 4 <> 0),
 c as (select c_custkey as path, c_mktsegment as domain, 'u' || c_nationkey as unit from customer), o as (select unit, min(domain) as other from u group by unit)
 select c.path, c.domain, c.unit, case when o.other is null then 'unregistered' else 'cross-domain' end as problem, o.other from c left join u on c.domain = u.domain and c.unit = u.unit left join o on c.unit = o.unit where u.unit is null""",
    "joi24_classification_mismatch": """select doc_id as path, case when doc_id % 11 = 1 then 'unreported' when doc_id % 13 = 1 then 'unexpected' when doc_id % 6 = 0 then 'rules' else 'kind' end as problem from documents
 where (doc_id % 11 = 1) <> (doc_id % 13 = 1) or (doc_id % 11 <> 1 and doc_id % 13 <> 1 and (doc_id % 6 = 0 or doc_id % 9 = 0))""",
    "joi25_scope_status": f"""with {WITH_PATHS}, {INVENTORY}, scope as (select 'u' || (p_partkey % 50) as slug, 'p' || p_partkey as path, case when p_partkey % 50 < 5 then null when p_partkey % 50 < 30 then p_size else p_size + p_partkey % 2 end as blob from part where p_partkey % 50 < 10 or p_partkey % 7 <> 0),
 d as (select s.slug, s.path, s.blob, i.path is null as missing, coalesce(s.blob <> i.blob, false) as changed from scope s left join inventory i on s.path = i.path),
 f as (select id, id % 50 as u, coalesce(n, 1) as n, unnest(paths) as p from withpaths), h as (select distinct f.id, f.n, d.slug from f join d on d.slug = 'u' || f.u and d.path = 'p' || (substr(f.p, 2)::bigint // 50 * 50 + f.u) where d.missing or d.changed),
 g as (select slug, sum(n) as n from h group by slug)
 select d.slug, count(*) as files, count(*) filter (missing) as missing, count(*) filter (changed) as changed, case when bool_or(missing or changed) then 'stale' else 'fresh' end as status,
 case when not bool_or(missing or changed) or bool_or(blob is not null) then coalesce(max(g.n), 0) end as findings_with_drift from d left join g on d.slug = g.slug group by d.slug""",
    "joi26_accepted_ledgers": """with p as (select 'p' || p_partkey as path, p_size as blob, p_partkey % 300 as g, p_partkey as k from part), c as (select path, blob, unnest(['u' || g, 'u' || (g + 1)]) as slug from p where k % 8 <> 0 and k % 5 = 0)
 select distinct 'u' || p.g as slug from p join c on c.slug = 'u' || p.g and c.path = p.path and c.blob = case when p.k % 3 = 0 then p.blob else p.blob + 1 end where p.g % 4 <> 0""",
    "joi27_registered_units": """with a as (select 'u' || c_custkey as slug, c_name as title from customer where c_custkey % 3 = 0), b as (select 'u' || s_suppkey as slug, s_name as title from supplier) select * from a union all select * from b where slug not in (select slug from a)""",
    "joi28_occurrence_receipts": f"""with {LOCATIONS}, r as (select path, blob % 20 as blob, bool_or(flag <> 'R') as reviewed from locations where id % 3 <> 0 group by 1, 2), l as (select distinct id, path, blob % 20 as blob from locations)
 select id as occurrence, count(*) as locations, count(r.reviewed) as exact, count(*) filter (r.reviewed) as reviewed, count(*) filter (r.reviewed) = count(*) as closure_eligible from l left join r using (path, blob) group by id""",
    "joi29_receipt_owners": f"with {LOCATIONS} select path, blob % 5 as blob, 'u' || min(id % 7) as slug from locations where id % 6 = 0 group by path, blob % 5 having count(distinct id % 7) = 1",
    "joi32_carried_forward": f"""with {LOCATIONS}, u as (select * from locations where id % 30 = 0), s as (select path from u group by path having count(*) = 1)
 select u.path, 'u' || (u.id % 4) as slug from u join s using (path) join part p on u.path = 'p' || p.p_partkey where u.id % 3 = u.id % 2 and u.blob % 3 = p.p_size % 3 and u.line % 2 = p.p_partkey % 2""",
    "joi42_tool_calls": """with a as (select event_id % 3000 as call, count(*) as asked from events where event_type in ('click', 'view', 'purchase') group by 1), b as (select (event_id * 7) % 3100 as call, count(*) as answers, bool_or(event_type = 'error') as failed from events where event_type in ('signup', 'error') group by 1)
 select call, case when asked is null then 'unasked' when answers is null then 'unanswered' when asked > 1 or answers > 1 then 'repeated' when failed then 'failed' else 'ok' end as problem from a full join b using (call)""",
    "joi43_synthesis": """select * from (select doc_id as path, case when doc_id % 12 = 5 and doc_id % 10 = 3 then null when doc_id % 12 = 5 then 'not-a-target' when doc_id % 10 = 3 then 'uncovered' when doc_id % 14 = 0 then 'repeated' when doc_id % 8 = 2 then 'carried-changed' end as problem from documents) where problem is not null""",
    "agg18_summary_identities": f"with {SUMMARY} select *, required - open - done as difference from summary where required <> open + done",
    "agg22_domain_totals": f"""with {SUMMARY}, s as (select 'd' || (substr(slug, 2)::bigint % 4) as domain, sum(required) as required, sum(done) as fresh, sum(required - done) as gaps, sum(open) as open from summary group by 1), d as (select 'd' || (c_custkey % 3) as domain, sum(c_custkey % 40) as n from customer group by 1)
 select domain, required, fresh, case when domain <> 'd1' then greatest(gaps, coalesce(n, 0), 1) else gaps end as gaps, open from s left join d using (domain)""",
    "agg23_portfolio": f"""with {FINDINGS}, f as (select slug as unit, case status when 'O' then 'open' when 'F' then case when id % 4 = 0 then 'expired' else 'accepted-risk' end else case when id % 3 = 0 then 'reopened' else 'remediated' end end as status from findings)
 select unit, status, count(*) as findings, count(*) filter (status in ('open', 'expired', 'reopened')) as open from f group by rollup (unit, status)""",
    "agg24_blocking": f"with {FINDINGS} select severity as derivation, count(*) as blocking, array_to_string(list_slice(list_sort(list(lpad(id::varchar, 12, '0'))), 1, 40), ',') as ids from findings where status = 'O' group by severity",
    "agg25_finding_counts": f"with {FINDINGS} select slug, sum(case when n - 1 >= 0 then n - 1 else 1 end) as total, bool_and(coalesce(n - 1 >= 0, true)) as valid from findings group by slug",
    "agg30_tallies": f"with {FINDINGS} select 'severity' as name, severity as value, count(*) as n from findings group by severity union all select 'status', status, count(*) from findings group by status union all select 'slug', slug, count(*) from findings group by slug",
    "agg31_path_outcomes": f"with {LOCATIONS}, o as (select path, bool_or(flag = 'A') as passed from locations where id % 9 = 0 group by path) select count(*) filter (passed) as passed, count(*) filter (not passed) as failed, count(*) filter (passed is null) as missing from part left join o on o.path = 'p' || p_partkey",
    "agg36_tool_use": "select user_id, count(*) filter (event_type in ('purchase', 'signup')) as write, count(*) filter (event_type = 'click') as shell, count(*) filter (event_type in ('view', 'error')) as other from events group by user_id",
    "agg40_surfaces": f"""with {FINDINGS}, s as (select slug as unit, {DISPOSITION.format(k='case when fingerprint % 50 < 25 and id % 5 = 4 then 1 else id % 5 end')} as disposition from findings where severity < '4'),
 u as (select 'u' || c_custkey as unit, case c_custkey % 5 when 0 then 'unknown' when 1 then 'partial' else 'complete' end as completeness, c_custkey % 3 % 2 as deferred from customer where c_custkey < 60),
 c as (select u.unit, completeness, deferred, count(s.unit) as total, {", ".join(f"count(*) filter (disposition = '{d}') as {d}" for d in O.DISPOSITIONS)} from u left join s using (unit) group by all)
 select * exclude (completeness, deferred), case when completeness = 'unknown' then 'unknown' when completeness = 'partial' or deferred > 0 or needs_follow_up > 0 then 'gap' else 'covered' end as state from c""",
    "srt6_units_by_severity": f"with {FINDINGS}, {UNITS} select u.slug, u.stale, coalesce(min({RANK.format(c='severity')}), 5) as worst from units u left join (select slug as s, severity from findings where id % 16 = 0) f on u.slug = f.s and f.s is not null group by all".replace("coalesce(min(", "coalesce(min(case when severity is not null then ").replace("end), 5)", "end end), 5)"),
    "srt7_tests_by_impact": f"with {FINDINGS}, {UNITS} select u.slug, u.stale, coalesce(min(case severity when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 3 end), 3) as worst from units u left join (select slug as s, severity from findings where id % 16 = 0) f on u.slug = f.s group by all",
    "srt8_unit_rows": "select c_name as slug, c_mktsegment as title, ['invalid', 'unknown', 'gap', 'fresh'][c_custkey % 4 + 1] as state, case when c_custkey % 6 < 5 then ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 6 + 1] end as worst from customer",
    "srt10_recent_units": f'with {FINDINGS} select slug, max("at") as scanned from findings group by slug having count(*) % 2 = 0 order by scanned desc, slug',
    "srt14_diagnostics": f"with {FINDINGS} select distinct case when id % 5 <> 0 then slug end as path, severity as code, status as message from findings",
    "fld26_gaps": f"with {FINDINGS} select id::varchar as path, case when id % 10 = 0 then '' else slug end as unit, case status when 'O' then 'missing' else 'stale' end as status from findings where status <> 'F' and id % 11 <> 0",
    "fld28_cards": f"with {WITH_PATHS}, {INVENTORY}, e as (select id, severity, unnest(paths) as path from withpaths) select path, severity, count(*) as findings, {RANK.format(c='severity')} as rank from e where path in (select path from inventory) group by path, severity",
    "fld29_judged_findings": f"""with {WITH_PATHS}, {INVENTORY}, l as (select distinct id from (select id, unnest(paths) as path from withpaths) where path in (select path from inventory where blob < 30)),
 r as (select id, case when title = '' then 'no-title' when severity >= '5' then 'unknown-severity' when id not in (select id from l) then 'out-of-scope' end as reason from withpaths) select id, reason is null as accepted, reason from r""",
    "win13_first_claims": f'with {FINDINGS} select fingerprint, "at", id, slug from findings qualify row_number() over (partition by fingerprint order by "at", id) = 1',
    "win15_chunks": f"with {LOCATIONS}, r as (select blob as unit, path, (row_number() over (partition by blob order by id, line, path, flag) - 1) // 16 as chunk from locations) select unit, chunk, count(*) as rows, count(distinct path) as files from r group by unit, chunk",
}
