"""Policy, evidence, coverage and queue queries over pages, orders, lineitem, customer, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.paths import ignored, location
from corpusloom.operators import coverage as O
from corpusloom.operators.links import url_path
from corpusloom.operators.tables import written
from corpusloom.sources import table

RULES = [
    O.Rule("english", ["*.example.com/en/**"], domains=["text", "style"]),
    O.Rule("french", ["*/fr/**"], domains=["text"]),
    O.Rule("german", ["*/de/**"], excluded=True),
    O.Rule("org", ["*.example.org/**"], domains=["style"]),
    O.Rule("spanish", ["*/es/[1-4]*"], excluded=True),
]
UNITS = [
    O.Unit("text", "com", ["*.example.com/**"]), O.Unit("text", "rest", ["*.example.net/**", "*.example.org/**"]),
    O.Unit("style", "com", ["*.example.com/**"]), O.Unit("style", "org", ["*.example.org/**"], exclude=["*/en/9*"]),
]


def classified(spark, sf):
    inv = table(spark, sf, "pages").select(url_path(F.col("url")).alias("path")).distinct()
    hazard = F.regexp_like("path", F.lit(r"/de/[0-9]*5"))
    return O.classify(inv, RULES, UNITS, hazard).select("path", "classification", "reason")


def ignored_paths(spark, sf):
    inv = table(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return inv.select("page_id", ignored(F.col("path"), ["en", "!*.example.net/en", "*.example.org/fr"]).alias("ignored"))


def locations(spark, sf):
    ref = F.concat(F.concat_ws("/", "source", "lang"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(":"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("#s"), F.col("doc_id").cast("string"))).otherwise(""))
    return table(spark, sf, "documents").select("doc_id", location(ref).alias("l")).select("doc_id", "l.path", "l.line", "l.symbol")


def _required(spark, sf):
    """Each order is a path that its customer's segment (domain) must review, in the unit of its priority; open orders are deleted."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("domain"))
    return orders.join(customers, "o_custkey").select("domain", F.col("o_orderpriority").alias("unit"), F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 5).cast("string").alias("blob"), (F.col("o_orderstatus") == "P").alias("deleted"))


def _receipts(spark, sf, required=None):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), ((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber") % 2)) % 5).cast("string").alias("blob"),
        (F.col("l_returnflag") != "R").alias("reviewed"), (F.col("l_linestatus") == "O").alias("full_read"))
    return (_required(spark, sf) if required is None else required).select("domain", "unit", "path").join(lines, "path")


def _units(spark, sf, required=None):
    required = (_required(spark, sf) if required is None else required).select("domain", "unit").distinct()
    return required.where(~F.col("unit").startswith("5")).withColumn("accepted", ~(F.col("domain") == "BUILDING")).unionByName(required.where("domain = 'MACHINERY'").where(F.col("unit").startswith("1")).withColumn("accepted", F.lit(True)))


def _evidence(spark, sf):
    required = written(_required(spark, sf), "required")  # read for the units, the receipts and itself
    return O.evidence_status(required, _units(spark, sf, required), _receipts(spark, sf, required))


def evidence(spark, sf):
    return _evidence(spark, sf)


def coverage_summary(spark, sf):
    return O.coverage_summary(_evidence(spark, sf), ["domain"])


def unit_states(spark, sf):
    return O.coverage_summary(_evidence(spark, sf), ["domain", "unit"]).withColumn("state", O.unit_state())


def verdict(spark, sf):
    return O.verdict(O.coverage_summary(_evidence(spark, sf), ["domain"]), F.col("invalid"))


SEVERITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _findings(spark, sf):
    disposition = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderkey") % 2 == 0, "accepted-risk").otherwise("separate-design")
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("severity"), disposition.alias("disposition"), F.concat(F.lit("order "), (F.col("o_orderkey") % 10).cast("string")).alias("title"))


def risk_summary(spark, sf):
    return O.risk_summary(_findings(spark, sf), "unit", SEVERITIES)


def action_queue(spark, sf):
    gaps = _evidence(spark, sf).where("status = 'invalid'")
    return O.action_queue(gaps, _findings(spark, sf), SEVERITIES, 100)


def interval_cover(spark, sf):
    reads = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") % 20 + 1).cast("int").alias("start"), (F.col("l_quantity") % 20 + F.col("l_linenumber") * 3).cast("int").alias("end"))
    return O.interval_cover(reads, ["l_orderkey"])


QUERIES = {
    "fld2_classify": classified, "prj1_ignored": ignored_paths, "prj6_locations": locations, "joi16_evidence": evidence, "agg16_coverage_summary": coverage_summary,
    "agg20_unit_states": unit_states, "agg17_verdict": verdict, "agg21_risk_summary": risk_summary, "srt9_action_queue": action_queue, "win14_interval_cover": interval_cover,
}

PATHS = "p as (select distinct regexp_extract(coalesce(url, ''), '^[a-z]+://([^?#]*)', 1) as path from pages)"
REQUIRED = """rq as (select c_mktsegment as domain, o_orderpriority as unit, o_orderkey::varchar as path, (o_orderkey % 5)::varchar as blob, o_orderstatus = 'P' as deleted from orders join customer on o_custkey = c_custkey),
 rc as (select domain, unit, path, ((l_orderkey + case when l_linenumber = 1 then 0 else l_linenumber % 2 end) % 5)::varchar as blob from rq join lineitem on path = l_orderkey::varchar where l_returnflag <> 'R' and l_linestatus = 'O'),
 un as (select distinct domain, unit, domain <> 'BUILDING' as accepted from rq where unit not like '5%' union all select distinct domain, unit, true from rq where domain = 'MACHINERY' and unit like '1%'),
 ru as (select domain, unit, count(*) as n, bool_and(accepted) as accepted from un group by 1, 2), gd as (select domain, unit, path, list(blob) as blobs from rc group by 1, 2, 3),
 ev as (select rq.domain, rq.unit, rq.path, case when n > 1 then 'invalid' when n is null or not accepted then 'missing' when blobs is null then 'missing' when deleted or not list_contains(blobs, blob) then 'stale' else 'fresh' end as status
  from rq left join ru using (domain, unit) left join gd using (domain, unit, path))"""
COUNTS = "count(*) filter (status = 'fresh') as fresh, count(*) filter (status = 'missing') as missing, count(*) filter (status = 'stale') as stale, count(*) filter (status = 'invalid') as invalid, count(*) as required, count(*) filter (status <> 'fresh') as gaps"
FINDINGS = "fi as (select o_orderkey::varchar as id, o_custkey as unit, o_orderpriority as severity, case when o_orderstatus = 'O' then 'open' when o_orderkey % 2 = 0 then 'accepted-risk' else 'separate-design' end as disposition, 'order ' || (o_orderkey % 10) as title from orders)"

ORACLE_SQL = {
    "fld2_classify": f"""with {PATHS}, m as (select path, regexp_matches(path, '^[^/]*\\.example\\.com/en/.*$') as en, regexp_matches(path, '^[^/]*/fr/.*$') as fr, regexp_matches(path, '^[^/]*/de/.*$') as de, regexp_matches(path, '^[^/]*\\.example\\.org/.*$') as og,
 regexp_matches(path, '^[^/]*/es/[1-4][^/]*$') as es, regexp_matches(path, '^[^/]*\\.example\\.com/.*$')::int as uc, regexp_matches(path, '^[^/]*\\.example\\.(net|org)/.*$')::int as ur,
 (regexp_matches(path, '^[^/]*\\.example\\.org/.*$') and not regexp_matches(path, '^[^/]*/en/9[^/]*$'))::int as uo, regexp_matches(path, '/de/[0-9]*5') as hz from p),
 r as (select path, case when not (en or fr or de or og or es) then 'unclassified' when de::int + es::int > 1 or (de::int + es::int = 1 and (en or fr or og)) then 'rule-conflict' when de::int + es::int = 1 and hz then 'unsafe-exclusion' when de::int + es::int = 1 then 'excluded'
  when ((en or fr) and uc + ur <> 1) or ((en or og) and uc + uo <> 1) then 'unit-conflict' else 'review' end as reason from m)
 select path, case when reason in ('rule-conflict', 'unsafe-exclusion', 'unit-conflict') then 'conflict' else reason end as classification, reason from r""",
    "prj1_ignored": """with p as (select page_id, regexp_extract(coalesce(url, ''), '^[a-z]+://([^?#]*)', 1) as path from pages) select page_id, case when regexp_matches(path, '^[^/]*\\.example\\.org/fr(/.*)?$') then true
 when regexp_matches(path, '^[^/]*\\.example\\.net/en(/.*)?$') then false else regexp_matches(path, '^([^/]+/)*en(/.*)?$') end as ignored from p""",
    "prj6_locations": "select doc_id, source || '/' || lang as path, case when doc_id % 3 = 0 and doc_id > 0 then doc_id::int end as line, case when doc_id % 3 = 1 then 's' || doc_id end as symbol from documents where doc_id <> 0 union all select doc_id, source || '/' || lang || ':0', null, null from documents where doc_id = 0",
    "joi16_evidence": f"with {REQUIRED} select * from ev",
    "agg16_coverage_summary": f"with {REQUIRED} select domain, {COUNTS} from ev group by domain",
    "agg20_unit_states": f"with {REQUIRED}, s as (select domain, unit, {COUNTS} from ev group by 1, 2) select *, case when invalid > 0 then 'invalid' when missing > 0 or stale > 0 then 'gap' when required = 0 then 'gap' when fresh = required then 'fresh' else 'gap' end as state from s",
    "agg17_verdict": f"with {REQUIRED} select count(*) filter (status = 'invalid') as errors, count(*) filter (status <> 'fresh') as gaps, case when count(*) filter (status = 'invalid') > 0 then 'invalid' when count(*) filter (status <> 'fresh') > 0 then 'incomplete' else 'complete' end as verdict from ev",
    "agg21_risk_summary": f"with {FINDINGS} select unit, count(*) filter (disposition = 'open') as open, count(*) filter (disposition = 'accepted-risk') as accepted, count(*) filter (disposition = 'separate-design') as separate, min(severity) filter (disposition = 'open') as worst from fi group by unit",
    "srt9_action_queue": f"""with {REQUIRED}, {FINDINGS}, q as (select 0 as kind, 0 as rank, path as name, unit as id from ev where status = 'invalid' union all select 1, substr(severity, 1, 1)::int - 1, title, id from fi where disposition = 'open')
 select * from q order by kind, rank, name, id limit 100""",
    "win14_interval_cover": """with r as (select l_orderkey, (l_quantity % 20 + 1)::int as a, (l_quantity % 20 + l_linenumber * 3)::int as b from lineitem), m as (select *, max(b) over (partition by l_orderkey order by a, b rows between unbounded preceding and 1 preceding) as reach from r),
 g as (select *, max((a > coalesce(reach, 0) + 1)::int) over (partition by l_orderkey order by a, b rows unbounded preceding) as broken from m) select l_orderkey, coalesce(max(b) filter (broken = 0), 0) as covered from g group by 1""",
}
