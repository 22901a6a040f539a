"""Migrated notes, ledgers beside histories, and findings as they are shown, over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import migration as M
from corpusloom.operators import portfolio as L
from corpusloom.plans.freshness import INV, inventory
from corpusloom.sources import table


def _pick(values, index):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def migrated_notes(spark, sf):
    """Every fifth note moves, one in ten of these on to where another was; notes name others, in one and in two backticks."""
    k, inv = F.col("doc_id"), inventory(spark, sf)
    name = lambda n: F.concat(F.lit("n/"), n.cast("string"))
    body = F.concat(F.lit("x\n# "), name(k), F.lit("\n`"), name(k + 1), F.lit("` ``"), name(k + 2), F.lit("`` `"), name(k + 3), F.lit("\n"), name(k + 4), F.lit("` `m/"), k - 1, F.lit("`"))
    notes = inv.select(name(k).alias("path"), F.concat(F.lit("h"), k).alias("hash"), body.alias("body"))
    moves = inv.where("doc_id % 5 = 2").select(name(k).alias("source"), F.concat(F.lit("m/"), k).alias("target"), F.when(k % 2 == 0, 100).otherwise(80).alias("similarity"), k.alias("place"))
    onward = inv.where("doc_id % 50 = 2").select(F.concat(F.lit("m/"), k).alias("source"), F.concat(F.lit("z/"), k).alias("target"), F.lit(70).alias("similarity"), (k + F.when(k % 100 == 2, 1).otherwise(-1)).alias("place"))
    found = M.migrated_notes(notes, moves.unionByName(onward), inv.select(F.concat(F.lit("m/"), k).alias("path"), "blob"))
    return found


def ledger_states(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    histories = o.where(c % 7 > 0).select(c.alias("slug"), place.alias("place"), k.alias("observation"))
    current = o.where(c % 5 > 0).groupBy(c.alias("slug")).agg(F.sort_array(F.collect_list(k)).alias("ks")).select("slug", F.when(F.col("slug") % 11 == 0, -1).otherwise(F.element_at("ks", F.greatest(F.lit(1), F.size("ks") - (F.col("slug") % 3).cast("int")))).alias("observation"))
    return L.ledger_states(current, histories)


def shown_findings(spark, sf):
    k = F.col("event_id")
    states = table(spark, sf, "events").where("event_id % 6 > 0").select(
        k.alias("finding"), _pick(["open", "accepted-risk", "remediated", "reopened"], k % 4).alias("disposition"), _pick(["new", "persisting"], k % 2).alias("lifecycle"), (k % 3 > 0).alias("blocking"),
        _pick(["carry-invalidated", "carried", "explicit-event"], F.floor(k / 4) % 3).alias("derivation"), _pick(["expired", "active", "not-applicable"], F.floor(k / 12) % 3).alias("expiry_state"))
    findings = table(spark, sf, "events").select(k.alias("finding"), (F.col("user_id") % 20).alias("unit"), _pick(["low", "high", "odd", "critical"], F.floor(k / 3) % 4).alias("severity"), F.concat(F.lit("t"), k % 5).alias("title"))
    shown = L.finding_rows(findings, states).join(findings, "finding")
    return L.ordered_findings(shown, [["open", "reopened", "unknown"], ["expired"], ["accepted"]], ["critical", "high", "low"], "unit")


QUERIES = {"fld17_migrated_notes": migrated_notes, "src14_ledger_states": ledger_states, "srt11_shown_findings": shown_findings}

ORACLE_SQL = {
    "fld17_migrated_notes": f"""with {INV}, n as (select doc_id as k, blob from inv), mv as (select k from n where k % 5 = 2), fin as (select 'n/' || k as s, case when k % 100 = 2 then 'z/' else 'm/' end || k as t from mv union all select 'm/' || k, 'z/' || k from mv where k % 50 = 2),
 a as (select n.k, n.blob, n.k % 5 = 2 as moved, f1.t as t1, f2.t as t2, f5.t as t5 from n left join fin f1 on f1.s = 'n/' || (n.k + 1) left join fin f2 on f2.s = 'n/' || (n.k + 2) left join fin f5 on f5.s = 'm/' || (n.k - 1))
 select case when moved then 'm/' else 'n/' end || k as path, case when moved then 'n/' || k end as moved_from, case when moved and k % 2 = 0 then blob else 'h' || k end as hash,
  'x' || chr(10) || '# ' || case when moved then 'm/' else 'n/' end || k || chr(10) || '`' || coalesce(t1, 'n/' || (k + 1)) || '` ``' || coalesce(t2, 'n/' || (k + 2)) || '`` `n/' || (k + 3) || chr(10) || 'n/' || (k + 4) || '` `' || coalesce(t5, 'm/' || (k - 1)) || '`' as body,
  (t1 is not null)::int + (t2 is not null)::int + (t5 is not null)::int as renamed from a""",
    "src14_ledger_states": """with h as (select o_custkey as slug, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place, o_orderkey as obs from orders where o_custkey % 7 > 0), n as (select slug, count(*) as n from h group by 1), k as (select o_custkey as slug, list_sort(list(o_orderkey)) as ks from orders where o_custkey % 5 > 0 group by 1),
 c as (select slug, case when slug % 11 = 0 then -1 else ks[greatest(1, len(ks) - slug % 3)] end as obs from k), p as (select c.slug, place, true as has from c left join h on h.slug = c.slug and h.obs = c.obs)
 select slug, case when has is null then case when n = 1 then 'history-ahead' else 'history-without-current' end when n is null then 'history-missing' when place is null or n - place - 1 > 1 then 'mismatch' when n - place = 2 then 'history-ahead' else 'current' end as state from p full join n using (slug)""",
    "srt11_shown_findings": """with e as (select event_id as k, user_id % 20 as unit, event_id % 6 > 0 as known, (['open', 'accepted-risk', 'remediated', 'reopened'])[event_id % 4 + 1] as d, event_id // 4 % 3 as dv, event_id // 12 % 3 as ex, (['low', 'high', 'odd', 'critical'])[event_id // 3 % 4 + 1] as severity, 't' || event_id % 5 as title from events),
 s as (select *, case when not known then 'unknown' when dv = 0 and ex = 0 then 'expired' when d = 'accepted-risk' then 'accepted' else d end as status from e), g as (select *, case when status in ('open', 'reopened', 'unknown') then 0 when status = 'expired' then 1 when status = 'accepted' then 2 else 3 end as grp from s)
 select k as finding, status, case when known then (['new', 'persisting'])[k % 2 + 1] else 'unknown' end as lifecycle, case when known then k % 3 > 0 else true end as blocking, case when known then (['carry-invalidated', 'carried', 'explicit-event'])[dv + 1] else 'decision-state-unavailable' end as derivation,
  known and dv = 0 and ex > 0 as policy_drift, unit, severity, title, grp as "group", row_number() over (partition by unit order by grp, case severity when 'critical' then 0 when 'high' then 1 when 'low' then 2 else 3 end, title, k) as rank from g""",
}
