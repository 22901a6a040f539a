"""History queries: events stand for occurrences and decisions, orders and lineitem for deadlines and reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import history as O
from corpusloom.sources import table


def _occurrences(spark, sf):
    """Each event is an occurrence of its user's finding, in the history of its type; the last tenth of each thousand is ahead of what is published."""
    k = F.col("event_id")
    return table(spark, sf, "events").select(k.alias("occurrence"), F.col("user_id").alias("finding"), F.col("event_type").alias("slug"), (k % 1000).alias("place"), (k % 1000 >= 900).alias("ahead"))


OCCURRENCES = "occ as (select event_id as occurrence, user_id as finding, event_type as slug, event_id % 1000 as place, event_id % 1000 >= 900 as ahead from events)"


def win3_consecutive(spark, sf):
    o = _occurrences(spark, sf)
    return O.consecutive(o, o.where("occurrence % 7 = 0"))


def grf11_earliest(spark, sf):
    o = _occurrences(spark, sf)
    return O.earliest(o, o.where("occurrence % 7 = 0"))


def win11_publication_state(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("observation"), F.col("o_orderkey").alias("place"))
    current = o.where("observation % 3 = 0 and slug % 5 <> 0").groupBy("slug").agg(F.min("observation").alias("observation")).withColumn("has_ahead", F.col("slug") % 2 == 0)
    return O.publication_state(o, current)


def grf10_frontier(spark, sf):
    o = _occurrences(spark, sf).where("not ahead")
    edges = o.where("occurrence % 50 <> 3").select(F.col("occurrence").alias("before"), F.when(F.col("occurrence") % 40 == 4, "distinct").otherwise("equivalent").alias("outcome"))
    return O.frontier(o, edges, o.select("occurrence", (F.col("occurrence") % 200 % 7).alias("component")))


def set4_partitions(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.when(F.col("l_linenumber") % 2 == 0, "before").otherwise("after").alias("side"), (F.col("l_suppkey") % 3).alias("occurrence"), (F.col("l_partkey") % 2).alias("binding"))
    return O.unmatched_partitions(b)


def set6_boundaries(spark, sf):
    """Observations of an order's lines before and after its third."""
    l = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("p"), "l_linenumber")
    side = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("p"))))
    sets = l.groupBy("l_orderkey").agg(side(F.col("l_linenumber") < 3).alias("b"), side(F.col("l_linenumber") >= 3).alias("a"))
    return sets.select("l_orderkey", O.boundary_problem(F.col("b"), F.col("a")).alias("problem"))


def set5_same_sets(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).alias("p"), (F.col("l_suppkey") % 4).alias("s"))
    return l.groupBy("l_orderkey").agg(F.collect_list("p").alias("a"), F.collect_list("s").alias("b")).select("l_orderkey", O.same_set(F.col("a"), F.col("b")).alias("same"))


def fld10_closures(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select(
        k.alias("event"), (F.col("user_id") * 10 + k % 10).alias("finding"), k.alias("place"),
        F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "error", "reopened").when(F.col("event_type") == "click", "remediated").otherwise("accepted-risk").alias("action"))
    before = F.lag("event").over(O.Window.partitionBy("finding").orderBy("place"))
    return O.closure_errors(e.withColumn("supersedes", F.when(F.col("event") % 3 == 0, before).when(F.col("event") % 31 == 0, F.col("event") - 1)))


def fld9_retirements(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event"), (F.col("o_custkey") % 1000).alias("path"), (F.col("o_custkey") % 3).alias("blob"), (F.col("o_orderkey") % 3000).alias("place"),
        F.when(F.col("o_orderstatus") == "O", "staged-deletion").when(F.col("o_orderstatus") == "F", "deleted").otherwise("superseded").alias("reason"))
    before = F.lag("event").over(O.Window.partitionBy("path", "blob").orderBy("place", "event"))
    return O.retirement_errors(o.withColumn("supersedes", F.when(F.col("event") % 7 == 0, F.col("event") - 1).when((F.col("reason") == "deleted") & (F.col("event") % 5 > 0), before)))


def grf7_cyclic_edges(spark, sf):
    e = table(spark, sf, "events")
    confirmed = e.where("event_type = 'click' and user_id % 9 < 7").select(F.col("user_id").alias("src"), (F.col("user_id") + 1 + F.col("event_id") % 2).alias("dst"))
    proposed = e.where("event_type = 'view'").select(F.col("event_id").alias("event"), (F.col("user_id") + F.col("event_id") % 7).alias("src"), F.col("user_id").alias("dst"))
    return O.cyclic_edges(confirmed, proposed)


def grf7_cyclic_in_turn(spark, sf):
    """Links from a part to the next supplied by a supplier, and back in every ninth line: a proposal is held against those before it."""
    rows = table(spark, sf, "lineitem").where("l_orderkey % 5 = 0").select(F.floor(F.col("l_orderkey") / 5 / 40).cast("long").alias("g"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event"), F.col("l_partkey"), F.col("l_suppkey"))
    node = lambda c: F.concat_ws("-", "g", (F.col(c) % 12).cast("string"))
    edges = rows.select("event", node("l_partkey").alias("src"), node("l_suppkey").alias("dst"))
    return O.cyclic_in_turn(edges.where("event % 4 = 0 and src < dst").select("src", "dst"), edges.where("event % 4 > 0").withColumn("place", F.col("event")))


def dat1_rfc3339(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    tails = ["T10:20:30Z", "t10:20:30Z", "T10:20:30.Z", "T00:00:00-00:00", "T23:59:59.9Z", "T10:20:30.125+02:00", "T24:00:00Z", " 10:20:30Z", "T10:20:60Z", "T10:20:30", "T10:20:30-23:59", "T10:20:30+24:00"]
    text = F.concat(F.when(k % 11 == 0, F.concat(F.substring(day, 1, 8), F.lit("31"))).otherwise(day), F.get(F.array(*[F.lit(t) for t in tails]), (k % 12).cast("int")))
    return table(spark, sf, "orders").select(k, O.rfc3339(text).alias("valid"))


def dat3_over_long(spark, sf):
    expires = F.expr("timestampadd(DAY, cast(o_orderkey % 400 as int) - 10, o_orderdate)").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", O.over_long(F.col("o_orderdate").cast("timestamp"), expires, F.col("o_orderpriority"), 365, {"1-URGENT": 30, "2-HIGH": 90}).alias("over_long"))


def dat4_snoozes(spark, sf):
    until = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select("o_orderkey", O.snooze_problem(until, F.lit("1996-06-01 00:00:00").cast("timestamp")).alias("problem"))


def dat5_marker_age(spark, sf):
    changed = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", O.marker_age(changed, F.lit("1998-01-01").cast("date")).alias("age"))


QUERIES = {name: plan for name, plan in list(globals().items()) if name.split("_")[0][-1:].isdigit()}

ORACLE_SQL = {
    "win3_consecutive": f"with {OCCURRENCES}, l as (select lag(occurrence) over (partition by finding, slug order by place, occurrence) as before, occurrence as after, finding, slug from occ where not ahead) select * from l where before is not null and after % 7 <> 0",
    "grf11_earliest": f"""with recursive {OCCURRENCES}, l as (select occurrence, lag(occurrence) over (partition by finding, slug order by place, occurrence) as before from occ where not ahead),
 w as (select occurrence, occurrence as seed from l where before is null or occurrence % 7 = 0 union all select l.occurrence, w.seed from l join w on l.before = w.occurrence where l.occurrence % 7 <> 0) select occurrence, seed from w""",
    "win11_publication_state": """with o as (select o_custkey as slug, o_orderkey as k from orders), c as (select slug, min(k) as now from o where k % 3 = 0 and slug % 5 <> 0 group by slug)
 select o.slug, k as observation, case when k = now then 'current' when slug % 2 = 0 and k > now then 'history-ahead' else 'historical' end as state from o left join c using (slug)""",
    "grf10_frontier": f"""with {OCCURRENCES} select finding, count(*) as frontier, count(distinct occurrence % 200 % 7) > 1 as conflict from occ where not ahead and (occurrence % 50 = 3 or occurrence % 40 = 4) group by finding""",
    "set4_partitions": """with s as (select l_orderkey as event, l_partkey % 2 as binding, count(distinct l_suppkey % 3) filter (l_linenumber % 2 = 0) as b, count(distinct l_suppkey % 3) filter (l_linenumber % 2 <> 0) as a from lineitem group by 1, 2),
 e as (select event, sum((b > 1)::int + (a > 1)::int) as shared, count(*) filter ((b = 0) <> (a = 0)) as differs from s group by event) select * from e where shared > 0 or differs > 0""",
    "set6_boundaries": """with s as (select l_orderkey, list(l_partkey % 40) filter (l_linenumber < 3) as b, list(l_partkey % 40) filter (l_linenumber >= 3) as a from lineitem group by 1)
 select l_orderkey, case when b is null or a is null then 'empty' when len(list_distinct(b)) < len(b) or len(list_distinct(a)) < len(a) then 'repeated' when list_has_any(a, b) then 'shared' end as problem from s""",
    "set5_same_sets": """with s as (select l_orderkey, list(l_partkey % 4) as a, list(l_suppkey % 4) as b from lineitem group by 1) select l_orderkey, len(list_distinct(a)) = len(a) and list_sort(a) = list_sort(b) as same from s""",
    "fld10_closures": """with e as (select event_id as event, user_id * 10 + event_id % 10 as finding, case event_type when 'view' then 'open' when 'error' then 'reopened' when 'click' then 'remediated' else 'accepted-risk' end as action from events),
 s as (select *, case when event % 3 = 0 then lag(event) over w when event % 31 = 0 then event - 1 end as supersedes from e window w as (partition by finding order by event)),
 b as (select *, lag(case when supersedes is null and action <> 'open' then event end) over w as active, lag(case when supersedes is null and action <> 'open' then action end) over w as act from s window w as (partition by finding order by event))
 select event, finding, supersedes, active from b where supersedes is not null and (active is null or supersedes <> active or act = 'reopened')""",
    "fld9_retirements": """with e as (select o_orderkey as event, o_custkey % 1000 as path, o_custkey % 3 as blob, o_orderkey % 3000 as place, o_orderstatus as r from orders), n as (select *, row_number() over w as n, lag(r) over w as pr, lag(event) over w as pe from e window w as (partition by path, blob order by place, event)),
 s as (select *, case when event % 7 = 0 then event - 1 when r = 'F' and event % 5 > 0 then pe end as sup from n) select event, path, blob from s where not ((n = 1 and (r <> 'F' or sup is null)) or (n = 2 and pr = 'O' and r = 'F' and coalesce(sup = pe, false)))""",
    "grf7_cyclic_edges": """with recursive c as (select distinct user_id as src, user_id + 1 + event_id % 2 as dst from events where event_type = 'click' and user_id % 9 < 7), r as (select src, dst from c union select r.src, c.dst from r join c on r.dst = c.src),
 p as (select event_id as event, user_id + event_id % 7 as src, user_id as dst from events where event_type = 'view') select * from p where src = dst or exists (select 1 from r where r.src = p.dst and r.dst = p.src)""",
    "dat1_rfc3339": """with t as (select o_orderkey, case when o_orderkey % 11 = 0 then strftime(o_orderdate, '%Y-%m-') || '31' else strftime(o_orderdate, '%Y-%m-%d') end || (['T10:20:30Z', 't10:20:30Z', 'T10:20:30.Z', 'T00:00:00-00:00', 'T23:59:59.9Z', 'T10:20:30.125+02:00', 'T24:00:00Z', ' 10:20:30Z', 'T10:20:60Z', 'T10:20:30', 'T10:20:30-23:59', 'T10:20:30+24:00'])[o_orderkey % 12 + 1] as x from orders),
 p as (select o_orderkey, x, regexp_extract(x, '^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$', ['d', 'h', 'm', 's', 'f', 'z']) as g from t)
 select o_orderkey, g.d <> '' and try_cast(g.d as date) is not null and try_cast(g.h as int) < 24 and try_cast(g.m as int) < 60 and try_cast(g.s as int) < 60 and (g.z = 'Z' or (try_cast(substr(g.z, 2, 2) as int) < 24 and try_cast(substr(g.z, 5, 2) as int) < 60)) as valid from p""",
    "dat3_over_long": """select o_orderkey, o_orderkey % 400 - 10 <= 0 or o_orderkey % 400 - 10 > case o_orderpriority when '1-URGENT' then 30 when '2-HIGH' then 90 else 365 end as over_long from orders""",
    "dat4_snoozes": """select o_orderkey, case when o_orderkey % 13 = 0 then 'missing' when o_orderdate <= timestamp '1996-06-01' then 'past' when o_orderdate > timestamp '1996-06-01' + interval 365 days then 'too-long' end as problem from orders""",
    "dat5_marker_age": """select o_orderkey, case when o_orderkey % 13 = 0 then 'unknown' when date_diff('day', o_orderdate::date, date '1998-01-01') >= 180 then 'stale' else 'recent' end as age from orders""",
}
