"""Findings with reconciled occurrences, from ``events``: every event is an occurrence of one of its user's findings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import reconciliation as R
from corpusloom.sources import table

#: A fixed time of judging, in milliseconds, beside deadlines that are made from event ids.
NOW, DAY, WARNING_DAYS, BLOCKING = 1_700_000_000_000, 86_400_000, 14, ["accepted-risk"]


def _tables(spark, sf):
    """Occurrences, decisions on every fifth event, and links from every eleventh to the next ones of its pair of findings."""
    own = F.col("event_id") % 7
    slug = F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise("all")
    e = table(spark, sf, "events").select("event_id", F.concat_ws("-", "user_id", own).alias("finding"), F.concat_ws("-", "user_id", F.floor(own / 2)).alias("pair"), slug.alias("event_type"))
    ahead = F.col("event_id") % 17 == 0
    last = F.max(F.when(~ahead, F.col("event_id"))).over(Window.partitionBy("finding", "event_type"))
    name = F.col("event_id").cast("string")
    occurrences = e.select(
        name.alias("occurrence"), "finding", F.col("event_type").alias("slug"), F.col("event_id").alias("place"), ahead.alias("ahead"),
        ((F.col("event_id") == last) & (F.col("event_id") % 3 > 0)).alias("authoritative"), (F.col("event_id") % 4 > 0).alias("closure_eligible"),
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 40) % 2).alias("ruleset"), F.concat(F.lit("b"), F.floor(F.col("event_id") / 90) % 2).alias("bindings"),
    )
    action = F.element_at(F.array(*map(F.lit, ["open", "remediated", "accepted-risk", "false-positive", "separate-design", "reopened", "superseded", "accepted-risk"])), (F.col("event_id") % 8 + 1).cast("int"))
    decided = e.where(~ahead & (F.col("event_id") % 5 == 0)).withColumn("action", action)
    before = F.lag(name).over(Window.partitionBy("finding").orderBy("event_id"))
    dispositions = decided.select(
        F.concat(F.lit("d"), name).alias("event"), name.alias("occurrence"), "finding", F.col("event_id").alias("place"), "action", F.concat(F.lit("u"), F.col("event_id") % 3 % 2).alias("owner"),
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 40) % 2).alias("ruleset"), F.lit("p").alias("policy"), F.concat(F.lit("b"), F.floor(F.col("event_id") / 90) % 2).alias("bindings"), (F.col("event_id") % 13 > 0).alias("context_current"),
        F.when(F.col("action").isin("accepted-risk", "separate-design"), F.lit(NOW) + (F.col("event_id") % 200 - 20) * DAY).alias("expires"),
        F.when(F.col("action") == "reopened", F.concat(F.lit("d"), before)).alias("supersedes"),
    )
    w = Window.partitionBy("pair").orderBy("event_id")
    linked = e.withColumns({"one": F.lead("event_id", 1).over(w), "two": F.lead("event_id", 2).over(w), "three": F.lead("event_id", 3).over(w)}).where((F.col("event_id") % 11 == 0) & F.col("three").isNotNull())
    merges, splits = F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1
    ids = lambda *columns: F.array(*[F.col(c).cast("string") for c in columns])
    reconciliations = linked.select(
        F.concat(F.lit("e"), name).alias("event"), F.col("event_id").alias("place"), F.when(merges, ids("event_id", "one")).otherwise(ids("event_id")).alias("before"),
        F.when(splits, ids("two", "three")).otherwise(ids("two")).alias("after"), F.when(F.col("event_id") % 7 == 0, "uncertain").when(F.col("event_id") % 7 == 1, "distinct").otherwise("equivalent").alias("outcome"),
        F.when(F.col("event_id") % 9 == 0, "low").otherwise("high").alias("confidence"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("e"), F.col("event_id") - 11)).alias("supersedes"),
    )
    return occurrences, dispositions, reconciliations


def reconciled_findings(spark, sf):
    found = R.finding_states(*_tables(spark, sf), now=NOW, warning_days=WARNING_DAYS, blocking=BLOCKING)
    return found.withColumns({"current": F.array_join("current", ","), "basis": F.array_join("basis", ",")})


def lifecycle_edges(spark, sf):
    """The links that states follow, numbered in their order."""
    occurrences, dispositions, reconciliations = _tables(spark, sf)
    edges = R.lifecycle_edges(occurrences, dispositions, reconciliations)
    return edges.select("number.rank", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"), "outcome", "confidence", "compatible")


QUERIES = {"fld7_reconciled_findings": reconciled_findings, "grf9_lifecycle_edges": lifecycle_edges}

_DECIDED = """d as (select event_id, user_id || '-' || event_id % 7 as finding, user_id || '-' || event_id % 7 // 2 as pair, case when user_id % 3 = 0 then event_type else 'all' end as event_type, event_id % 5 = 0 as decided, event_id % 17 = 0 as ahead, (event_id // 90) % 2 as b from events)"""
ORACLE_SQL = {
    "grf9_lifecycle_edges": f"""with {_DECIDED}, n as (select event_id, lead(event_id, 1) over w as one, lead(event_id, 2) over w as two, lead(event_id, 3) over w as three from d window w as (partition by pair order by event_id)),
 r as (select event_id, case when event_id % 3 = 0 then [event_id, one] else [event_id] end as bs, case when event_id % 3 = 1 then [two, three] else [two] end as a_s, case event_id % 7 when 0 then 'uncertain' when 1 then 'distinct' else 'equivalent' end as outcome,
  case when event_id % 9 = 0 then 'low' else 'high' end as confidence, case when event_id % 10 = 0 then event_id - 11 end as supersedes from n where event_id % 11 = 0 and three is not null),
 a as (select * from r where event_id not in (select supersedes from r where supersedes is not null) and not list_bool_or(list_transform(bs || a_s, lambda x: x % 17 = 0))),
 inc as (select distinct unnest(a_s) as id from a), outg as (select distinct unnest(bs) as id from a),
 p as (select *, lag(event_id) over (partition by finding, event_type order by event_id) as prev from d where not ahead),
 stable as (select p.*, q.b as qb from p join d q on q.event_id = p.prev where p.event_id not in (select id from inc)),
 seeds as (select p.event_id, max(case when p.prev is null or p.event_id in (select id from inc) then p.event_id end) over (partition by finding, event_type order by event_id) as seed, finding from p),
 open_seeds as (select distinct s.finding, s.seed from seeds s join outg o on o.id = s.event_id where s.event_id % 5 <> 0 and s.event_id not in (select id from inc) and s.seed % 5 <> 0 and s.seed not in (select id from inc)),
 lastd as (select finding, max(event_id) as src from d where decided and not ahead group by finding),
 crossing as (select distinct src, seed, x.b as xb, y.b as yb from open_seeds join lastd using (finding) join d x on x.event_id = src join d y on y.event_id = seed where src <> seed and x.event_type <> y.event_type)
 select 0 as rank, prev::varchar as before, event_id::varchar as after, 'equivalent' as outcome, 'high' as confidence, qb = b as compatible from stable
 union all select 1, src::varchar, seed::varchar, 'equivalent', 'high', xb = yb from crossing
 union all select 2, array_to_string(bs, ','), array_to_string(a_s, ','), outcome, confidence, true from a""",
}
