"""Graph, decision-log, attention and localization queries over events, conversations, documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import attention as T
from corpusloom.operators import decisions as D
from corpusloom.operators import graph as G
from corpusloom.operators.links import url_path
from corpusloom.sources import table


def _transitions(spark, sf, rising=True):
    """Event type to next event type of the same user, all or where the value rises: a small graph with cycles."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_type", "value", F.lead("event_type").over(w).alias("next"), F.lead("value").over(w).alias("next_value"))
    return e.where("next is not null and next_value > value * 100" if rising else "next is not null").select(F.col("event_type").alias("src"), F.col("next").alias("dst")).distinct()


def strong_components(spark, sf):
    return G.strong_components(_transitions(spark, sf))


def reachability(spark, sf):
    return G.reachability(_transitions(spark, sf))


def all_strong_components(spark, sf):
    return G.strong_components(_transitions(spark, sf, rising=False))


def all_reachability(spark, sf):
    return G.reachability(_transitions(spark, sf, rising=False))


def turn_waves(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    node = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    edges = c.withColumn("before", before).where("before is not null").select(node.alias("src"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("before").cast("string")).alias("dst"))
    return G.waves(c.select(node.alias("node")), edges)


def shared_line_components(spark, sf):
    """Documents linked by an equal line of 40 characters or more; each line links its documents to the first."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") >= 40).select("doc_id", F.xxhash64("l").alias("h"), F.sha1("l").alias("h2")).distinct()
    first = lines.groupBy("h", "h2").agg(F.min("doc_id").alias("dst"), F.count("*").alias("n")).where("n > 1")
    return G.components(lines.join(first, ["h", "h2"]).where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst"))


def sibling_edges(spark, sf):
    paths = table(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    other = paths.select((F.col("page_id") + 1).alias("page_id"), F.col("path").alias("src"))
    return G.sibling_edges(paths.join(other, "page_id").select("src", F.col("path").alias("dst")))


def ledger_chain(spark, sf):
    return D.chained(table(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"])


def broken_chain(spark, sf):
    chain = D.chained(table(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"])
    return D.broken_links(chain.withColumn("previous", F.when(F.col("conv_id") % 10 == 0, F.sha1("digest")).otherwise(F.col("previous"))), "conv_id", "turn").select("conv_id", "turn", "previous")


def latest_decision(spark, sf):
    return D.latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def expiry(spark, sf):
    deadline = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    return table(spark, sf, "events").select("event_id", D.expiry_state(deadline, F.lit("2024-01-15").cast("timestamp_ntz"), 7).alias("state"))


def finding_lifecycle(spark, sf):
    """Users as findings: occurrences from their number of events, the last event type as action."""
    last = D.latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"])
    actions = F.element_at(F.array(*[F.lit(a) for a in ("open", "remediated", "false-positive", "accepted-risk", "separate-design", "reopened", "superseded")]), (F.col("event_id") % 7 + 1).cast("int"))
    findings = last.select(
        F.col("user_id").alias("finding"), (F.col("event_id") % 3).cast("int").alias("current"), F.when(F.col("user_id") % 8 != 0, actions).alias("action"),
        ((F.col("user_id") % 2 == 0) & (F.col("event_id") % 3 > 0)).alias("on_current"), (F.col("user_id") % 5 != 0).alias("context_current"), (F.col("user_id") % 11 == 0).alias("expired"),
        ((F.col("user_id") % 3 == 0) & (F.col("user_id") % 5 != 0) & (F.col("user_id") % 11 != 0) & (F.col("event_id") % 3 == 1)).alias("compatible"))
    return D.effective_state(findings, blocking=["accepted-risk"]).select("finding", "disposition", "derivation", "lifecycle", "blocks")


def identity_registry(spark, sf):
    d = table(spark, sf, "documents")
    return D.identity_conflicts(d.select(F.concat_ws("-", "source", (F.col("doc_id") % 40).cast("string")).alias("id"), F.sha2("text", 256).alias("digest")))


def reviews(spark, sf):
    e = table(spark, sf, "events")
    return D.review_sufficiency(e.select((F.col("event_id") % 500).alias("subject"), F.col("user_id").alias("reviewer"), (F.col("value") > 10).alias("approves"), (F.col("event_id") % 150).alias("actor"), (F.col("event_id") % 7).alias("owner")), 5)


def attention_reconcile(spark, sf):
    """Stored states from the first half of the month's events, seen snapshots from all."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    snap = lambda df: D.latest(df, "user_id", ["ts", "event_id"]).select(F.col("user_id").cast("string").alias("slug"), F.col("event_type").alias("snapshot"), "event_id", "ts")
    stored = snap(e.where("ts < timestamp_ntz'2024-01-02'")).select("slug", "snapshot", F.lit(3).cast("long").alias("revision"), F.when(F.col("event_id") % 3 == 0, "snoozed").when(F.col("event_id") % 3 == 1, "done").otherwise("open").alias("workflow"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("snoozed_until"))
    seen = snap(e).where(F.col("slug").cast("int") % 9 != 0).select("slug", "snapshot", (F.col("event_id") % 2 == 0).alias("fresh"))
    return T.reconcile(stored, seen, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))


def attention_revisions(spark, sf):
    return T.revisions(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


def ingest_props(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def localized(spark, sf):
    """A source's text in each language against English: complete, stale or missing, by number of characters modulo 5."""
    d = table(spark, sf, "documents").select("source", "lang", "doc_id", (F.col("n_chars") % 5).alias("digest"))
    english = d.where("lang = 'en'").groupBy("source").agg(F.max_by("digest", "doc_id").alias("wanted"))
    other = d.where("lang <> 'en'").groupBy("source", "lang").agg(F.max_by("digest", "doc_id").alias("has"))
    langs = spark.createDataFrame([("de",), ("es",), ("fr",)], "lang string")
    status = F.when(F.col("has").isNull(), "missing").when(F.col("has") == F.col("wanted"), "complete").otherwise("stale")
    return english.join(F.broadcast(langs)).join(other, ["source", "lang"], "left").select("source", "lang", status.alias("status"), (status != "complete").alias("fallback"))


def running_budget(spark, sf):
    """Turns of a conversation that fit a running budget of 2,000 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = table(spark, sf, "conversations").withColumn("used", F.sum(F.length(F.coalesce("text", F.lit("")))).over(w))
    return c.where("used <= 2000").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("used").alias("used"))


QUERIES = {
    "grf1_strong_components": strong_components, "grf7_reachability": reachability, "grf1_all_strong_components": all_strong_components, "grf7_all_reachability": all_reachability, "grf6_waves": turn_waves, "grf8_components": shared_line_components, "grf2_sibling_edges": sibling_edges,
    "win1_ledger_chain": ledger_chain, "win1_broken_links": broken_chain, "win2_latest_decision": latest_decision, "dat2_expiry_state": expiry, "fld7_finding_lifecycle": finding_lifecycle,
    "agg41_identity_registry": identity_registry, "fld8_reviews": reviews, "fld13_attention_reconcile": attention_reconcile, "agg28_attention_revisions": attention_revisions,
    "src19_ingest_props": ingest_props, "joi20_localized": localized, "win12_running_budget": running_budget,
}

EDGES = "w as (select event_type as src, lead(event_type) over x as dst, value, lead(value) over x as nv from events window x as (partition by user_id order by ts, event_id)), ed as (select distinct src, dst from w where dst is not null and nv > value * 100)"
REACH = f"{EDGES}, re as (select src, dst, 1 as hops from ed union all select re.src, ed.dst, hops + 1 from re join ed on re.dst = ed.src where hops < 8), rr as (select src, dst, min(hops) as hops from re group by 1, 2)"
LAST = "la as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1)"
DIGEST = "sha256(conv_id || chr(0) || turn || chr(0) || coalesce(role, '') || chr(0) || coalesce(text, ''))"

#: All transitions, and what each type reaches, with the fewest hops.
REACHED = """recursive n as (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events), e as (select distinct src, dst from n where dst is not null),
 r(src, dst, hops) as (select src, dst, 1 from e union select r.src, e.dst, hops + 1 from r join e on r.dst = e.src where hops < (select count(distinct src) from e)), h as (select src, dst, min(hops) as hops from r group by all)"""

ORACLE_SQL = {
    "grf7_all_reachability": f"with {REACHED} select src, dst, hops from h",
    "grf1_all_strong_components": f"with {REACHED} select a.src as node, min(a.dst) as component from h a join h b on a.src = b.dst and a.dst = b.src group by a.src",
    "grf7_reachability": f"with recursive {REACH} select src, dst, hops from rr",
    "grf1_strong_components": f"with recursive {REACH} select a.src as node, least(a.src, min(a.dst)) as component from rr a join rr b on a.src = b.dst and a.dst = b.src group by a.src",
    "grf6_waves": "select conv_id || '-' || turn as node, (row_number() over (partition by conv_id order by turn) - 1)::int as wave from conversations",
    "grf8_components": """with recursive l as (select distinct doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) where length(l) >= 40), f as (select l, min(doc_id) as dst, count(*) as n from l group by 1 having count(*) > 1),
 e as (select distinct doc_id as src, dst from l join f using (l) where doc_id <> dst), b as (select src, dst from e union select dst, src from e), r(node, other) as (select src, src from b union select r.node, b.dst from r join b on r.other = b.src)
 select node, min(other) as component from r group by node""",
    "grf2_sibling_edges": """with p as (select page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) as path from pages), e as (select a.path as s, b.path as d from p a join p b on b.page_id = a.page_id + 1 where a.path <> b.path),
 x as (select string_split(s, '/') as a, string_split(d, '/') as b from e), k as (select a, b, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])[1] as k from x)
 select array_to_string(a[1:k - 1], '/') as dir, a[k] as src, b[k] as dst, count(*) as n from k where k is not null group by 1, 2, 3""",
    "win1_ledger_chain": f"select conv_id, turn, {DIGEST} as digest, lag({DIGEST}) over (partition by conv_id order by turn) as previous from conversations",
    "win1_broken_links": f"with c as (select conv_id, turn, {DIGEST} as digest from conversations) select conv_id, turn, sha1(digest) as previous from c where conv_id % 10 = 0",
    "win2_latest_decision": f"with {LAST} select user_id, event_id, event_type, value from la",
    "dat2_expiry_state": "select event_id, case when event_id % 10 = 0 then null when ts <= timestamp '2024-01-15' then 'expired' when ts <= timestamp '2024-01-22' then 'warning' else 'active' end as state from events",
    "fld7_finding_lifecycle": f"""with {LAST}, f as (select user_id as finding, event_id % 3 as n, case when user_id % 8 <> 0 then (['open', 'remediated', 'false-positive', 'accepted-risk', 'separate-design', 'reopened', 'superseded'])[event_id % 7 + 1] end as e, user_id % 2 = 0 and event_id % 3 > 0 as oc,
  user_id % 5 <> 0 and user_id % 11 <> 0 as ok, user_id % 3 = 0 and user_id % 5 <> 0 and user_id % 11 <> 0 and event_id % 3 = 1 as cp from la),
 d as (select *, case when e is null then 'implicit-open' when oc and n > 1 then 'reconciliation-conflict' when (oc or n = 0) and not ok then 'carry-invalidated' when oc or n = 0 then 'explicit-event' when e in ('remediated', 'false-positive', 'superseded') then 'automatic-reopen'
  when e in ('accepted-risk', 'separate-design') and not cp then 'carry-invalidated' else 'carried' end as derivation from f),
 s as (select *, case when derivation in ('implicit-open', 'reconciliation-conflict', 'carry-invalidated') then 'open' when derivation = 'automatic-reopen' then 'reopened' else e end as disposition from d)
 select finding, disposition, derivation, case when derivation = 'implicit-open' then case when n > 0 then 'new' else 'unknown' end when derivation = 'reconciliation-conflict' then 'unknown' when derivation = 'automatic-reopen' then 'reopened'
  when derivation = 'carry-invalidated' then case when n > 0 then 'persisting' else 'unknown' end when derivation = 'explicit-event' and e = 'remediated' and n = 0 then 'resolved' when e = 'reopened' then 'reopened'
  when derivation = 'explicit-event' and e in ('false-positive', 'superseded') then 'unknown' when n > 0 then 'persisting' else 'unknown' end as lifecycle,
  case when derivation in ('reconciliation-conflict', 'carry-invalidated', 'automatic-reopen') then true when derivation = 'implicit-open' then n > 0 when derivation = 'carried' and disposition in ('open', 'reopened') then true else disposition in ('accepted-risk', 'reopened', 'open') end as blocks from s""",
    "agg41_identity_registry": """with i as (select source || '-' || (doc_id % 40) as id, sha256(text) as digest from documents) select case when count(distinct digest) > 1 then 'collision' else 'duplicate' end as problem, id as key, count(*) as n from i group by id having count(*) > 1
 union all select 'alias', digest, count(distinct id) from i group by digest having count(distinct id) > 1""",
    "fld8_reviews": "with r as (select event_id % 500 as subject, count(distinct case when value > 10 and user_id <> event_id % 150 and user_id <> event_id % 7 then user_id end) as approvals from events group by 1) select *, approvals >= 5 as sufficient from r",
    "fld13_attention_reconcile": """with l1 as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where ts < timestamp '2024-01-02'), l2 as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events),
 st as (select user_id::varchar as slug, event_type as o, case event_id % 3 when 0 then 'snoozed' when 1 then 'done' else 'open' end as w, case when event_id % 2 = 0 then ts end as u from l1 where k = 1),
 se as (select user_id::varchar as slug, event_type as s, event_id % 2 = 0 as fresh from l2 where k = 1 and user_id % 9 <> 0), j as (select slug, s, o, w, u, fresh from se full join st using (slug)),
 m as (select *, case when o is null then null when s is not null and s <> o then 'source-reopened' when w = 'snoozed' and (u is null or u <= timestamp '2024-01-01 12:00:00') then 'reopened' end as event from j)
 select slug, coalesce(s, o) as snapshot, case when o is null then 1 when event is not null then 4 else 3 end as revision, case when o is null then case when fresh then 'done' else 'open' end when event is not null then 'open' else w end as workflow, event from m""",
    "agg28_attention_revisions": "with c as (select user_id, coalesce((event_type <> lag(event_type) over (partition by user_id order by ts, event_id))::int, 0) as c from events) select user_id, count(*) as snapshots, sum(c) + 1 as revision, sum(c) as reopened from c group by 1",
    "src19_ingest_props": "select try_cast(json_extract_string(props, '$.k') as int) as k, count(*) as n, min(event_id) as first_event from events group by 1",
    "joi20_localized": """with d as (select source, lang, doc_id, n_chars % 5 as g from documents), en as (select source, arg_max(g, doc_id) as w from d where lang = 'en' group by 1), ot as (select source, lang, arg_max(g, doc_id) as h from d where lang <> 'en' group by 1, 2),
 s as (select en.source, l.lang, case when h is null then 'missing' when h = w then 'complete' else 'stale' end as status from en cross join (values ('de'), ('es'), ('fr')) l(lang) left join ot on ot.source = en.source and ot.lang = l.lang) select *, status <> 'complete' as fallback from s""",
    "win12_running_budget": "with c as (select conv_id, sum(length(coalesce(text, ''))) over (partition by conv_id order by turn rows unbounded preceding) as used from conversations) select conv_id, count(*) as turns, max(used) as used from c where used <= 2000 group by 1",
}
