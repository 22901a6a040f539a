"""Canonical texts, digests and an appended log, over ``events`` and ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import canonical as C
from corpusloom.operators import ledgerlog as L
from corpusloom.operators import scopes as S
from corpusloom.operators.tables import shared_folder, written
from corpusloom.plans.freshness import INV, inventory
from corpusloom.sources import table


def _bodies(spark, sf):
    """Nested objects with keys in two orders, numbers in several forms, and some that have no canonical form."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    number = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit("e2"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".250"))).otherwise(F.concat(F.lit("-"), k.cast("string"), F.lit("E-8")))
    a = F.concat(F.lit('"a" : ['), number, F.lit(', null,true , "t\\u00e9\\n\\u0001/'), F.col("event_type"), F.lit('"]'))
    b = F.concat(F.lit('"\\ud83d\\ude00": {"z":'), F.coalesce("props", F.lit("{}")), F.lit(', "B":-0.0}, "\\uffee": []'))
    body = F.when(k % 2 == 0, F.concat_ws(",", a, b)).otherwise(F.concat_ws(" , ", b, a))
    bad = F.when(k % 29 == 0, ',"a":1').when(k % 31 == 0, ',"c":9007199254740992').when(k % 37 == 0, ',"c":1e999').when(k % 41 == 0, ',"c":"\\ud800"').when(k % 43 == 0, ',"__proto__":1').when(k % 47 == 0, ",").otherwise("")
    return e.select("event_id", "user_id", "ts", F.concat(F.lit("{"), body, bad, F.lit("}")).alias("body"))


def canonical_bodies(spark, sf):
    found = _bodies(spark, sf).select("event_id", C.canonical_json(F.col("body")).alias("c"))
    return found.select("event_id", "c.json", "c.problem", C.digest(F.col("c.json")).alias("digest"))


def inventory_digests(spark, sf):
    inv = inventory(spark, sf)
    k = F.col("doc_id")
    lists = {"findings": F.array(F.concat(F.lit("o"), k % 7), F.concat(F.lit("o"), k % 3 + 10)), "receipts": F.when(k % 2 == 0, F.array(F.lit("z"), F.lit("r"))).otherwise(F.array().cast("array<string>"))}
    files = inv.select("source", F.when(k % 400 == 399, "twice").otherwise(F.col("path")).alias("path"), "blob", F.when(k % 5 == 0, "not-reviewed").otherwise("reviewed").alias("status"), F.lit("clean").alias("outcome"), *[v.alias(n) for n, v in lists.items()])
    found = S.inventory_digests(files, "source")
    return found.withColumn("scope_hash", S.scope_result_hash(F.lit("unit"), F.array(F.lit("src/**"), F.lit("a")), F.array().cast("array<string>"), F.col("digest")))


def source_digests(spark, sf):
    bodies = _bodies(spark, sf).where("event_id % 3 = 0")
    return bodies.select("event_id", S.source_digest(F.col("body")).alias("source_digest"))


def _ledger_events(spark, sf):
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","user": '), F.col("user_id").cast("string"), F.lit(', "at":'), (F.col("event_id") - F.col("event_id") % 2).cast("string"), F.lit("}"))
    return e.select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("ledger"), F.col("event_id").alias("at"), body.alias("body"))


def _appended(spark, sf):
    """A new log, filled by three appends that overlap; the last is the whole table, and is repeated."""
    log, events = f"{shared_folder(spark)}/logs/{uuid.uuid4().hex}", written(L.identified(_ledger_events(spark, sf)), "ledger-events")
    # About the middle: the log is the same wherever its parts are cut.
    half = table(spark, sf, "events").agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    statuses = [L.append_identified(part, log) for part in (events.where(F.col("at") < half / 2), events.where(F.col("at") < half), events, events)]
    return log, statuses


def appended_log(spark, sf):
    log, _ = _appended(spark, sf)
    return L.entries(spark, log).select("ledger", "place", "event", "previous", "digest")


def appended_twice(spark, sf):
    """How many events of each ledger the last, repeated append found there, and how many entries are broken."""
    log, statuses = _appended(spark, sf)
    found = statuses[-1].groupBy("ledger").agg(F.count_if(F.col("status") == "already-present").alias("present"), F.count_if(F.col("status") == "append").alias("appended"))
    broken = L.broken_entries(L.entries(spark, log)).groupBy("ledger").agg(F.count("*").alias("broken"))
    return found.join(broken, "ledger", "left").fillna(0, ["broken"])


QUERIES = {"hsh3_canonical_bodies": canonical_bodies, "hsh6_inventory_digests": inventory_digests, "hsh8_source_digests": source_digests, "snk3_appended_log": appended_log, "snk2_appended_twice": appended_twice}

_BAD = "event_id % 29 = 0 or event_id % 31 = 0 or event_id % 37 = 0 or event_id % 41 = 0 or event_id % 43 = 0 or event_id % 47 = 0"
#: -k * 1e-8 in its shortest form: digits without zeros at the end, plain from 1e-6 up.
_SMALL = "case when event_id < 100 then '-' || left(rtrim(event_id::varchar, '0'), 1) || case when length(rtrim(event_id::varchar, '0')) > 1 then '.' || substr(rtrim(event_id::varchar, '0'), 2) else '' end || 'e-' || (9 - length(event_id::varchar)) else '-0.' || rtrim(lpad(event_id::varchar, 8, '0'), '0') end"
_CANONICAL = f"""j as (select event_id, user_id, case event_id % 4 when 0 then event_id::varchar when 1 then (event_id * 100)::varchar when 2 then event_id || '.25' else {_SMALL} end as num, event_type, coalesce(replace(props, ' ', ''), '{{}}') as props from events),
 c as (select event_id, case when {_BAD} then null else '{{"a":[' || num || ',null,true,"té\\n\\u0001/' || event_type || '"],"😀":{{"B":0,"z":' || props || '}},"' || chr(65518) || '":[]}}' end as json,
  case when event_id % 29 = 0 then 'repeated-key' when event_id % 31 = 0 then 'unsafe-integer' when event_id % 37 = 0 then 'not-finite' when event_id % 41 = 0 then 'lone-surrogate' when event_id % 43 = 0 then 'forbidden-key' when event_id % 47 = 0 then 'no-json' end as problem from j)"""
_LEDGER = """b as (select 'u' || user_id % 50 as ledger, event_id, '{"at":' || (event_id - event_id % 2) || ',"type":"' || event_type || '","user":' || user_id || '}' as content from events),
 d as (select ledger, content, min(event_id) as first_at, 'event-' || substr(sha256('decision-event/v1' || chr(0) || ledger || chr(0) || content), 1, 24) as event from b group by ledger, content),
 o as (select *, row_number() over (partition by ledger order by first_at, event) - 1 as place from d)"""

ORACLE_SQL = {
    "hsh3_canonical_bodies": f"with {_CANONICAL} select event_id, json, problem, 'sha256:' || sha256(json) as digest from c",
    "hsh6_inventory_digests": f"""with {INV}, f as (select source, case when doc_id % 400 = 399 then 'twice' else path end as path, blob, case when doc_id % 5 = 0 then 'not-reviewed' else 'reviewed' end as status,
  list_sort(['o' || doc_id % 7, 'o' || doc_id % 3 + 10]) as fs, case when doc_id % 2 = 0 then '["r","z"]' else '[]' end as rs from inv),
 j as (select source, path, '{{"blob":"' || blob || '","findingOccurrenceIds":["' || array_to_string(fs, '","') || '"],"outcome":"clean","path":"' || path || '","receiptRefs":' || rs || ',"status":"' || status || '"}}' as json from f),
 g as (select source, count(*) as files, count(*) - count(distinct path) as extra, 'sha256:' || sha256('{{"files":[' || string_agg(json, ',' order by path, json) || '],"namespace":"exact-inventory/v1"}}') as digest from j group by source),
 r as (select source, count(*) filter (n > 1) as repeated from (select source, path, count(*) as n from j group by all) group by source), x as (select source, files, repeated, case when repeated = 0 then digest end as digest from g join r using (source))
 select *, 'sha256:' || sha256('{{"excludePaths":[],"includePaths":["a","src/**"],"inventoryDigest":' || coalesce('"' || digest || '"', 'null') || ',"mode":"unit","namespace":"exact-scope-result/v1"}}') as scope_hash from x""",
    "hsh8_source_digests": f"with {_CANONICAL} select event_id, sha256(json || chr(10)) as source_digest from c where event_id % 3 = 0",
    "snk3_appended_log": f"""with recursive {_LEDGER}, w(ledger, place, event, previous, digest) as (
  select ledger, place, event, null::varchar, 'sha256:' || sha256('{{"event":' || content || ',"eventId":"' || event || '","previousEntryDigest":null}}') from o where place = 0
  union all select o.ledger, o.place, o.event, w.digest, 'sha256:' || sha256('{{"event":' || o.content || ',"eventId":"' || o.event || '","previousEntryDigest":"' || w.digest || '"}}') from w join o on o.ledger = w.ledger and o.place = w.place + 1)
 select * from w""",
    "snk2_appended_twice": f"with {_LEDGER} select ledger, count(*) as present, 0 as appended, 0 as broken from o group by ledger",
}
