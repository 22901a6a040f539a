"""Streaming queries, run over the table as it is until all of it is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators.tables import shared_folder, written
from corpusloom.sources import table
from corpusloom.streaming import activity
from corpusloom.streaming.workflow import COLUMNS, OUTPUT, run_workflow

PARTS = 3


def daily_activity(spark, sf):
    """Windowed activity of ``events`` as a stream that reads the table once; each batch writes the windows so far, the last stands."""
    events = table(spark, sf, "events")
    source = spark.readStream.schema(events.schema).parquet(written(events, "stream-source").inputFiles()[0].rsplit("/", 1)[0])
    out, last = f"{shared_folder(spark)}/streams/activity-{uuid.uuid4().hex}", []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(number)

    stream = activity(source.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/{last[-1]}").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


def _workflow_rows(spark, sf):
    """Views and errors are sightings of a user's snapshot, other events are actions; some name a wrong snapshot or revision."""
    e = table(spark, sf, "events")
    k, at = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type").isin("view", "error"), "seen").when(F.col("event_type") == "click", "snooze").when(F.col("event_type") == "signup", F.when(k % 3 == 0, "reopen").otherwise("acted")).otherwise(F.when(k % 2 == 0, "understood").otherwise("decided"))
    return e.select(
        F.concat(F.lit("s"), F.col("user_id")).alias("slug"), F.timestamp_millis(at).alias("ts"), at.alias("at"), k.alias("seq"), kind.alias("kind"),
        F.when(kind == "seen", F.concat(F.lit("v"), F.floor(F.dayofmonth("ts") / 9))).when(k % 10 == 7, "v0").alias("snapshot"), (k % 2 == 0).alias("fresh"), F.when(k % 6 == 5, k % 8).alias("revision"),
        F.when(kind == "snooze", at + F.when(k % 13 == 0, 366).otherwise(k % 11 - 1) * 86_400_000 + F.lit(1)).alias("until"), F.when(k % 7 > 0, "because").alias("note"),
    )


def attention_workflow(spark, sf):
    """The rows come in three parts by time; each is a run of its own that goes on from the checkpoint of the one before."""
    rows = _workflow_rows(spark, sf)
    ends = rows.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    base = f"{shared_folder(spark)}/streams/workflow-{uuid.uuid4().hex}"
    if ends["first"] is None:
        return spark.createDataFrame([], OUTPUT)
    step = (ends["last"] - ends["first"]) // PARTS + 1
    for part in range(PARTS):
        begin = ends["first"] + part * step
        rows.where((F.col("at") >= begin) & (F.col("at") < begin + step)).write.parquet(f"{base}/in/{part}")
        run_workflow(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(OUTPUT).parquet(f"{base}/out").select(*COLUMNS)


QUERIES = {"stm1_daily_activity": daily_activity, "stm3_attention_workflow": attention_workflow}

ORACLE_SQL = {
    "stm1_daily_activity": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 6) as value from events group by 1, 2",
    "stm3_attention_workflow": """with recursive k as (select 's' || user_id as slug, epoch_us(ts) // 1000 as at_, event_id as seq, ts, event_id,
  case when event_type in ('view', 'error') then 'seen' when event_type = 'click' then 'snooze' when event_type = 'signup' then case when event_id % 3 = 0 then 'reopen' else 'acted' end when event_id % 2 = 0 then 'understood' else 'decided' end as kind from events),
 r as (select *, case when kind = 'seen' then 'v' || day(ts) // 9 when event_id % 10 = 7 then 'v0' end as snap, event_id % 2 = 0 as fresh, case when event_id % 6 = 5 then event_id % 8 end as rev, event_id % 7 > 0 as noted,
  case when kind = 'snooze' then at_ + case when event_id % 13 = 0 then 366 else event_id % 11 - 1 end * 86400000 + 1 end as til, row_number() over (partition by slug order by epoch_us(ts) // 1000, event_id) as n from k),
 w(slug, n, at_, seq, snapshot, revision, workflow, until_, woke, event, outcome) as (
  select slug, 0::bigint, null::bigint, null::bigint, null::varchar, null::bigint, null::varchar, null::bigint, null::bigint, null::varchar, null::varchar from (select distinct slug from r)
  union all select slug, n, at_, seq, case when seen_new then snap else snapshot end,
   case when not known and kind = 'seen' then 1 when changes then revision + 1 else revision end,
   case when not known and kind = 'seen' then case when fresh then 'done' else 'open' end when not changes then workflow when kind in ('seen', 'reopen') then 'open' when kind = 'snooze' then 'snoozed' else 'done' end,
   case when changes and kind = 'snooze' then til when changes then null else until_ end, woke,
   case when not known and kind = 'seen' then 'first' when kind = 'seen' then case when changes then 'source-reopened' end when refused is not null then 'refused' when kind = 'snooze' then 'snoozed' when kind = 'reopen' then 'reopened' else 'reviewed' end,
   case when kind <> 'seen' then coalesce(refused, case when kind in ('snooze', 'reopen') then null else kind end) end from (
   select *, case when kind = 'seen' then known and snap <> snapshot else refused is null end as changes, kind = 'seen' and (not known or snap <> snapshot) as seen_new from (
    select *, case when kind = 'seen' then null when not known then 'unknown-subject' when snap <> snapshot then 'stale-snapshot' when rev <> revision then 'stale-revision' when kind in ('understood', 'decided') and not noted then 'note-required'
      when kind = 'snooze' and til <= at_ then 'past' when kind = 'snooze' and til - at_ > 31536000000 then 'too-long' end as refused from (
     select r.*, w.snapshot, w.revision is not null as known, case when w.workflow = 'snoozed' and w.until_ <= r.at_ then w.revision + 1 else w.revision end as revision, case when w.workflow = 'snoozed' and w.until_ <= r.at_ then 'open' else w.workflow end as workflow,
      case when w.workflow = 'snoozed' and w.until_ <= r.at_ then null else w.until_ end as until_, case when w.workflow = 'snoozed' and w.until_ <= r.at_ then w.until_ end as woke from w join r on r.slug = w.slug and r.n = w.n + 1)))),
 p as (select *, lag(snapshot) over v as ps, lag(revision) over v as pr, lead(n) over v as following from w window v as (partition by slug order by n)), top as (select max(at_) as mark from r)
 select slug, at_ as at, seq, snapshot, revision, workflow, case when event <> 'first' then event end as event, outcome from p where event is not null
 union all select slug, woke, -1, ps, pr + 1, 'open', 'reopened', null from p where woke is not null
 union all select slug, until_, -1, snapshot, revision + 1, 'open', 'reopened', null from p, top where following is null and workflow = 'snoozed' and until_ <= mark""",
}
