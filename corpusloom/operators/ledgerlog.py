"""Append-only ledgers: entries chained by digest, appended once however often the append is repeated.

A log is a folder: tables of entries, and numbered commits that name the tables that count. A
commit is a file that is created only if there is none of its number, which is one step; what
was written without a commit is never read. So a job that is lost leaves the log as it was, one that is
repeated finds its events there, and of two writers the later chains its entries behind the other's.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.canonical import canonical_json, digest, serialized
from corpusloom.functions.hashing import stable_id
from corpusloom.operators.tables import spread

ENTRIES = "ledger string, place long, event string, content string, previous string, digest string"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _commits(spark: SparkSession, log: str) -> list[str]:
    """Tables of the log, by commit."""
    fs, folder = _files(spark, f"{log}/commits")
    if not fs.exists(folder):
        return []
    found = sorted((s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    # One small file an append, each with a table's name.
    return [json.loads(row.value)["table"] for row in spark.read.text([p for _, p in found], wholetext=True).orderBy("_metadata.file_name").collect()] if found else []


def _commit(spark: SparkSession, log: str, number: int, table: str) -> bool:
    """Whether the commit of this number could be made; another writer may have made it."""
    fs, path = _files(spark, f"{log}/commits/{number:012}.json")
    fs.mkdirs(path.getParent())
    try:
        out = fs.create(path, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception) or "already exists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(json.dumps({"table": table}).encode()))
    out.close()
    return True


def entries(spark: SparkSession, log: str, tables: list[str] | None = None) -> DataFrame:
    """(ledger, place, event, content, previous, digest) of all that is committed."""
    tables = _commits(spark, log) if tables is None else tables
    if not tables:
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).parquet(*[f"{log}/{t}" for t in tables])


def entry_digest(event: str, previous: str | None, content: str) -> str:
    """Digest of an entry: its event's id, the digest of the entry before it and its canonical content."""
    core = f'{{"event":{content},"eventId":{serialized(event)},"previousEntryDigest":{serialized(previous)}}}'
    return "sha256:" + hashlib.sha256(core.encode()).hexdigest()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ledger, place, event, content, tail) in order by ledger and place, each with the digest of the one before, the first with its tail's."""
    ledger, last = None, None
    for batch in batches:
        previous, digests = [], []
        for own, event, content, tail in zip(*(batch.column(c).to_pylist() for c in ("ledger", "event", "content", "tail")), strict=True):
            last = last if own == ledger else tail
            previous.append(last)
            ledger, last = own, entry_digest(event, last, content)
            digests.append(last)
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("ledger", "place", "event", "content")} | {"previous": pa.array(previous, pa.string()), "digest": pa.array(digests, pa.string())})


def identified(events: DataFrame, prefix: str = "event-", tag: str = "decision-event/v1") -> DataFrame:
    """(ledger, at, event, content, problem) of events (ledger, at, body): the id comes from the canonical body, so equal events are one.

    Bodies are parsed by all tasks that can run at once, however few the files' row groups are.
    """
    parsed = spread(events).select("ledger", "at", canonical_json(F.col("body")).alias("c"))
    return parsed.select("ledger", "at", F.when(F.col("c.json").isNotNull(), stable_id(prefix, tag, F.col("ledger"), F.col("c.json"))).alias("event"), F.col("c.json").alias("content"), F.coalesce("c.problem", F.when(F.col("c.json").isNull(), "no-json")).alias("problem"))


def append(events: DataFrame, log: str) -> DataFrame:
    """Append events (ledger, at, body as JSON) to a log, in order of ``at`` and id in each ledger; returns (ledger, event, status) of each distinct one.

    Status: ``append``, ``already-present``, ``broken-chain`` for a ledger whose last entry's digest isn't that of its
    content (nothing is appended to it), or the problem of a body without canonical form. Events are told apart by content: what the log has, or
    the call names twice, is appended once. The order of the ledgers' rows is made by one
    shuffle; a ledger's digests hang on each other, so its new entries pass through one task, row by row.
    """
    return append_identified(identified(events), log)


def append_identified(events: DataFrame, log: str) -> DataFrame:
    """``append`` of events that are ``identified`` already, so one who appends some of them again need not parse their bodies again."""
    spark = events.sparkSession
    staged = f"{log}/staged-{uuid.uuid4().hex}"
    events.groupBy("ledger", "event", "content", "problem").agg(F.min("at").alias("at")).write.parquet(staged)
    own = spark.read.parquet(staged)
    whole = own.where("problem is null")
    while True:
        tables = _commits(spark, log)
        known = entries(spark, log, tables)
        # A ledger's last place comes from numbers alone; its texts are those of that place only.
        last = known.groupBy("ledger").agg(F.max("place").alias("place"))
        tails = known.join(F.broadcast(last), ["ledger", "place"]).groupBy("ledger").agg(F.max_by(F.struct("place", "event", "content", "previous", "digest"), "place").alias("t"))
        core = F.concat(F.lit('{"event":'), "t.content", F.lit(',"eventId":"'), "t.event", F.lit('","previousEntryDigest":'), F.coalesce(F.concat(F.lit('"'), "t.previous", F.lit('"')), F.lit("null")), F.lit("}"))
        tails = tails.select("ledger", F.col("t.place").alias("last"), F.col("t.digest").alias("tail"), (digest(core) != F.col("t.digest")).alias("broken"))
        present = known.select("ledger", "event").distinct().withColumn("present", F.lit(True))
        marked = whole.join(present, ["ledger", "event"], "left").join(tails, "ledger", "left")
        status = F.when(F.col("present"), "already-present").when(F.col("broken"), "broken-chain").otherwise("append")
        judged = marked.select("ledger", "at", "event", "content", "last", "tail", status.alias("status"))
        order = Window.partitionBy("ledger").orderBy("at", "event")
        new = judged.where("status = 'append'").withColumn("place", F.coalesce("last", F.lit(-1)) + F.row_number().over(order))
        rows = new.select("ledger", "place", "event", "content", "tail").repartition("ledger").sortWithinPartitions("ledger", "place")
        table = f"entries-{uuid.uuid4().hex}"
        rows.mapInArrow(_chained, ENTRIES).write.parquet(f"{log}/{table}")
        made = spark.read.schema(ENTRIES).parquet(f"{log}/{table}")
        if made.isEmpty() or _commit(spark, log, len(tables), table):
            break
    # What the last round judged is what its commit made: both hang on the tables that were there before.
    return judged.select("ledger", "event", "status").unionByName(own.where("problem is not null").select("ledger", "event", F.col("problem").alias("status")))


def broken_entries(log_entries: DataFrame) -> DataFrame:
    """(ledger, place, problem): entries whose digest isn't that of their content, whose link isn't the digest before, or whose place is not the next."""
    w = Window.partitionBy("ledger").orderBy("place")
    core = F.concat(F.lit('{"event":'), "content", F.lit(',"eventId":"'), "event", F.lit('","previousEntryDigest":'), F.coalesce(F.concat(F.lit('"'), "previous", F.lit('"')), F.lit("null")), F.lit("}"))
    # Contents are digested where they are read; only links and places are sorted.
    own = log_entries.select("ledger", "place", "previous", "digest", (digest(core) != F.col("digest")).alias("other"))
    linked = own.withColumns({"before": F.lag("digest").over(w), "number": F.row_number().over(w) - 1})
    problem = F.when(F.col("other"), "digest").when(~F.col("previous").eqNullSafe(F.col("before")), "link").when(F.col("number") != F.col("place"), "place")
    return linked.select("ledger", "place", problem.alias("problem")).where("problem is not null")
