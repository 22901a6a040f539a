"""Panels, rounds, explanations and batches, from ``documents``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import panels as P
from corpusloom.plans.freshness import inventory
from corpusloom.plans.presentation import PROSE
from corpusloom.sources import table


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def panel_reasons(spark, sf):
    """Forty documents are what the readers of one note say; the first of them is its body."""
    k = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf, "documents").select(k, F.floor(k / 40).alias("note"), (k % 4).alias("reader"), text.alias("text"))
    body = F.col("text")
    for old, new in PROSE[:5]:
        body = F.replace(body, F.lit(old), F.lit(new))
    notes = d.where("doc_id % 40 = 1").select("note", body.alias("body"))
    readers = d.where("doc_id % 40 < 4").select("note", "reader", (k % 3 + F.col("note") % 3 + 1).cast("double").alias("overall"), ((k + F.col("note")) % 9 > 0).alias("retells"), F.when(k % 2 == 0, (k % 5).cast("double")).alias("concreteness"))
    sections = d.select("note", "reader", _pick(["one", "two", "进阶", "a Callout", "three"], F.floor(k / 4) % 5).alias("section"), ((k * 7) % 6).cast("double").alias("score"))
    flagged = d.select("note", "reader", F.col("doc_id").alias("key"), F.col("text").alias("sentence"))
    claims = d.where("doc_id % 40 = 7").select("note", _pick(["unsupported", "misleading", "fine"], F.col("note") % 3).alias("verdict"))
    found = P.panel_reasons(notes, readers, sections, flagged, claims, P.Limits(unclear=1, section=2, overall=3, concreteness=2))
    return found.withColumn("reasons", F.array_join("reasons", ","))


def best_rounds(spark, sf):
    """Orders of a customer are rounds of a page, their lines readings."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rounds = o.select(F.col("o_custkey").alias("page"), k.alias("round"), F.when(F.col("o_custkey") % 2 == 0, "general").otherwise("dev").alias("audience"), (k % 3 % 2).alias("other_reasons"), F.when(k % 5 == 0, 1).otherwise(0).alias("unsupported"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("round"), F.monotonically_increasing_id().alias("reader"), (F.col("l_quantity") % 8).alias("unclear"), (F.col("l_partkey") % 6).cast("double").alias("breaks"), (F.col("l_suppkey") % 3 > 0).alias("retells"))
    readings = lines.join(rounds.select("page", "round"), "round")
    return P.best_rounds(readings, rounds, {"general": 5, "dev": 4}, {"general": 4, "dev": 3})


def explained_again(spark, sf):
    d = table(spark, sf, "documents")
    notes = d.select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("body"))
    concepts = [P.Concept("c1", "th[ea] ", "src1", True), P.Concept("c2", "Onan|tion", "src2/en/2", False), P.Concept("c3", "zzzz", "src3", True)]
    return P.explained_again(notes, concepts, 400, "ing|de ")


def dealt_files(spark, sf):
    """Files with few names in the directories of a source, thirteen to a batch."""
    k = F.col("doc_id")
    files = inventory(spark, sf).select(F.col("source").alias("unit"), F.concat(F.lit("d"), k % 7, F.lit("/f"), F.floor(k / 20) % 23).alias("path"))
    return P.batches(files.distinct(), 13)


QUERIES = {"agg32_panel_reasons": panel_reasons, "fld30_best_rounds": best_rounds, "joi40_explained_again": explained_again, "fld20_dealt_files": dealt_files}

ORACLE_SQL = {
    "fld30_best_rounds": """with r as (select o_custkey as page, o_orderkey as round, o_custkey % 2 = 0 as general, o_orderkey % 3 % 2 as other, case when o_orderkey % 5 = 0 then 1 else 0 end as un from orders),
 m as (select l_orderkey as round, median(l_quantity % 8) as unclear, median((l_partkey % 6)::double) as breaks, count(*) filter (l_suppkey % 3 > 0) as told from lineitem group by 1),
 j as (select page, r.round, other + (unclear > case when general then 5 else 4 end)::int + (breaks > case when general then 4 else 3 end)::int + (told < 2)::int + un as reasons, unclear, breaks, un from r join m using (round)), p as (select *, reasons * 2 + unclear + breaks * 2 + un * 3 as penalty from j)
 select page, round, reasons = 0 as passes, reasons, penalty, row_number() over (partition by page order by reasons > 0, case when reasons > 0 then penalty else 0 end, round) = 1 as best from p""",
    "joi40_explained_again": """with p as (select source || '/' || lang || '/' || doc_id as path, unnest(regexp_split_to_array(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\\n\\n+')) as p from documents), c as (select * from (values ('c1', 'th[ea] ', 'src1', 'src1/'), ('c2', 'Onan|tion', 'src2/en/2', 'src2/en/2'), ('c3', 'zzzz', 'src3', 'src3/')) t(concept, pattern, home, prefix))
 select concept, path, sum(length(p)) + count(*) - 1 as chars, count(*) as paragraphs from p, c where regexp_matches(p, pattern) and path <> home and not starts_with(path, prefix) group by all having sum(length(p)) + count(*) - 1 >= 400 and bool_or(regexp_matches(p, 'ing|de '))""",
}
