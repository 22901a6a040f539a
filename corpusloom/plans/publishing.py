"""Published cards and reports, hashes of a list and a memo of import specifiers, over ``documents`` and ``lineitem``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import imports as I
from corpusloom.operators import presentation as P
from corpusloom.operators.tables import shared_folder
from corpusloom.plans.freshness import INV, inventory
from corpusloom.plans.programs import EDGES, _programs
from corpusloom.sources import sinks as S
from corpusloom.sources import table


def _new(spark, name):
    return f"{shared_folder(spark)}/published/{name}-{uuid.uuid4().hex}"


def published_cards(spark, sf):
    """Cards of all pages are published, then those of every second page again with other limits: the others are gone."""
    l = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 8).alias("page"), F.concat(F.lit("m"), F.col("l_linenumber") % 2).alias("metric"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("path"), ((F.col("l_partkey") * 41 + F.col("l_orderkey")) % 397 - 190).cast("double").alias("z"))  # noqa: E741
    folder = _new(spark, "cards")
    S.publish(P.card_rows(l, "page", 5), folder, ["page"])
    S.publish(P.card_rows(l.where("page % 2 = 0"), "page", 12), folder, ["page"])
    return S.published(spark, folder, "metric string, path string, z double, rank int, page long")


def regenerated(spark, sf):
    """A report is made, made again, and made after its inputs changed."""
    folder, inv = _new(spark, "report"), inventory(spark, sf).select("path", "blob", "doc_id")
    statuses = [S.regenerate(lambda part=part: inv.where(part).select("path", "blob"), lambda: 0, folder) for part in ("true", "true", "doc_id % 2 = 0", "doc_id % 2 = 0")]
    final = S.published(spark, folder)
    return final.agg(F.count("*").alias("rows"), F.lit(",".join(statuses)).alias("statuses"))


def listed_hashes(spark, sf):
    inv = inventory(spark, sf)
    asked = inv.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("no/"), "path")).otherwise(F.col("path")).alias("path"))
    return S.hashes_of(asked.unionByName(asked), inv.where("doc_id % 5 > 0").select("path", F.when(F.col("doc_id") % 7 > 0, F.col("blob")).alias("blob")))


def memoized_imports(spark, sf):
    """What each file names, from a memo that half of the files filled before."""
    files, packages = _programs(spark, sf)
    keyed = files.where(F.regexp_like("path", F.lit(I.CODE_FILE))).withColumn("blob", F.sha1("text"))
    folder = _new(spark, "specifiers")
    S.memoized(keyed.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 0), folder, lambda t: F.array_distinct(I.specifiers(t)), "array<string>").count()
    found = S.memoized(keyed, folder, lambda t: F.array_distinct(I.specifiers(t)), "array<string>")
    named = found.select("path", F.explode("value").alias("spec"))
    roots = packages.groupBy("name").agg(F.max("root").alias("root"))
    return named.where(~F.col("spec").startswith(".")).select("path", I.package_name(F.col("spec")).alias("name")).join(roots, "name").select("path", "root").distinct()


QUERIES = {"snk5_published_cards": published_cards, "snk7_regenerated": regenerated, "src3_listed_hashes": listed_hashes, "stm6_memoized_imports": memoized_imports}

ORACLE_SQL = {
    "snk5_published_cards": "with l as (select l_suppkey % 8 as page, 'm' || l_linenumber % 2 as metric, l_orderkey || '-' || l_linenumber || '-' || l_partkey as path, ((l_partkey * 41 + l_orderkey) % 397 - 190)::double as z from lineitem where l_suppkey % 8 % 2 = 0) select *, row_number() over (partition by page order by abs(z) desc, metric, path, z) as rank from l qualify rank <= 12",
    "snk7_regenerated": "select count(*) as rows, case when count(*) < (select count(*) from documents) then 'written,unchanged,written,unchanged' else 'written,unchanged,unchanged,unchanged' end as statuses from documents where doc_id % 2 = 0",
    "src3_listed_hashes": f"""with {INV}, a as (select distinct case when doc_id % 3 = 0 then 'no/' || path else path end as path from inv), k as (select path, case when doc_id % 7 > 0 then blob end as blob, true as known from inv where doc_id % 5 > 0)
 select a.path, blob, case when known is null then 'missing' when blob is null then 'failed' else 'hashed' end as state from a left join k using (path)""",
    "stm6_memoized_imports": f"with {EDGES} select path, dst as root from pk",
}
