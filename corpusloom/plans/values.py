"""Pointers into JSON, lists as sets and batches in a seeded order, over ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import values as V
from corpusloom.sources import table


def _pick(values, index):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def pointed(spark, sf):
    k = F.col("event_id")
    text = F.concat(F.lit('{"a/b":['), k.cast("string"), F.lit(',{"~x":"'), F.col("event_type"), F.lit('"}],"":{"0":null,"k":'), F.coalesce("props", F.lit("{}")), F.lit("}}"))
    pointer = _pick(["/a~1b/0", "/a~1b/1/~0x", "//k/k", "//0", "/a~1b/01", "/a~1b/2", "/none", "x", "/~", "//k"], k % 10)
    return table(spark, sf, "events").select("event_id", V.at_pointer(text, pointer).alias("value"))


def lists(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("long") - 1)).alias("places"), F.collect_list(F.concat(F.lit("p:"), F.col("l_partkey") % 6, F.lit(":b"), F.col("l_suppkey"))).alias("bindings"))  # noqa: E741
    within = V.binding_paths_within(F.col("bindings"), F.array(*[F.lit(f"p:{i}") for i in range(5)]))
    return l.select("l_orderkey", V.is_dense(F.col("places")).alias("dense"), F.array_join(V.sorted_unique(F.transform("bindings", lambda b: F.substring(b, 3, 1))), ",").alias("kinds"), within.alias("within"))


def seeded_batches(spark, sf):
    """How many orders each batch of ten of a customer's group has, in a seeded order: that it deals all, each once."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("g"), "o_orderkey")
    place = F.row_number().over(Window.partitionBy("g").orderBy(V.seeded_key(42, F.col("o_orderkey")), "o_orderkey")) - 1
    return o.withColumn("batch", F.floor(place / 10)).groupBy("g", "batch").agg(F.count("*").alias("n"))


QUERIES = {"jsn3_pointed": pointed, "arr1_lists": lists, "srt16_seeded_batches": seeded_batches}

ORACLE_SQL = {
    "jsn3_pointed": """select event_id, case event_id % 10 when 0 then event_id::varchar when 1 then '"' || event_type || '"' when 2 then json_extract(props, '$.k')::varchar when 3 then 'null' when 9 then replace(coalesce(props, '{}'), ' ', '') end as value from events""",
    "arr1_lists": """with g as (select l_orderkey, list_sort(list(l_linenumber - 1)) as ps, list_sort(list_distinct(list((l_partkey % 6)::varchar))) as ks from lineitem group by 1) select l_orderkey, ps = range(0, len(ps)) as dense, array_to_string(ks, ',') as kinds, not list_contains(ks, '5') as within from g""",
    "srt16_seeded_batches": "with g as (select o_custkey % 100 as g, count(*) as c from orders group by 1), b as (select g, c, unnest(range(0, (c + 9) // 10)) as batch from g) select g, batch, least(10, c - 10 * batch) as n from b",
}
