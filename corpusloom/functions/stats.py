"""Quantiles, ranks, z-scores and agreement, defined as the reports need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import written


def entropy(values: Column) -> Column:
    """Shannon entropy in bits of the elements of an array; 0 for an empty one."""
    n = F.size(values)
    counted = F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)) / n)
    return F.when(n > 0, F.aggregate(counted, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """Null, not zero, where there is nothing to divide by."""
    return F.when(whole > 0, part / whole)


def running_sums(df: DataFrame, order: str, measure: str, out: str) -> DataFrame:
    """``df`` with the sum of ``measure`` up to each row, in the order of a column without ties.

    Rows are ranged and summed in their ranges; a range adds what the ranges before it sum up to. So no
    task orders them all: what meets is one row a range.
    """
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(F.sum(measure).alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum(measure).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_within")).drop("_at", "_part", "_within", "_before")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the average rank of ``value`` (ties share theirs); null values have none.

    Ranks come from counts by distinct value and their running sums; rows are never gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranks = running_sums(counts, value, "_n", "_up").withColumn(out, F.col("_up") - (F.col("_n") - 1) / 2).drop("_n", "_up")
    return df.join(ranks, value, "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho): rank correlation; rho is null, not 0, if either side has no variance."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(both, a, "_ra"), b, "_rb")
    # corr() itself divides by zero without variance
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    return ranked.agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_ra", "_rb"), spread).alias("rho"))


def z_scores(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Long form (all other columns, metric, value, z): population z-scores over values that are not null; sd 0 gives none.

    The measures are written once, as they are read twice: for the norms, and beside them.
    """
    df = written(df, "measures")
    others = [c for c in df.columns if c not in metrics]
    long = df.select(*others, F.expr(f"stack({len(metrics)}, {', '.join(f"'{m}', cast(`{m}` as double)" for m in metrics)}) as (metric, value)")).where("value is not null")
    norms = long.groupBy("metric").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    # One row a metric.
    return long.join(F.broadcast(norms), "metric").where("_sd > 0").withColumn("z", (F.col("value") - F.col("_mean")) / F.col("_sd")).drop("_mean", "_sd")
