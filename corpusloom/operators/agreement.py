"""Agreement of labels, gates over panels, least squares and string similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, exact share and mean absolute error."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.avg(F.abs(F.col(a) - F.col(b)).cast("double")).alias("mae"))


def binary_accuracy(pairs: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """One row: n, and the share on the same side of the threshold."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), F.avg(((F.col(a) >= threshold) == (F.col(b) >= threshold)).cast("double")).alias("accuracy"))


def normal_sums(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """One row of the sums that the normal equations of y on xs (with intercept) consist of."""
    of = ["1", *xs]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    products = [F.sum(value(of[i]) * value(of[j])).alias(f"s_{of[i]}_{of[j]}") for i in range(len(of)) for j in range(i, len(of))]
    return rows.agg(*products, *[F.sum(value(c) * F.col(y)).alias(f"t_{c}") for c in of])


def _solved(sums: pa.Table, width: int) -> list[tuple]:
    """Weights of standardised measures from rows of sums (n, x sums, products, y sums): of each row, and of all rows but it."""
    rows = np.array(sums.to_pylist(), dtype=object)
    table = np.array([[r["n"], *r["x"], *r["xx"], r["y"], *r["xy"]] for r in rows], dtype=np.float64)
    whole = table.sum(axis=0)

    def weights(s: np.ndarray) -> list[float] | None:
        n, mean, products, y, cross = s[0], s[1 : 1 + width] / s[0], s[1 + width : 1 + width + width * width].reshape(width, width) / s[0], s[-1 - width] / s[0], s[-width:] / s[0]
        spread = np.sqrt(np.maximum(np.diag(products) - mean * mean, 0))
        spread[spread == 0] = 1.0
        covariance = products - np.outer(mean, mean)
        try:
            return np.linalg.solve(covariance / np.outer(spread, spread), (cross - mean * y) / spread).tolist() if n > 0 else None
        except np.linalg.LinAlgError:
            return None

    return [(r["group"], int(r["n"]), weights(t), weights(whole - t) if len(rows) > 1 else None) for r, t in zip(rows, table, strict=True)]


def fit_weights(rows: DataFrame, group: str, xs: list[str], y: str) -> DataFrame:
    """(group, n, weights, others): least squares of y on the standardised xs, in each group and in all rows but the group's.

    Only sums meet: one row a group has all that the normal equations need, and leaving a group out is to take its sums
    from the total. Weights are null where the equations have no single solution.
    """
    full = rows.select(F.col(group).cast("long").alias("group"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna()
    of = lambda *columns: F.array(*[F.sum(c) for c in columns])
    sums = full.groupBy("group").agg(
        F.count("*").alias("n"), of(*[F.col(x) for x in xs]).alias("x"), of(*[F.col(a) * F.col(b) for a in xs for b in xs]).alias("xx"), F.sum(y).alias("y"), of(*[F.col(x) * F.col(y) for x in xs]).alias("xy"))
    schema = pa.schema([("group", pa.int64()), ("n", pa.int64()), ("weights", pa.list_(pa.float64())), ("others", pa.list_(pa.float64()))])
    width = len(xs)

    def solved(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*_solved(table, width), strict=True), schema.types, strict=True)], schema=schema)

    # One row a group.
    return sums.groupBy().applyInArrow(solved, "group long, n long, weights array<double>, others array<double>")


def held_out_agreement(rows: DataFrame, fitted: DataFrame, group: str, xs: list[str], y: str, fixed: dict[str, list[float]]) -> DataFrame:
    """(group, n, one column for each of ``fixed``, fitted, held_out): rank correlation of y with weighted sums of the xs, standardised in the group.

    Weights are the fixed ones, those of ``fit_weights`` for the group, and those of the other groups.
    Sums that agree to nine digits are ties. Null where a side has no variance.
    """
    full = rows.select(F.col(group).cast("long").alias("group"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna()
    norms = full.groupBy("group").agg(*[f(x).alias(f"{n}_{x}") for x in xs for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    joined = full.join(F.broadcast(norms), "group").join(F.broadcast(fitted), "group")
    z = [(F.col(x) - F.col(f"mean_{x}")) / F.when(F.col(f"sd_{x}") > 0, F.col(f"sd_{x}")).otherwise(1.0) for x in xs]
    weighted = lambda ws: F.round(sum((w * v for w, v in zip(ws, z, strict=True)), F.lit(0.0)), 9)
    scores = {name: weighted([F.lit(w) for w in ws]) for name, ws in fixed.items()} | {n: weighted([F.col(c)[i] for i in range(len(xs))]) for n, c in (("fitted", "weights"), ("held_out", "others"))}
    scored = joined.select("group", F.round(y, 9).alias("_y"), *[s.alias(n) for n, s in scores.items()])
    out = scored.groupBy("group").agg(F.count("*").alias("n"))
    for name in scores:
        pairs = scored.select("group", F.col("_y").alias("a"), F.col(name).alias("b")).dropna()
        for side in ("a", "b"):
            # Ranks come from counts by value, so what a task orders is a group's distinct values.
            counts = pairs.groupBy("group", side).agg(F.count("*").alias("_n"))
            ranks = counts.withColumn(f"r{side}", F.sum("_n").over(Window.partitionBy("group").orderBy(side)) - (F.col("_n") - 1) / 2).drop("_n")
            pairs = pairs.join(ranks, ["group", side])
        rho = F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))
        out = out.join(pairs.groupBy("group").agg(rho.alias(name)), "group", "left")
    return out


def panel_gate(scores: DataFrame, group: str, score: str, least: float, most_failed: int) -> DataFrame:
    """(group, n, median, failed, reason) per section: gates on the median score and on how many fall below ``least``."""
    of = scores.groupBy(group).agg(F.count(score).alias("n"), F.median(score).alias("median"), F.count_if(F.col(score) < least).alias("failed"))
    reason = F.when(F.col("n") == 0, "no-ratings").when(F.col("median") < least, "median").when(F.col("failed") > most_failed, "failures").otherwise("pass")
    return of.withColumn("reason", reason)


def bigrams(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float) -> DataFrame:
    """(left_key, right_key, dice) of texts that share bigrams: multiset Dice of ``least`` or more, by an equi-join on bigrams."""
    of = lambda df, key, n: df.select(F.col(key), F.explode(bigrams(F.col("text"))).alias("g")).groupBy(key, "g").agg(F.count("*").alias(n))
    a, b = of(left, left_key, "na"), of(right, right_key, "nb")
    common = a.join(b, "g").groupBy(left_key, right_key).agg(F.sum(F.least("na", "nb")).alias("common"))
    ta, tb = a.groupBy(left_key).agg(F.sum("na").alias("ta")), b.groupBy(right_key).agg(F.sum("nb").alias("tb"))
    return common.join(ta, left_key).join(tb, right_key).select(left_key, right_key, (2 * F.col("common") / (F.col("ta") + F.col("tb"))).alias("dice")).where(F.col("dice") >= least)
