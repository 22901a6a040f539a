"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, shuffle_partitions, written

#: Rows that one task of the reduction tree pairs at once: the tree's fan-in.
FAN_IN = 4096
#: Repeated rows (same doc_id, source and text) that stay together when they are dealt into groups.
REPEATS = 256
EPS = 1e-12


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, target) of each source, from (source, source_size).

    Sources in code point order, null last, get ``weights`` in turn and share the total of all
    sizes by weight; none gets more than ``most`` times its size, and the excess is shared again.
    The capped sources are those with the least size per weight: in that order, the first source
    whose share of what the capped ones leave is within its cap ends them. One row a source, so
    the windows over all sources hold as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    every, order = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap") * (1 + EPS))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _uniforms(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and seed alone (a 64-bit finaliser of shifts and products)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) / float(1 << 53)


def _settled(p: float) -> bool:
    return p <= EPS or p >= 1 - EPS


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> int | None:
    """Round the copy probabilities ``p`` in place by pairs; the row that stays fractional, or None.

    Of two units, words move from one to the other, size * p of both together staying the same,
    until one is all or nothing; the direction is drawn so that each probability keeps its mean.
    While all open rows have one probability, as at first, the pair is the largest open row and
    all smaller ones as a unit, which keep one probability: so large documents are settled while
    there are many words to balance them, and the row left is the smallest. Rows of different
    probabilities are paired one by one, large ones first.
    """
    for i in range(len(p)):
        if size[i] == 0 or _settled(p[i]):
            p[i] = round(p[i]) if size[i] else 0.0
    open_rows = [int(i) for i in np.argsort(-size, kind="stable") if size[i] and not _settled(p[i])]
    if len(open_rows) > 1 and np.ptp(p[open_rows]) < EPS:
        return _pivot_with_rest(size, p, u, open_rows)
    return _pivot_by_twos(size, p, u, open_rows)


def _moved(words_a: tuple[float, float], words_b: tuple[float, float], draw: float) -> float:
    """Words that go to a from b (negative: to b from a); each pair is (words in it, words it can still take)."""
    to_a, to_b = min(words_a[1], words_b[0]), min(words_a[0], words_b[1])
    return to_a if draw * (to_a + to_b) < to_b else -to_b


def _pivot_with_rest(size: np.ndarray, p: np.ndarray, u: np.ndarray, open_rows: list[int]) -> int | None:
    shared, rest = float(p[open_rows[0]]), float(size[open_rows].sum())
    for k, i in enumerate(open_rows[:-1]):
        rest -= size[i]
        words = _moved((shared * size[i], (1 - shared) * size[i]), (shared * rest, (1 - shared) * rest), u[i])
        p[i] = shared + words / size[i]
        shared -= words / rest
        if _settled(shared):
            p[open_rows[k + 1 :]] = round(shared)
            if _settled(p[i]):
                p[i] = round(p[i])
                return None
            return i
        p[i] = round(p[i])
    p[open_rows[-1]] = shared
    return open_rows[-1]


def _pivot_by_twos(size: np.ndarray, p: np.ndarray, u: np.ndarray, open_rows: list[int]) -> int | None:
    held = None
    for i in open_rows:
        if held is None:
            held = i
            continue
        words = _moved((p[held] * size[held], (1 - p[held]) * size[held]), (p[i] * size[i], (1 - p[i]) * size[i]), u[i])
        p[held] += words / size[held]
        p[i] -= words / size[i]
        if _settled(p[held]):
            p[held], held = round(p[held]), i
        if _settled(p[i]):
            p[i] = round(p[i])
            held = None if held == i else held
    return held


def row_key(doc_id: str, source: str, text: str) -> Column:
    """64-bit hash of what tells rows apart; null and empty or zero differ."""
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, F.col(source).isNull(), source, F.col(text).isNull(), text)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """How often each document is taken, so that each source's words come near its target.

    Returns the rows' doc_id and source with row_key, size (words), source_size, target (the
    source's), copies (int) and taken (copies * size). A document's expected copies are target
    over source_size; the whole part is given, the fraction p is rounded by pairs: ``pivot``
    moves words from one document of a source to another until one of them is all or nothing.
    That is done in groups of about FAN_IN rows; the one open row of each group goes on to the
    next level, where groups are FAN_IN times as large, until a source has one open row, which is
    rounded to the nearer side. So a source misses its target by half of one document at most.

    Groups hold a share of one source by hash, so a hot source is many groups. Only (ids, size,
    source) are shuffled. Repeated rows are counted first and dealt in blocks of REPEATS, so they
    are many groups too. All draws depend on seed, doc_id, source and text alone, so reruns agree.
    What grows with the number of sources only (one row each) is ordered in one task and broadcast.

    Cases: a null text has size 0 and is never taken; a null source is a source, ordered last;
    null doc_ids count as one id; repeated rows have one row_key and are rounded one by one (which
    of them is taken makes no difference); texts of any length are counted whole; an empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select("doc_id", "source", word_count("text").alias("size"), row_key("doc_id", "source", "text").alias("row_key")),
        "mix-rows",
    )
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    # One row a source.
    facts = written(
        per_source.join(counts, per_source["source"].eqNullSafe(counts["source"])).select(per_source["source"], "source_size", "target", "n"),
        "mix-sources",
    )
    largest = facts.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(largest, 2), FAN_IN)))
    share = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    copied = facts.withColumnRenamed("source", "of")
    # Blocks of repeated rows; all but a few are blocks of one row.
    counted = rows.groupBy("doc_id", "source", "row_key", "size").agg(F.count("*").alias("times"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))))
    level = (
        blocks.join(F.broadcast(copied), blocks["source"].eqNullSafe(copied["of"]))
        .select("doc_id", "source", "row_key", "size", "times", "block", "source_size", "target", "n", F.floor(share + EPS).cast("int").alias("whole"), F.greatest(F.lit(0.0), share - F.floor(share + EPS)).alias("p"))
        .withColumn("open", F.lit(True))
    )
    settled = []
    columns = ["doc_id", "source", "row_key", "draw_key", "size", "source_size", "target", "whole", "p"]
    for k in range(levels):
        final = k == levels - 1
        groups = F.lit(1) if final else F.ceil(F.col("n") / F.lit(float(FAN_IN) ** (k + 1))).cast("long")
        key = ["row_key", "block"] if k == 0 else ["draw_key"]
        grouped = level.withColumn("cell", F.pmod(F.xxhash64(*key, F.lit(seed)), groups))
        parts = max(1, min(shuffle_partitions(spark), 1 << 15))
        dealt = grouped.repartition(parts, "source", "cell")
        if k == 0:  # each row of a block draws by its own key
            member = F.explode(F.sequence(F.col("block") * REPEATS, F.least(F.col("times"), (F.col("block") + 1) * REPEATS) - 1))
            dealt = dealt.withColumn("member", member).withColumn("draw_key", F.when(F.col("member") == 0, F.col("row_key")).otherwise(F.xxhash64("row_key", "member")))
            dealt = dealt.drop("times", "block", "member")
        done = written(_rounded(dealt, seed + k, final), f"mix-level{k}")
        settled.append(done.where(~F.col("open")).select(*columns))
        level = done.where("open")
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    copies = F.col("whole") + F.col("p").cast("int")
    return result.select("doc_id", "source", "row_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _rounded(dealt: DataFrame, seed: int, final: bool) -> DataFrame:
    """One level of the tree: rows sorted by group stream through each task, and each group is rounded as it ends."""
    order = [F.col("source").isNull(), "source", "cell", "draw_key", "doc_id"]
    schema = dealt.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
            if not len(rows):
                held = []
                continue
            groups = _group_numbers(rows)
            last = groups[-1]
            whole = int(np.searchsorted(groups, last))
            if whole:
                yield _round_groups(rows.iloc[:whole].reset_index(drop=True), groups[:whole], seed, final)
            held = [rows.iloc[whole:].reset_index(drop=True)]
        if held and len(rows := pd.concat(held, ignore_index=True)):
            yield _round_groups(rows, _group_numbers(rows), seed, final)

    return dealt.sortWithinPartitions(*order).mapInPandas(run, schema)


def _group_numbers(rows: pd.DataFrame) -> np.ndarray:
    """0, 1, 2 for the consecutive groups of equal (source, cell)."""
    source, cell = rows["source"].fillna("").to_numpy(dtype=object), rows["cell"].to_numpy()
    null = rows["source"].isna().to_numpy()
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (source[1:] != source[:-1]) | (null[1:] != null[:-1]) | (cell[1:] != cell[:-1])
    return np.cumsum(new) - 1


def _round_groups(rows: pd.DataFrame, groups: np.ndarray, seed: int, final: bool) -> pd.DataFrame:
    p, size = rows["p"].to_numpy(dtype=float, copy=True), rows["size"].to_numpy(dtype=float)
    u = _uniforms(rows["draw_key"].to_numpy(), seed)
    is_open = np.zeros(len(rows), dtype=bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([-1], groups, [groups[-1] + 1]))))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = p[a:b]
        left = pivot(size[a:b], part, u[a:b])
        if left is not None:
            if final:
                part[left] = round(part[left])
            else:
                is_open[a + left] = True
    return rows.assign(p=p, open=is_open)
