"""Sentences that several readers flag in near the same words: a similarity join by prefixes, then representatives in order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import written

KEPT = pa.schema([("group", pa.string()), ("key", pa.string()), ("readers", pa.int64()), ("flags", pa.int64())])


def similar_pairs(rows: DataFrame, group: str, key: str, text: str, above: float, together: int = 1_000_000) -> DataFrame:
    """(group, a, b, dice) for a <= b: keys of one group whose texts' bigrams, counted as often as they occur, have a Dice similarity over ``above``.

    A text is kept as a count for each bigram, and what has about the right length is counted exactly, whatever the way by which pairs were found: where
    a group's pairs are no more than its texts' counts, as with a few long texts, all of them are; elsewhere those that share one of the first few elements of either.
    There a bigram's n-th occurrence is an element of its own, so texts are sets. With elements in one order, the
    rarest bigrams first, two such sets share one of the first |x| - ceil(|x| * t / (2 - t)) + 1 of either. A text without bigrams is like none, not even itself.

    Pairs are counted in cells of a group: two parts of its texts, each with about ``together`` counts, which is one cell for most groups.
    """
    each = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(text).alias("text")).where("length(text) > 1").dropDuplicates(["group", "key"])
    types = {f.name: f.dataType.simpleString() for f in each.schema}
    texts = written(each.mapInArrow(_bigrams, f"group {types['group']}, key {types['key']}, n long, gram array<long>, c array<int>"), "bigrams")
    sizes = texts.groupBy("group").agg(F.count("*").alias("texts"), F.sum(F.size("gram")).alias("counts"))
    sizes = sizes.select("group", (F.col("texts") * F.col("texts") > F.col("counts")).alias("many"), (F.floor(F.col("counts") / together) + 1).alias("parts"))
    # Rounding must not shorten a prefix: a little less than the share is taken.
    share, n = above / (2 - above) - 1e-9, F.col("n")
    fits = (F.col("a") <= F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * share)
    of = lambda df, c: df.select("group", F.col("key").alias(c), F.col("n").alias(f"n_{c}"))
    few = texts.join(sizes.where("not many"), "group", "left_semi").select("group", "key", "n")
    every = of(few, "a").join(of(few, "b"), "group").where(fits).select("group", "a", "b")

    counted = texts.join(sizes.where("many"), "group", "left_semi").select("group", "key", "n", F.explode_outer(F.arrays_zip("gram", "c")).alias("e")).select("group", "key", "n", "e.gram", "e.c")
    spread = counted.groupBy("gram").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("group", "key").orderBy("rows", "gram").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = counted.join(spread, "gram").select("group", "key", "n", "gram", "c", (n - F.ceil(n * share) + 1 - before).alias("left"))
    # Of a bigram's occurrences the last ones come first, so those of a prefix are the ones above ``low``.
    prefix = ordered.where("left > 0").select("group", "key", "n", "c", F.greatest(F.lit(0), F.col("c") - F.col("left")).alias("low"), F.col("gram").alias("e"))
    left, right = (prefix.select("group", "e", F.col("key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "c", "low")]) for c in ("a", "b"))
    # A pair meets at each element that both prefixes hold, so it is made one by its keys alone; the counts follow once.
    shared = left.join(right, ["group", "e"]).where(fits & (F.least("c_a", "c_b") > F.greatest("low_a", "low_b"))).select("group", "a", "b").distinct()

    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    cells = every.unionByName(shared).join(sizes, "group").select(F.col("group").alias("of_group"), (part("a") * F.col("parts") + part("b")).alias("of_cell"), "a", "b")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    of_cells = F.array_distinct(F.concat(F.transform(others, lambda p: part("key") * F.col("parts") + p), F.transform(others, lambda p: p * F.col("parts") + part("key"))))
    dealt = texts.join(sizes, "group").select("group", F.explode_outer(of_cells).alias("cell"), "key", "n", "gram", "c")
    out = f"group {types['group']}, a {types['key']}, b {types['key']}, dice double"
    return dealt.groupBy("group", "cell").cogroup(cells.groupBy("of_group", "of_cell")).applyInArrow(_counted_pairs, out).where(F.col("dice") > above)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, key, n, gram, c) of texts (group, key, text): the pairs of signs that follow one another in a text, as a number of both, how often each does, and how many they are."""
    for batch in batches:
        n, found, counts = [], [], []
        for text in batch.column("text"):
            signs = np.frombuffer(text.as_buffer().to_pybytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
            # Signs are numbered within the text, so that its pairs are few numbers, which are counted in a table where that is not much longer than the text.
            there = np.zeros(int(signs.max()) + 1, dtype=bool)
            there[signs] = True
            own = np.flatnonzero(there)
            number = np.zeros(len(there), dtype=np.int64)
            number[own] = np.arange(len(own))
            pairs = number[signs[:-1]] * len(own) + number[signs[1:]]
            if len(own) ** 2 <= 4 * len(signs):
                count = np.bincount(pairs)
                gram = np.flatnonzero(count)
                count = count[gram]
            else:
                gram, count = np.unique(pairs, return_counts=True)
            n.append(len(pairs))
            found.append(own[gram // len(own)] << 32 | own[gram % len(own)])
            counts.append(count)
        if n:
            ends = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in found])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t))) for x, t in ((found, np.int64), (counts, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("key"), pa.array(n, pa.int64()), *lists], names=["group", "key", "n", "gram", "c"])


def _counted_pairs(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """(group, a, b, dice) of pairs (a, b), from the counts of both: each text's counts are laid out once, beside those of all it is paired with."""
    keys, lists = texts.column("key").combine_chunks(), texts.column("gram").combine_chunks()
    n, ends = texts.column("n").to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    grams, c = lists.flatten().dictionary_encode(), texts.column("c").combine_chunks().flatten().to_numpy()
    gram = grams.indices.to_numpy()
    a, b = (pc.index_in(pairs.column(x).combine_chunks(), keys).to_numpy(zero_copy_only=False) for x in ("a", "b"))
    dice, laid = np.zeros(len(a)), np.zeros(len(grams.dictionary), dtype=np.int64)
    by_a = np.argsort(a, kind="stable")
    for own in np.split(by_a, np.flatnonzero(np.diff(a[by_a])) + 1) if len(a) else []:
        here = slice(ends[a[own[0]]], ends[a[own[0]] + 1])
        laid[gram[here]] = c[here]
        both = [np.minimum(laid[gram[ends[m]:ends[m + 1]]], c[ends[m]:ends[m + 1]]).sum() for m in b[own]]
        dice[own] = 2 * np.array(both) / (n[a[own]] + n[b[own]])
        laid[gram[here]] = 0
    return pairs.select(["of_group", "a", "b"]).rename_columns(["group", "a", "b"]).append_column("dice", pa.array(dice, pa.float64()))


def consensus(flagged: DataFrame, above: float = 0.6, least: int = 2, group_least: DataFrame | None = None) -> DataFrame:
    """(group, key, readers, flags): representatives of sentences (group, reader, key, sentence) that ``least`` readers flag or more, or as many as ``group_least`` (group, least) says.

    A sentence's readers are those who flag one that is similar to it, its own among them. In the order of
    keys, a sentence with enough readers represents those similar to it, unless one that already does is similar to it. ``flags`` counts the flags similar to
    it. Keys are in the order in which readers and their sentences are taken; a group's sentences are chosen in one task, from pairs found before.
    """
    # Several steps read the pairs, so they are found once.
    pairs = written(similar_pairs(flagged, "group", "key", "sentence", above), "similar-pairs")
    both = pairs.select("group", F.col("a").alias("key"), F.col("b").alias("other")).union(pairs.where("a <> b").select("group", F.col("b"), F.col("a")))
    readers = flagged.select("group", F.col("key").alias("other"), "reader").distinct()
    judged = both.join(readers, ["group", "other"]).groupBy("group", "key").agg(F.count_distinct("reader").alias("readers"), F.count_distinct("other").alias("flags")).where(F.col("readers") >= least)
    if group_least is not None:
        judged = judged.join(group_least, "group").where(F.col("readers") >= F.col("least")).drop("least")
    strong = both.join(judged.select("group", "key"), ["group", "key"], "left_semi").join(judged.select("group", F.col("key").alias("other")), ["group", "other"], "left_semi")
    lists = strong.where("other < key").groupBy("group", "key").agg(F.collect_set("other").alias("earlier"))
    rows = judged.join(lists, ["group", "key"], "left").select(F.col("group").cast("string").alias("group"), F.col("key").cast("string").alias("key"), F.transform(F.coalesce("earlier", F.array().cast(lists.schema["earlier"].dataType)), lambda k: k.cast("string")).alias("earlier"), "readers", "flags", F.col("key").alias("_order"))

    def chosen(table: pa.Table) -> pa.Table:
        kept, out = set(), []
        for row in sorted(table.to_pylist(), key=lambda r: r["_order"]):
            if not kept & set(row["earlier"]):
                kept.add(row["key"])
                out.append({c: row[c] for c in KEPT.names})
        return pa.Table.from_pylist(out, schema=KEPT)

    return rows.groupBy("group").applyInArrow(chosen, "group string, key string, readers long, flags long")


def prefix_length(n: int, above: float) -> int:
    """How many elements of a set of ``n`` must be looked at, as in ``similar_pairs``."""
    return n - math.ceil(n * (above / (2 - above) - 1e-9)) + 1
