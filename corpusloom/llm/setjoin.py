"""Exact Jaccard self-join of word shingles by universe partition and pigeonhole, and its components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import text_bytes, written

U = np.uint64
#: Words whose hashes a task remembers, and texts whose sets it remembers.
WORDS_HELD, SETS_HELD = 1 << 20, 64
#: Sets of one partition that emit their keys once only; beyond it they may do so again.
SEEN_HELD = 1 << 21
#: Shingles of sets whose keys are made together.
SHINGLES_HELD = 200_000
#: Rounds in which each bucket compares all members with one of them, before what is still apart is compared by rare shingles.
STAR_ROUNDS = 2


def mix(z: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser of shifts and products, for arrays of unsigned numbers."""
    with np.errstate(over="ignore"):
        z = z + U((0x9E3779B97F4A7C15 * (2 * salt + 1)) % (1 << 64))
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to WORDS_HELD."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(data: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a shorter text, the one hash of all its words; of no words, none.

    ``bytes.lower`` and ``bytes.split`` change and split ASCII only, which is what is asked for.
    """
    parts = data.lower().split()
    if not parts:
        return np.empty(0, U)
    h = np.array([hashes[w] for w in parts], dtype=U)
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        total = mix(h[: len(h) - n + 1], n)
        for i in range(1, n):
            total = mix(total * U(3) + h[i : len(h) - n + 1 + i], i)
    return np.unique(total)


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(s, 5)) + U(len(s))]), 6).view(np.int64)[0])


@dataclass(frozen=True)
class Scheme:
    """How the universe is cut for pairs whose larger set has ``low`` to ``high`` elements.

    Sets of a pair differ in at most ``differ`` elements. Each segment has an allocation: 1, the
    segment's subset itself is a key; 2, so are the subsets without one element. If allocations
    add up to more than ``differ``, then in some segment the two differ by less than its
    allocation, so they share a key. ``spare`` is what they add up to beyond that: as long as
    the segments in which a set has fewer than ``least`` elements take no more than the spare,
    keys of subsets below ``least`` elements, which many sets share by chance, are left out.
    """

    low: int
    high: int
    differ: int
    segments: int
    doubled: int
    spare: int
    least: int


class Schemes:
    """Size bands for a similarity num / den, with the cheapest allocation for each."""

    #: Rows that a key of two elements less costs more, by chance matches.
    CHANCE = 64.0

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]

    def band(self, size: int) -> int:
        """Number of the band: a set links only within its band and with the next ones above and below."""
        while self.lows[-1] <= size:
            low = self.lows[-1]
            self.lows.append(max(low + 1, (low - 1) * self.den // self.num + 1))
        return int(np.searchsorted(self.lows, size, "right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def scheme(self, band: int) -> Scheme | None:
        """None if sets of this band link with equal ones only."""
        while len(self.lows) < band + 2:
            self.band(self.lows[-1])
        low, high = self.lows[band], self.lows[band + 1] - 1
        differ = 2 * high * (self.den - self.num) // (self.den + self.num)
        if not differ:
            return None
        spare = 1 + differ // 16
        need = differ + 1 + spare

        def cost(doubled: int) -> float:
            size = low / (need - doubled)
            chance = lambda k: 1 + self.CHANCE * 2.0**-k
            return (need - 2 * doubled) * chance(size) + doubled * (size + 1) * chance(size - 1)

        doubled = min(range(need // 2 + 1) if need <= 64 else [0], key=cost)
        segments = need - doubled
        return Scheme(low, high, differ, segments, doubled, spare, 2 if low / segments >= 6 else 1)

    def keys(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(key, index of its set) of all ``sets``, under the scheme of each one's band and of the next, in which a larger partner may be."""
        by_band: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                band = self.band(len(s))
                for b in (band, band + 1):
                    if self.scheme(b):
                        by_band.setdefault(b, []).append(i)
        found = [self._keys([sets[i] for i in which], np.array(which), b) for b, which in by_band.items()]
        return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.empty(0, U), np.empty(0, np.int64))

    def _keys(self, sets: list[np.ndarray], names: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of sets under one band's scheme; a cell is a set's segment."""
        plan = self.scheme(band)
        every = np.concatenate(sets)
        cell = (mix(every, 11 + band) % U(plan.segments)).astype(np.int64) + np.repeat(np.arange(len(sets)) * plan.segments, [len(s) for s in sets])
        order = np.argsort(cell)
        cell, value = cell[order], mix(every, 7)[order]
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        counts = np.diff(np.concatenate((starts, [len(cell)])))
        owner, at = np.divmod(cell[starts], plan.segments)
        twice = at < plan.doubled
        total = lambda of: np.bincount(owner, of, len(sets)).astype(np.int64)
        weak = total(np.where(twice, 2 * (counts <= plan.least), counts < plan.least)) + (plan.segments - total(np.ones(len(at)))) + (plan.doubled - total(twice))
        small = weak > plan.spare
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(value, starts)
            keep = (counts >= plan.least) | small[owner]
            of, where, parts = [owner[keep]], [at[keep]], [sums[keep]]
            if small.any():  # their empty segments are keys too
                rows = np.flatnonzero(small)
                absent = np.ones((len(rows), plan.segments), dtype=bool)
                mine = small[owner]
                absent[np.searchsorted(rows, owner[mine]), at[mine]] = False
                row, segment = np.nonzero(absent)
                of, where, parts = [*of, rows[row]], [*where, segment], [*parts, np.zeros(len(row), U)]
            if plan.doubled:
                which = np.repeat(np.arange(len(at)), counts)
                out = twice[which] & ((counts[which] - 1 >= plan.least) | small[owner[which]])
                of, where, parts = [*of, owner[which[out]]], [*where, at[which[out]]], [*parts, sums[which[out]] - value[out]]
            keys = mix(np.concatenate(parts) + np.concatenate(where).astype(U) * U(0x9E3779B97F4A7C15), 1_000 + band)
        return keys, names[np.concatenate(of)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), text_bytes("text").alias("data"))


def _index(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """One pass over the texts: (key, node, null) rows of all sets, and a row (_, node, of) of each document.

    ``of`` is (doc_id, text_key, n_shingles); a document's node is its set's fingerprint, null for
    the empty set, and its key only spreads the rows. Equal sets within a partition emit their
    keys once.
    """
    of_type = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, schemes, seen, passed = WordHashes(), Schemes(num, den), set(), TaskContext.get().partitionId() << 40

        def emit(sets: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
            keys, which = schemes.keys(sets)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.array(nodes, np.int64)[which]), pa.nulls(len(keys), of_type)], names=["key", "node", "of"])

        for batch in batches:
            sets, nodes, held, sizes, of_rows = [], [], 0, [], []
            for data in batch.column("data"):
                s = shingles(data.as_py(), words, hashes)
                node = fingerprint(s) if len(s) else None
                sizes.append(len(s))
                of_rows.append(node)
                if node is None or node in seen:
                    continue
                if len(seen) < SEEN_HELD:
                    seen.add(node)
                sets.append(s)
                nodes.append(node)
                held += len(s)
                if held >= SHINGLES_HELD:
                    yield emit(sets, nodes)
                    sets, nodes, held = [], [], 0
            if sets:
                yield emit(sets, nodes)
            of = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64())], fields=list(of_type))
            spread = mix(np.arange(passed, passed + len(sizes), dtype=U), 3).view(np.int64)
            passed += len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(of_rows, pa.int64()), of], names=["key", "node", "of"])

    return _texts(docs).mapInArrow(run, "key long, node long, of struct<doc_id:bigint,text_key:bigint,n_shingles:bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b) whose sets have a Jaccard similarity of num / den or more, counted exactly."""
    first = texts.select(F.col("node").alias("a"), F.col("data").alias("data_a"))
    second = texts.select(F.col("node").alias("b"), F.col("data").alias("data_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[int, np.ndarray] = {}

        def of(node: int, data: pa.Scalar) -> np.ndarray:
            if node not in held:
                if len(held) >= SETS_HELD:
                    held.clear()
                held[node] = shingles(data.as_py(), words, hashes)
            return held[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                r, s = of(x, batch.column("data_a")[i]), of(y, batch.column("data_b")[i])
                both = len(np.intersect1d(r, s, assume_unique=True))
                if den * both >= num * (len(r) + len(s) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], names=["a", "b"])

    return pairs.join(first, "a").join(second, "b").mapInArrow(run, "a long, b long")


def components(spark: SparkSession, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of all nodes in ``links`` (a, b); label is the least node of the component.

    Each round, a node takes the least label of its neighbours, then that label's own label, so
    the number of rounds grows with the logarithm of the longest path; each is a written table.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    for k in count(1):
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("heard"))
        jump = labels.select(F.col("node").alias("heard"), F.col("label").alias("jump"))
        stepped = written(nearer.join(jump, "heard").select("node", F.col("label").alias("old"), F.least("heard", "jump").alias("label")), f"{name}-{k}")
        labels = stepped.select("node", "label")
        if stepped.where("old <> label").isEmpty():
            return labels


def shingle_components(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """Groups of ``docs`` (doc_id, text) whose sets of word shingles are linked by Jaccard similarity.

    Returns each row's doc_id, n_shingles and component_id, the least doc_id that links reach.
    Two rows link if their sets share at least ``similarity`` (a fraction) of their union; exactly:
    no candidate is left out or capped, and every link that counts was verified on whole sets.

    Rows with equal sets are one node, so copies never multiply. Sets emit keys by ``Schemes``;
    equal keys make a bucket. All pairs of a bucket would be quadratic, so a bucket first compares
    every member with one of them, then with its most central one; members that are then in one
    component need no more. Pairs still apart are found by their rarest shingles, exactly. Sets are compared
    by 64-bit hashes of their shingles; nodes are told apart by 64-bit fingerprints.

    Cases: null and texts without words have no set and link with nothing; a text of fewer words
    is one shingle; a null doc_id joins its group, which takes the least id that is not null;
    repeated rows are one node; texts of any length are taken whole; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    num, den = similarity
    by_key = Window.partitionBy("key").orderBy(F.col("of").isNotNull(), "node")
    # Streams over a sorted partition with one value held, so a bucket of any size passes.
    pivot = F.first("node").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = _index(docs, words, num, den).withColumns({"pivot": pivot, "before": F.lag("node").over(by_key)})
    passed = written(passed.where("of is not null or (node <> pivot and node <> before)").drop("before"), "setjoin-passed")
    sets = passed.where("of is not null").select("of.doc_id", "of.text_key", "of.n_shingles", "node")
    members = passed.where("of is null").select("key", "node", "pivot")
    nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"))
    nodes = written(nodes, "setjoin-nodes")
    involved = members.select("node").union(members.select("pivot")).distinct()
    wanted = nodes.join(involved, "node").select("node", F.col("of.doc_id").alias("_id"), F.col("of.text_key").alias("text_key"))
    rows = _texts(docs)
    texts = written(
        rows.join(wanted, (rows["text_key"] == wanted["text_key"]) & rows["doc_id"].eqNullSafe(wanted["_id"])).select("node", "data").dropDuplicates(["node"]),
        "setjoin-texts",
    )
    sizes = nodes.select("node", "n")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Distinct pairs, the smaller node first, whose sizes allow a link."""
        ordered = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        a, b = sizes.toDF("a", "n_a"), sizes.toDF("b", "n_b")
        return ordered.join(a, "a").join(b, "b").where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")).select("a", "b")

    pairs = plausible(members.select(F.col("node").alias("x"), F.col("pivot").alias("y")))
    tried = written(pairs, "setjoin-tried")
    links = written(_verified(tried, texts, words, num, den), "setjoin-links")
    for turn in range(1, STAR_ROUNDS + 1):
        apart = _apart(spark, members, links, turn)
        if apart.isEmpty():
            break
        last = turn == STAR_ROUNDS
        pairs = _rare_pairs(apart, texts, words, num, den) if last else _central_pairs(apart)
        more = written((pairs if last else plausible(pairs)).join(tried, ["a", "b"], "left_anti"), f"setjoin-tried{turn}")
        tried = tried.union(more)
        links = links.union(written(_verified(more, texts, words, num, den), f"setjoin-links{turn}"))
    labels = components(spark, links, "setjoin-result")
    of_node = nodes.select("node", "least_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_node.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = of_node.join(least, "label").select("node", "component_id")
    return sets.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _apart(spark: SparkSession, members: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """(key, node, label) of the buckets whose members are not yet in one component; of two members, the pair was compared."""
    labels = components(spark, links, f"setjoin-labels{turn}")
    whole = members.select("key", "node").union(members.select("key", F.col("pivot").alias("node")).distinct())
    marked = whole.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_keys = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    return written(marked.join(open_keys, "key"), f"setjoin-apart{turn}")


def _central_pairs(apart: DataFrame) -> DataFrame:
    """Each bucket's members with the one that is in the most buckets, as near the centre of a group of near copies, if they are apart."""
    degree = apart.groupBy("node").agg(F.count("*").alias("degree"))
    pivot = apart.join(degree, "node").groupBy("key").agg(F.max_by(F.struct("node", "label"), F.struct("degree", "node")).alias("pivot"))
    return apart.join(pivot, "key").where(F.col("label") != F.col("pivot.label")).select(F.col("node").alias("x"), F.col("pivot.node").alias("y"))


def _rare_pairs(apart: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b) of all pairs still apart that can link, found by their rarest shingles.

    Whatever links with a node left here is here too, as they share a bucket. Shingles are put in
    order, those of the fewest sets first. Two sets that link share one among each one's first
    n - ceil(n * num / den) + 1; and if the first that they share is at places i and j, they
    share 1 + min(n - i, m - j) at most, which must be enough. In a group of near copies, the
    rarest shingles are each copy's own changes, so copies far apart never meet.
    """
    nodes = apart.select("node", "label").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("data"), strict=True):
                s = shingles(data.as_py(), words, hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), node, np.int64)), pa.array(np.full(len(s), len(s), np.int64))], names=["token", "node", "n"])

    tokens = written(texts.join(nodes, "node", "left_semi").mapInArrow(run, "token long, node long, n long"), "setjoin-tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    of_node = Window.partitionBy("node")
    # Shingles of one set alone come first and meet nothing; only their number counts.
    placed = (
        tokens.join(common, "token")
        .withColumn("place", F.row_number().over(of_node.orderBy("sets", "token")) + F.col("n") - F.count("*").over(of_node))
        .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)
    )
    rare = written(placed.join(nodes, "node").select("token", "node", "n", "place", "label"), "setjoin-rare")
    mixed = rare.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    rare = rare.join(mixed, "token", "left_semi")
    x, y = rare.alias("x"), rare.alias("y")
    needed = (F.col("x.n") + F.col("y.n")) * num / (num + den)
    share = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    sizes_fit = den * F.least(F.col("x.n"), F.col("y.n")) >= num * F.greatest(F.col("x.n"), F.col("y.n"))
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & sizes_fit & (share + 1e-9 >= needed)
    return x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
