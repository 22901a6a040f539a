"""Approximate nearest neighbours: an NN-descent graph built by joins, searched greedily."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import shuffle_partitions, written

#: Neighbours of a node in the graph; orders that start it; rows of an order that are compared at once.
DEGREE, ORDERS, BLOCK = 24, 6, 512
#: The graph is done when a round of neighbours of neighbours changes a smaller share of its edges.
LEAST_CHANGE = 0.05
#: Nodes that a search holds, and nodes that it expands in a step.
BEAM, EXPANDED = 320, 64
CODE_BITS = 8


def _usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, all of x to all of y, in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def _nearest(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest distinct b of each a, from (a, b, d, new); an edge is new if all its rows are."""
    # Two products of one pair can differ in their last bits; a limit by rank is applied in each task before the shuffle.
    once = edges.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return once.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def _ordered_blocks(points: DataFrame, dim: int, order: int, parts: int) -> DataFrame:
    """Edges between near rows of one order: sorted by a code of random half-spaces, then one projection.

    The order is cut into blocks of BLOCK rows wherever that falls, so no code, however common,
    makes a block larger. In a block, all pairs are compared.
    """
    rng = np.random.default_rng(1_000 + order)
    planes = rng.standard_normal((dim, CODE_BITS + 1))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector")) @ planes
            code = (x[:, :CODE_BITS] > 0) @ (1 << np.arange(CODE_BITS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(code.astype(np.int64)), pa.array(x[:, CODE_BITS])], names=["id", "vector", "code", "along"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.empty(0, np.int64), np.empty((0, dim))
        for batch in batches:
            ids = np.concatenate((ids, batch.column("id").to_numpy()))
            rows = np.concatenate((rows, _matrix(batch.column("vector")).reshape(-1, dim)))
            while len(ids) >= 2 * BLOCK:
                yield _block_edges(ids[:BLOCK], rows[:BLOCK])
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        if len(ids) > 1:
            yield _block_edges(ids, rows)

    held = points.schema["vector"].dataType.simpleString()
    keyed = points.mapInArrow(coded, f"id long, vector {held}, code long, along double")
    by = ["code", "along", "id"]
    return keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("id", "vector").mapInArrow(compared, "a long, b long, d double")


def _block_edges(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    by_id = np.argsort(ids)
    ids, rows = ids[by_id], rows[by_id]
    d = _distances(rows, rows)
    np.fill_diagonal(d, np.inf)
    k = min(DEGREE, len(ids) - 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(d, near, 1).ravel())], names=["a", "b", "d"])


def _local_join(graph: DataFrame, points: DataFrame) -> DataFrame:
    """Edges between neighbours of a common node that are no farther than the worst edge of one of them.

    A node's neighbours are its own, and the nearest DEGREE of those that have it as theirs, so
    a list is at most 2 * DEGREE long; a node that many have as neighbour stays bounded. Two
    neighbours of which neither is new were compared in an earlier round.
    """
    worst = graph.groupBy("a").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    known = points.join(worst.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("b"), "vector", F.when(F.col("n") >= DEGREE, F.col("worst")).otherwise(float("inf")).alias("worst"))
    both = graph.unionByName(_reversed(graph)).groupBy("a", "b").agg(F.max("new").alias("new"))
    lists = both.join(known, "b").groupBy("a").agg(F.collect_list(F.struct("b", "worst", "new", "vector")).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("near")
            flat, ends = column.flatten(), np.cumsum([len(x) for x in column])
            if not len(flat):
                continue
            ids, worst = flat.field("b").to_numpy(), flat.field("worst").to_numpy()
            fresh = flat.field("new").to_numpy(zero_copy_only=False)
            vectors = _matrix(flat.field("vector"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for begin, end in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
                d = _distances(vectors[begin:end], vectors[begin:end])
                np.fill_diagonal(d, np.inf)
                d[~(fresh[begin:end, None] | fresh[begin:end])] = np.inf
                i, j = np.nonzero(np.isfinite(d) & (d <= worst[begin:end, None]))
                out.append((ids[begin + i], ids[begin + j], d[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "d"])

    return lists.select("near").mapInArrow(run, "a long, b long, d double")


def _reversed(graph: DataFrame) -> DataFrame:
    """Of each node the nearest DEGREE edges that lead to it, as edges from it."""
    return _nearest(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", "new"), DEGREE)


def neighbour_graph(points: DataFrame, dim: int, name: str = "ann") -> DataFrame:
    """NN-descent over ``points`` (id, vector), ids distinct: edges (a, b, d, new), d the squared distance.

    Starts from ORDERS random orders, then joins each node's neighbours with one another until a
    round changes few edges; edges only get nearer, so there is such a round.
    """
    # Of a few rows, many ranges would be blocks of one or two, which have no edges.
    parts = max(1, min(shuffle_partitions(points.sparkSession), points.count() // (4 * BLOCK)))
    start = _ordered_blocks(points, dim, 0, parts)
    for order in range(1, ORDERS):
        start = start.union(_ordered_blocks(points, dim, order, parts))
    graph = written(_nearest(start.withColumn("new", F.lit(True)), DEGREE), f"{name}-graph0")
    for k in itertools.count(1):
        found = _local_join(graph, points).withColumn("new", F.lit(True))
        graph = written(_nearest(graph.withColumn("new", F.lit(False)).unionByName(found), DEGREE), f"{name}-graph{k}")
        change = graph.agg(F.avg(F.col("new").cast("double"))).first()[0]
        if not change or change < LEAST_CHANGE:
            return graph


def _measured(pairs: DataFrame) -> DataFrame:
    """(query, node, seen, d): squared distance of q_vector and vector, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = _matrix(batch.column("q_vector")).astype(np.float64) - _matrix(batch.column("vector"))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array((apart * apart).sum(axis=1))], names=["query", "node", "d"])

    return pairs.select("query", "node", "q_vector", "vector").mapInArrow(run, "query long, node long, d double")


def greedy_search(queries: DataFrame, entries: DataFrame, graph: DataFrame, points: DataFrame, beam: int = BEAM, name: str = "ann") -> DataFrame:
    """Greedy graph search: (query, node, d) of the ``beam`` nearest nodes found for each of ``queries`` (query, q_vector).

    ``entries`` (query, node) is where each search begins. In each step, the nearest EXPANDED nodes
    of a beam that were not yet expanded give their neighbours, by edges from them and to them;
    the beam keeps the nearest. A search ends when all of its beam is expanded: each step expands
    nodes nearer than what the beam lets go, so there is an end. Queries advance together, one
    join of the frontier with the graph a step; a beam is bounded, so the lists here are.
    """
    edges = graph.select("a", "b").union(_reversed(graph).select("a", "b"))
    adjacency = edges.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("next"))
    adjacency = written(points.select(F.col("id").alias("node"), "vector").join(adjacency, "node", "left"), f"{name}-adjacency")
    vectors = adjacency.select("node", "vector")
    first = _measured(entries.distinct().join(vectors, "node").join(queries, "query"))
    held = written(_best_of(first.withColumn("done", F.lit(False)), beam), f"{name}-beam0")
    for k in itertools.count(1):
        frontier = held.where("next")
        if frontier.isEmpty():
            return held.select("query", "node", "d")
        reached = frontier.select("query", "node").join(adjacency.select("node", "next"), "node").select("query", F.explode("next").alias("node")).distinct()
        fresh = reached.join(held.select("query", "node"), ["query", "node"], "left_anti")
        found = _measured(fresh.join(vectors, "node").join(queries, "query")).withColumn("done", F.lit(False))
        kept = held.select("query", "node", "d", (F.col("done") | F.col("next")).alias("done"))
        held = written(_best_of(kept.unionByName(found), beam), f"{name}-beam{k}")


def _best_of(rows: DataFrame, beam: int) -> DataFrame:
    """The ``beam`` nearest of each query, with the EXPANDED nearest that are not done as ``next``."""
    near = Window.partitionBy("query").orderBy("d", "node")
    rank = F.row_number().over(near)
    best = rows.withColumn("rank", rank).where(F.col("rank") <= beam).drop("rank")
    open_ = F.count(F.when(~F.col("done"), 1)).over(near)
    return best.withColumn("next", ~F.col("done") & (open_ <= EXPANDED))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest found of all ``vectors`` for the rows of ``vectors`` whose key is in ``queries`` (key), k at most DEGREE.

    Returns query_id, rank (from 1), vec_id and score, the Euclidean distance on the original
    vectors in double precision, ties to the smaller id; a row is never its own neighbour. Equal
    vectors are one node of the graph, with their k + 1 least ids (more can't be among the k
    nearest of any row), so copies neither crowd the graph nor multiply; every row is indexed.
    The search is approximate: ``beam`` sets its recall, and has to grow, slowly, with the table
    where vectors have no clusters. A table of no more than BLOCK vectors is searched exactly.

    Cases: null, zero, and vectors with null or non-finite components take no part, neither as
    query nor as candidate, nor do null ids, nor vectors of another length than the most common
    one (ties: the longer); of rows that repeat an id, the least vector stands; fewer than k
    candidates give fewer rows; an empty table gives none; other columns are not read.
    """
    if k > DEGREE:
        raise ValueError(f"k is at most {DEGREE}, the neighbours of a node in the graph")
    held = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    clean = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(held).alias("vector")).where(F.col("id").isNotNull() & _usable("vector"))
    lengths = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = lengths["n"] if lengths else 1
    single = clean.where(F.size("vector") == dim).groupBy("id").agg(F.min("vector").alias("vector"))
    single = written(single, "ann-single")
    points = written(single.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "ann-points")
    graph = neighbour_graph(points, dim)
    asked = queries.select(F.col(key).cast("long").alias("query")).where(F.col("query").isNotNull()).distinct()
    vector_of = single.join(asked, F.col("id") == F.col("query")).select("query", F.col("vector").alias("q_vector"))
    own = written(vector_of.join(points, F.col("vector") == F.col("q_vector")).select("query", F.col("id").alias("node"), "q_vector"), "ann-queries")
    found = greedy_search(own.select("query", "q_vector"), own.select("query", "node"), graph, points, beam)
    # A limit by rank is applied within each task before the shuffle, so a vector of any number of copies sends few.
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    copied = single.withColumn("rank", rank).where(F.col("rank") <= k + 1).withColumnRenamed("id", "vec_id").drop("rank")
    copies = copied.join(points, "vector").select(F.col("id").alias("node"), "vec_id")
    ranked = (
        found.join(copies, "node").where(F.col("vec_id") != F.col("query"))
        .withColumn("score", F.sqrt("d"))  # squares that differ can have one root, and that is a tie
        .withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")))
        .where(F.col("rank") <= k)
    )
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
