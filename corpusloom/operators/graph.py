"""Graphs as edge tables: components, cycles, layers, reachability."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (src, dst): the least node of each component.

    Each round a node takes the name that its neighbour of least hash takes from its own such neighbour; then only
    edges between different names go on, by these names. So a round's tables are a part of those of the round before, whatever
    the order of the nodes on a long way, and names are followed back to the nodes once, at the end.
    """
    def ends(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()

    left, rounds = written(ends(edges), "graph"), []
    while not left.isEmpty():
        mixed = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("name"))
        both = left.select(F.col("src").alias("node"), "dst").union(left.select(F.col("dst").alias("node"), F.col("src").alias("dst")))
        near = both.groupBy("node").agg(F.min(mixed("dst")).alias("near")).select("node", F.least("near", mixed("node"))["name"].alias("via"))
        near = written(near, "graph")
        names = written(near.join(near.select(F.col("node").alias("via"), F.col("via").alias("name")), "via").select("node", "name"), "graph")
        rounds.append(names)
        of = lambda end: names.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"))  # noqa: E731, B023
        named = left.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
        left = written(ends(named), "graph")
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    if not rounds:
        return written(alone.select("node", F.col("node").alias("component")), "graph")
    roots = rounds.pop()
    while rounds:
        further = roots.select(F.col("node").alias("name"), F.col("name").alias("root"))
        roots = written(rounds.pop().join(further, "name", "left").select("node", F.coalesce("root", "name").alias("name")), "graph")
    least = roots.groupBy("name").agg(F.min("node").alias("component"))
    found = roots.join(least, "name").select("node", "component")
    return written(found.unionByName(alone.join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))), "graph")


def reachability(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops): the fewest hops to what each start reaches, only new pairs going into the next round.

    Ends when a round finds no new pair. The result has a row for each pair, so starts should be
    few, or the graph small.
    """
    edges = written(edges.select("src", "dst").distinct(), "graph")
    base = edges if starts is None else edges.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    reached = frontier = written(base.select("src", "dst", F.lit(1).alias("hops")), "graph")
    hops = 1
    while not frontier.isEmpty():
        hops += 1
        onward = frontier.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        frontier = written(onward.join(reached, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)), "graph")
        reached = reached.unionByName(frontier)
        if hops % 16 == 0:
            # A union of very many tables would be slow to plan.
            reached = written(reached, "graph")
    return reached


def _spread(edges: DataFrame) -> DataFrame:
    """(node, label): the least of a node and of all nodes that reach it. Labels also take their label's label, so long ways are soon crossed."""
    labels = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("label", F.col("node")), "graph")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        new = written(step.join(jump, "via").select("node", "old", F.least("via", "jump").alias("label")), "graph")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes on a cycle: the least node each reaches and is reached by.

    Forward-backward: a node's label is the least node that reaches it, and among nodes of a label,
    those that reach it are its component. These go, and so do edges between labels and nodes
    without an edge in or out, until no edge is left. Tables are as long as the edges, never as the pairs.
    """
    edges = written(edges.select("src", "dst").distinct(), "graph")
    found = edges.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component"))
    open_edges = written(edges.where("src <> dst"), "graph")
    while True:
        # Nodes without an edge in or without one out are on no cycle.
        inner = open_edges.select(F.col("src").alias("node")).intersect(open_edges.select("dst"))
        kept = written(open_edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "graph")
        trimmed, open_edges = kept.count() < open_edges.count(), kept
        if open_edges.isEmpty():
            break
        if trimmed:
            continue
        labels = _spread(open_edges)
        same = open_edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst")
        same = written(same, "graph")
        back = _spread(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("label", "back")
        done = written(labels.join(back, "node").where("label = back").select("node", F.col("label").alias("component")), "graph")
        found = found.unionByName(done)
        gone = done.select("node").union(labels.where("node = label").select("node"))
        open_edges = written(same.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "graph")
    several = found.groupBy("component").agg(F.count_distinct("node").alias("_n")).where("_n > 1").select("component")
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    return found.join(several, "component", "left_semi").select("node", "component").unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def waves(items: DataFrame, requires: DataFrame) -> DataFrame:
    """(node, wave): 0 without requirements, else one more than the highest wave of what it requires (src requires dst).

    Each round settles the items whose requirements are all settled, so there are as many rounds
    as waves; if a round settles none while some are open, a requirement depends on itself.
    """
    left = written(items.select("node").distinct(), "graph")
    needs = requires.select("src", "dst").distinct().join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
    needs = written(needs.join(left.withColumnRenamed("node", "src"), "src", "left_semi"), "graph")
    settled = left.withColumn("wave", F.lit(0)).limit(0)
    for wave in count():
        blocked = needs.select(F.col("src").alias("node")).distinct().withColumn("blocked", F.lit(True))
        # Two tables a wave: what is free and what waits in one, and the requirements that are left.
        marked = written(left.join(blocked, "node", "left").select("node", F.coalesce("blocked", F.lit(False)).alias("blocked")), "graph")
        free, left = marked.where("not blocked").select("node"), marked.where("blocked").select("node")
        if free.isEmpty():
            if left.isEmpty():
                return settled
            raise ValueError("a requirement depends on itself")
        settled = settled.unionByName(free.withColumn("wave", F.lit(wave)))
        if wave % 16 == 15:
            settled = written(settled, "graph")  # a union of very many tables would be slow to plan
        needs = written(needs.join(free.select(F.col("node").alias("dst")), "dst", "left_anti"), "graph")


def sibling_edges(edges: DataFrame) -> DataFrame:
    """(dir, src, dst, n): each edge between paths lifted to the children of the directory where the two part."""
    a, b = F.split("src", "/"), F.split("dst", "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    k = (F.array_position(same, F.lit(False)) - 1).cast("int")
    lifted = edges.where("src <> dst").select(F.array_join(F.slice(a, F.lit(1), k), "/").alias("dir"), F.get(a, k).alias("src"), F.get(b, k).alias("dst"))
    return lifted.where("src is not null and dst is not null").groupBy("dir", "src", "dst").agg(F.count("*").alias("n"))
