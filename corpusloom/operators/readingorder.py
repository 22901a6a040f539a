"""The order in which a directory's children are read: named ones first, then from those that use the others to those that are used."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of children that only serve the others.
AUXILIARY = r"\.(test|spec)\.|^tests?$|^__tests__$|fixtures|^test-(helpers|fixtures|utils)$|^scripts?$|^bin$|^tools?$|^examples?$|^benchmarks?$|^drizzle$|^migrations?$"

ORDERED = pa.schema([("dir", pa.string()), ("name", pa.string()), ("place", pa.int64())])


def is_auxiliary(name: Column) -> Column:
    return F.regexp_like(name, F.lit(AUXILIARY))


def _greedy(children: list[dict], edges: list[dict]) -> list[str]:
    """Names in order: of what is left always the best child, one that nothing waits for if there is one.

    Only a child that others wait for can change its rank, and only for the better, so a heap with
    renewed entries finds each next one.
    """
    head = [c["name"] for c in sorted((c for c in children if c["head"] is not None), key=lambda c: (c["head"], c["name"]))]
    rest = {c["name"]: c for c in children if c["head"] is None}
    uses = {name: set() for name in rest}
    for e in edges:
        if e["src"] in rest and e["dst"] in rest and not rest[e["src"]]["auxiliary"]:
            uses[e["src"]].add(e["dst"])
    waits = dict.fromkeys(rest, 0)
    for name, others in uses.items():
        others.discard(name)
        for other in others:
            waits[other] += 1
    rank = {name: (c["auxiliary"], -len(uses[name]), not c["is_dir"], name.encode("utf-16-be")) for name, c in rest.items()}
    heap = [(waits[name] > 0, *rank[name], name) for name in rest]
    heapq.heapify(heap)
    order, placed = head, set()
    while heap:
        name = heapq.heappop(heap)[-1]
        if name in placed:
            continue
        placed.add(name)
        order.append(name)
        for other in uses[name]:
            waits[other] -= 1
            if not waits[other] and other not in placed:
                heapq.heappush(heap, (False, *rank[other], other))
    return order


def reading_order(children: DataFrame, edges: DataFrame) -> DataFrame:
    """(dir, name, place from 0) of the children (dir, name, is_dir, head) of each directory; ``head`` is a place among those named first, else null.

    ``edges`` (dir, src, dst) say that one child uses another. A child that none of its siblings uses comes first, and when it is placed it
    no longer holds back those it uses. Auxiliary children hold back nobody and come late. Ties,
    and cycles, in which all wait, are broken by: no auxiliary, most siblings used, directories first, name.
    Each pick depends on those before it, so a directory is ordered in one task; its children and
    their edges are what that task holds. A name twice in a directory counts once.

    Cases: edges to or from names that are no children, and from a child to itself, don't count;
    a directory without edges is ordered by the ties alone; an empty table gives none.
    """
    own = children.groupBy("dir", "name").agg(F.max("is_dir").alias("is_dir"), F.min("head").alias("head")).withColumn("auxiliary", is_auxiliary(F.col("name")))
    links = edges.select(F.col("dir").alias("of_dir"), "src", "dst").distinct()

    def ordered(children: pa.Table, edges: pa.Table) -> pa.Table:
        if not len(children):
            return ORDERED.empty_table()
        directory = children.column("dir")[0].as_py()
        names = _greedy(children.to_pylist(), edges.to_pylist())
        return pa.table({"dir": pa.array([directory] * len(names), pa.string()), "name": names, "place": list(range(len(names)))}, schema=ORDERED)

    return own.groupBy("dir").cogroup(links.groupBy("of_dir")).applyInArrow(ordered, "dir string, name string, place long")
