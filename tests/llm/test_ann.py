import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.ann import nearest_vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, query, k):
    x = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    return sorted((float(np.sqrt(((x[query] - v) ** 2).sum())), i) for i, v in x.items() if i != query)[:k]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    rows = [(k, (centres[k % 20] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(2000)]
    rows += [(5000 + k, rows[0][1]) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = nearest_vectors(df, df.where("vec_id % 100 = 0").select("vec_id")).collect()
    queries = {k for k, _ in rows if k % 100 == 0}
    hits = 0
    for q in queries:
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, *_ in own] == list(range(1, 11))
        assert [(s, v) for _, s, v in own] == sorted((s, v) for _, s, v in own)
        wanted = brute(rows, q, 10)
        exact = {i: d for d, i in brute(rows, q, len(rows))}
        assert all(s == pytest.approx(exact[v], abs=1e-9) for _, s, v in own)
        hits += len({v for *_, v in own} & {i for _, i in wanted})
    assert hits / (10 * len(queries)) >= 0.9


def test_unusable_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (100, [1.0, 2.0]), (200, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", vector string")
    got = nearest_vectors(df, df.where("vec_id % 100 = 0").select("vec_id")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 2), (100, 2, 0), (100, 3, 1)]
    assert nearest_vectors(df.where(F.lit(False)), df.select("vec_id")).count() == 0


def test_recall_on_vectors_without_clusters(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA).repartition(4)
    got = nearest_vectors(df, df.where("vec_id % 100 = 0").select("vec_id")).collect()
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1)
        d[q] = np.inf
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in own] == list(range(1, 11))
        assert all(score == pytest.approx(np.sqrt(d[v]), abs=1e-12) for _, v, score in own)
        hits += len({v for _, v, _ in own} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / (10 * 120) >= 0.9


def test_more_ties_than_neighbours(spark):
    rows = [(k, [float(i == k) for i in range(40)]) for k in range(40)]
    got = nearest_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(rows[::4], SCHEMA), k=5).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, i + 1, v) for q in range(0, 40, 4) for i, v in enumerate([v for v in range(7) if v != q][:5])}


def test_doubles_are_measured_as_doubles(spark):
    rows = [(k, [1.0 + k * 1e-10, 1.0]) for k in range(6)]
    got = nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(0,)], "vec_id long"), k=3).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (2, 2), (3, 3)]
    with pytest.raises(ValueError):
        nearest_vectors(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(0,)], "vec_id long"), k=1000)


def test_nodes_that_many_have_as_neighbour(spark):
    # A star: every vector is nearest to the middle one, which lists no more than DEGREE backward edges.
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 48))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100_000, (x.mean(0) + 1e-6).tolist())]
    got = nearest_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(rows[::300], SCHEMA)).collect()
    assert len(got) == 110
    for q, v in rows[::300]:
        wanted = sorted((float(np.sqrt(((np.float32(v).astype(np.float64) - np.float32(w).astype(np.float64)) ** 2).sum())), i) for i, w in rows if i != q)[:10]
        found = sorted((r.score, r.vec_id) for r in got if r.query_id == q)
        assert (100_000 in {i for _, i in wanted}) == (100_000 in {i for _, i in found}) and len({i for _, i in wanted} & {i for _, i in found}) >= 8


def test_equal_roots_of_different_squares_are_ties(spark):
    rows = [(0, [0.0, 0.0, 1.0]), (5, [2.0**26, 0.0, 1.0]), (3, [2.0**26, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest_vectors(vectors, vectors.where("vec_id = 0").select("vec_id"), k=2).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in found] == [(1, 3, 2.0**26), (2, 5, 2.0**26)]
