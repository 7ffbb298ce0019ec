import numpy as np
import pytest

from millrace.llm import op02_neighbours as op


def exact(ids, x, every, top):
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:top]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), op.EVERY, op.TOP)
    got = results(op.op2_neighbours(spark, f"/root/testdata/{sf}"))
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    scores = {(q, v): s for q, found in want.items() for v, s in found}
    assert all(abs(s - scores.get((q, v), s)) < 1e-12 for q, found in got.items() for v, s in found)


def test_walk_visits_pairs_in_order():
    rng = np.random.default_rng(3)
    for _ in range(50):
        one, two, sizes = rng.random(6), rng.random(6), rng.integers(0, 4, (6, 6))
        total = (one[:, None] + two[None]).ravel()
        order = np.argsort(total, kind="stable")
        held = np.cumsum(sizes.ravel()[order])
        for enough in (1, 5, 20):
            at = np.searchsorted(held, enough)
            assert op.walk(one, two, sizes, enough) == (total[order[at]] if at < 36 else float("inf"))


def test_edges(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(0, same), (7, same), (3, same), (5, [9.0, 0.0, 0.0, 0.0]), (5, [10.0, 0.0, 0.0, 0.0]), (100, None), (200, [0.0] * 4), (300, [1.0, None, 1.0, 1.0]), (400, [float("nan"), 1.0, 1.0, 1.0]), (500, [1.0]), (None, same), (600, [1.0, 2.0, 3.0, 5.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = results(op.nearest(spark, df))
    assert [v for v, _ in got[0]] == [3, 7, 600, 5] and got.keys() == {0, 600}
    assert op.nearest(spark, df.where("false")).count() == 0


def test_clusters_need_few_rows(spark):
    """Recall of 0.9 at under a tenth of the rows where vectors lie in clusters."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 16))
    x = centres[rng.integers(0, 150, 6000)] + 0.05 * rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact(np.arange(6000), x, 100, 10)
    got = results(op.nearest(spark, df))
    assert got.keys() == want.keys()
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 600
    seen = op.candidates(spark, df).groupBy().sum("seen").first()[0]
    assert seen < 0.1 * len(want) * 6000


def test_large_offset_is_exact(spark, monkeypatch):
    """Vectors far from the origin, all cells seen; then in small blocks."""
    x = np.random.default_rng(6).normal(size=(600, 8)) + 1e7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact(np.arange(600), x, 100, 10)
    assert results(op.nearest(spark, df, share=1.0)) == want
    monkeypatch.setattr(op, "ROWS", 7)
    monkeypatch.setattr(op, "QUERIES", 2)
    monkeypatch.setattr(op, "HELD", 50)
    assert results(op.nearest(spark, df, share=1.0)) == want


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(1000 + i, [1.0, 2.0 + i]) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = results(op.nearest(spark, df))
    assert [v for v, _ in got[0]] == list(range(1, 11)) and [v for v, _ in got[300]] == list(range(10)) and all(s == 0 for _, s in got[100])
