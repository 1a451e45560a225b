import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillstone.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<float>, score double, cell string"


def brute(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        cos = np.round(u @ u[ids.index(q)], 12)
        order = [i for i in np.lexsort((ids, -cos)) if ids[i] != q][:k]
        out[q] = [(ids[i], cos[i]) for i in order]
    return out


def sample(n, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(10, 16))
    x = (centres[r.integers(0, 10, n)] + 0.6 * r.normal(size=(n, 16))).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[7]  # one very common vector
    return list(range(n)), x.astype(np.float64)


def test_recall_and_ties(spark):
    ids, x = sample(1200)
    rows = [(i, v.tolist(), 0.0, "c") for i, v in zip(ids, x)]
    rows += [(None, x[3].tolist(), 0.0, None), (5000, None, 0.0, None), (5050, [0.0] * 16, 0.0, None), (5100, [float("nan")] * 16, 0.0, None), (5150, [1.0, None] * 8, 0.0, None), (5200, [1.0], 0.0, None), (5250, [float("inf")] * 16, 0.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = nn.nearest(df, F.col("vec_id") % 50 == 0, cell_rows=100).toPandas()
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    assert set(got["query_id"]) == set(want)
    hits = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(g["vec_id"])
        np.testing.assert_allclose(g["score"], [float(x[i] @ x[q] / np.linalg.norm(x[i]) / np.linalg.norm(x[q])) for i in g["vec_id"]], rtol=1e-9)
        hits += len({i for i, _ in want[q]} & set(g["vec_id"]))
        if 600 <= q < 900:
            assert g["vec_id"].tolist() == [i for i, _ in want[q]]
    assert hits >= 0.9 * 5 * len(want)


def test_few_and_none(spark):
    df = spark.createDataFrame(pd.DataFrame({"vec_id": [0, 1, 2], "embedding": [[1.0, 0.0], [0.5, 0.5], [-1.0, 0.0]]}))
    got = nn.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2)] and abs(got[0].score - 0.5**0.5) < 1e-12
    assert nn.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []


def test_recall_over_many_cells_and_parts(spark):
    """Isotropic vectors of 64 numbers, the hardest case: no structure to prune by."""
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for options in ({"cell_rows": 300}, {"cell_rows": 100, "sample": 64}):  # 20 cells; 8 cells in parts
        got = nn.nearest(df, F.col("vec_id") % 50 == 0, **options).toPandas()
        hits = 0
        for q, g in got.groupby("query_id"):
            cos = u @ u[q]
            cos[q] = -2
            hits += len(set(np.argsort(-cos)[:5]) & set(g["vec_id"]))
        assert len(got) == 600 and hits >= 0.9 * 600


def test_the_stopping_test_spares_most_of_clustered_data():
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 64))
    v = nn.unit(centres[r.integers(0, 40, 4000)] + 0.3 * r.normal(size=(4000, 64)))
    project = r.normal(size=(64, 16))
    tree, stretch, seen = nn.KdTree(v @ project), nn.chi2.quantile(0.92, 16), []
    for i in range(0, 4000, 100):
        _, cos = nn.search_cell(tree, v, np.arange(4000), v[i], v[i] @ project, 6, -1.0, stretch)
        seen.append((tree.distances(v[i] @ project) <= stretch * (2 - 2 * cos[-1])).mean())
    assert np.mean(seen) < 0.3
