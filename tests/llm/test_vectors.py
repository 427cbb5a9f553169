"""Vector searches over several ranges against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import vectors


def table(spark, sf_dir, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16))
    x[10] = x[400] = x[401] = x[900]
    rows = [(i, v.tolist(), "x", 1.0) for i, v in enumerate(x)]
    rows += [(n + 1, None, "x", 1.0), (n + 2, [1.0, None] * 8, "x", 1.0), (n + 3, [float("inf")] * 16, "x", 1.0), (n + 4, [0.0] * 16, "x", 1.0), (n + 5, [], "x", 1.0), (None, x[1].tolist(), "x", 1.0), (2000, [1.0, 2.0], "x", 1.0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, score double").repartition(4)


@pytest.mark.parametrize("row_block", [100, 4096])
def test_exact_over_ranges(spark, sf_dir, row_block):
    x, df = table(spark, sf_dir)
    f = np.floor(x * 256).astype(np.int64)
    ids = np.array([*range(len(x)), len(x) + 4])
    f = np.vstack([f, np.zeros((1, 16), np.int64)])
    got = sorted(map(tuple, vectors.exact_top_k(df, F.col("id") % 50 == 0, 5, row_block=row_block).collect()))
    want = []
    for q in range(0, len(x), 50):
        s = f @ f[q]
        other = ids != q
        order = np.lexsort((ids[other], -s[other]))[:5]
        want += [(q, k + 1, int(ids[other][i]), int(s[other][i])) for k, i in enumerate(order)]
    assert got == sorted(want)


@pytest.mark.parametrize("row_block", [100, 4096])
def test_near_recall_scores_and_ties(spark, sf_dir, row_block):
    x, df = table(spark, sf_dir)
    found = {}
    for r in vectors.nearest(df, F.col("id") % 20 == 0, 20, row_block=row_block).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q, rows in found.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, len(rows) + 1)) and [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        assert all(s == vectors.in_order(x[[q]], x[[i]])[0] for _, i, s in rows)
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({i for _, i, _ in rows} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        total += 20
    assert len(found) == 75 and hit / total >= 0.9


def test_repeated_rows_and_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vectors.exact_top_k(df, F.col("id") == 2, 9).collect()))
    assert got == [(2, 1, 1, 256 * 3 * 256), (2, 2, 1, 256 * 3 * 256), (2, 3, 0, 0), (2, 4, 0, 0)]


def test_two_queries_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for search, scale in ((vectors.exact_top_k, 256 * 256), (vectors.nearest, 1)):
        got = sorted(map(tuple, search(df, F.col("id") == 0, 2).collect()))
        assert got == sorted([(0, 1, 3, scale), (0, 2, 1, scale / 2), (0, 1, 3, scale), (0, 2, 2, scale / 2)])


@pytest.mark.parametrize("spread,most", [(None, 0.55), (0.1, 0.1)])
def test_the_stopping_test_stops(monkeypatch, spread, most):
    """The share of rows that are verified, on isotropic and on clustered vectors, and the recall it leaves."""
    rng = np.random.default_rng(8)
    if spread is None:
        x = rng.normal(size=(2000, 64))
    else:
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 64)) * spread
    x = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, 2000, 20)
    method = vectors.Near(20, 32, 0.88, 11, np.abs(x).max(), float(((x / np.abs(x).max()) ** 2).sum(1).max()))
    counted = []
    reach = vectors.Near.reach

    def counting(self, q, kth):
        out = reach(self, q, kth)
        counted.append((q, out))
        return out

    monkeypatch.setattr(vectors.Near, "reach", counting)
    found = method.block(x, np.arange(2000), x[asked], asked, asked, np.full(len(asked), -np.inf)).to_pandas()
    hit = total = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(found[found.query_id == q].vec_id))
        total += 20
    assert hit / total >= 0.9
    # What the last threshold of each query lets through bounds what later leaves verify.
    p, pq = method.coordinates(x), (x[asked] / method.lengths(x[asked])[:, None]) @ method.project(64)[:-1]
    last = {}
    for q, out in counted:
        for v, r in zip(q, out.min(1)):
            last[v.tobytes()] = r
    share = np.mean([(((p - pq[i]) ** 2).sum(1) <= last[x[q].tobytes()]).mean() for i, q in enumerate(asked)])
    assert share <= most
