"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunframe.llm import ann, exact_topk

NAN, INF = float("nan"), float("inf")


def brute(rows, transform, k=20):
    out = {}
    for q, v in rows:
        if q % 20:
            continue
        a = transform(v)
        best = sorted(((-(a @ transform(w)), i) for i, w in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(12) * (1 + i % 5)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[40][1]) for i in range(1000, 1400)]  # one common vector
    bad = [(2000, None), (2020, [1.0, None] + [0.0] * 10), (2040, [NAN] * 12), (2060, [INF] * 12), (2080, []), (None, rows[0][1])]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows + [rows[5]] + bad], "vec_id long, embedding array<float>, score string")


def test_exact(vectors):
    rows, df = vectors
    want = brute(rows, lambda v: np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64))
    got = lists(exact_topk.top_twenty(df))
    assert got == {q: [(i, int(s)) for i, s in best] for q, best in want.items()}


def test_approximate(vectors):
    rows, df = vectors
    rows = [r for r in rows if any(r[1])]
    want = brute(rows, lambda v: np.array(v, dtype=np.float64))
    got = lists(ann.nearest_twenty(df))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    vec = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, best in got.items():
        assert len(best) == len(want[q]) and q not in [i for i, _ in best]
        assert [(-s, i) for i, s in best] == sorted((-s, i) for i, s in best)
        assert all(abs(s - vec[q] @ vec[i]) < 1e-9 for i, s in best)


def test_query_slices_change_nothing(vectors):
    _, df = vectors
    is_query = F.col("vec_id") % 20 == 0
    assert lists(ann.search(df, is_query, query_block=4, task_blocks=2, stripes=3)) == lists(ann.nearest_twenty(df))


@pytest.mark.parametrize("kind", ["offset", "flat"])
def test_recall_on_alike_vectors(spark, kind):
    """All vectors point about the same way, or lie in few dimensions: products are large, their unseen parts too."""
    rng = np.random.default_rng(5)
    made = rng.standard_normal((6000, 48)) + 3 if kind == "offset" else rng.standard_normal((6000, 3)) @ rng.standard_normal((3, 48))
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    got = lists(ann.nearest_twenty(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    scores = made[::20] @ made.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20].tolist()
    assert sum(len({i for i, _ in got[20 * n]} & set(best)) for n, best in enumerate(want)) >= 0.9 * 20 * 300


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows, lambda v: np.array(v, dtype=np.float64)), lists(ann.nearest_twenty(df))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("run", [exact_topk.top_twenty, ann.nearest_twenty])
def test_few_and_none(spark, run):
    shape = "vec_id long, embedding array<float>"
    assert run(spark.createDataFrame([], shape)).count() == 0
    assert run(spark.createDataFrame([(20, [1.0, 2.0])], shape)).count() == 0
    rows = run(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.5]), (2, [3.0])], shape)).collect()
    assert [(r.query_id, r.vec_id) for r in rows] == [(0, 1)]
    assert run(spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0])], shape)).where(F.col("score") != 0).count() == 0
