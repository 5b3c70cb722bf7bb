"""Nearest neighbours against brute force in double precision."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from kitman.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, point int, query string, block int"


def brute(rows, asked, k):
    """(row, rank) → (vec_id, score) over rows (vec_id, vector) that take part."""
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in rows), default=0)
    x = np.zeros((len(rows), dim))
    for at, (_, v) in enumerate(rows):
        x[at, :len(v)] = v
    out = []
    for at, (i, _) in enumerate(rows):
        if asked(i):
            score = np.einsum("ij,ij->i", x, np.broadcast_to(x[at], x.shape))
            best = sorted((-s, rows[j][0]) for j, s in enumerate(score) if j != at)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def got(df):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows], SCHEMA).repartition(3)


def test_chi_square():
    # known upper 5 % points
    assert N.quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3) and N.quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    drawn = (np.random.default_rng(1).standard_normal((20_000, 8)) ** 2).sum(axis=1)
    assert np.mean(drawn <= N.quantile(0.9, 8)) == pytest.approx(0.9, abs=0.01)


def test_tree_leaves_hold_every_point_once():
    x = np.random.default_rng(2).standard_normal((1000, N.DIMS))
    x[:300] = x[0]                                          # equal points stay together
    x[300:400, 1:] = x[0, 1:]
    tree = N.cuts(x, 20)
    leaf = N.leaf_of(tree, x)
    assert set(leaf) == set(range(len(tree) + 1)) and len(set(leaf[:300])) == 1
    sizes = np.bincount(leaf)
    assert max(s for i, s in enumerate(sizes) if i != leaf[0]) <= 20


def test_edge_cases_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), r.integers(-2, 3, 3).astype(float).tolist()) for i in range(200)]      # many ties and equal vectors
    rows += [(i, [1.0, 0.0, 0.0]) for i in range(300, 360)]                                 # a group of copies
    rows += [(400, None), (401, []), (402, [0.0, 0.0, 0.0]), (420, [1.0, None, 2.0]), (440, [1.0, float("nan"), 0.0]),
             (460, [float("inf"), 1.0, 0.0]), (None, [5.0, 5.0, 5.0]), (480, [2.0]), (500, [1.0, 1.0, 1.0, 9.0]), (20, [2.0, 2.0, -1.0]),
             (40, [1.0, 0.0, 0.0]), (40, [1.0, 0.0, 0.0])]                                  # short, long, repeated ids and rows
    have = got(N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, block=40, queries=7))
    assert sorted(have) == sorted(brute(rows, lambda i: i % 20 == 0, 20))


def test_fewer_than_asked_for_and_empty(spark):
    rows = [(20, [1.0, 2.0]), (21, [2.0, 1.0]), (22, [-1.0, 0.5])]
    assert sorted(got(N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0))) == [(20, 1, 21, 4.0), (20, 2, 22, 0.0)]
    assert got(N.nearest(frame(spark, rows[:1]), F.col("vec_id") % 20 == 0)) == []
    assert got(N.nearest(frame(spark, []), F.col("vec_id") % 20 == 0)) == []


def recall(have, want):
    left = {(q, v) for q, _, v, _ in want}
    return len(left & {(q, v) for q, _, v, _ in have}) / len(left)


def test_recall_of_the_table(spark):
    df = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    rows = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    have, want = got(N.nearest(df, F.col("vec_id") % 20 == 0)), brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(have, want) >= 0.95 and len(have) == len(want)
    exact = {(q, v): s for q, _, v, s in brute(rows, lambda i: i % 20 == 0, len(rows))}
    assert all(s == exact[q, v] for q, _, v, s in have)


def test_recall_and_pruning_on_clusters(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((40, 16)) * 4
    x = (centres[r.integers(0, 40, 4000)] + 0.3 * r.standard_normal((4000, 16))) * r.choice([0.5, 1, 2], 4000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(got(N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, block=200)), want) >= 0.9
