"""Whitening and hard negatives against plain numpy versions; the eigensolver against numpy's."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import DATA
from pyspark.sql import functions as F

from episode_mart.llm import negatives, whitening
from episode_mart.llm.queries import QUERIES
from episode_mart.llm.spectrum import Slicer, factor, solve

VECTORS = "vec_id long, embedding array<float>, label int"


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def numbers(v, scale=256):
    return [math.floor(scale * c) for c in v]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 40])
@pytest.mark.parametrize("kind", ["any", "low rank", "steep", "equal", "one large"])
def test_slicing_equals_numpy(n, kind):
    r = np.random.default_rng(n)
    q = np.linalg.qr(r.standard_normal((n, n)))[0]
    e = {"any": r.random(n) * 10, "low rank": np.r_[np.ones(n // 2), np.zeros(n - n // 2)], "steep": r.random(n) ** 8,
         "equal": np.full(n, 3.0), "one large": np.r_[100.0, np.full(n - 1, 1e-3)]}[kind]
    a = q @ np.diag(e) @ q.T
    a = (a + a.T) / 2
    true = np.sort(np.linalg.eigvalsh(a))[::-1]
    values, vectors = Slicer(a).leading(4)
    assert len(values) == min(4, (true > 1e-12 * true[0]).sum())
    assert np.allclose(values, true[:len(values)], rtol=1e-12, atol=1e-13 * true[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * max(1, true[0]))
    for shift in (*true[:3][true[:3] > 1e-6] * 0.999, 0.5):
        assert Slicer(a).above(shift) == (true > shift).sum()
    shifted = a - 0.37 * np.eye(n)
    b = r.standard_normal(n)
    assert np.allclose(shifted @ solve(factor(shifted, 1e-300), b), b, atol=1e-8)


def plain_whitening(rows, components=4):
    """vec_id to (n, deviation), and the covariance with its eigenpairs."""
    kept = [(i, numbers(v)) for i, v in rows if usable(v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, "float64") - np.array(sums) / n
    cov = x.T @ x / n
    e, u = np.linalg.eigh(cov)
    return kept, n, sums, np.trace(cov), e[::-1][:components], u[:, ::-1][:, :components]


def check_whitening(got, rows):
    kept, n, sums, trace, e, u = plain_whitening(rows)
    assert len(got) == 4 * len(kept)
    signs = {}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i, x in kept:
        for k in range(4):
            r = by[i, k + 1]
            want = float((np.array(x) - np.array(sums) / n) @ u[:, k] / math.sqrt(e[k]))
            if abs(want) > 1e-3:
                signs.setdefault(k, math.copysign(1, want * r["whitened"]))
                assert abs(r["whitened"] * signs[k] - want) < 1e-6
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert abs(r["explained"] - e[k] / trace) < 1e-9 and r["identity_error"] < 1e-9


def test_op11_equals_plain_version(spark):
    rows = pq.read_table(f"{DATA}/sf0.01/embeddings.parquet").to_pylist()
    check_whitening(QUERIES["op11_embedding_whitening"](spark, f"{DATA}/sf0.01").collect(),
                    [(r["vec_id"], r["embedding"]) for r in rows])


def embeddings(tmp_path, spark, rows):
    spark.createDataFrame(rows, VECTORS).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def odd_rows(n=300, d=6, seed=3):
    r = random.Random(seed)
    hot = [round(r.uniform(-1, 1), 2) for _ in range(d)]
    rows = [(i, hot if i % 3 == 0 else [r.uniform(-1, 1) for _ in range(d)], r.randrange(10)) for i in range(n)]
    return rows + [(1000, None, 1), (1100, [None] * d, 1), (1200, [float("nan")] * d, 1), (1300, [math.inf] * d, 2),
                   (1400, [0.0] * d, None), (1500, [0.0] * d, 3), (1600, [-0.0] * d, 3)]


def test_whitening_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    check_whitening(QUERIES["op11_embedding_whitening"](spark, embeddings(tmp_path, spark, rows)).collect(),
                    [(i, v) for i, v, _ in rows])


def test_whitening_edges(spark):
    def whiten(rows, schema="vec_id long, embedding array<float>"):
        df = spark.createDataFrame(rows, schema).withColumn("n", F.lit("mine")).withColumn("a.b", F.lit(7))
        return whitening.whiten(df, whitening.fit(df)).collect()

    assert whiten([]) == [] and whiten([(1, None), (2, [])]) == []
    # one vector, repeated: nothing varies, so nothing can be whitened
    same = whiten([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r["n"], r["deviation"], r["whitened"], r["a.b"]) for r in same] == [(1, 0, [], 7)] * 3
    # two vectors have one direction; lengths are fitted by themselves
    mixed = whiten([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [4.0])])
    assert sorted((r["vec_id"], r["n"], [round(abs(w), 9) for w in r["whitened"]]) for r in mixed) == [
        (1, 2, [1.0]), (2, 2, [1.0]), (3, 1, [])]
    # numbers beyond a long
    huge = whiten([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [5.0, 5.0])])
    assert len(huge) == 3 and huge[0]["deviation"] is None


def plain_negatives(rows, k=5, positives=5, low=80, high=100):
    kept = {(i, label, tuple(numbers(v))) for i, v, label in rows if i is not None and label is not None and usable(v)}
    out = []
    for anchor in sorted({i for i, _, _ in kept if i % 100 == 0}):
        own, x = min((label, x) for i, label, x in kept if i == anchor)
        score = {(i, label): sum(a * b for a, b in zip(x, y, strict=True)) for i, label, y in kept if len(y) == len(x)}
        pos = sorted((-s, i) for (i, label), s in score.items() if label == own and i != anchor)[:positives]
        for p, pid in pos:
            fits = sorted((-s, i) for (i, label), s in score.items() if label != own and low * -p <= 100 * s <= high * -p)
            out += [(anchor, pid, rank, nid, -p, -s) for rank, (s, nid) in enumerate(fits[:k], 1)]
    return sorted(out)


def mined(df, **how):
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **how)
    return sorted(tuple(r) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("how", [{}, {"k": 2, "positives": 3, "low": 50, "high": 90}])
def test_negatives_equal_brute_force(spark, monkeypatch, how):
    for name, value in (("BLOCK_ROWS", 40), ("FIRST_DEPTH", 2), ("ANCHOR_ENTRIES", 12)):  # many blocks and passes
        monkeypatch.setattr(negatives, name, value)
    rows = odd_rows(800, 4) + [(i, [0.5, -0.25, 0.0, 0.125], i % 4) for i in range(2000, 2200)]
    df = spark.createDataFrame(rows + rows[:50], VECTORS).repartition(7)
    want = plain_negatives(rows, **how)
    assert want and mined(df, **how) == want


def test_search_ends_early():
    r = np.random.default_rng(0)
    x = (r.standard_normal((4000, 4)) * 100).astype("int64")
    lists = negatives.Lists(np.arange(4000), np.zeros(4000, "int64"), x, 5)
    anchor, met = np.array([90, -40, 3, 0]), []
    windows = negatives.Windows([(-negatives._MOST, negatives._MOST)], 5, -1, 0, True)
    offer = windows.offer
    windows.offer = lambda s, i, labels: (met.extend(i), offer(s, i, labels))
    lists.search(anchor, windows)
    assert [i for _, i in windows.best[0]] == np.lexsort((np.arange(4000), -(x @ anchor)))[:5].tolist()
    assert len(met) == len(set(met)) < 2000


def test_negatives_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1)], VECTORS)) == []
    # no positives, negative scores, zero anchors, other lengths, large numbers, clashing columns
    rows = [(100, [1.0, 0.0], 1), (1, [0.5, 9.0], 1), (2, [0.45, -9.0], 2), (3, [0.45, 1.0], 2), (4, [0.51, 0.0], 3),
            (200, [0.0, 0.0], 4), (5, [3.0, 3.0], 4), (6, [1.0, 2.0], 5), (300, [1.0], 6), (7, [1.0], 6), (8, [1.0], 7),
            (400, [-3e7, 1.0], 8), (9, [-2e6, 5.0], 8), (10, [-2e6, 4.0], 9), (500, [1.0, 1.0], None), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("mine")).withColumn("rank", F.lit(3)).withColumn("a.b", F.lit(0))
    assert mined(df) == plain_negatives(rows)
    # an id with two vectors: the anchor is the one with the smaller label
    twice = [*rows, (100, [0.9, 0.1], 2), (100, [1.0, 0.0], 1)]
    assert mined(spark.createDataFrame(twice, VECTORS)) == plain_negatives(twice)
