"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, row string, q int, `a.b` int"


def _table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "r", 1, 2) for r in rows], schema)


def _brute(rows, step=5, n=5, k=3, window=(50, 95)):
    """Sorted result rows, with nulls as None."""
    live = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda s, i: (-s, i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for at, (i, label, v) in enumerate(live):
        if i is None or i % step:
            continue
        others = [(dot(v, w), j, other) for to, (j, other, w) in enumerate(live) if to != at and len(w) == len(v)]
        for score, j, _ in sorted((x for x in others if x[2] == label), key=lambda x: place(*x[:2]))[:n]:
            fit = [x for x in others if x[2] != label and window[0] * score <= 100 * x[0] <= window[1] * score]
            out += [(i, j, rank, m, score, s) for rank, (s, m, _) in enumerate(sorted(fit, key=lambda x: place(*x[:2]))[:k], 1)]
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def _clusters(n, dim, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    return [(i, int(draw.integers(4)), [float(np.float32(x)) for x in (centres[draw.integers(12)] + 0.3 * draw.normal(size=dim)) / 4]) for i in range(n)]


@pytest.mark.parametrize(("dim", "values", "tile"), [(64, 1 << 12, (7, 13)), (33, 1 << 19, (128, 2048)), (5, 50, (2, 3)), (3, 1 << 19, (1, 1))])
def test_all_pairs(spark, monkeypatch, dim, values, tile):
    monkeypatch.setattr(negatives, "ROW_VALUES", values)
    monkeypatch.setattr(negatives, "ANCHOR_VALUES", max(20, values // 8))
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = _clusters(240, dim)
    assert _got(negatives.mined(_table(spark, rows), F.col("vec_id") % 5 == 0)) == _brute(rows)


def test_odd_vectors(spark):
    """Nulls, ties, repeated rows, several lengths, empty vectors, huge components, lonely labels."""
    draw = random.Random(5)
    some = lambda n: [draw.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(n)]
    rows = [(draw.choice([*range(40), None]), draw.choice([0, 1, 2, None]), some(draw.choice([2, 6, 6, 18]))) for _ in range(150)]
    rows += [(5, 1, [0.5, 0.5]), (5, 1, [0.5, 0.5]), (10, 7, some(6)), (15, 1, None), (20, 1, [0.5, None]), (25, 1, [0.5, float("nan")]), (30, 1, [float("inf"), 0.0]), (0, 0, []), (35, 0, []), (1, 1, []), (40, 2**31 - 1, [1.0, 1.0])]
    rows += [(i, i % 2, [3e5 + i, 1e5 * (i % 3), -2e5, 7.0, 1.0, 0.5]) for i in range(50, 70)]  # products beyond 2 ** 53
    assert _got(negatives.mined(_table(spark, rows), F.col("vec_id") % 5 == 0)) == _brute([(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows])
    table = _table(spark, [(i, i % 2, [0.5] * 6) for i in range(40)])
    assert _got(negatives.mined(table, F.lit(True), 2, 1, (100, 100))) == _brute([(i, i % 2, [0.5] * 6) for i in range(40)], 1, 2, 1, (100, 100))
    assert negatives.mined(table.limit(0), F.lit(True)).collect() == [] == negatives.mined(table, F.lit(False)).collect()


def test_bounds(monkeypatch):
    """Bounds hold for every pair at every level, finer ones are tighter, and they spare exact scores."""
    import pyarrow as pa

    rows = _clusters(300, 64)
    q = np.floor(256 * np.array([v for *_, v in rows]))
    means, devs = negatives._summed(q)
    exact, last = q @ q.T, np.inf
    for lo, hi, edges in negatives._segments(64):
        middle, reach = (means[:, lo:hi] * np.diff(edges)) @ means[:, lo:hi].T, devs[:, lo:hi] @ devs[:, lo:hi].T
        assert (np.abs(exact - middle) <= reach + 1e-6).all() and reach.mean() < last
        last = reach.mean()
    table = pa.table({"row": pa.array(range(300)), "vec_id": pa.array(range(300)), "label": pa.array([x[1] for x in rows]), "dim": pa.array([64] * 300), "q": negatives._lists(q), "means": negatives._lists(means), "devs": negatives._lists(devs)})
    block, scored = negatives._Vectors(table), []
    monkeypatch.setattr(negatives, "SPARSE", 2)
    monkeypatch.setattr(negatives, "_exact", lambda a, b: scored.append(len(a)) or np.einsum("ij,ij->i", a, b).astype(np.int64))
    i, j, score = negatives.survivors(block, block, np.full(300, 200_000), np.full(300, 10**9))
    assert {*zip(i, j, strict=True)} == {*zip(*np.nonzero(exact >= 200_000), strict=True)} and (score == exact[i, j]).all()
    assert sum(scored) < 0.6 * 300 * 300


def test_bounds_decide(spark, monkeypatch):
    rows = _clusters(120, 64)
    want = _brute(rows)
    monkeypatch.setattr(negatives, "SLACK", -10.0)  # bounds that are too tight lose pairs
    assert _got(negatives.mined(_table(spark, rows), F.col("vec_id") % 5 == 0)) != want
