import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import nearest


def inner(x, y):
    """Component after component; sum() would correct the rounding."""
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += float(a) * float(b)
    return total


def brute(rows, k, every):
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q in {i for i, _ in sound if i % every == 0}:
        found = {(-inner(x, v), i) for i, v in sound if i != q for j, x in sound if j == q and len(x) == len(v)}
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)}
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, `id` string, `v` string").repartition(4)


@pytest.mark.parametrize("seed", [0, 1])
def test_search_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", 40)
    r, g = random.Random(seed), np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in g.normal(size=8) * g.choice([1e-3, 1, 50])]) for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [rows[5], rows[10], rows[10], (10, [1.0] * 8), (500, [1.0, 2.0]), (505, [2.0, 1.0])]
    rows += [(600, None), (605, []), (610, [0.0] * 8), (615, [float("nan")] * 8), (620, [float("inf")] * 8), (625, [None] * 8), (None, [1.0] * 8)]
    r.shuffle(rows)
    df = table(spark, [(i, v, 0, "x", "y") for i, v in rows])
    found = sorted(tuple(x) for x in nearest.search(df, F.col("vec_id") % 5 == 0, k=6).collect())
    assert found == brute(rows, 6, 5)


def test_fewer_candidates_than_asked_for(spark):
    df = table(spark, [(0, [1.0, 0.0], 0, "", ""), (1, [2.0, 0.0], 0, "", "")])
    assert [tuple(x) for x in nearest.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]


def test_no_rows(spark):
    assert nearest.search(table(spark, []), F.lit(True)).count() == 0


def test_bounds_hold():
    g = np.random.default_rng(4)
    q, c = g.normal(size=(50, 33)), g.normal(size=(60, 33)) * g.choice([1e-8, 1, 1e6], size=(60, 1))
    q8, qs, q_len, q_err = nearest.quantised(q)
    c8, cs, _, c_err = nearest.quantised(c)
    about = (q8.astype(float) @ c8.T.astype(float)) * qs[:, None] * cs[None, :]
    slack = q_err[:, None] * np.linalg.norm(c, axis=1)[None, :] + q_len[:, None] * c_err[None, :]
    assert (np.abs(q @ c.T - about) <= slack * (1 + 1e-9) + 1e-12).all()
