"""Whitening against a dense decomposition of the same whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from docflow.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, x array<long>, n long, `row` string"


def rows_of(seed, n=300, dims=7):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(dims, dims)) * np.linspace(3, 0.2, dims)
    vectors = (r.normal(size=(n, dims)) @ mix + r.normal(size=dims) * 5).astype(np.float32).tolist()
    rows = list(enumerate(vectors))
    rows += [(n, vectors[3]), (n, vectors[3]), (None, vectors[4]), *((n + 2 + k, vectors[7]) for k in range(n // 2))]  # copies
    bad = [None, [None] * dims, [float("nan")] * dims, [1.0] * (dims - 1) + [float("inf")], [], [1.0], [0.0] * (dims + 1)]
    return rows + [(9000 + k, v) for k, v in enumerate(bad)], rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, [1], 2, "x") for i, v in rows], SCHEMA).repartition(5)


def brute(rows, k=4):
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    means = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(v, means, strict=True)] for v in fit])
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1][:k], vectors[:, ::-1][:, :k]
    trace = sum(sum((c - m) ** 2 for c, m in zip(v, means, strict=True)) for v in fit) / n
    out = {}
    for (i, _), v in zip(rows, x, strict=True):
        white = np.array([float(c - m) for c, m in zip(v, means, strict=True)]) @ vectors / np.sqrt(e)
        out.setdefault(i, []).append((n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), white, e / float(trace)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_a_dense_decomposition(spark, seed):
    rows, good = rows_of(seed)
    found, expected = {}, brute(good)
    for r in whiten(frame(spark, rows)).collect():
        found.setdefault(r.vec_id, []).append(r)
    assert set(found) == set(expected)
    first = {r.component: r for r in found[0]}
    signs = {c: math.copysign(1, first[c].whitened * expected[0][0][2][c - 1]) for c in first}
    for i, got in found.items():
        assert len(got) == 4 * len(expected[i])
        n, deviation, white, explained = expected[i][0]
        for r in got:
            assert (r.n, r.deviation, int(r.deviation_exact)) == (n, deviation, deviation)
            assert r.whitened * signs[r.component] == pytest.approx(white[r.component - 1], rel=1e-9, abs=1e-9)
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
            assert r.identity_error < 1e-9


def test_large_entries_are_exact(spark):
    rows = [(k, [float(2**40 * (k % 5)), float(k), -float(2**39 * (k % 3)), 0.5, 1.0]) for k in range(30)]
    found = whiten(frame(spark, rows)).collect()
    exact = {i: x[0][1] for i, x in brute(rows, 2).items()}
    assert all(int(r.deviation_exact) == exact[r.vec_id] and r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 2**63 else None) for r in found)
    assert any(r.deviation is None for r in found)


def test_little_variance(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, []), (3, [])])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # one distinct vector
    line = whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert {(r.vec_id, r.component) for r in line} == {(1, 1), (2, 1), (3, 1)}
    assert sorted(abs(round(r.whitened, 9)) for r in line) == [0, round(1.5**0.5, 9), round(1.5**0.5, 9)]
