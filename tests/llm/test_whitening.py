"""Whitening against a plain computation over the distinct vectors."""

import math
import random

import numpy as np
import pytest

from quillspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, part int, n long"


def plain(vectors):
    """Exact deviations, and the covariance's eigenvalues and vectors by numpy."""
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for v in fit])
    e, p = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, sums, e[::-1], p[:, ::-1]


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0.2 * k, 0.3 + 0.2 * k) for k in range(20)] for _ in range(300)]
    return base + [base[0]] * 200 + [base[1]] * 3


def test_against_plain(spark, given):
    df = spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in enumerate(given)], SCHEMA).repartition(7)
    got = rows_of(whitening.whiten(df))
    xs, n, sums, e, p = plain(given)
    assert len(got) == len(given) and n == 300
    for i, x in enumerate(xs):
        assert sorted(got[i]) == list(range(1, 17))
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for k, r in got[i].items():
            assert (r["n"], r["deviation"]) == (n, dev)
            want = sum((c - s / n) * p[j, k - 1] for j, (c, s) in enumerate(zip(x, sums, strict=True))) / math.sqrt(e[k - 1])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
            assert abs(r["explained"] / (e[k - 1] / e.sum()) - 1) < 1e-10
            assert r["identity_error"] < 1e-9
    signs = {k: {np.sign(got[i][k]["whitened"]) * np.sign(sum((c - s / n) * p[j, k - 1] for j, (c, s) in enumerate(zip(x, sums, strict=True)))) for i, x in enumerate(xs)} for k in range(1, 17)}
    assert all(len(s - {0.0}) == 1 for s in signs.values())


@pytest.mark.parametrize("n, seed", [(1, 0), (2, 1), (5, 2), (33, 3), (64, 4)])
def test_eigen_solve(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n)) * np.logspace(0, 3, n)
    a = a @ a.T
    e, v = whitening.eigen(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-10, atol=1e-9 * e[0])
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-12
    assert np.abs(a @ v - v * e).max() < 1e-11 * e[0] * n


def test_eigen_solve_of_equal_values():
    e, v = whitening.eigen(np.eye(6) * 3)
    assert e.tolist() == [3.0] * 6 and np.abs(v.T @ v - np.eye(6)).max() < 1e-14
    assert whitening.eigen(np.zeros((4, 4)))[0].tolist() == [0.0] * 4


def test_merging_in_a_tree_is_the_whole(spark, given):
    x = spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in enumerate(given)], SCHEMA)
    distinct = whitening.quantized(x).select("x")
    one, tree = whitening.moments(distinct.coalesce(1)), whitening.moments(distinct.repartition(23), fan_in=2)
    assert (one.n, one.total.tolist()) == (tree.n, tree.total.tolist())
    assert np.allclose(one.spread, tree.spread, rtol=1e-12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 5.0], 0), (None, [2.0, 0.0], 0), (3, None, 0), (4, [None, 1.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [], 0), (8, [1.0], 0), (9, [1e30, 1.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == sorted([(k, c, 3) for k in (1, 1, 2, 0) for c in (1, 2)])
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.filter("vec_id = 1")).collect() == []  # one distinct vector spans nothing
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0, "x", 1, 2) for i in range(9)], SCHEMA)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}


def test_exact_beyond_small_numbers(spark):
    df = spark.createDataFrame([(i, [1e9 * i, -3e9 * i], 0, "x", 1, 2) for i in range(4)], SCHEMA)
    xs, n, sums, _, _ = plain([[1e9 * i, -3e9 * i] for i in range(4)])
    for r in whitening.whiten(df).collect():
        want = sum((n * c - s) ** 2 for c, s in zip(xs[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (want if want < 1 << 63 else None)
