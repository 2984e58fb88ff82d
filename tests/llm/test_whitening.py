"""Whitening against a dense eigendecomposition, and the solver by itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowmill.llm import whitening


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumns({c: F.lit("clash") for c in ("x", "dim", "v", "n", "place", "component")})


def compare(found, rows, components=8):
    """Rows of one dimension against numpy; vectors by id and content may repeat."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], dtype=object)
    deviation = (centred**2).sum(axis=1).tolist()
    y = centred.astype(float) / n
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1], u[:, ::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    assert len(found) == n * k
    w = y @ u[:, :k] / np.sqrt(values[:k])
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(by_id) == n
    for at, (i, _) in enumerate(rows):
        for c, r in by_id[i].items():
            assert (r.n, int(r.deviation)) == (n, deviation[at])
            assert abs(abs(r.whitened) - abs(w[at, c - 1])) < 1e-8
            assert abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9
            assert 0 <= r.identity_error < 1e-8
    for c in range(1, k + 1):  # one sign for all rows
        signs = {math.copysign(1, by_id[i][c].whitened * w[at, c - 1]) for at, (i, _) in enumerate(rows) if abs(w[at, c - 1]) > 1e-6}
        assert len(signs) == 1


def test_equals_dense_eigenvectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    compare(whitening.whiten(vectors).collect(), [(r.vec_id, r.embedding) for r in vectors.collect()])


def test_bad_vectors_go_and_all_else_stays(spark):
    rng = np.random.default_rng(3)
    good = [(k, (rng.standard_normal(5) * [5, 4, 3, 2, 1]).tolist()) for k in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan, 1.0, 1.0, 1.0, 1.0]), (104, [math.inf, 1.0, 1.0, 1.0, 1.0]), (105, [1e300, 1.0, 1.0, 1.0, 1.0])]
    compare(whitening.whiten(frame(spark, good + bad, "double")).collect(), good, 5)
    nameless = whitening.whiten(frame(spark, good + [(None, [0.0] * 5), (7, [0.0] * 5)], "double"))
    assert nameless.count() == 42 * 5 and {r.n for r in nameless.collect()} == {42}


def test_spaces_of_their_own_and_without_spread(spark):
    rng = np.random.default_rng(4)
    three, two = [(k, rng.standard_normal(3).tolist()) for k in range(20)], [(k, rng.standard_normal(2).tolist()) for k in range(20, 50)]
    found = whitening.whiten(frame(spark, three + two + [(99, [1.0])], "double")).collect()
    compare([r for r in found if r.vec_id < 20], three, 3)
    compare([r for r in found if 20 <= r.vec_id < 50], two, 2)
    assert not [r for r in found if r.vec_id == 99]  # one vector has no spread
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    flat = [(k, [float(k), 7.0, float(2 * k)]) for k in range(10)]
    assert {r.component for r in whitening.whiten(frame(spark, flat)).collect()} == {1}


def test_deviation_beyond_64_bits_is_exact(spark):
    rows = [(k, [float(2**40 * (k - 3)), float(k % 3)]) for k in range(9)]
    compare(whitening.whiten(frame(spark, rows, "double"), 1).collect(), rows, 1)


def test_one_common_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.standard_normal(24) if k % 3 else np.full(24, 30.0)).tolist()) for k in range(90)]
    compare(whitening.whiten(frame(spark, rows, "double")).collect(), rows)


@pytest.mark.parametrize("matrix", [np.zeros((5, 5)), np.diag([1.0, 0, 0, 0]), np.ones((20, 20)), np.eye(30), np.diag(np.r_[1e6, np.ones(40)]), np.array([[2.0]]), np.diag(np.linspace(1, 1.001, 60)), np.diag(1.0 / (1 + np.arange(300)))])
def test_solver_is_certified(matrix):
    wanted = min(8, len(matrix))
    values, vectors, residuals = whitening.lobpcg(lambda b: matrix @ b, len(matrix), wanted)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:wanted], rtol=1e-10, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-12)
    assert (residuals <= 1e-12 * max(values[0], 1e-300)).all()
