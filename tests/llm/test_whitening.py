"""Whitening against whole-number sums and a library's eigenvectors."""

import math

import numpy as np
import pytest

from sylvastack.llm import queries, whitening

COLUMNS = [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def plain(rows, k=8):
    """By id, the deviation and the absolute whitened coordinates, and the shares, from the definition."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    z = [[n * c - t for c, t in zip(v, s)] for v in x]
    centred = np.array([[c / n for c in v] for v in z])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    w = np.abs(centred @ vectors[:, :k] / np.sqrt(values[:k]))
    return [i for i, _ in kept], [sum(c * c for c in v) for v in z], w, values[:k] / values.sum()


def test_query_on_the_whole_table(spark, data):
    found = queries.QUERIES["op11_whitening"](spark, data)
    assert found.dtypes == COLUMNS
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    ids, deviation, w, share = plain(rows)
    got = {(r.vec_id, r.component): r for r in found.collect()}
    assert set(got) == {(i, k) for i in ids for k in range(1, 9)}
    for at, i in enumerate(ids):
        for k in range(1, 9):
            r = got[i, k]
            assert (r.n, r.deviation) == (len(ids), deviation[at])
            assert abs(abs(r.whitened) - w[at, k - 1]) < 1e-8 and abs(r.explained / share[k - 1] - 1) < 1e-9
            assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got.values()}) == 1
    signed = np.array([[got[i, k].whitened for k in range(1, 9)] for i in ids])  # one sign for all rows
    assert np.abs(signed.T @ signed / len(ids) - np.eye(8)).max() < 1e-9


@pytest.mark.parametrize("shape, rank", [((5, 5), 5), ((40, 7), 7), ((3, 9), 3), ((30, 1), 1)])
def test_spectrum_of_any_rank(shape, rank):
    rng = np.random.default_rng(3)
    a = rng.standard_normal(shape) * 10.0 ** rng.integers(-3, 4, shape[1])
    scatter = a.T @ a
    values, vectors = whitening.spectrum(scatter)
    assert len(values) == rank
    assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-12
    assert np.allclose(scatter @ vectors, vectors * values, atol=1e-9 * values[0])


def test_factor_is_triangular_and_gives_the_matrix():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 6))
    factor, order = whitening.pivoted_cholesky(a.T @ a)
    assert np.allclose(factor, np.tril(factor)) and (np.diff(np.abs(np.diag(factor))) <= 0).all()
    assert np.allclose(factor @ factor.T, (a.T @ a)[order][:, order])


def test_equal_eigenvalues():
    values, vectors = whitening.spectrum(np.diag([2.0, 5.0, 5.0, 0.0]))
    assert np.allclose(values, [5, 5, 2]) and np.allclose(np.abs(vectors).sum(axis=0), 1)


def test_null_and_non_finite_vectors_repeats_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(i % 17, [float(x) for x in rng.standard_normal(3)]) for i in range(40)] + [(None, [1.0, 2.0, 3.0])] * 2
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [0.0, -float("inf"), 0.0])]
    df = frame(spark, rows + bad, "double").withColumns({c: F.lit("clash") for c in ("id", "v", "n", "i", "component", "deviation")})
    found = whitening.whiten(df).collect()
    ids, deviation, w, _ = plain(rows)
    want = sorted((str(i), d, k + 1, round(float(w[at, k]), 7) + 0.0) for at, (i, d) in enumerate(zip(ids, deviation)) for k in range(3))
    assert sorted((str(r.id), int(r.deviation), r.component, round(abs(r.whitened), 7) + 0.0) for r in found) == want
    assert {r.n for r in found} == {42}


def test_no_spread_no_rows(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [])).columns == ["id", *(c for c, _ in COLUMNS[1:])]


def test_huge_entries_and_sizes(spark):
    found = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.5]), (3, [0.0, 1.0])], "double")).collect()
    assert {r.component for r in found} == {1, 2} or {r.component for r in found} == {1}
    assert all(math.isfinite(r.whitened) for r in found)
    with pytest.raises(Exception, match="different sizes"):
        whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0])])).collect()


def test_exact_products_where_doubles_do_not_do():
    y = np.array([[3_000_000_019, 7], [2_999_999_929, -5]], np.int64)
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(2)] for i in range(2)]
    assert whitening.exact_products(y).tolist() == want
    assert whitening.exact_products(y % 100).tolist() == ((y % 100).T @ (y % 100)).tolist()
