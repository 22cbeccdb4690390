"""Whitening against numpy's eigensolver and exact integers; defined edge cases."""

import duckdb
import numpy as np
import pytest

from tenderlens.llm import whitening
from tenderlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, v int, n string, component int"


def expected(vectors):
    """n, exact deviations, eigenvalues, eigenvectors and centred rows of integer vectors."""
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in row] for row in vectors]
    n = len(x)
    sums = [sum(col) for col in zip(*x)]
    z = [[n * c - s for c, s in zip(row, sums)] for row in x]
    y = np.array([[c / n for c in row] for row in z])
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, [sum(c * c for c in row) for row in z], values[::-1], axes[:, ::-1], y


def check(rows, ids, vectors, components=32):
    n, deviation, values, axes, y = expected(vectors)
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    k = max(c for _, c in got)
    assert len(rows) == len(ids) * k and k <= components
    signs = np.ones(k)
    for at, key in enumerate(ids):
        for c in range(k):
            r = got[key, c + 1][0]
            want = y[at] @ axes[:, c] / values[c] ** 0.5
            if at == 0 or abs(want) > 0.5:
                signs[c] = np.sign(want * r.whitened) if at == 0 else signs[c]
            assert (r.n, r.deviation) == (n, deviation[at])
            assert abs(r.whitened * signs[c] - want) < 1e-6
            assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9
            assert r.identity_error < 1e-9
    return k


def test_query_matches_numpy(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet'").fetchall()
    got = QUERIES["op13_whitening"](spark, FOLDER)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"]
    assert check(got.collect(), [i for i, _ in rows], [v for _, v in rows]) == 32


def test_edges(spark):
    good = [(1, [0.5, -0.25, 3.0]), (2, [0.0, 1.0, 2.0]), (3, [9.0, 1.5, -2.0]),
            (None, [4.0, 4.0, 4.0]), (5, [-1.0, 2.0, 8.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]),
           (9, [1.0, float("inf"), 1.0]), (10, []), (11, [1.0]), (12, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 1, "x", 7) for i, v in good + bad], SCHEMA)
    got = whitening.whitened(frame).collect()
    assert check(got, [i for i, _ in good], [v for _, v in good]) == 3
    assert whitening.whitened(frame.limit(0)).count() == 0
    assert whitening.whitened(frame.filter("vec_id = 1")).count() == 0
    assert whitening.whitened(frame.filter("vec_id > 5")).count() == 0
    twice = frame.unionByName(frame)
    assert sorted(r.vec_id or 0 for r in whitening.whitened(twice).filter("component = 1").collect()
                  ) == [0, 0, 1, 1, 2, 2, 3, 3, 5, 5]
    equal = spark.createDataFrame([(i, [1.0, 2.0], 1, "x", 7) for i in range(5)], SCHEMA)
    assert whitening.whitened(equal).count() == 0


def test_far_entries_are_exact(spark):
    vectors = [[3e7, -1e9], [2.5e7, 4e9], [1.0, 2e9], [-8e8, 1e8]]
    frame = spark.createDataFrame([(i, v, 1, "x", 7) for i, v in enumerate(vectors)], SCHEMA)
    n, deviation, values, axes, y = expected(vectors)
    rows = whitening.whitened(frame).filter("component = 1").collect()
    assert {r.vec_id: r.deviation for r in rows} == \
        {i: d if d < 1 << 63 else None for i, d in enumerate(deviation)}
    huge = spark.createDataFrame([(i, [3e38, float(i)], 1, "x", 7) for i in range(4)], SCHEMA)
    assert whitening.whitened(huge).count() == 4


@pytest.mark.parametrize("d", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["plain", "flat", "equal", "steep", "clustered"])
def test_slicing_matches_eigensolver(d, kind):
    a = np.random.default_rng(d).standard_normal((200, d))
    if kind == "flat":
        a[:, 1 + d // 2:] = 0
    elif kind == "equal":
        a = np.repeat(a, 2, axis=1)
    elif kind == "steep":
        a = a * 10.0 ** -np.minimum(np.arange(d), 7)
    v = np.eye(d) * 3 if kind == "clustered" else a.T @ a / 200
    if kind == "clustered":
        v[0, 0] += 1e-9
    values, axes = whitening.leading(v, 32)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ axes - axes * values).max() < 1e-12 * want[0]
    for s in np.array([0.4, 0.02, -0.1]) * want[0]:
        assert whitening.count_above(v, s) == (np.linalg.eigvalsh(v) > s).sum()
