"""Whitening and clustering against brute force, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest

from loomspark.llm import centroids, queries, whitening

COLUMNS = "vec_id long, embedding array<double>, n string, x string, key string, cluster string, distance string, dims string"


def table(spark, vectors, ids=None):
    """Rows with columns named as the operators' own."""
    rows = [(k if ids is None else ids[k], v, "a", "b", "c", "d", "e", "f") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, COLUMNS)


def some(count, dims, seed=1, spread=0.2):
    """Vectors of unequal variance by dimension, with copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, spread, (count, dims)) * np.linspace(1, 3, dims)
    x[1::4] = x[0]
    return x.tolist()


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    vectors = [*some(80, 6), None, [1.0, None] * 3, [math.nan] * 6, [math.inf] + [0.0] * 5, [0.001] * 6, [0.0011] * 6]
    ids = [*range(len(vectors) - 1), None]
    got = whitening.whiten(table(spark, vectors, ids), ["vec_id"], weights=weights).collect()
    own = [(i, [math.floor(256 * c) for c in v]) for i, v in zip(ids, vectors, strict=True) if whole(v)]
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in own)
    fit = [list(v) for v in ({tuple(x) for _, x in own} if weights == "one" else [tuple(x) for _, x in own])]
    n, total = len(fit), np.sum(fit, 0).tolist()
    c = np.array(fit) - np.mean(fit, 0)
    e, axes = np.linalg.eigh(c.T @ c / n)
    by = {r.vec_id: r for r in got}
    for i, x in own:
        r = by[i]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
        want = (np.array(x) - np.mean(fit, 0)) @ axes[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])
        assert np.allclose(np.abs(r.whitened), np.abs(want), atol=1e-9)
        assert np.allclose(r.explained, e[::-1][:4] / e.sum(), rtol=1e-9) and 0 <= r.identity_error < 1e-9
    w = np.array([r.whitened for r in got])
    assert len({np.sign(w[k, 0] * (np.array(x) - np.mean(fit, 0)) @ axes[:, -1]) for k, x in enumerate(dict(own)[r.vec_id] for r in got)} - {0}) == 1  # one sign for all rows


def test_whitening_without_variance(spark):
    """Fewer distinct vectors than components, equal vectors, several lengths, none."""
    got = whitening.whiten(table(spark, [[1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0], [7.0], [7.0], [], [3.0, 4.0]]), ["vec_id"]).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == 7 and by[0].whitened == by[2].whitened
    assert [None if v is None else abs(v) for v in by[0].whitened] == [1.0, None, None, None] and by[0].explained == [1.0, 0.0, 0.0, 0.0]
    assert by[3].whitened == [None] and by[3].explained == [None] and by[3].deviation == 0 and by[3].n == 1
    assert by[5].whitened == [] and len(by[6].whitened) == 2
    assert whitening.whiten(table(spark, []), ["vec_id"]).count() == 0
    assert whitening.whiten(table(spark, [None, [math.nan]]), ["vec_id"]).count() == 0


def test_deviation_beyond_64_bits():
    rng = np.random.default_rng(3)
    for reach, n in ((200, 10), (200, 10**12), (1 << 40, 10**9), ((1 << 62), 7)):
        x = rng.integers(-reach, reach, (5, 64))
        total = [int(v) for v in x.astype(object).sum(0) * (n // 5)]
        want = [sum((n * int(a) - t) ** 2 for a, t in zip(row, total, strict=True)) for row in x.tolist()]
        assert [int(v) for v in whitening._deviation(x, n, total)] == want


def lloyd(rows, dims, k, rounds, seed):
    """Plain clustering in Python integers."""
    x = [(i, [min(max(math.floor(256 * c), -(2**63)), 2**63 - 1) for c in v]) for i, v in rows if whole(v) and len(v) == dims]
    first = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(now))

    for _ in range(rounds):
        own = {}
        for _, v in x:
            own.setdefault(near(v)[1], []).append(v)
        now = [[sum(col) // len(own[c]) for col in zip(*own[c], strict=True)] if c in own else m for c, m in enumerate(now)]
    return sorted((str(i), near(v)[1], near(v)[0], tuple(now[near(v)[1]])) for i, v in x)


@pytest.mark.parametrize("odd", [[], [[1e18, -1e18, 3.0], [1e300, 0.0, -1e300], [1e7, 1e7, -1e7]]])
def test_clusters(spark, odd):
    vectors = [*some(90, 3), None, [1.0], [math.nan, 1.0, 1.0], [None, 1.0, 1.0], [-0.001, 0.0, -0.0], *odd]
    ids = [k if k % 11 else 5 for k in range(len(vectors) - 1)] + [None]  # repeated ids
    got = centroids.cluster(table(spark, vectors, ids), dims=3, k=8, rounds=4, seed=3).collect()
    want = lloyd(list(zip(ids, vectors, strict=True)), 3, 8, 4, 3)
    fits = [(i, c, d if d < 10**38 else None, m) for i, c, d, m in want]
    assert sorted(((str(r.vec_id), r.cluster, None if r.distance is None else int(r.distance), tuple(r.centroid)) for r in got), key=str) == sorted(fits, key=str)
    if not odd:
        assert {r.inertia for r in got} == {sum(w[2] for w in want)}
        assert all(r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in got)


def test_few_and_no_vectors(spark):
    got = centroids.cluster(table(spark, [[0.5, 0.5], [0.5, 0.5], [9.0, 9.0]]), dims=2, k=40).collect()
    assert sorted(r.distance for r in got) == [0, 0, 0] and len({r.cluster for r in got}) == 2 and {r.inertia for r in got} == {0}
    for rows in ([], [None, [1.0]]):
        assert centroids.cluster(table(spark, rows), dims=2).count() == 0


def test_tables_equal_plain_distances():
    """Small, middling and large ranges take other tables; all give the same."""
    rng = np.random.default_rng(5)
    for reach in (3, 300, 1 << 20, 1 << 40):
        x, m = rng.integers(-reach, reach, (50, 7)), rng.integers(-reach, reach, (5, 7))
        x[3] = x[4]
        best, distance = centroids.nearest(x, m)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in m] for v in x]
        assert distance.tolist() == [min(w) for w in want] and best.tolist() == [w.index(min(w)) for w in want]


def test_queries(spark):
    """The whitened table's own covariance is the identity; columns are those agreed on."""
    got = queries.QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.cov(w.T, bias=True), np.eye(4), atol=1e-9) and got["explained"].between(0, 1).all()
