"""Embedding whitening: principal components over the distinct integer vectors.

Rows with one and the same integer vector are one group. The covariance is a
centred matrix product over the groups, whose weight is one or their count;
every distinct vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored
from .vectors import blocks, decimals, exact, integers, largest, sums, vector_key, whole

#: A component whose share of the variance is not above this is nought but rounding.
NOUGHT = 1e-13


def _totals(groups: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Weight and sums by dimension, exact, for every length of vector."""

    def work(batches):
        import pyarrow as pa

        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for rows, x in blocks(batch.column(0)):
                w = weights[rows]
                n, s = held.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
                x = exact(x, largest(x) * int(w.sum()))
                held[x.shape[1]] = n + int(w.sum()), s + (x * w[:, None]).sum(0).astype(object)
        for d, (n, s) in held.items():
            # at place -1 stands the weight
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d] * (d + 1), pa.int32()), "place": pa.array(range(-1, d), pa.int32()), "total": decimals([n, *s])})

    got = sums(groups.select("x", "weight").mapInArrow(work, "dims int, place int, total decimal(38,0)"), ["dims", "place"], "total").toArrow().to_pylist()
    out: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(got, key=lambda r: (r["dims"], r["place"])):
        if row["total"] is None:
            raise ValueError("a sum of integer vectors has more than 38 digits")
        if row["place"] < 0:
            out[row["dims"]] = int(row["total"]), []
        else:
            out[row["dims"]][1].append(int(row["total"]))
    return out


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n as doubles, by whole numbers as far as these are exact."""
    if n * largest(x) < 1 << 53 and all(abs(t) < 1 << 53 for t in total):
        return (n * x - np.array(total, np.int64)) / n
    return x - np.array([t / n for t in total])


def _deviation(x: np.ndarray, n: int, total: list[int]):
    """Sum of (n * x - total)**2 over the dimensions, exact."""
    reach = n * largest(x) + max(map(abs, total), default=0)
    if reach * reach * x.shape[1] < 1 << 62:
        y = n * x - np.array(total, np.int64)
        return (y * y).sum(1)
    # n*n*x.x - 2*n*x.total + total.total, with the totals in two halves so that products fit 64 bits
    low, high = [t & 0x7FFFFFFF for t in total], [t >> 31 for t in total]
    size = largest(x)
    if size * size * x.shape[1] < 1 << 62 and size * max([1 << 31, *map(abs, high)]) * x.shape[1] < 1 << 62:
        parts = zip((x * x).sum(1).tolist(), (x @ np.array(low, np.int64)).tolist(), (x @ np.array(high, np.int64)).tolist(), strict=True)
        rest = sum(t * t for t in total)
        return [n * n * q - 2 * n * (a + (b << 31)) + rest for q, a, b in parts]
    y = x.astype(object) * n - np.array(total, object)
    return (y * y).sum(1)


def _covariance(groups: DataFrame, totals: dict) -> dict[int, np.ndarray]:
    """Weighted covariance for every length, divisor n: each task multiplies its centred block, Spark sums the products."""

    def work(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for rows, x in blocks(batch.column(0)):
                c = _centred(x, *totals[x.shape[1]])
                held[x.shape[1]] = held.get(x.shape[1], 0) + c.T @ (c * weights[rows][:, None])
        for d, g in held.items():
            for i in range(d):
                yield pa.RecordBatch.from_pydict({"dims": pa.array([d] * (d - i), pa.int32()), "i": pa.array([i] * (d - i), pa.int32()), "j": pa.array(range(i, d), pa.int32()), "v": g[i, i:]})

    parts = groups.select("x", "weight").mapInArrow(work, "dims int, i int, j int, v double")
    got = parts.groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    dims, i, j, v = (got.column(k).to_numpy() for k in range(4))
    out = {}
    for d in totals:
        own = dims == d
        g = np.zeros((d, d))
        g[i[own], j[own]] = g[j[own], i[own]] = v[own]
        out[d] = g / totals[d][0]
    return out


def principal(cov: np.ndarray, most: int) -> dict:
    """The foremost components of a covariance: shares of the variance, axes, and what they are divided by.

    An axis' sign is such that its greatest entry is positive. A component
    without variance has nan where whitening would divide by nought.
    """
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    trace = float(np.trace(cov))
    big = np.abs(axes).argmax(0) if axes.size else []
    axes = axes * np.sign(axes[big, range(axes.shape[1])])
    real = e > NOUGHT * trace
    explained = np.where(real, e, 0) / trace if trace > 0 else np.full(len(e), np.nan)
    return {"axes": axes, "root": np.sqrt(np.where(real, e, np.nan)), "explained": explained}


def whiten(df: DataFrame, ids: list[str], col: str = "embedding", components: int = 4, weights: str = "one", scale: int = 256) -> DataFrame:
    """Columns `ids` and, for every row whose vector is whole, its place on the foremost principal components.

    Rows whose vector is null or has a null or non-finite entry go; the others'
    entries become x = floor(scale * c). The fit list is each distinct x
    once (weights "one") or as often as it occurs ("count"). Adds n (the fit list's
    length), deviation decimal(38,0) (sum of (n*x - S)^2, exact; null beyond 38 digits), whitened and
    explained (arrays, one entry for each component) and identity_error
    (largest difference of the whitened vectors' covariance from the identity).

    Vectors of each length are a space of their own. A component without
    variance (fewer distinct vectors or dimensions than components, or equal
    entries) has a null place and explains 0; where nothing varies at all, explained is null
    too. Components of equal variance are any basis of theirs, one for all rows. Repeated rows and null ids each give a
    row; an empty table none. Of df only `ids` and `col` are read. The driver holds one square matrix
    for each length of vector, whatever the number of rows.
    """
    if weights not in ("one", "count"):
        raise ValueError('weights is "one" or "count"')
    kept = df.filter(whole(col)).select(F.struct(*ids).alias("id"), integers(col, scale).alias("x"))
    rows = kept.withColumn("key", vector_key("x"))
    groups = rows.groupBy("key", "x").agg(F.count("*").alias("n_rows"))
    groups = stored(groups.withColumn("weight", F.lit(1).cast("long") if weights == "one" else F.col("n_rows")), "vectors")
    totals = _totals(groups)
    spaces = {d: principal(c, components) for d, c in _covariance(groups, totals).items()}

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, x in blocks(batch.column(3)):
                d, m = x.shape[1], spaces[x.shape[1]]
                n, total = totals[d]
                places = (_centred(x, n, total) @ m["axes"]) / m["root"]
                k = places.shape[1]
                flat = pa.array(places.ravel(), pa.float64(), from_pandas=True)  # nan: null
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in range(3)), pa.array([d] * len(x), pa.int32()), pa.array([n] * len(x), pa.int64()), decimals(_deviation(x, n, total)), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, flat)],
                    names=["key", "n_rows", "weight", "dims", "n", "deviation", "whitened"],
                )

    done = groups.select("key", "n_rows", "weight", "x").mapInArrow(work, "key binary, n_rows long, weight long, dims int, n long, deviation decimal(38,0), whitened array<double>")
    done = stored(done, "whitened")
    told = df.sparkSession.createDataFrame([(d, [None if np.isnan(v) else float(v) for v in m["explained"]], e) for d, m, e in ((d, spaces[d], e) for d, e in _errors(done, spaces).items())], "dims int, explained array<double>, identity_error double")
    joined = spread(rows.select("id", "key"), done.drop("n_rows", "weight"), ["key"], done.select("key", "n_rows"), by=["id"])
    return joined.join(F.broadcast(told), "dims").select("id.*", "n", "deviation", "whitened", "explained", "identity_error")


def _errors(done: DataFrame, spaces: dict) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, by length; over components that vary."""
    width = max([len(m["root"]) for m in spaces.values()], default=0)
    if not width:
        return dict.fromkeys(spaces, 0.0)
    w = [F.get("whitened", F.lit(k)) for k in range(width)]
    means = done.groupBy("dims").agg(F.sum("weight").alias("_n"), *[(F.sum(F.col("weight") * c) / F.sum("weight")).alias(f"m{k}") for k, c in enumerate(w)])
    joined = done.join(F.broadcast(means), "dims")
    off = [c - F.col(f"m{k}") for k, c in enumerate(w)]
    cells = [(a, b) for a in range(width) for b in range(a, width)]
    got = joined.groupBy("dims").agg(*[(F.sum(F.col("weight") * off[a] * off[b]) / F.sum("weight")).alias(f"c{a}_{b}") for a, b in cells]).collect()
    return {r["dims"]: max([abs(r[f"c{a}_{b}"] - (a == b)) for a, b in cells if r[f"c{a}_{b}"] is not None], default=0.0) for r in got}
