"""Sufficient statistics and the models fitted from them. Data stays on the cluster; the driver sees d x d numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.vectors import logistic_loss
from gleanery.operators.graph import cluster_ranks, cluster_suppression
from gleanery.session import durable

RESIDUAL_LIMIT = 1e-10


def packed_moments(df: DataFrame, vector: str, target: str, sign: str | None = None, group: str | None = None, single: bool = False) -> DataFrame:
    """(group, pos, value): upper Gram triangle, cross products with the target, and count, in double precision.

    Each task adds its batches up to one row of numbers for each group before the exchange; ``sign`` weighs rows. ``single`` keeps products,
    targets and each task's sums in single precision, to see what it costs; the sums of tasks are rounded once.
    """
    kind = np.float32 if single else np.float64
    rows = df.select((F.col(group) if group else F.lit(0)).cast("string").alias("grp"), F.col(vector).alias("x"), F.col(target).cast("double").alias("y"), (F.col(sign) if sign else F.lit(1)).cast("double").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column("grp").to_pylist(), object)
            vectors = batch.column("x")
            x = np.asarray(vectors.flatten(), kind).reshape(len(vectors), -1)
            y, s = np.asarray(batch.column("y")).astype(kind), np.asarray(batch.column("s")).astype(kind)
            upper = np.triu_indices(x.shape[1])
            for name in set(names.tolist()):
                at = names == name
                weighed = x[at] * s[at][:, None]
                sums[name] = sums.get(name, 0) + np.concatenate(((weighed.T @ x[at])[upper], weighed.T @ y[at], [s[at].sum()]))
        for name, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(np.float64))], names=["grp", "pos", "value"])

    total = F.sum("value")
    return rows.mapInArrow(run, "grp string, pos int, value double").groupBy("grp", "pos").agg((total.cast("float").cast("double") if single else total).alias("value"))


def unpack(moments: DataFrame, dims: int) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """{group: (gram, cross, count)} on the driver."""
    out = {}
    values: dict[str, np.ndarray] = {}
    size = dims * (dims + 1) // 2 + dims + 1
    for r in moments.collect():
        values.setdefault(r["grp"], np.zeros(size))[r["pos"]] = r["value"]
    upper = np.triu_indices(dims)
    for name, v in values.items():
        gram = np.zeros((dims, dims))
        gram[upper] = v[: len(upper[0])]
        gram = gram + np.triu(gram, 1).T
        out[name] = gram, v[len(upper[0]) : -1], float(v[-1])
    return out


def ordered_moments(df: DataFrame, vector: str, target: str, order: str, dtype=np.float32) -> DataFrame:
    """One row of packed moments added row by row in ``order``, for checks of rounding. All rows go to one task by design."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("o")
        x = np.asarray(table["x"].combine_chunks().flatten()).reshape(table.num_rows, -1).astype(dtype)
        y = np.asarray(table["y"].combine_chunks()).astype(dtype)
        upper = np.triu_indices(x.shape[1])
        total = np.zeros(len(upper[0]) + x.shape[1] + 1, dtype)
        for row, t in zip(x, y, strict=True):
            total = total + np.concatenate((np.outer(row, row)[upper], row * t, [1])).astype(dtype)
        return pa.table({"values": pa.array([total.astype(np.float64).tolist()], pa.list_(pa.float64()))})

    return df.select(F.lit(0).alias("one"), F.col(order).alias("o"), F.col(vector).alias("x"), F.col(target).cast("double").alias("y")).groupBy("one").applyInArrow(run, "values array<double>")


def solve_ridge(gram: np.ndarray, cross: np.ndarray, n: float, ridge: float) -> np.ndarray:
    """(gram + ridge * n * I) w = cross; zero for no rows."""
    if n <= 0:
        return np.zeros_like(cross)
    root = np.linalg.cholesky(gram + ridge * n * np.eye(len(gram)))
    return np.linalg.solve(root.T, np.linalg.solve(root, cross))


def solve_dual(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """The same weights through the rows' kernel, for fewer rows than dimensions."""
    return x.T @ np.linalg.solve(x @ x.T + ridge * len(x) * np.eye(len(x)), y) if len(x) else np.zeros(x.shape[1])


def solve_rows(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights by the smaller of both systems: the kernel of the rows where they are fewer than dimensions, the Gram matrix else."""
    return solve_dual(x, y, ridge) if len(x) < x.shape[1] else solve_ridge(x.T @ x, x.T @ y, len(x), ridge)


def solve_gated(gram: np.ndarray, cross: np.ndarray, n: float, ridge: float, method: str = "cholesky") -> np.ndarray:
    """Weights only where the relative residual is within the limit; conjugate gradients start at zero, with at most ten rounds a dimension."""
    a = gram + ridge * n * np.eye(len(gram))
    if n <= 0 or not np.any(cross):
        return np.zeros_like(cross)
    if method == "cholesky":
        w = solve_ridge(gram, cross, n, ridge)
    else:
        w, r = np.zeros_like(cross), cross.copy()
        p, rr = r.copy(), float(r @ r)
        for _ in range(10 * len(cross)):
            q = a @ p
            step = rr / float(p @ q)
            w, r = w + step * p, r - step * q
            new = float(r @ r)
            if np.sqrt(new) <= RESIDUAL_LIMIT * np.linalg.norm(cross) / 10:
                break
            p, rr = r + new / rr * p, new
    if np.linalg.norm(a @ w - cross) > RESIDUAL_LIMIT * max(1.0, np.linalg.norm(cross)):
        raise ArithmeticError("residual over the release limit")
    return w


def extended_residual(gram: np.ndarray, cross: np.ndarray, n: float, ridge: float, w: np.ndarray) -> float:
    """Residual length in extended precision."""
    a = gram.astype(np.longdouble) + np.longdouble(ridge * n) * np.eye(len(gram), dtype=np.longdouble)
    return float(np.linalg.norm((a @ w.astype(np.longdouble) - cross.astype(np.longdouble)).astype(np.float64)))


def ridge_grid(df: DataFrame, vector: str, target: str, fold: str, dims: int, ridges: list[float]) -> list[tuple[float, float]]:
    """(ridge, out-of-fold mean squared error). Each fold's moments come from one pass; training moments are the total less the fold.

    The held-out error needs no second pass: it is a quadratic form in the fold's own moments and its sum of squares.
    """
    folds = unpack(packed_moments(df, vector, target, group=fold), dims)
    squares = {r["grp"]: r["yy"] for r in df.groupBy(F.col(fold).cast("string").alias("grp")).agg(F.sum(F.col(target).cast("double") * F.col(target)).alias("yy")).collect()}
    gram, cross, n = (sum(m[i] for m in folds.values()) for i in range(3))
    out = []
    for ridge in ridges:
        error = 0.0
        for name, (g, c, k) in folds.items():
            w = solve_ridge(gram - g, cross - c, n - k, ridge)
            error += float(w @ g @ w - 2 * w @ c + squares[name])
        out.append((ridge, error / n))
    return out


def fit_logistic(df: DataFrame, vector: str, target: str, dims: int, ridge: float, rounds: int = 50, tolerance: float = 1e-9, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of fractional logistic regression by damped Newton steps: each round is one pass for loss, gradient and curvature."""
    return fit_with_gradient(df, vector, target, dims, ridge, rounds, tolerance, start)[0]


def fit_with_gradient(df: DataFrame, vector: str, target: str, dims: int, ridge: float, rounds: int = 50, tolerance: float = 1e-9, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The same, with the length of the gradient there."""
    rows = df.select(F.col(vector).alias("x"), F.col(target).cast("double").alias("y")).persist()

    def totals(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + dims + dims * dims)
            for batch in batches:
                vectors = batch.column("x")
                x, y = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1), np.asarray(batch.column("y"))
                s = x @ w
                p = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
                loss = np.where(s >= 0, np.log1p(np.exp(-np.abs(s))) + (1 - y) * s, np.log1p(np.exp(-np.abs(s))) - y * s)
                total += np.concatenate([[loss.sum(), len(y)], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["pos", "value"])

        got = np.zeros(2 + dims + dims * dims)
        for r in rows.mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("v")).collect():
            got[r["pos"]] = r["v"]
        n = max(1.0, got[1])
        return got[0] / n + ridge / 2 * float(w @ w), got[2 : 2 + dims] / n + ridge * w, got[2 + dims :].reshape(dims, dims) / n + ridge * np.eye(dims)

    w = np.zeros(dims) if start is None else start.copy()
    try:
        loss, gradient, hessian = totals(w)
        for _ in range(rounds):
            if np.linalg.norm(gradient) <= tolerance:
                break
            step, damp = np.linalg.solve(hessian, gradient), 1.0
            tried = totals(w - step)
            while damp > 1e-8 and tried[0] > loss - 1e-4 * damp * float(gradient @ step) + 1e-14 * max(1.0, abs(loss)):  # near the end, less than rounding is left to gain
                damp /= 2
                tried = totals(w - damp * step)
            w, (loss, gradient, hessian) = w - damp * step, tried
    finally:
        rows.unpersist()
    return w, float(np.linalg.norm(gradient))


def _score(vector: str, weights: np.ndarray):
    return F.aggregate(F.zip_with(vector, F.lit([float(x) for x in weights]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def logistic_errors(df: DataFrame, vector: str, fits: dict[str, np.ndarray]) -> tuple[float, float]:
    """Mean cross-entropy and mean squared error of probabilities over rows and outputs, in one pass."""
    each = []
    for target, w in fits.items():
        z, y = _score(vector, w), F.col(target).cast("double")
        each.append(F.struct(logistic_loss(z, y).alias("bce"), F.pow(1 / (1 + F.exp(-z)) - y, F.lit(2.0)).alias("mse")))
    found = df.select(F.explode(F.array(*each)).alias("e")).agg(F.avg("e.bce").alias("bce"), F.avg("e.mse").alias("mse")).first()
    return found["bce"], found["mse"]


def warm_gradient(gradient: np.ndarray, n: int, changed: np.ndarray, m: int, ridge: float, w: np.ndarray) -> np.ndarray:
    """Mean gradient after a repair from the one before: only the changed rows' signed gradient is new."""
    return n / m * gradient + changed / m + (1 - n / m) * ridge * w


def spherical_kmeans(df: DataFrame, vector: str, k: int, seed: int = 1):
    """Clusters by cosine with Spark's own k-means: (model, rows with ``cluster``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_features", predictionCol="cluster").fit(rows)
    return model, model.transform(rows).drop("_features")


def refit_arms(rows: DataFrame, deleted: DataFrame, k: int, tau: float, seed: int = 1) -> DataFrame:
    """(arm, id): what three ways select after units are deleted, by suppression inside clusters of (id, unit, p, z) rows.

    ``frozen_selection`` keeps the survivors of the first selection; ``frozen_fit`` suppresses again among survivors with the
    first clusters and order; ``full_refit`` fits clusters and order to the survivors. Fits are cut off, so the arms share them.
    """

    def fitted(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        # No rows have no fit; fewer rows than k are a cluster each at most.
        n = part.limit(k).count()
        placed = durable(spherical_kmeans(part, "z", n, seed)[1] if n > 1 else part.withColumn("cluster", F.lit(0)))
        return placed, durable(cluster_ranks(placed, "cluster"))

    def chosen(placed: DataFrame, ranked: DataFrame) -> DataFrame:
        return placed.join(cluster_suppression(placed, "cluster", tau, ranked), "id", "left_anti").select("id", "unit")

    placed, ranked = fitted(rows)
    survivors = placed.join(deleted, "unit", "left_anti")
    arms = {
        "frozen_selection": chosen(placed, ranked).join(deleted, "unit", "left_anti"), "frozen_fit": chosen(survivors, ranked),
        "full_refit": chosen(*fitted(survivors.drop("cluster"))),
    }
    return reduce(DataFrame.union, [found.select(F.lit(arm).alias("arm"), "id") for arm, found in arms.items()])


def utility_panel(chosen: DataFrame, test: DataFrame, vector: str, target: str, method: str, dims: int, ridge: float) -> DataFrame:
    """(method, n_test, mse, mae): a ridge model for each method's selection, all scored on the same test rows in one pass.

    Methods are few; the driver holds d numbers for each. A method without rows has the zero model.
    """
    fits = {name: solve_gated(gram, cross, n, ridge) for name, (gram, cross, n) in unpack(packed_moments(chosen, vector, target, group=method), dims).items()}
    models = F.array(*[F.struct(F.lit(name).alias("method"), F.lit([float(x) for x in w]).alias("w")) for name, w in sorted(fits.items())])
    scored = test.select(F.col(vector).alias("x"), F.col(target).cast("double").alias("y"), F.explode(models).alias("m"))
    error = F.aggregate(F.zip_with("x", "m.w", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a) - F.col("y")
    return scored.groupBy("m.method").agg(F.count("*").alias("n_test"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))
