"""Compressed forms of a matrix-valued deletion polynomial: signed factors, joint spans and rank coordinates.

Each key of the polynomial holds the sum of sign * w w' over its records, w the features with the targets behind them.
Batches compress each key to at most as many factors as w has numbers before any exchange, and merges go through salts
and then keys, so no task sees more than the factors of its share however many records a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.structure import component_labels, endpoints, key_text

TOLERANCE = 1e-12
SALTS = 32
_FACTORS = "key array<{unit}>, scale double, weights array<double>, factors array<double>"


def compress(weights: np.ndarray, factors: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Few orthogonal rows with the same signed sum: QR of the rows, then the eigenvalues of the signed core over the tolerance times ``scale``."""
    if not len(weights):
        return weights, factors
    q, r = np.linalg.qr(factors.T)
    values, turned = np.linalg.eigh((r * weights) @ r.T)
    kept = np.abs(values) > TOLERANCE * scale
    return values[kept], (q @ turned[:, kept]).T


def _merge(keys: list[tuple], scales: list[float], weights: list[np.ndarray], factors: list[np.ndarray]) -> Iterator[tuple]:
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        groups.setdefault(key, []).append(i)
    for key, at in groups.items():
        scale = sum(scales[i] for i in at)
        yield key, scale, *compress(np.concatenate([weights[i] for i in at]), np.concatenate([factors[i] for i in at]), scale)


def _merged_table(table: pa.Table | pa.RecordBatch, dims: int, key_type: pa.DataType) -> pa.Table:
    keys = [tuple(k) for k in table["key"].to_pylist()]
    weights = [np.array(w, float) for w in table["weights"].to_pylist()]
    factors = [np.array(f, float).reshape(-1, dims) for f in table["factors"].to_pylist()]
    out = list(_merge(keys, table["scale"].to_pylist(), weights, factors))
    doubles = pa.list_(pa.float64())
    return pa.table({
        "key": pa.array([list(o[0]) for o in out], key_type), "scale": pa.array([o[1] for o in out], pa.float64()),
        "weights": pa.array([o[2].tolist() for o in out], doubles), "factors": pa.array([o[3].ravel().tolist() for o in out], doubles),
    })


def _schema(df: DataFrame) -> str:
    return _FACTORS.format(unit=dict(df.dtypes)["key"].removeprefix("array<").removesuffix(">"))


def merge_factors(parts: DataFrame, dims: int) -> DataFrame:
    """One row for each key: in each batch, then over salts, then over keys. Keys without any factor left drop."""
    schema = _schema(parts)

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _merged_table(batch, dims, batch.schema.field("key").type).to_batches()

    def whole(table: pa.Table) -> pa.Table:
        return _merged_table(table, dims, table.schema.field("key").type)

    salted = parts.mapInArrow(batchwise, schema).withColumn("salt", F.pmod(F.xxhash64("weights", "factors"), F.lit(SALTS)))
    once = salted.groupBy("key", "salt").applyInArrow(lambda t: whole(t.drop_columns(["salt"])), schema)
    return once.groupBy("key").applyInArrow(whole, schema).where(F.size("weights") > 0)


def factor_polynomial(found: DataFrame, stats: DataFrame, dims: int, horizon: int | None = None) -> DataFrame:
    """(key, scale, weights, factors) from terms and (id, w), w an array of ``dims`` numbers: the signed-factor state.

    ``scale`` is the sum of squared lengths that entered a key; what cancels to less than the tolerance of it drops. Records
    without statistics add nothing; without records the state is empty.
    """
    each = endpoints(found, horizon).join(stats.select("id", F.col("w").cast("array<double>").alias("factors")), "id")
    length = F.aggregate("factors", F.lit(0.0), lambda s, x: s + x * x)
    return merge_factors(each.select("key", length.alias("scale"), F.array(F.col("sign").cast("double")).alias("weights"), "factors"), dims)


def substitute_factors(state: DataFrame, deleted: list, dims: int, horizon: int | None = None) -> DataFrame:
    """The state after deleting units: they leave every key, keys over the rest of the horizon drop, merged keys compress again."""
    gone = F.array(*[F.lit(x) for x in deleted]).cast(dict(state.dtypes)["key"])
    moved = state.withColumn("key", F.array_sort(F.array_except("key", gone)))
    if horizon is not None:
        moved = moved.where(F.size("key") <= horizon - len(deleted))
    return merge_factors(moved.select("key", "scale", "weights", "factors"), dims)


def evaluate_factors(state: DataFrame, deleted: list, dims: int) -> DataFrame:
    """At most one row, with the empty key: the signed factors of what is selected after deleting units."""
    gone = F.array(*[F.lit(x) for x in deleted]).cast(dict(state.dtypes)["key"])
    inside = state.where(F.size(F.array_except("key", gone)) == 0)
    return merge_factors(inside.select(F.array_except("key", "key").alias("key"), "scale", "weights", "factors"), dims)


def dense(weights: list[float], factors: list[float], dims: int) -> np.ndarray:
    """The matrix of one row of factors."""
    f = np.array(factors, float).reshape(-1, dims)
    return (f.T * np.array(weights, float)) @ f


def dense_rows(state: DataFrame, dims: int) -> DataFrame:
    """(key, i, j, value), i <= j from 1: the upper triangle of each key's matrix."""
    unit = dict(state.dtypes)["key"]
    i, j = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, w, f in zip(*(batch.column(n).to_pylist() for n in ("key", "weights", "factors")), strict=True):
                columns = [pa.array([key] * len(i), batch.schema.field("key").type), pa.array(i + 1, pa.int32()), pa.array(j + 1, pa.int32()), pa.array(dense(w, f, dims)[i, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "i", "j", "value"])

    return state.mapInArrow(run, f"key {unit}, i int, j int, value double")


def joint_spans(state: DataFrame, dims: int, features: int) -> DataFrame:
    """(key, rank, basis, core, cross) of the first ``features`` coordinates: Gram = basis core basis', cross products = basis cross.

    The basis spans the columns of both, from their singular vectors, each with its largest coordinate positive. All arrays are row by row.
    """
    unit = dict(state.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, scale, w, f in zip(*(batch.column(n).to_pylist() for n in ("key", "scale", "weights", "factors")), strict=True):
                m = dense(w, f, dims)
                gram, cross = m[:features, :features], m[:features, features:]
                u, s, _ = np.linalg.svd(np.hstack([gram, cross]), full_matrices=False)
                u = u[:, s > TOLERANCE * scale]
                u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0) if u.size else u
                rows.append((key, u.shape[1], u.ravel().tolist(), (u.T @ gram @ u).ravel().tolist(), (u.T @ cross).ravel().tolist()))
            doubles = pa.list_(pa.float64())
            kinds = (batch.schema.field("key").type, pa.int32(), doubles, doubles, doubles)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "rank", "basis", "core", "cross"])

    return state.mapInArrow(run, f"key {unit}, rank int, basis array<double>, core array<double>, cross array<double>")


# Rank coordinates ---------------------------------------------------------------------------------------------------


def rank_coordinates(polynomial: DataFrame, found: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """The polynomial (key, coefficient) without one key of each ungrounded component, and (key, label, loose) of all keys.

    A record gives and takes in one component, so coefficients of a component without ground sum to zero and its smallest key is
    told by the others.
    """
    labels = component_labels(found, [horizon]).drop("horizon")
    members = labels.where("node <> 'ground'").select(F.substring("node", 3, 1 << 30).alias("name"), F.col("node"), "label", (F.col("label") != "ground").alias("loose"))
    omitted = members.where("loose and node = label").select("name")
    named = polynomial.withColumn("name", key_text(F.col("key")))
    return named.join(omitted, "name", "left_anti").drop("name"), members.select("name", "label", "loose")


def restore_keys(coordinates: DataFrame, members: DataFrame) -> DataFrame:
    """(name, coefficient) with the omitted keys back, keys as comma-joined text, zeros dropped."""
    named = coordinates.select(key_text(F.col("key")).alias("name"), "coefficient")
    back = named.join(members.where("loose"), "name").groupBy("label").agg((-F.sum("coefficient")).alias("coefficient")).where("coefficient <> 0")
    return named.union(back.select(F.substring("label", 3, 1 << 30), "coefficient"))
