"""Vector expressions in coordinate order, score bins, sign words."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Left fold over the coordinates in double precision, so each pair has one value wherever it is computed."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Column) -> Column:
    """Null for zero, null or non-finite vectors."""
    # The length is a field of one struct, so that it is taken once and not for every coordinate.
    one = F.array(F.struct(a.alias("a"), norm(a).alias("n")))
    return F.get(F.transform(one, lambda s: F.when((s["n"] > 0) & (s["n"] < float("inf")) & ~F.isnan(s["n"]), F.transform(s["a"], lambda x: x.cast("double") / s["n"]))), F.lit(0))


def score_bin(score: Column, bins: int = 20) -> Column:
    """Bin of [-1, 1], closed below: score + 1 counted in bins, rounded to nine decimals, then down. What lies beyond falls in the first or last."""
    fine = (score + 1) * F.lit(bins / 2) * F.lit(1e9)
    near = F.floor(fine) + (fine - F.floor(fine) >= 0.5).cast("int")
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(near / F.lit(1e9)).cast("int")))


def bin_places(score: np.ndarray, bins: int = 20) -> np.ndarray:
    """The same of an array."""
    fine = (score + 1) * (bins / 2) * 1e9
    near = np.floor(fine)
    near += fine - near >= 0.5
    return np.clip(np.floor(near / 1e9), 0, bins - 1).astype(np.int16)


def similarity_band(score: Column, tau: float) -> Column:
    margin = (score - tau) / (1 - tau)
    return F.when(margin < 0.25, 0).when(margin < 0.5, 1).when(margin < 0.75, 2).otherwise(3)


def label_relation(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "unavailable").when(a == b, "equal").otherwise("unequal")


def planes(dims: int, tables: int, bits: int) -> list[list[list[int]]]:
    """Hyperplanes with entries -1 and 1, from a rule that SQL can repeat: the low bit of a multiplicative hash."""
    return [[[1 - 2 * ((((t * bits + b) * dims + i + 1) * 2654435761 % 2**32) >> 16 & 1) for i in range(dims)] for b in range(bits)] for t in range(tables)]


def plane_signature(vector: Column, table: list[list[int]]) -> Column:
    """Signs of the products with each plane, packed into a number."""
    out = F.lit(0).cast("long")
    for b, plane in enumerate(table):
        product = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in plane]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        out = out + F.when(product >= 0, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


@F.pandas_udf(T.StringType())
def vector_hash(vectors: pd.Series) -> pd.Series:
    """SHA-256 of a vector's little-endian single-precision bytes, whatever its width was; null for null."""
    return vectors.map(lambda v: None if v is None else sha256(np.asarray(v, "<f4").tobytes()).hexdigest())


def sign_bits(vector: Column) -> Column:
    """One bit for each coordinate, 1 where it is not negative, as text padded with zeros to whole bytes."""
    bits = F.array_join(F.transform(vector, lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    return F.rpad(bits, F.ceil(F.length(bits) / 8).cast("int") * 8, "0")


def pack_bits(bits: Column) -> Column:
    """Text of bits to bytes in hex."""
    n = (F.length(bits) / 8).cast("int")
    byte = lambda i: F.lpad(F.hex(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 10).cast("long")), 2, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), "")


def unpack_bits(packed: Column) -> Column:
    """The inverse of pack_bits."""
    n = (F.length(packed) / 2).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.conv(F.substring(packed, i * 2 + 1, F.lit(2)), 16, 2), 8, "0")), "")


def pooled_chunks(chunks: DataFrame, group: str = "doc_id", weight: str = "n_tokens", vector: str = "vector") -> DataFrame:
    """(group, pos, value): chunk vectors at unit length, averaged by weight, at unit length again."""
    long = chunks.select(group, weight, F.posexplode(unit_vector(F.col(vector))).alias("pos", "x"))
    mean = long.groupBy(group, "pos").agg((F.sum(F.col("x") * F.col(weight)) / F.sum(weight)).alias("x"))
    length = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return mean.join(length, group).select(group, "pos", (F.col("x") / F.col("n")).alias("value"))


def orthonormal_projection(dims: int, out: int, seed: int) -> np.ndarray:
    """The first columns of a seeded orthogonal matrix, signs fixed by a positive diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, out)))
    return q * np.sign(np.diag(r))


def project(vector: Column, matrix: np.ndarray) -> Column:
    return F.array(*[dot(vector, F.array(*[F.lit(float(x)) for x in column])) for column in matrix.T])


_INTERVAL = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])


def _outward(rounded: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lower": np.nextafter(rounded, -np.inf), "upper": np.nextafter(rounded, np.inf)})


@F.pandas_udf(_INTERVAL)
def outward_product(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """An interval that holds the exact product: one step outward of the rounded one."""
    return _outward(a.to_numpy(float) * b.to_numpy(float))


@F.pandas_udf(_INTERVAL)
def outward_sum(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """An interval that holds the exact sum."""
    return _outward(a.to_numpy(float) + b.to_numpy(float))


@F.pandas_udf(_INTERVAL)
def outward_quotient(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """An interval that holds the exact quotient; NaN ends for a divisor of zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return _outward(np.where(b.to_numpy(float) == 0, np.nan, a.to_numpy(float) / b.to_numpy(float)))


def logistic_loss(score: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit, stable for either sign."""
    return F.when(score >= 0, F.log1p(F.exp(-score)) + (1 - target) * score).otherwise(F.log1p(F.exp(score)) - target * score)
