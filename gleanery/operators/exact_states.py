"""A matrix-valued deletion polynomial with exact rational coefficients.

Features lie on a dyadic grid, so each coefficient is a whole number over a power of two: sums are decimals of 38 digits that
add up the same in any order, cancel to a true zero, and fail loudly where they would overflow. Only one matrix, never
the state, becomes fractions on the driver.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.inference import canonical_chart
from gleanery.operators.structure import endpoints, substitute

WHOLE = "decimal(19,0)"
#: Larger multiples of the grid's step aren't told apart by doubles.
LIMIT = 2.0**53


def to_grid(vector: Column, bits: int) -> Column:
    """Each number as the nearest multiple of 2**-bits, ties up."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 2.0**bits + 0.5).cast("double") / 2.0**bits)


def grid_multiples(vector: Column, bits: int) -> Column:
    """Each number times 2**bits; a null, a number off the grid or one too large for it is an error."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * 2.0**bits
        return F.when((y == F.floor(y)) & (F.abs(y) < LIMIT), y.cast(WHOLE)).otherwise(F.raise_error(F.lit(f"a number is not on the grid of 2**-{bits}")).cast(WHOLE))

    return F.transform(vector, whole)


def exact_polynomial(found: DataFrame, stats: DataFrame, bits: int, horizon: int | None = None) -> DataFrame:
    """(key, i, j, coefficient), i <= j from 1: sums of sign * w w' in units of 4**-bits, zeros dropped, from terms and (id, w).

    Records without statistics add nothing; without records the state is empty. Each record spreads over the upper
    triangle before partial sums, so this is for few dimensions.
    """
    multiples = stats.select("id", grid_multiples(F.col("w"), bits).alias("w"))
    each = endpoints(found, horizon).join(multiples, "id")

    def row(x: Column, i: Column) -> Column:
        return F.transform(F.slice("w", i + 1, F.size("w") - i), lambda y, k: F.struct((i + 1).alias("i"), (i + k + 1).alias("j"), (x * y).cast("decimal(38,0)").alias("value")))

    cells = each.select("key", "sign", F.explode(F.flatten(F.transform("w", row))).alias("c"))
    signed = F.when(F.col("sign") > 0, F.col("c.value")).otherwise(-F.col("c.value"))
    return cells.groupBy("key", "c.i", "c.j").agg(F.sum(signed).alias("coefficient")).where("coefficient <> 0")


def substitute_exact(state: DataFrame, deleted: list, horizon: int | None = None) -> DataFrame:
    """The state after deleting units; what cancels is gone."""
    return substitute(state, deleted, horizon, ("i", "j")).select("key", "i", "j", "coefficient")


def evaluate_exact(state: DataFrame, deleted: list) -> DataFrame:
    """(i, j, coefficient) of what is selected after deleting units, zeros dropped."""
    gone = F.array(*[F.lit(x) for x in deleted]).cast(dict(state.dtypes)["key"])
    inside = state.where(F.size(F.array_except("key", gone)) == 0)
    return inside.groupBy("i", "j").agg(F.sum("coefficient").alias("coefficient")).where("coefficient <> 0")


def exact_matrix(cells: DataFrame, dims: int, bits: int) -> list[list[Fraction]]:
    """The symmetric matrix of (i, j, coefficient) on the driver: dims * dims fractions at most."""
    out = [[Fraction(0)] * dims for _ in range(dims)]
    for r in cells.collect():
        out[r["i"] - 1][r["j"] - 1] = out[r["j"] - 1][r["i"] - 1] = Fraction(int(r["coefficient"]), 4**bits)
    return out


def exact_chart(matrix: list[list[Fraction]], features: int) -> tuple[list[int], list[list[Fraction]]]:
    """Canonical chart of the joint row space of the Gram matrix and, beside it, the cross products of the first ``features`` numbers."""
    return canonical_chart([row[:features] for row in matrix[:features]] + [list(c) for c in zip(*[row[features:] for row in matrix[:features]], strict=True)])
