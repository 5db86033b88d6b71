"""Earlier-neighbor suppression and its exact repair under deletion, as anti joins over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import durable


def initial_selection(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows without a blocker."""
    return rows.join(edges.select(F.col("rid").alias("id")), "id", "left_anti")


def selection_after(rows: DataFrame, edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of units that stay, all of whose blockers' units are deleted. deleted: (unit)."""
    live = edges.join(deleted.select(F.col("unit").alias("bown")), "bown", "left_anti")
    return rows.join(deleted, "unit", "left_anti").join(live.select(F.col("rid").alias("id")), "id", "left_anti")


def rebuilt_selection(rows: DataFrame, deleted: DataFrame, tau: float) -> DataFrame:
    """The same from the rows that stay alone: their graph is made anew. The oracle of every repair."""
    from gleanery.operators.graph import blocker_edges

    left = rows.join(deleted, "unit", "left_anti")
    return initial_selection(left, blocker_edges(left, tau))


def admissions_after(rows: DataFrame, edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows selected after the deletion that weren't before. Only rows with a blocker in a deleted unit are looked at."""
    touched = edges.join(deleted.select(F.col("unit").alias("bown")), "bown", "left_semi").select(F.col("rid").alias("id")).distinct()
    return selection_after(rows.join(touched, "id", "left_semi"), edges, deleted)


def frozen_selection(rows: DataFrame, edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """The initial selection without deleted units and without admissions."""
    return initial_selection(rows, edges).join(deleted, "unit", "left_anti")


def owned_records(rows: DataFrame, units: DataFrame) -> DataFrame:
    return rows.join(units, "unit", "left_semi")


def eligible(rows: DataFrame, edges: DataFrame, horizon: int) -> DataFrame:
    """Rows that some request of ``horizon`` units can select: blocked by at most so many units, none their own."""
    blocked = edges.groupBy("rid").agg(F.countDistinct("bown").alias("n"), F.max((F.col("bown") == F.col("rown")).cast("int")).alias("own"))
    return rows.join(blocked.where((F.col("n") > horizon) | (F.col("own") == 1)).select(F.col("rid").alias("id")), "id", "left_anti")


def greedy_selection(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows blocked by no selected earlier row. Each round settles every row whose earlier neighbours are settled."""
    state = durable(rows.select("id", F.lit(None).cast("boolean").alias("chosen")))
    links = durable(edges.select("rid", "bid"))
    while True:
        seen = links.join(state.select(F.col("id").alias("bid"), "chosen"), "bid")
        told = seen.groupBy("rid").agg(F.max(F.coalesce("chosen", F.lit(False)).cast("int")).alias("any"), F.max(F.col("chosen").isNull().cast("int")).alias("open"))
        found = state.join(told.withColumnRenamed("rid", "id"), "id", "left")
        verdict = F.when(F.coalesce("any", F.lit(0)) == 1, F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = durable(found.select("id", F.coalesce("chosen", verdict).alias("chosen")))
        if state.where("chosen is null").limit(1).count() == 0:
            return rows.join(state.where("chosen").select("id"), "id", "left_semi")


def first_of_class(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each class, the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def validate_request(universe: DataFrame, request: DataFrame, horizon: int, already: DataFrame | None = None, mode: str = "strict") -> DataFrame:
    """(unit) to delete, or ValueError for the whole batch.

    strict: a repeated, unknown or already deleted unit, or more units than the horizon left, rejects it. idempotent:
    repeated and already deleted units do nothing and consume nothing; unknown units and too many still reject.
    """
    gone = already if already is not None else request.limit(0)
    wanted = request.groupBy("unit").agg(F.count("*").alias("n"))
    told = wanted.join(universe.select("unit", F.lit(True).alias("known")).distinct(), "unit", "left").join(gone.select("unit", F.lit(True).alias("gone")).distinct(), "unit", "left")
    tally = told.agg(
        F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("unknown"), F.sum(F.when((F.col("n") > 1) | F.col("gone").isNotNull(), 1).otherwise(0)).alias("repeated"), F.sum(F.when(F.col("gone").isNull(), 1).otherwise(0)).alias("fresh")
    ).first()
    left = horizon - gone.select("unit").distinct().count()
    if tally["unknown"]:
        raise ValueError(f"{tally['unknown']} unknown units")
    if mode == "strict" and tally["repeated"]:
        raise ValueError(f"{tally['repeated']} repeated units")
    if (tally["fresh"] or 0) > left:
        raise ValueError(f"{tally['fresh']} units exceed the {left} left of the horizon")
    return told.where("gone is null").select("unit")
