"""Ordered prefixes, folds and calendar rules. Windows without a partition only see aggregates: one row per group or date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.hashing import salted_hash


def whole_group_prefix(sizes: DataFrame, group: str, target: int, salt: str) -> DataFrame:
    """Groups in hash order while the rows before them are under the target: the last may overshoot. sizes: (group, n)."""
    order = Window.orderBy("h", group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("h", salted_hash(salt, F.col(group))).withColumn("upto", F.sum("n").over(order))
    return ranked.where(F.col("upto") - F.col("n") < target).select(group, "n", "upto")


def chronological_batches(daily: DataFrame, horizon: int) -> DataFrame:
    """(day, n, upto, status): whole days while the total is within the horizon; the first that isn't is blocked, later ones wait."""
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = daily.withColumn("upto", F.sum("n").over(order)).withColumn("over", (F.col("upto") > horizon).cast("int"))
    count = F.sum("over").over(order)
    return total.withColumn("status", F.when(count == 0, "applied").when((count == 1) & (F.col("over") == 1), "blocked").otherwise("waiting")).drop("over")


def calendar_prefix(months: DataFrame, target: int) -> DataFrame:
    """Selected months of (month, n, complete): the first complete month with the target, or else complete months from the first on, up to a gap or the target."""
    order = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = months.withColumn("alone", F.min(F.when(F.col("complete") & (F.col("n") >= target), F.col("month"))).over(every))
    m = m.withColumn("gap", F.min(F.when(~F.col("complete"), F.col("month"))).over(every)).withColumn("upto", F.sum("n").over(order))
    chosen = F.when(F.col("alone").isNotNull(), F.col("month") == F.col("alone")).otherwise((F.col("gap").isNull() | (F.col("month") < F.col("gap"))) & (F.col("upto") - F.col("n") < target))
    rule = F.when(F.col("alone").isNotNull(), "earliest_complete_month").otherwise("complete_prefix")
    return m.where(chosen).select("month", "n", rule.alias("rule"))


def source_folds(sources: DataFrame, source: str, folds: int, salt: str) -> DataFrame:
    """(source, fold): sources in hash order, dealt round robin."""
    return sources.withColumn("h", salted_hash(salt, F.col(source))).select(source, F.pmod(F.row_number().over(Window.orderBy("h", source)) - 1, F.lit(folds)).cast("int").alias("fold"))


def month_counts(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def size_quantiles(sizes: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): inverse-distribution quantiles, never interpolated."""
    exprs = [F.expr(f"percentile_disc({q}) within group (order by {column})").cast("long").alias(f"q{i}") for i, q in enumerate(shares)]
    return sizes.agg(*exprs).select(F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"q{i}").alias("value")) for i, q in enumerate(shares)])).alias("x")).select("x.*")


def balanced_ranges(weights: DataFrame, order_by: str, weight: str, shards: int) -> DataFrame:
    """Weighted consecutive ranges: shard of each row of an ordered table of groups by its share of the running weight."""
    upto = Window.orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum(weight).over(upto) - F.col(weight)
    return weights.withColumn("shard", F.least(F.lit(shards - 1), F.floor(before * shards / F.sum(weight).over(every))).cast("int"))
