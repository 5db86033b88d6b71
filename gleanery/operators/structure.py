"""Counts, incidence and expected repair of a blocker graph, and its membership polynomial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.graph import components
from gleanery.session import durable


def blocker_histogram(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(n_blockers, n_records), records without a blocker included."""
    counts = edges.groupBy("rid").agg(F.count("*").alias("n"))
    return rows.join(counts.withColumnRenamed("rid", "id"), "id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_blockers")).agg(F.count("*").alias("n_records"))


def terms(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, own, tail): each record with the sorted units of its blockers."""
    found = edges.groupBy("rid").agg(F.array_sort(F.collect_set("bown")).alias("tail"))
    empty = F.array().cast(f"array<{dict(rows.dtypes)['unit']}>")
    return rows.join(found.withColumnRenamed("rid", "id"), "id", "left").select("id", F.col("unit").alias("own"), F.coalesce("tail", empty).alias("tail"))


def endpoints(found: DataFrame, horizon: int | None = None) -> DataFrame:
    """(id, key, sign): +1 at a record's blocker units, -1 at these and its own; keys over the horizon drop, own-blocked records have none."""
    found = found.where(~F.array_contains("tail", F.col("own")))
    if horizon is not None:
        found = found.where(F.size("tail") <= horizon)
    head = F.array_sort(F.array_append("tail", F.col("own")))
    ends = F.array(F.struct(F.col("tail").alias("key"), F.lit(1).alias("sign")), F.struct(head.alias("key"), F.lit(-1).alias("sign")))
    out = found.select("id", F.explode(ends).alias("e")).select("id", "e.key", "e.sign")
    return out if horizon is None else out.where(F.size("key") <= horizon)


def count_polynomial(found: DataFrame, horizon: int | None = None) -> DataFrame:
    """(key, coefficient), zeros dropped: the number selected after deleting D is the sum over keys within D."""
    return endpoints(found, horizon).groupBy("key").agg(F.sum("sign").alias("coefficient")).where("coefficient <> 0")


def membership_polynomial(found: DataFrame, horizon: int | None = None) -> DataFrame:
    """(key, id, coefficient): the same for each record alone."""
    return endpoints(found, horizon).groupBy("key", "id").agg(F.sum("sign").alias("coefficient")).where("coefficient <> 0")


def substitute(polynomial: DataFrame, deleted: list, horizon: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The polynomial after deleting units: they leave every key, merged coefficients add up, zeros and keys over the rest of the horizon drop."""
    gone = F.array(*[F.lit(x) for x in deleted])
    moved = polynomial.withColumn("key", F.array_sort(F.array_except("key", gone)))
    if horizon is not None:
        moved = moved.where(F.size("key") <= horizon - len(deleted))
    return moved.groupBy("key", *extra).agg(F.sum("coefficient").alias("coefficient")).where("coefficient <> 0")


def evaluate(polynomial: DataFrame, deleted: list) -> DataFrame:
    gone = F.array(*[F.lit(x) for x in deleted])
    return polynomial.where(F.size(F.array_except("key", gone)) == 0).agg(F.coalesce(F.sum("coefficient"), F.lit(0)).alias("n_selected"))


def key_text(key: Column) -> Column:
    return F.array_join(F.transform(key, lambda x: x.cast("string")), ",")


def component_labels(found: DataFrame, horizons: list[int]) -> DataFrame:
    """(horizon, node, label) from one run of components: keys as "k:" and their text, and "ground", with the smallest node of their component at each horizon; a component with ground has the label "ground".

    A record within the horizon links its blocker key to the key with its own unit, or to ground where that is over the
    horizon.
    """
    usable = found.where(~F.array_contains("tail", F.col("own"))).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).where(F.size("tail") <= F.col("horizon"))
    named = lambda x: F.concat(F.format_string("%09d", F.col("horizon")), F.lit("|"), x)
    head = F.when(F.size("tail") < F.col("horizon"), F.concat(F.lit("k:"), key_text(F.array_sort(F.array_append("tail", F.col("own")))))).otherwise("ground")
    labels = components(usable.select(named(F.concat(F.lit("k:"), key_text(F.col("tail")))).alias("a"), named(head).alias("b")))
    return labels.select(F.substring("node", 1, 9).cast("int").alias("horizon"), *[F.substring(c, 11, 1 << 30).alias(c) for c in ("node", "label")])


def incidence_profile(found: DataFrame, horizons: list[int]) -> DataFrame:
    """A row for each horizon: eligible, interior, boundary and own-blocked records, keys, ungrounded components, and the rank: keys less those components."""
    found = durable(found)
    labels = component_labels(found, horizons)
    grounded = labels.where("node = 'ground'").select("horizon", "label")
    loose = labels.join(grounded, ["horizon", "label"], "left_anti").groupBy("horizon").agg(F.countDistinct("label").alias("loose"))
    keys = labels.where("node <> 'ground'").groupBy("horizon").agg(F.count("*").alias("keys"))
    every = found.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    own, count = F.array_contains("tail", F.col("own")), lambda x: F.sum(x.cast("long"))
    counts = every.groupBy("horizon").agg(
        count(own).alias("own_blocked"), count(~own & (F.size("tail") <= F.col("horizon"))).alias("eligible"), count(~own & (F.size("tail") < F.col("horizon"))).alias("interior"), count(~own & (F.size("tail") == F.col("horizon"))).alias("boundary"),
    )
    out = counts.join(keys, "horizon", "left").join(loose, "horizon", "left")
    out = out.withColumn("n_keys", F.coalesce("keys", F.lit(0))).withColumn("ungrounded_components", F.coalesce("loose", F.lit(0))).drop("keys", "loose")
    return out.withColumn("query_rank", F.col("n_keys") - F.col("ungrounded_components"))


def incidence_census(found: DataFrame, horizon: int) -> DataFrame:
    """The profile's row of one horizon."""
    return incidence_profile(found, [horizon]).drop("horizon")


def rank_profile(found: DataFrame, horizons: list[int]) -> DataFrame:
    """(horizon, query_rank) for each horizon, in one pass."""
    return incidence_profile(found, horizons).select("horizon", "query_rank")


def expected_admissions(found: DataFrame, frame: int, k: int) -> DataFrame:
    """Mean admissions of a uniform request of k of ``frame`` units, all units in the frame: (n_blockers, n_records, probability) for each size.

    The chance that all b blockers are among the k and the owner isn't: falling products, no factorials; none for more blockers than k.
    """
    usable = found.where((F.size("tail") > 0) & ~F.array_contains("tail", F.col("own")))
    sizes = usable.groupBy(F.size("tail").alias("n_blockers")).agg(F.count("*").alias("n_records"))
    within = F.aggregate(F.sequence(F.lit(0), F.col("n_blockers") - 1), F.lit(1.0), lambda p, i: p * F.greatest(F.lit(0.0), (F.lit(float(k)) - i) / (F.lit(float(frame)) - i)))
    outside = F.lit(float(frame - k)) / (F.lit(float(frame)) - F.col("n_blockers"))
    return sizes.withColumn("probability", F.when(F.col("n_blockers") > k, 0.0).otherwise(within * outside))


def source_singletons(found: DataFrame) -> DataFrame:
    """(unit, n_admitted): records that deleting one unit alone admits."""
    only = found.where((F.size("tail") == 1) & ~F.array_contains("tail", F.col("own")))
    return only.groupBy(F.get("tail", F.lit(0)).alias("unit")).agg(F.count("*").alias("n_admitted"))


def distinct_owners(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rid").agg(F.countDistinct("bown").alias("n_owners"), F.count("*").alias("n_blockers"))
