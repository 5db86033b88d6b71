"""Seeded workloads in hash order: trajectories, request arms, stratified and successive sampling, bootstraps.

A generator's draws are replaced by the order of salted hashes, which has the same law, needs no driver and repeats on
any engine. Rankings within a stratum keep ``n`` rows of each, so Spark cuts them down before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.hashing import hash_number, resample_weight, salted_hash


def stratified_sample(frame: DataFrame, strata: list[str], key: Column, n: int, salt: str) -> DataFrame:
    """At most ``n`` rows of each stratum by hash order, with ``stratum_rows`` and the inclusion probability as num / den."""
    hashed = frame.withColumn("h", salted_hash(salt, key))
    chosen = hashed.withColumn("draw", F.row_number().over(Window.partitionBy(*strata).orderBy("h"))).where(F.col("draw") <= n)
    sizes = frame.groupBy(*strata).agg(F.count("*").alias("stratum_rows"))
    return chosen.join(sizes, strata).withColumn("num", F.least(F.lit(n).cast("long"), F.col("stratum_rows"))).withColumn("den", F.col("stratum_rows")).drop("h")


def simple_sample(frame: DataFrame, key: Column, n: int, salt: str) -> DataFrame:
    """The first ``n`` rows in hash order; all of a smaller frame."""
    return frame.withColumn("h", salted_hash(salt, key)).orderBy("h").limit(n).drop("h")


def missed_pairs(pairs: DataFrame, n: int, salt: str) -> DataFrame:
    """(a, b) of a sample of the pairs (a, b, hit) that weren't retrieved."""
    return simple_sample(pairs.where(~F.col("hit")).select("a", "b"), F.concat_ws("|", "a", "b"), n, salt)


def trajectories(units: DataFrame, arm: str, count: int, horizon: int, salt: str) -> DataFrame:
    """(trajectory_id, arm, pos, unit): the first ``horizon`` units in each trajectory's own hash order."""
    grid = units.select("unit", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("trajectory_id"))
    name = F.concat_ws("|", F.lit(arm), F.col("trajectory_id").cast("string"), F.col("unit").cast("string"))
    ranked = grid.withColumn("pos", F.row_number().over(Window.partitionBy("trajectory_id").orderBy(salted_hash(salt, name), "unit")))
    return ranked.where(F.col("pos") <= horizon).select("trajectory_id", F.lit(arm).alias("arm"), "pos", "unit")


def mass_trajectories(masses: DataFrame, count: int, horizon: int, salt: str) -> DataFrame:
    """(trajectory_id, arm, pos, unit) from (unit, mass): each trajectory takes units one by one with probability by mass, the order of -ln(u) / mass for u of its own hash."""
    grid = masses.withColumn("trajectory_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    u = (hash_number(salt, F.concat_ws("|", F.lit("S-mass"), F.col("trajectory_id").cast("string"), F.col("unit").cast("string")), 12) + F.lit(0.5)) / F.lit(float(2**48))
    ranked = grid.withColumn("pos", F.row_number().over(Window.partitionBy("trajectory_id").orderBy(-F.log(u) / F.col("mass"), "unit")))
    return ranked.where(F.col("pos") <= horizon).select("trajectory_id", F.lit("S-mass").alias("arm"), "pos", "unit")


def one_percent_horizon(population: int, feasible: int | None = None, levels: tuple[int, ...] = (1, 8, 32, 128)) -> tuple[int, list[int]]:
    """A hundredth of the units, rounded up, as far as feasible, and the checkpoints: the levels and the horizon itself, clipped to it."""
    whole = -(-population // 100)
    horizon = whole if feasible is None else min(whole, feasible)
    return horizon, [k for k in clipped_checkpoints([*levels, whole], horizon) if k]


def stress_paths(rows: DataFrame, edges: DataFrame, horizon: int, count: int, cap: int, salt: str) -> DataFrame:
    """(trajectory_id, arm, pos, unit, candidate) over records: a path deletes the blockers of one excluded record first, in their order, then others in hash order, up to ``horizon``.

    Each trajectory scores up to ``cap`` excluded records of at most ``horizon`` blockers by what deleting their blockers admits, and takes the best,
    the smallest id on ties; without any, it deletes in hash order alone.
    """
    sizes = edges.groupBy("rid").agg(F.countDistinct("bid").alias("n"))
    mine = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("trajectory_id")
    hashed = lambda kind, c: salted_hash(salt, F.concat_ws("|", F.lit(kind), F.col("trajectory_id").cast("string"), F.col(c).cast("string")))
    drawn = sizes.where(F.col("n") <= horizon).select("rid", mine).withColumn("k", F.row_number().over(Window.partitionBy("trajectory_id").orderBy(hashed("candidate", "rid")))).where(F.col("k") <= cap)
    scores = admissions_of_sets(edges, drawn.select(F.col("rid").alias("candidate")).distinct())
    best = drawn.select("trajectory_id", F.col("rid").alias("candidate")).join(scores, "candidate").groupBy("trajectory_id").agg(F.min(F.struct((-F.col("n_admitted")).alias("s"), "candidate")).alias("m")).select("trajectory_id", "m.candidate")
    prefix = best.join(edges.select(F.col("rid").alias("candidate"), F.col("bid").alias("id")).distinct(), "candidate").select("trajectory_id", "id", F.lit(0).alias("late"), F.lit("").alias("h"))
    padding = rows.select("id", mine).join(prefix.select("trajectory_id", "id"), ["trajectory_id", "id"], "left_anti").select("trajectory_id", "id", F.lit(1).alias("late"), hashed("padding", "id").alias("h"))
    ranked = prefix.union(padding).withColumn("pos", F.row_number().over(Window.partitionBy("trajectory_id").orderBy("late", "h", "id"))).where(F.col("pos") <= horizon)
    return ranked.join(best, "trajectory_id", "left").select("trajectory_id", F.lit("A").alias("arm"), "pos", F.col("id").alias("unit"), "candidate")


def clipped_checkpoints(levels: list[int], horizon: int) -> list[int]:
    return sorted({min(k, horizon) for k in levels})


def observations(paths: DataFrame, rows: DataFrame, edges: DataFrame, checkpoints: list[int]) -> DataFrame:
    """(trajectory_id, k, deleted_records, lost, admitted, new_deletions): all paths and checkpoints in one plan.

    A record is admitted once every unit of its blockers is deleted and its own isn't: the distinct blocker units
    deleted so far are counted for each (trajectory, checkpoint, record) and compared with all of them.
    """
    ks = F.explode(F.array(*[F.lit(k) for k in checkpoints])).alias("k")
    grid = paths.select("trajectory_id").distinct().select("trajectory_id", ks)
    at = paths.select("trajectory_id", "pos", "unit", ks).where("pos <= k").drop("pos")
    owned = rows.groupBy("unit").agg(F.count("*").alias("n"))
    free = rows.join(edges.select(F.col("rid").alias("id")), "id", "left_anti").groupBy("unit").agg(F.count("*").alias("free"))
    gone = at.join(owned, "unit", "left").join(free, "unit", "left").groupBy("trajectory_id", "k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deleted_records"), F.coalesce(F.sum("free"), F.lit(0)).alias("lost"))
    blocked = edges.select("rid", "rown", "bown").distinct()
    needed = blocked.groupBy("rid", "rown").agg(F.count("*").alias("needed"))
    freed = at.join(blocked.withColumnRenamed("bown", "unit"), "unit").groupBy("trajectory_id", "k", "rid", "rown").agg(F.count("*").alias("have"))
    opened = freed.join(needed, ["rid", "rown"]).where("have = needed")
    admitted = opened.join(at.withColumnRenamed("unit", "rown"), ["trajectory_id", "k", "rown"], "left_anti").groupBy("trajectory_id", "k").agg(F.count("*").alias("admitted"))
    out = grid.join(gone, ["trajectory_id", "k"], "left").join(admitted, ["trajectory_id", "k"], "left")
    out = out.select("trajectory_id", "k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("deleted_records", "lost", "admitted")])
    before = F.lag("deleted_records", 1, 0).over(Window.partitionBy("trajectory_id").orderBy("k"))
    return out.withColumn("new_deletions", F.col("deleted_records") - before)


def arm_frames(rows: DataFrame, edges: DataFrame, genuine: Column) -> DataFrame:
    """(arm, unit_or_record): R any record, S sources that are genuine, U records that are excluded at first."""
    excluded = rows.join(edges.select(F.col("rid").alias("id")), "id", "left_semi")
    return (
        rows.select(F.lit("R").alias("arm"), F.col("id").cast("string").alias("member"))
        .union(rows.where(genuine).select(F.lit("S"), F.col("unit").cast("string")).distinct())
        .union(excluded.select(F.lit("U"), F.col("id").cast("string")))
    )


def admissions_of_sets(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, n_admitted): how many records the deletion of each candidate's blockers admits. candidates: (candidate)."""
    links = edges.select("rid", "bid").distinct()
    gone = candidates.join(links.withColumnRenamed("rid", "candidate"), "candidate")
    needed = links.groupBy("rid").agg(F.count("*").alias("needed"))
    opened = gone.join(links, "bid").groupBy("candidate", "rid").agg(F.count("*").alias("have")).join(needed, "rid").where("have = needed")
    free = opened.join(gone.select("candidate", F.col("bid").alias("rid")), ["candidate", "rid"], "left_anti")
    return free.groupBy("candidate").agg(F.count("*").alias("n_admitted"))


def stress_candidates(edges: DataFrame, rows: DataFrame, limit: int, salt: str) -> DataFrame:
    """(candidate, n_admitted) for the blocker sets of up to ``limit`` excluded records: how many records each set admits."""
    return admissions_of_sets(edges, simple_sample(edges.select("rid").distinct(), F.col("rid"), limit, salt).select(F.col("rid").alias("candidate")))


def volume_matched(rows: DataFrame, volumes: DataFrame, salt: str) -> DataFrame:
    """(trajectory_id, k, id): for each (trajectory_id, k, deleted_records), so many records in the trajectory's hash order."""
    paths = volumes.agg(F.collect_set("trajectory_id")).scalar()  # trajectories are few
    named = F.concat_ws("|", F.col("trajectory_id").cast("string"), F.col("id").cast("string"))
    ranked = rows.select("id", paths.alias("all")).select("id", F.explode("all").alias("trajectory_id")).withColumn("pos", F.row_number().over(Window.partitionBy("trajectory_id").orderBy(salted_hash(salt, named))))
    return ranked.join(volumes, "trajectory_id").where(F.col("pos") <= F.col("deleted_records")).select("trajectory_id", "k", "id")


def successive_sources(masses: DataFrame, salt: str, n: int) -> DataFrame:
    """(source, mass, pos): successive sampling with probability by mass: the order of -ln(u) / mass, u from the hash."""
    u = (hash_number(salt, F.col("source"), 12) + F.lit(0.5)) / F.lit(float(2**48))
    return masses.withColumn("key", -F.log(u) / F.col("mass")).withColumn("pos", F.row_number().over(Window.orderBy("key", "source"))).where(F.col("pos") <= n).select("source", "mass", "pos")


def assignments(pairs: DataFrame, raters: int, salt: str) -> DataFrame:
    """(pair_id, rater, first, second): each pair once for each rater, sides swapped by the parity of a hash."""
    grid = pairs.withColumn("rater", F.explode(F.sequence(F.lit(0), F.lit(raters - 1))))
    odd = F.pmod(hash_number(salt, F.concat_ws("|", "pair_id", "rater")), F.lit(2)) == 1
    return grid.select("pair_id", "rater", F.when(odd, F.col("b")).otherwise(F.col("a")).alias("first"), F.when(odd, F.col("a")).otherwise(F.col("b")).alias("second"))


def swapped_share(sample: DataFrame, share: float, salt: str) -> DataFrame:
    """``share`` of the rows, rounded up, by hash order, sides swapped."""
    n = -(-sample.count() * int(share * 1000) // 1000)
    return simple_sample(sample, F.col("pair_id"), n, salt).select("pair_id", F.col("b").alias("a"), F.col("a").alias("b"))


def audit_sample(cells: DataFrame, strata: list[str], quota: int, key: str, salt: str) -> DataFrame:
    """(key, probability): rows chosen in any of their strata, with the chance of the union of independent draws."""
    drawn = stratified_sample(cells, strata, F.col(key), quota, salt).select(key).distinct()
    sizes = cells.groupBy(*strata).agg(F.count("*").alias("rows"))
    rate = cells.join(sizes, strata).withColumn("r", F.least(F.lit(1.0), F.lit(float(quota)) / F.col("rows")))
    some = rate.groupBy(key).agg(F.max((F.col("r") >= 1).cast("int")).alias("sure"), F.sum(F.log1p(-F.least(F.col("r"), F.lit(1 - 1e-12)))).alias("miss"))
    return drawn.join(some.select(key, F.when(F.col("sure") == 1, 1.0).otherwise(1 - F.exp("miss")).alias("probability")), key)


def context_budget(lines: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each group, in order, that fit the budget whole."""
    upto = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("upto", upto).where(F.col("upto") <= budget)


def bootstrap(values: DataFrame, unit: str, value: str, replicates: int, salt: str, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(mean, low, high): percentile interval of the mean over resampled units.

    Each unit's count in a replicate is Poisson with mean 1, read off a hash, so that replicates need no exchange of
    rows: one row per unit and replicate meets in partial sums.
    """
    means = values.groupBy(unit).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    grid = means.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weight = resample_weight(salt, F.col("rep"), F.col(unit))
    by = grid.withColumn("w", weight).groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    centre = values.agg(F.avg(value).alias("mean"))
    return by.agg(F.percentile("m", levels[0]).alias("low"), F.percentile("m", levels[1]).alias("high")).join(centre)
