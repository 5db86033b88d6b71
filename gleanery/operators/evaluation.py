"""Ratings, weighted estimates, ranking and effect metrics, registries. Undefined ratios are null, never imputed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority_labels(ratings: DataFrame, unit: str, label: str, least: int = 2) -> DataFrame:
    """(unit, label): the label that at least ``least`` ratings share, or no_majority."""
    counts = ratings.groupBy(unit, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(unit).agg(F.max(F.struct("n", label)).alias("m"))
    return best.select(unit, F.when(F.col("m.n") >= least, F.col(f"m.{label}")).otherwise("no_majority").alias(label))


def conservative_labels(ratings: DataFrame, unit: str, label: str, raters: int = 2) -> DataFrame:
    """(unit, lower, upper): positive only where every rating is present and yes; upper counts what isn't a clear no."""
    yes, no = F.sum((F.col(label) == "yes").cast("int")), F.sum((F.col(label) == "no").cast("int"))
    return ratings.groupBy(unit).agg((yes == raters).cast("int").alias("lower"), (no == 0).cast("int").alias("upper"))


def precision_by_cut(rated: DataFrame, cuts: list[float]) -> DataFrame:
    """(cut, precision, effective_n): weighted share of label 1 over each cut, and the squared sum over the sum of squares of weights."""
    over = lambda c: F.col("score") > c
    aggs = []
    for i, c in enumerate(cuts):
        aggs += [F.sum(F.when(over(c), F.col("weight") * F.col("label"))).alias(f"y{i}"), F.sum(F.when(over(c), F.col("weight"))).alias(f"w{i}"), F.sum(F.when(over(c), F.col("weight") * F.col("weight"))).alias(f"q{i}")]
    sums = rated.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("cut"), (F.col(f"y{i}") / F.col(f"w{i}")).alias("precision"), (F.col(f"w{i}") * F.col(f"w{i}") / F.col(f"q{i}")).alias("effective_n")) for i, c in enumerate(cuts)]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def select_threshold(grid: DataFrame, share: float = 0.95) -> DataFrame:
    """The least strict cut whose precision reaches ``share``; null where none does."""
    return grid.agg(F.min(F.when(F.col("precision") >= share, F.col("cut"))).alias("threshold"))


def weighted_prevalence(units: DataFrame, frame_units: int) -> DataFrame:
    """One row of inverse-probability estimates of (probability, outcome), outcome null where it is missing, with the extremes that missing outcomes allow."""
    w, y = 1 / F.col("probability"), F.col("outcome")
    s = units.agg(F.count("*").alias("sampled"), F.count("outcome").alias("observed"), F.sum(w).alias("w"), F.sum(F.when(y.isNotNull(), w)).alias("kw"), F.sum(w * y).alias("yes"))
    whole = (F.col("sampled") == F.col("observed")) & (F.col("sampled") > 0)
    n, yes, missing = F.lit(float(frame_units)), F.coalesce("yes", F.lit(0.0)), F.col("w") - F.coalesce("kw", F.lit(0.0))
    some = F.lit(frame_units > 0)
    return s.select(
        "sampled", "observed", F.when(whole & some, yes / n).alias("ht"), F.when(whole, yes / F.col("w")).alias("hajek"), (F.col("yes") / F.col("kw")).alias("observed_only"),
        F.when(some, yes / n).alias("ht_low"), F.when(some, (yes + missing) / n).alias("ht_high"), (yes / F.col("w")).alias("hajek_low"), ((yes + missing) / F.col("w")).alias("hajek_high"),
    )


def weighted_agreement(ratings: DataFrame, unit: str, label: str, raters: int = 3) -> DataFrame:
    """(units, agreement, kappa) over units with all ratings; kappa is null where chance agreement is 1. weight comes with the ratings."""
    counts = ratings.where(F.col(label).isNotNull()).groupBy(unit, label).agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    whole = counts.groupBy(unit).agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"), F.first("weight").alias("w")).where(F.col("all") == raters)
    total = whole.agg(F.count("*").alias("units"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("agree")) / (raters * (raters - 1)) / F.sum("w")).alias("agreement"))
    margins = counts.join(whole.select(unit, "w"), unit).groupBy(label).agg(F.sum(F.col("w") * F.col("n") / raters).alias("m"))
    chance = margins.agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    out = total.join(chance).withColumn("chance", F.col("mm") / (F.col("sw") * F.col("sw")))
    return out.select("units", "agreement", F.when(F.col("chance") < 1 - 1e-12, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def tie_curve(scored: DataFrame, group: list[str] | None = None, slices: int = 64) -> DataFrame:
    """(score, tp, fp, positives, negatives) cumulated over distinct scores from the top.

    Scores are cut at approximate quantiles into ``slices`` ranges; sums run inside a range, and the sums of the ranges
    above, one row for each, are added. So no task orders all scores. Null scores come last and NaN first.
    """
    group = group or []
    ties = scored.groupBy(*group, "score").agg(F.sum("target").alias("p"), F.sum(1 - F.col("target")).alias("n"))
    cuts = sorted(set(ties.select(F.col("score").cast("double").alias("score")).approxQuantile("score", [i / slices for i in range(1, slices)], 0.002))) if slices > 1 else []
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    ties = ties.withColumn("slice", F.when(F.col("score").isNull(), len(cuts) + 1).otherwise(above))
    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    totals = ties.groupBy(*group, "slice").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    totals = totals.select(*group, "slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("sp", "sn")], F.sum("sp").over(every).alias("positives"), F.sum("sn").over(every).alias("negatives"))
    down = Window.partitionBy(*group, "slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ties.select(*group, "slice", "score", "p", "n", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp")).alias("i")
    met = inner.join(totals.alias("t"), reduce(lambda a, b: a & b, [F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*group, "slice"]]))
    return met.select(*[F.col(f"i.{c}") for c in [*group, "score", "p", "n"]], (F.col("tp") + F.col("sp_before")).alias("tp"), (F.col("fp") + F.col("sn_before")).alias("fp"), "positives", "negatives")


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """(average_precision, auroc), null where a class is missing; ties are one step."""
    curve = tie_curve(scored)
    return curve.agg(
        (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("positives"), F.lit(0))).alias("average_precision"),
        (F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.max("positives") * F.max("negatives"), F.lit(0))).alias("auroc"),
    )


def best_f1_threshold(scored: DataFrame) -> DataFrame:
    """(threshold, true_positives, predicted, positives) with the best F1; of equal ones the strictest. Compared as a ratio of integers by cross products within double range."""
    curve = tie_curve(scored).where("positives > 0")
    f1 = 2 * F.col("tp") / (F.col("positives") + F.col("tp") + F.col("fp"))
    best = curve.agg(F.max(F.struct(f1.alias("f1"), "score", "tp", "fp", "positives")).alias("m"))
    return best.select(F.col("m.score").alias("threshold"), F.col("m.tp").alias("true_positives"), (F.col("m.tp") + F.col("m.fp")).alias("predicted"), F.col("m.positives").alias("positives"))


def f1_scores(rows: DataFrame) -> DataFrame:
    """(micro_f1, macro_f1) of (output, predicted, target) with values 0 and 1; no predictions and no targets give 0."""
    each = rows.groupBy("output").agg(F.sum(F.col("predicted") * F.col("target")).alias("tp"), F.sum(F.col("predicted") + F.col("target")).alias("d"))
    return each.agg(F.coalesce(2 * F.sum("tp") / F.nullif(F.sum("d"), F.lit(0)), F.lit(0.0)).alias("micro_f1"), F.avg(F.coalesce(2 * F.col("tp") / F.nullif(F.col("d"), F.lit(0)), F.lit(0.0))).alias("macro_f1"))


def weighted_errors(rows: DataFrame) -> DataFrame:
    """(mse, mae) of (weight, score, target), weights over 0 only; scores stay as they are."""
    w, e = F.col("weight"), F.col("score") - F.col("target")
    return rows.where("weight > 0").agg((F.sum(w * e * e) / F.sum(w)).alias("mse"), (F.sum(w * F.abs(e)) / F.sum(w)).alias("mae"))


def effect_metrics(rows: DataFrame) -> DataFrame:
    """One row of effects of (y, before, frozen, oracle): losses, their difference raw and over the loss before, distance of predictions raw and over their spread before."""
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    s = rows.agg(F.avg(square("before", "y")).alias("base"), F.stddev_pop("before").alias("spread"), F.avg(square("frozen", "y")).alias("fm"), F.avg(square("oracle", "y")).alias("om"), F.sqrt(F.avg(square("frozen", "oracle"))).alias("rms"))
    return s.select(F.col("base").alias("predelete_mse"), F.col("spread").alias("predelete_score_sd"), F.col("fm").alias("frozen_mse"), F.col("om").alias("oracle_mse"), (F.col("fm") - F.col("om")).alias("signed_raw_loss"), ((F.col("fm") - F.col("om")) / F.nullif("base", F.lit(0.0))).alias("signed_normalized_loss"), F.col("rms").alias("prediction_rms"), (F.col("rms") / F.nullif("spread", F.lit(0.0))).alias("normalized_prediction_rms"))


def trajectory_summary(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """mean, sd, min, median and max of the defined values of each group, with how many are defined and not."""
    v = F.col(value)
    return rows.groupBy(*group).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.median(v).alias("median"), F.max(v).alias("max"), F.count(v).alias("defined"), F.sum(v.isNull().cast("long")).alias("undefined"))


def planned_vs_observed(planned: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Every planned cell with its status, ``missing`` where nothing was observed. Extra or repeated observations are a ValueError."""
    extra = observed.join(planned, keys, "left_anti").limit(1).count()
    twice = observed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if extra or twice:
        raise ValueError("observations outside the plan" if extra else "repeated observations")
    return planned.join(observed, keys, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def status_table(cells: DataFrame, group: list[str], statuses: list[str]) -> DataFrame:
    """Counts of each status by group."""
    return cells.groupBy(*group).agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in statuses])


def arm_summary(paths: DataFrame, results: DataFrame) -> DataFrame:
    """(arm, n_orders, n_sets, n_zero): distinct deletion orders and request sets, and paths that never admit."""
    each = paths.groupBy("arm", "trajectory_id").agg(F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("o"), F.array_sort(F.collect_set("unit")).alias("s"))
    ever = results.groupBy("trajectory_id").agg(F.max("admitted").alias("a"))
    digest = lambda c: F.sha2(F.to_json(c), 256)
    return each.join(ever, "trajectory_id", "left").groupBy("arm").agg(F.countDistinct(digest(F.col("o"))).alias("n_orders"), F.countDistinct(digest(F.col("s"))).alias("n_sets"), F.sum((F.coalesce("a", F.lit(0)) == 0).cast("long")).alias("n_zero"))


def panel_grid(pairs: DataFrame, raters: list[str], seen: DataFrame) -> DataFrame:
    """Every pair with every rater; what wasn't observed is there with status missing."""
    grid = pairs.withColumn("rater", F.explode(F.array(*[F.lit(r) for r in raters])))
    return grid.join(seen, ["pair_id", "rater"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def changed_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pair_id, label, again): pairs of both samples whose label changed."""
    return first.join(second.withColumnRenamed("label", "again"), "pair_id").where("label <> again").select("pair_id", "label", "again")


def paired_effects(results: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """(keys, method, difference) of each method from the baseline at the same trajectory and checkpoint."""
    base = results.where(F.col("method") == baseline).select(*keys, F.col("value").alias("base"))
    return results.where(F.col("method") != baseline).join(base, keys).select(*keys, "method", (F.col("value") - F.col("base")).alias("difference"))


def holm(tests: DataFrame) -> DataFrame:
    """(name, p, adjusted): step-down adjusted p values, never over 1 and never falling."""
    order = Window.orderBy("p", "name")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = tests.withColumn("k", F.row_number().over(order)).withColumn("m", F.count("*").over(every))
    raised = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("k") + 1) * F.col("p"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return step.select("name", "p", raised.alias("adjusted"))


def best_by_loss(grid: DataFrame) -> DataFrame:
    """The parameter with the least loss, the larger one on ties."""
    return grid.agg(F.min(F.struct("loss", (-F.col("parameter")).alias("p"))).alias("m")).select((-F.col("m.p")).alias("parameter"), F.col("m.loss").alias("loss"))


def top_vocabulary(tagged: DataFrame, id_col: str, tags: str, n: int) -> DataFrame:
    """(tag, n) of the most frequent tags by distinct rows, then by name."""
    return tagged.select(id_col, F.explode(tags).alias("tag")).groupBy("tag").agg(F.countDistinct(id_col).alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def selection_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b, common, total_variation) of two selections of ids."""
    both = a.select("id", F.lit(1).alias("a")).join(b.select("id", F.lit(1).alias("b")), "id", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = both.agg(n(F.col("b").isNull()).alias("only_a"), n(F.col("a").isNull()).alias("only_b"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    return s.withColumn("total_variation", F.when(F.greatest("only_a", "only_b") + F.col("common") > 0, 1 - F.col("common") / (F.col("common") + F.greatest("only_a", "only_b"))).otherwise(0.0))
