"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source, documents are ordered by that key; prefix sums of word
counts come in two levels (slices of the key, then rows of a slice), so a source with very many rows is dealt over as many
tasks as it needs, and an id that very many rows share is sliced further by size and text. The mix is cut at each source's exact budget; a budget over the source's own size repeats whole epochs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import WORD

#: Rows in a slice of a source, about; slices are at most 1 << MOST_BITS a source.
SLICE_ROWS, MOST_BITS = 1 << 16, 16
#: A slice with so many times its rows is cut by size, up to SIZES words, and each size into TEXTS parts.
HOT, SIZES, TEXTS = 8, 1024, 16


def word_count(text: Column) -> Column:
    """Words of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_: Column, seed: str) -> Column:
    """A 60-bit hash-random key of an id, the same in every run and on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], most: int = 3) -> DataFrame:
    """(source, source_size, target): shares of the whole by weight, none above ``most`` times its source.

    ``sizes`` has one row per source. Sources go by code point, null last, and take the weights in turn. The excess
    over a ceiling is dealt again by weight until none is above: with ceilings ordered by ceiling/weight, all before
    the first that its share doesn't reach are at their ceiling. One row per source passes through one window.
    """
    turn = F.when(F.lit(False), 0)
    for i, w in enumerate(weights):
        turn = turn.when(F.pmod(F.col("at"), F.lit(len(weights))) == i, F.lit(w).cast("long"))
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", turn)
    ranked = ranked.withColumn("top", F.col("source_size") * most)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("top") / F.col("w")).asc(), F.col("at").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0)))
    level = level.withColumn("heft", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    level = level.withColumn("free", F.col("left") * F.col("w") <= F.col("top") * F.col("heft"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("top") / F.col("w"), F.col("at"), F.col("left"), F.col("heft")).cast("struct<r:double,at:long,left:long,heft:long>"))).over(every)
    level = level.withColumn("first", first)
    share = (F.col("first.left") * F.col("w")).cast("double") / F.col("first.heft").cast("double")
    capped = F.struct((F.col("top") / F.col("w")).alias("r"), F.col("at").cast("long").alias("at")) < F.struct(F.col("first.r").alias("r"), F.col("first.at").alias("at"))
    return level.select("source", "source_size", F.when(F.col("first").isNull() | capped, F.col("top").cast("double")).otherwise(share).alias("target"))


def _sliced(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with ``slice``, from the top of their key in ``at``: in order of key, id and size, and of no more than ``limit`` rows where some of these differ."""
    hot = rows.groupBy("source", "at").count().where(F.col("count") > limit).select(F.col("source").alias("of_source"), F.col("at").alias("of_at"))
    if hot.isEmpty():
        return rows.withColumn("slice", F.struct("at", F.lit(0).alias("cut")))
    # The fullest key of a slice is cut by size, sizes up to a bound also by text, since rows of one id and size are alike.
    within = rows.join(F.broadcast(hot), F.col("source").eqNullSafe(F.col("of_source")) & (F.col("at") == F.col("of_at"))).groupBy("of_source", "of_at", "key").count()
    f = within.groupBy("of_source", "of_at").agg(F.max_by("key", "count").alias("full_key"))
    rows = rows.join(F.broadcast(f), F.col("source").eqNullSafe(F.col("of_source")) & (F.col("at") == F.col("of_at")), "left")  # fewer than rows / limit
    cut = F.least("size", F.lit(SIZES)) * TEXTS + F.when(F.col("size") < SIZES, F.pmod("of_text", F.lit(TEXTS))).otherwise(0)
    cut = F.when(F.col("full_key").isNull(), 0).when(F.col("key") < F.col("full_key"), -1).when(F.col("key") > F.col("full_key"), (SIZES + 1) * TEXTS).otherwise(cut)
    return rows.withColumn("slice", F.struct("at", cut.cast("int").alias("cut"))).drop("of_source", "of_at", "full_key")


def mix_sources(docs: DataFrame, weights: list[int], most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the columns in ``keep``, prefixed ``kept_``: words taken of each row, repeats counted.

    A null or blank text has size 0 and gives 0 words; texts of any length are counted whole. A null source is a source of its own,
    after the others. Rows with one id (or without) and one size are alike, so their order can't show; an empty table gives no rows. The
    document at the cut gives just the words that are left, so each source's sum is its target, rounded. Other columns, whatever their
    names, stay only with ``keep``. Rows of sources, and of slices that are too full, are counted when this is called.
    """
    kept = [F.col(f"`{c}`").alias(f"kept_{c}") for c in keep or []]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), random_key(F.col(f"`{id_col}`"), seed).alias("key"), F.xxhash64(F.col(f"`{text_col}`")).alias("of_text"), *kept
    )
    fullest = rows.groupBy("source").count().agg(F.max("count").alias("n")).first()["n"] or 0
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(1, fullest / SLICE_ROWS)))))
    rows = _sliced(rows.withColumn("at", F.shiftright("key", 60 - bits)), HOT * max(SLICE_ROWS, fullest >> bits))
    sums = rows.select("source", "slice", "size").groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    within = Window.partitionBy("source").orderBy("slice")
    sums = sums.withColumn("slice_before", F.coalesce(F.sum("slice_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, most)
    sums = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.slice", "s.slice_before", "t.source_size", "t.target")
    order = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "of_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("row_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = rows.alias("r").join(sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice")))
    budget, whole = F.round("target").cast("long"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(F.lit(0)).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0), budget - epochs * whole - F.col("slice_before") - F.col("row_before")))
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *[f"kept_{c}" for c in keep or []])
