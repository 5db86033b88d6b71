"""Consistent-hash ring with virtual nodes and bounded loads, with DataFrame operations only.

Shards sit on a ring as many virtual nodes; a row belongs to the first virtual node clockwise of its hash. A shard takes what
hashes to it, in ring order, up to its bound; rows over that continue clockwise to the next virtual node of a shard with room.
So rows leave the shard that they hash to only where it is full, and few rows move when shards are added.

Each virtual node's rows are one run of ring ranks, so the whole flow is made from the loads of the virtual nodes, on the
driver, and a row finds its shard by its rank. Ranks come in two levels (slices of the ring, then rows of a slice); no
task holds a shard, and a key with very many rows is sliced further by what else its rows hold.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RING_BITS = 60
#: Rows in a slice of the ring, about; slices are at most 1 << MOST_BITS.
SLICE_ROWS, MOST_BITS = 1 << 16, 16
#: A slice with so many times its rows is cut into 1 << TIE_BITS by its rows' ties.
HOT, TIE_BITS = 8, 8


def ring_point(name: Column) -> Column:
    """A 60-bit point on the ring."""
    return F.conv(F.substring(F.md5(name.cast("string")), 1, 15), 16, 10).cast("long")


def virtual_nodes(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(shard, vnode, point), shards * vnodes rows."""
    ring = spark.range(shards * vnodes, numPartitions=1).select((F.col("id") / vnodes).cast("int").alias("shard"), F.pmod("id", F.lit(vnodes)).cast("int").alias("vnode"))
    return ring.withColumn("point", ring_point(F.concat(F.lit("shard-"), F.col("shard"), F.lit("/"), F.col("vnode"))))


def shard_runs(nodes: list[tuple[int, int]], shards: int, load_factor: float = 1.0) -> list[tuple[int, int, int]]:
    """(first, shard, slot_first) of the runs of ring ranks that each shard serves, from (shard, load) of the virtual nodes in ring order.

    Every shard first serves what hashes to it, in ring order, up to its bound; what is left goes clockwise to the next virtual
    node of a shard with room, and so on. Each round with rows left fills a shard, so there are at most as many as shards.
    """
    total = sum(load for _, load in nodes)
    room = [total // shards + (s < total % shards) if load_factor <= 1.0 else math.ceil(total * load_factor / shards) for s in range(shards)]
    used = [0] * shards
    runs, waiting, first = [], [], 0
    for at, (_, load) in enumerate(nodes):
        waiting.append((at, first, load))
        first += load
    while waiting:
        left = []
        for at, first, n in sorted(waiting):
            shard = nodes[at][0]
            fits = min(n, room[shard] - used[shard])
            if fits:
                runs.append((first, shard, used[shard]))
                used[shard] += fits
            if n > fits:
                left.append((at, first + fits, n - fits))
        following, after = {}, None
        for at in [*range(len(nodes))[::-1]] * 2 if left else []:
            following[at] = after
            after = at if used[nodes[at][0]] < room[nodes[at][0]] else after
        waiting = [(following[at], first, n) for at, first, n in left]
    return sorted(runs)


def ring_shards(rows: DataFrame, key: Column, ties: list[str], shards: int, vnodes: int = 64, load_factor: float = 1.0) -> DataFrame:
    """``rows`` with shard int and slot long (gapless from 0 in each shard).

    ``key`` names a row on the ring, a null key is the empty name; rows with one key are ordered by a hash of ``ties`` and then by them,
    nulls first, and rows alike in both are interchangeable. Columns shard and slot of ``rows`` are replaced, other columns stay, whatever
    their names. An empty table gives no rows. Shards hold at most ``load_factor`` times the mean (1: counts at most one apart). The
    loads of the virtual nodes and of slices that are too full are counted when this is called.
    """
    if shards < 1 or vnodes < 1 or shards * vnodes >= 1 << 16:
        raise ValueError("shards and vnodes must be positive, and the ring under 65536 virtual nodes")
    rows = rows.drop("shard", "slot").withColumn("_point", ring_point(F.coalesce(key.cast("string"), F.lit(""))))
    nodes = virtual_nodes(rows.sparkSession, shards, vnodes).orderBy("point", "shard", "vnode").collect()  # shards * vnodes rows
    # The virtual node of a row, found by bisection in the sorted points of the ring: one array.
    arcs = F.lit([r["point"] for r in nodes])
    edges = rows.select("_point").withColumn("point", _clockwise(F.col("_point"), arcs))
    held = edges.groupBy("point", (F.col("_point") > nodes[-1]["point"]).alias("over")).count().collect()  # shards * vnodes rows and one
    loads, total = {}, sum(r["count"] for r in held)
    for r in held:
        loads[r["point"]] = loads.get(r["point"], 0) + r["count"]
    runs = shard_runs([(r["shard"], loads.pop(r["point"], 0)) for r in nodes], shards, load_factor)
    # The rows after the last virtual node are the first one's; ranks start with them.
    start = total - sum(r["count"] for r in held if r["over"])

    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(1, total / SLICE_ROWS)))))
    rows = rows.withColumn("_slice", F.shiftright("_point", RING_BITS - bits).cast("int"))
    hot = rows.groupBy("_slice").count().where(F.col("count") > HOT * max(SLICE_ROWS, total >> bits)).select("_slice").collect()  # 1 << MOST_BITS rows at most
    tie = ring_point(F.concat_ws("/", *[F.col(f"`{c}`").cast("string") for c in ties]))
    cut = F.array_contains(F.lit([r["_slice"] for r in hot]), F.col("_slice")) if hot else F.lit(False)
    rows = rows.withColumn("_tie", tie).withColumn("_cut", F.when(cut, F.shiftright("_tie", RING_BITS - TIE_BITS)).otherwise(F.lit(0)).cast("int"))
    if hot:  # all rows of a hot slice go by its points first: its cuts are of its fullest point, the rows before and after it are cuts of their own
        most = rows.where(cut).groupBy("_slice", "_point").count().groupBy("_slice").agg(F.max_by("_point", "count").alias("_full"))
        rows = rows.join(F.broadcast(most), "_slice", "left")  # a row for each hot slice
        beside = F.when(F.col("_point") < F.col("_full"), F.lit(-1)).when(F.col("_point") > F.col("_full"), F.lit(1 << TIE_BITS)).otherwise(F.col("_cut"))
        rows = rows.withColumn("_cut", F.when(cut, beside).otherwise(F.col("_cut")).cast("int")).drop("_full")
    slices = rows.select("_slice", "_cut").groupBy("_slice", "_cut").agg(F.count("*").alias("_n"))  # slices, and a few hundred for each hot one
    slices = slices.withColumn("_before", F.sum("_n").over(Window.orderBy("_slice", "_cut")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("_slice", "_cut").orderBy("_point", "_tie", *[f"`{c}`" for c in ties])
    ranked = rows.withColumn("_in", F.row_number().over(within) - 1).join(F.broadcast(slices), ["_slice", "_cut"])
    ranked = ranked.withColumn("_rank", F.pmod(F.col("_before") + F.col("_in") - start, F.lit(max(1, total))))
    served = F.from_json(F.lit(json.dumps([dict(zip(("first", "shard", "slot_first"), r, strict=True)) for r in runs])), "array<struct<first: long, shard: int, slot_first: long>>")
    ranked = ranked.withColumn("_run", _run_of(F.col("_rank"), served))
    ranked = ranked.withColumn("shard", F.col("_run.shard")).withColumn("slot", F.col("_rank") - F.col("_run.first") + F.col("_run.slot_first"))
    return ranked.drop("_point", "_slice", "_tie", "_cut", "_in", "_before", "_rank", "_run")


def search(arr: Column, below) -> Column:
    """Number of leading elements for which ``below`` holds, by bisection in the sorted array; 17 halvings hold any ring's runs."""
    start = F.struct(F.lit(0).alias("lo"), F.size(arr).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        up = (acc["lo"] < acc["hi"]) & below(F.get(arr, mid))
        down = (acc["lo"] < acc["hi"]) & ~below(F.get(arr, mid))
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(down, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(17)), start, step, lambda acc: acc["lo"])


def _clockwise(point: Column, arcs: Column) -> Column:
    """The first of the ring's points at or after a point, or the first of all."""
    return F.coalesce(F.get(arcs, search(arcs, lambda x: x < point)), F.get(arcs, F.lit(0)))


def _run_of(rank: Column, runs: Column) -> Column:
    return F.get(runs, search(runs, lambda x: x["first"] <= rank) - 1)
