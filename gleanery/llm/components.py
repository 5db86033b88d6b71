"""Connected components of a link table by alternating stars.

Each round is a large-star and a small-star step: minima per node are partial aggregates, and they come back to the
links by an inner join whose skewed side AQE can split, so a node with very many links never meets in one task.
Rounds are cut by checkpoint() in the shared folder; the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpoint


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node long, label long) for each linked node but the smallest of its component, whose id is the label.

    Null ends, self links and repeated links change nothing; no links give an empty table. Nodes that are missing
    in the result are their own label.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    links = _state(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(links)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        links = _state(_small_star(_large_star(links)))
        now = _digest(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _state(links: DataFrame) -> DataFrame:
    return checkpoint(links)


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, go to the smallest neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


#: Parts that the members of a component are dealt into where its minimum comes back to them.
PARTS = 16


def with_least(nodes: DataFrame, label: str, node: str, value: str) -> DataFrame:
    """``nodes`` with ``least``: the smallest value of the component, nulls not counted.

    Minima are partial aggregates; each comes back in a row for each part of its component, so one with very many nodes is read by many
    tasks.
    """
    mixed = nodes.withColumn("part", F.pmod(F.xxhash64(node), F.lit(PARTS)))
    tops = nodes.groupBy(label).agg(F.min(value).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    spread = tops.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    return mixed.join(spread, [label, "part"], "left").withColumn("least", F.coalesce("least", value)).drop("part")
