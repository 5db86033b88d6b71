"""Sinks: create-once tables with unique ids, versioned state, canonical digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.hashing import table_digest
from gleanery.operators.guards import repeated_ids


def write_once(records: DataFrame, exclusions: DataFrame, path: str, id_col: str = "record_id") -> DataFrame:
    """Writes both tables to new folders and returns the digest of the records; repeated ids are a ValueError before anything is written."""
    if repeated_ids(records, id_col).limit(1).count():
        raise ValueError("repeated ids")
    records.write.mode("errorifexists").parquet(f"{path}/records")
    exclusions.write.mode("errorifexists").parquet(f"{path}/exclusions")
    return table_digest(records.sparkSession.read.parquet(f"{path}/records"))


def replay_matches(spark: SparkSession, path: str, again: DataFrame) -> bool:
    """Whether a regenerated table has the digest of the one that was written."""
    first, second = (table_digest(x).first() for x in (spark.read.parquet(f"{path}/records"), again))
    return first == second


def save_state(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """One folder for each table of a state version; a version is written once."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/v={version}/{name}")


def load_state(spark: SparkSession, path: str, version: int, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/v={version}/{name}") for name in names}


def canonical_state(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(state, sha256): the rows sorted by key as one JSON text. For states of bounded size, such as the keys of a small horizon."""
    out = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))).alias("state"))
    return out.withColumn("sha256", F.sha2("state", 256))


def state_digest(rows: DataFrame, key: Column, value: Column, buckets: int = 256) -> DataFrame:
    """(sha256) of a state of any size: its rows as JSON text sorted by key in each hash bucket, and the digests of the buckets in their order."""
    cells = rows.select(F.struct(key.alias("k"), value.alias("v")).alias("c")).withColumn("bucket", F.pmod(F.xxhash64("c.k"), F.lit(buckets)))
    parts = cells.groupBy("bucket").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("c"))), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "|"), 256).alias("sha256"))
