"""A corpus pipeline of five stages: each reads what the stage before it kept, as Parquet, and all but the last return documents.

Language ID drops documents without a language; SimHash keeps the smallest id of each near-duplicate group; benchmark
decontamination drops contaminated documents; mixing takes each source up to its target, a row for each time that a document is
taken; sharding deals what is left to shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.decontaminate import find_contamination
from gleanery.llm.language_id import fit_languages, predict_languages
from gleanery.llm.mixing import mix_sources
from gleanery.llm.queries import SHARDS, VNODES, WEIGHTS
from gleanery.llm.sharding import ring_shards
from gleanery.llm.simhash import simhash_groups
from gleanery.session import checkpoint_folder


def _kept(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`kept_{c}`").alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without any letter go."""
    found = predict_languages(docs, fit_languages(docs), keep=docs.columns)
    return _kept(found.where("lang_pred <> 'und'"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of the smallest id, or without any id; of rows with that id, the one with the smallest fingerprint, then hash of all columns."""
    keys = [F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in docs.columns]).alias(f"_k{i}") for i in (0, 1)]
    groups = simhash_groups(docs.select("doc_id", "text", *keys), keep=["_k0", "_k1"])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "kept__k0", "kept__k1")).alias("least")
    kept = groups.groupBy("label").agg(least).select(F.col("least.kept__k0").alias("_k0"), F.col("least.kept__k1").alias("_k1"))
    # The wide rows meet only the kept keys, which name a row; rows alike in all columns count once.
    return docs.select("*", *keys).join(kept, ["_k0", "_k1"], "left_semi").dropDuplicates(["_k0", "_k1"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates, with an id or without."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark, keep=docs.columns, nameless=True)
    return _kept(found.where("not contaminated"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut counts whole. Documents without words go: the mix takes nothing of them.

    Counts come back to the wide rows by a hash of id, source and text; rows alike in these share their count evenly.
    """
    keys = [F.xxhash64(F.lit(i), "doc_id", "source", "text").alias(f"_k{i}") for i in (0, 1)]
    taken = mix_sources(docs.select("doc_id", "source", "text", *keys), WEIGHTS, keep=["_k0", "_k1"]).where("taken > 0")
    times = taken.groupBy("kept__k0", "kept__k1").agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).alias("_times"), F.count("*").alias("_alike"))
    joined = docs.select("*", *keys).join(times.withColumnsRenamed({"kept__k0": "_k0", "kept__k1": "_k1"}), ["_k0", "_k1"])
    place = F.row_number().over(Window.partitionBy("_k0", "_k1").orderBy("_k0"))
    each = F.floor(F.col("_times") / F.col("_alike")) + (place <= F.pmod("_times", F.col("_alike"))).cast("int")
    copies = joined.withColumn("_n", each.cast("int")).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return copies.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = ring_shards(rows, F.col("doc_id"), ["doc_id", "size", "text_crc32"], SHARDS, VNODES)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("language_id", identify_language), ("simhash_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the stages' results go to a folder of their own in the checkpoint folder, and go once the next is written."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs


#: Language ID and SimHash have no SQL form; tests hold run() against plain versions of the stages.
ORACLE_SQL = None
