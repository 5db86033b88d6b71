"""Exclusion ledgers and leakage guards. All guards judge the original split; their reasons are united, nothing cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.graph import witnesses

# Which split keeps a text that several hold.
PRECEDENCE = {"test": 3, "calibration": 2, "train": 1}


def precedence(partition: Column) -> Column:
    out = F.lit(0)
    for name, rank in PRECEDENCE.items():
        out = F.when(partition == name, rank).otherwise(out)
    return out


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds; a rule that is null doesn't hold. Null where none does."""
    out = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def split_ledger(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, excluded rows with ``reason``); every row is in exactly one."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def exact_text_guard(records: DataFrame, text: Column) -> DataFrame:
    """(record_id, reason): records whose normalised text a split of higher precedence holds. Texts meet by their hash."""
    keyed = records.select("record_id", precedence(F.col("partition")).alias("prec"), F.sha2(text, 256).alias("key"))
    top = keyed.groupBy("key").agg(F.max("prec").alias("top"))
    return keyed.join(top, "key").where("prec < top").select("record_id", F.lit("exact_text").alias("reason"))


def text_guard(records: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Records whose text none of the held ones has; texts meet by ``key``, and a null key meets none."""
    return records.join(held.select(key), key, "left_anti")


def link_guard(records: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((record_id, reason) of the lower-precedence ends of links over splits, links with an unknown end). links: (a, b)."""
    side = lambda c: records.select(F.col("record_id").alias(c), precedence(F.col("partition")).alias(f"{c}_prec"))
    resolved = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    known = resolved.where("a_prec is not null and b_prec is not null and a_prec <> b_prec")
    lower = known.select(F.when(F.col("a_prec") < F.col("b_prec"), F.col("a")).otherwise(F.col("b")).alias("record_id"))
    return lower.distinct().withColumn("reason", F.lit("duplicate_link")), resolved.where("a_prec is null or b_prec is null").select("a", "b")


def parent_guard(records: DataFrame) -> DataFrame:
    """(record_id, reason): train records whose parent is held out. Parents null, empty, 0 and -1 are none."""
    child = records.where((F.col("partition") == "train") & F.col("parent_id").isNotNull() & ~F.col("parent_id").cast("string").isin("", "0", "-1"))
    parent = records.where("partition <> 'train'").select(F.col("record_id").alias("parent_id"))
    return child.join(parent, "parent_id", "left_semi").select("record_id", F.lit("heldout_parent").alias("reason"))


def semantic_guard(train: DataFrame, heldout: DataFrame, tau: float) -> DataFrame:
    """(id, witness, score): train rows with a held-out row over ``tau``, and the one with the smallest id."""
    return witnesses(train, heldout, [tau]).select("id", F.col("w0").alias("witness"), F.col("s0").alias("score"))


def semantic_guard_grid(train: DataFrame, heldout: DataFrame, taus: list[float]) -> DataFrame:
    """(id, top, w0, w1, …): the largest score and the smallest witness over each threshold, in one pass."""
    return witnesses(train, heldout, taus).select("id", "top", *[f"w{i}" for i in range(len(taus))])


def unite_reasons(*reasons: DataFrame) -> DataFrame:
    """(record_id, reasons): the sorted reasons of each excluded record."""
    out = reasons[0]
    for other in reasons[1:]:
        out = out.unionByName(other)
    return out.groupBy("record_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def apply_guards(records: DataFrame, reasons: DataFrame) -> DataFrame:
    return records.join(reasons, "record_id", "left_anti")


def contract_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations), one scan for all rules; a null outcome violates."""
    sums = df.agg(*[F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias(n) for n, ok in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("n_violations")) for n in rules])).alias("x")).select("x.*")


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def benchmark_containment(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold an item's text. Only pairs that share the longest inner word of the item are compared.

    The first and last word of an item may be parts of longer words in a document; the inner ones are whole there.
    """
    words = F.split("text", " ")
    inner = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2))
    longest = F.aggregate(inner, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    items = benchmark.where(F.length("text") > 0).select("item_id", F.col("text").alias("item"), longest.alias("word"))
    held = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word"))
    candidates = held.join(items.where("word <> ''"), "word").select("doc_id", "item_id", "item")
    found = candidates.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    short = items.where("word = ''").select("item_id", "item")  # of two words at most
    return found.union(docs.join(short, F.contains(docs.text, short.item)).select("doc_id", "item_id"))
