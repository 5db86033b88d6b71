"""URL filters as a sort-merge range join.

The canonical key of a host is its labels from the last to the first, each closed by a dot (``com.example.www.``), so a
host and all its subdomains are the interval of keys with that prefix. Distinct (host, path) keys are dealt over ranges of
that order, each rule goes to the ranges that its interval meets, and a sweep over the sorted range keeps a stack of the nested
host rules that are active, with the path rules of each. Hosts with very many urls are no hot group: equal keys
collapse before the sort, and a range boundary may fall within a host, between two of its paths.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.sharding import search

#: Distinct keys in a range, about; ranges are at most MAX_RANGES.
RANGE_KEYS, MAX_RANGES = 1 << 18, 1 << 16


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, a dot after each; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the path starts with the
    rule's; among fitting rules the one of the longest host and path together wins, of equal ones the one with the
    longer host, then the smaller verdict. No fitting rule: rule null and the verdict ``default``. A null url, or one
    without ``://``, has an empty host and path, which no rule with a host fits. Rules that are null in any column are
    left out, repeated rows stay, urls of any length are judged whole, other columns are left out, and empty tables give what holds
    without their rows. Ranges are as many as distinct urls need, unless ``ranges`` says.
    """
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(F.col(f"`{url_col}`")).alias("host"), url_path(F.col(f"`{url_col}`")).alias("path"))
    keys = urls.groupBy("host", "path").agg(F.lit(1).alias("one")).select(host_key(F.col("host")).alias("key"), "host", "path")
    if ranges is None:
        distinct = urls.agg(F.approx_count_distinct(F.xxhash64("host", "path")).alias("n")).first()["n"]
        ranges = max(2, min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct // 1024), -(-distinct // RANGE_KEYS))
    bounds = _boundaries(keys, min(MAX_RANGES, ranges))
    clean = rules.select(F.lower("host").alias("host"), "path", "verdict").dropna().distinct()
    clean = clean.withColumn("low", host_key(F.col("host"))).withColumn("high", F.concat(F.substring("low", F.lit(1), F.length("low") - 1), F.lit("/")))
    clean = clean.withColumn("range", F.explode(F.sequence(_range_of(F.col("low"), F.lit(""), bounds), F.greatest(_range_of(F.col("low"), F.lit(""), bounds), _range_of(F.col("high"), F.lit(""), bounds)))))
    left = keys.withColumn("range", _range_of(F.col("key"), F.col("path"), bounds)).groupBy("range")
    right = clean.groupBy("range")
    judged = left.cogroup(right).applyInArrow(_sweep, "host string, path string, rule string, verdict string")
    found = urls.join(judged, ["host", "path"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _boundaries(keys: DataFrame, ranges: int) -> list[tuple[str, str]]:
    """At most ranges - 1 boundaries, from a hash sample of the distinct keys, some four for each range. They deal the work and decide no verdict."""
    slot = F.pmod(F.xxhash64("key", "path"), F.lit(max(1 << 12, 4 * ranges)))
    sample = keys.withColumn("slot", slot).groupBy("slot").agg(F.min_by(F.struct("key", "path"), F.xxhash64(F.lit(1), "key", "path")).alias("k"))
    found = sorted({(r["k"]["key"], r["k"]["path"]) for r in sample.collect()})  # a row for each slot at most
    return [found[i * len(found) // ranges] for i in range(1, ranges)] if len(found) > ranges else found[1:]


def _range_of(key: Column, path: Column, bounds: list[tuple[str, str]]) -> Column:
    """Number of boundaries at or below (key, path), by bisection."""
    if not bounds:
        return F.lit(0)
    edges = F.from_json(F.lit(json.dumps([{"k": k, "p": p} for k, p in bounds])), "array<struct<k: string, p: string>>")
    return search(edges, lambda x: x <= F.struct(key.alias("k"), path.alias("p")))


def _sweep(keys: pa.Table, rules: pa.Table) -> pa.Table:
    """Sorted sweep: rules enter the stack at their interval's low end and leave past its high end."""
    opened = sorted(zip(rules["low"].to_pylist(), rules["high"].to_pylist(), rules["host"].to_pylist(), rules["path"].to_pylist(), rules["verdict"].to_pylist(), strict=True), key=lambda r: (r[0], r[3], r[4]))
    rows = sorted(zip(keys["key"].to_pylist(), keys["path"].to_pylist(), keys["host"].to_pylist(), strict=True))
    stack: list[dict] = []  # nested host intervals: low, high and the path rules by path
    out: dict[str, list] = {"host": [], "path": [], "rule": [], "verdict": []}
    at = 0
    for key, path, host in rows:
        while at < len(opened) and opened[at][0] <= key:
            low, high, rule_host, rule_path, verdict = opened[at]
            at += 1
            while stack and not low < stack[-1]["high"]:
                stack.pop()
            if not (stack and stack[-1]["low"] == low):
                stack.append({"low": low, "high": high, "host": rule_host, "paths": [], "verdicts": {}})
            if rule_path not in stack[-1]["verdicts"]:  # sorted, so the smaller verdict came first
                stack[-1]["paths"].append(rule_path)
                stack[-1]["verdicts"][rule_path] = verdict
        while stack and not key < stack[-1]["high"]:
            stack.pop()
        best = None
        for level in stack:
            if (found := _longest_prefix(level["paths"], path)) is not None:
                rank = (len(level["host"]) + len(found), len(level["host"]))
                if best is None or rank > best[0]:
                    best = (rank, level["host"] + found, level["verdicts"][found])
        if best:
            for name, value in zip(out, (host, path, best[1], best[2]), strict=True):
                out[name].append(value)
    return pa.table(out, schema=pa.schema([(n, pa.string()) for n in out]))


def _longest_prefix(paths: list[str], path: str) -> str | None:
    """The longest of the sorted rule paths that ``path`` starts with; prefixes of a text sort before it, the longest last."""
    hi = bisect_right(paths, path)
    while hi:
        rule = paths[hi - 1]
        if path.startswith(rule):
            return rule
        common = next((i for i, (a, b) in enumerate(zip(rule, path, strict=False)) if a != b), min(len(rule), len(path)))
        hi = min(hi - 1, bisect_left(paths, path[:common] + "\0", 0, hi)) if common else min(hi - 1, bisect_left(paths, "\0", 0, hi))
    return None
