"""SimHash near-duplicates through anchor points of a covering code.

Four differing bits leave one of three parts of the fingerprint (21, 21 and 22 bits) with at most one. On each part the
anchors are a covering code: the perfect Hamming code [15, 11], covering radius 1, times all values of the other bits.
A fingerprint is at home at the one anchor within the covering radius, and is replicated to every anchor within radius
plus the part's threshold; two fingerprints within one bit in a part meet where one is at home. Per anchor, fingerprints
are compared on all 64 bits, and only a spanning forest of the links found there leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpoint, mix, pieces, spanning_links
from gleanery.llm.components import connected_components, with_least

SHINGLE = 4
PARTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints at home at one anchor that one task compares; more are dealt over several.
HOME_ROWS = 16384
#: Entries that one group of anchors holds, about.
GROUP_ENTRIES = 1 << 20
PAIRS_AT_ONCE = 1 << 21


def fingerprint_rows(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) and the columns in ``keep``, prefixed ``kept_``."""
    keep = keep or []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *[batch.column(f"kept_{c}") for c in keep]], names=["doc_id", "fp", *[f"kept_{c}" for c in keep]])

    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "fp long", *[f"`kept_{c}` {kinds[f'kept_{c}']}" for c in keep]]))


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """64-bit SimHash of each text: XXH64 of its shingles, a bit set where over half of the hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    for i, j in pieces([len(t or "") for t in texts], 1 << 19):
        hashes, counts = [], []
        for text in texts[i:j]:
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
            n = max(1, len(words) - SHINGLE + 1) if words else 0
            hashes += [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist(), strict=True)]
            counts.append(n)
        each = np.array(counts, np.int64)
        full = np.flatnonzero(each)
        if len(full):
            ones = _bit_counts(np.array(hashes, np.uint64), each[full])
            over = (2 * ones > each[full][:, None]).astype(np.uint8)
            out[np.arange(i, j)[full]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each document's hashes have each bit; the hashes of a long document are taken in slices."""
    unpack = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    if len(sizes) == 1:
        step = 1 << 16
        return sum(unpack(hashes[i : i + step]).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), step))[None, :]
    return np.add.reduceat(unpack(hashes), np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)


# Anchors ----------------------------------------------------------------------------------------------------------

_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _hamming() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each 15-bit value: the codeword within 1, and the codewords within 2 with their number. Bit i has the syndrome i + 1."""
    if not _TABLES:
        value = np.arange(1 << 15, dtype=np.uint32)
        syndrome = np.zeros_like(value)
        for i in range(15):
            syndrome ^= ((value >> np.uint32(i)) & np.uint32(1)) * np.uint32(i + 1)
        home = value ^ np.where(syndrome > 0, np.uint32(1) << np.maximum(syndrome, 1).astype(np.uint32) - np.uint32(1), 0).astype(np.uint32)
        near = np.zeros((1 << 15, 8), np.uint32)
        near[:, 0] = home
        count = np.where(syndrome > 0, 8, 1)
        filled = np.ones(1 << 15, np.int64)
        for i in range(15):  # flips of two bits whose syndromes add up to the value's
            other = syndrome ^ np.uint32(i + 1)
            rows = np.flatnonzero((syndrome > 0) & (other > i + 1))
            near[rows, filled[rows]] = value[rows] ^ np.uint32(1 << i) ^ (np.uint32(1) << (other[rows] - np.uint32(1)))
            filled[rows] += 1
        _TABLES.append((home, near, count))
    return _TABLES[0]


def anchors(fps: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each fingerprint; then, of all replicas: index of the fingerprint, anchor) on one part."""
    home15, near, count = _hamming()
    shift, width = PARTS[part]
    block = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.uint32)
    low, high = block & np.uint32(0x7FFF), block >> np.uint32(15)
    home = (high << np.uint32(15)) | home15[low]
    index, anchor = [], []
    for j in range(8):
        rows = np.flatnonzero(count[low] > j)
        index.append(rows)
        anchor.append((high[rows] << np.uint32(15)) | near[low[rows], j])
    for j in range(width - 15):
        index.append(np.arange(len(fps)))
        anchor.append(home ^ np.uint32(1 << (15 + j)))
    return home, np.concatenate(index), np.concatenate(anchor)


def near_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b) links that join all fingerprints within ``bits`` differing bits, for a table of distinct ``fp``; ``bits`` is at most 5."""
    if not 0 <= bits <= 5:
        raise ValueError("three parts with one bit each hold for at most five differing bits")
    total = fps.count()
    groups = 1 << max(4, int(np.ceil(np.log2(max(1, total * 45 / GROUP_ENTRIES)))))
    limit = max(HOME_ROWS, 3 * total // 50_000)  # so at most 50,000 anchors are hot

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("fp")).view(np.uint64)
            keys = [anchors(values, p)[0].astype(np.int64) | (p << 32) for p in range(3)]
            names, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["anchor", "n"])

    hot_rows = fps.mapInArrow(homes, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()
    hot = {r["anchor"]: -(-r["n"] // limit) for r in hot_rows}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sorted(hot), np.int64)
        salts = np.array([hot[x] for x in names.tolist()], np.int64)
        for batch in batches:
            values = np.asarray(batch.column("fp")).view(np.uint64)
            for p in range(3):
                home, index, anchor = anchors(values, p)
                key = np.concatenate((home, anchor)).astype(np.int64) | (p << 32)
                fp = np.concatenate((values, values[index]))
                role = np.concatenate((np.ones(len(home), np.uint8), np.zeros(len(anchor), np.uint8)))
                salt = np.zeros(len(key), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                    n = np.where(names[at] == key, salts[at], 1)
                    times = np.where(role == 0, n, 1)  # replicas meet every share of a hot anchor's homes
                    row = np.repeat(np.arange(len(key)), times)
                    share = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    own = (mix(fp) % n.astype(np.uint64)).astype(np.int64)
                    key, fp, role = key[row], fp[row], role[row]
                    salt = np.where(role == 1, own[row], share)
                group = (mix(key.astype(np.uint64) ^ (salt.astype(np.uint64) << np.uint64(40))) >> np.uint64(32)).astype(np.int64) & (groups - 1)
                order = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(groups + 1))
                full = np.flatnonzero(np.diff(cuts))
                # The key of a bucket: anchor, part and salt in one number.
                packed = key | (salt << 34)
                cols = [[x[order[cuts[g] : cuts[g + 1]]].tobytes() for g in full] for x in (packed, fp, role)]
                yield pa.RecordBatch.from_arrays([pa.array(full), *[pa.array(c, pa.binary()) for c in cols]], names=["grp", "keys", "fps", "roles"])

    def compare(table: pa.Table) -> pa.Table:
        gather = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        key, fp, role = gather("keys", np.int64), gather("fps", np.uint64), gather("roles", np.uint8)
        a, b = bucket_links(key, fp, role, bits)
        a, b = spanning_links(a.view(np.int64), b.view(np.int64))
        return pa.table({"a": a, "b": b})

    return fps.mapInArrow(deal, "grp long, keys binary, fps binary, roles binary").groupBy("grp").applyInArrow(compare, "a long, b long")


def bucket_links(key: np.ndarray, fp: np.ndarray, role: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the homes and the replicas of each key, forests of them where a round finds many."""
    order = np.lexsort((role, key))
    key, fp, role = key[order], fp[order], role[order]
    first = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(key))
    replicas = np.add.reduceat(1 - role.astype(np.int64), first) if len(key) else first
    width = np.repeat(replicas, last - first)
    begin = np.repeat(first, last - first)
    homes = np.flatnonzero((role == 1) & (width > 1))
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    held = 0
    at = 0
    sums = np.cumsum(width[homes])
    while at < len(homes):
        until = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        own, n = homes[at:until], width[homes[at:until]]
        left = np.repeat(own, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
        x, y = fp[left], fp[right]
        near = np.flatnonzero((np.bitwise_count(x ^ y) <= bits) & (x != y))
        found_a.append(x[near])
        found_b.append(y[near])
        held += len(near)
        if held > PAIRS_AT_ONCE:
            a, b = spanning_links(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
        at = until
    return np.concatenate(found_a), np.concatenate(found_b)


def simhash_groups(docs: DataFrame, bits: int = 4, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, label, fingerprint, component_id) and the columns in ``keep``, prefixed ``kept_``, a row for each row of docs.

    Texts without words have fingerprint zero, linked like any other. component_id is the smallest doc_id reachable over
    links of at most ``bits`` differing bits; null ids don't count for it, and a group with null ids alone has null. label
    names the group whatever its ids: its smallest fingerprint. Rows with one fingerprint collapse before any comparison, and repeated rows
    stay. Texts of any length are hashed whole. An empty table gives no rows.
    """
    # Written, because three later steps use it; the texts are read once and don't travel.
    rows = checkpoint(fingerprint_rows(docs, keep, id_col, text_col))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = connected_components(near_links(checkpoint(classes.select("fp")), bits))
    classes = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    members = with_least(classes, "label", "fp", "first_id").select("fp", "label", F.col("least").alias("component_id"))
    return rows.join(members, "fp").withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))
