"""Hash-ordered identity: salted SHA-256, splits by exact fractions, priorities, canonical digests."""

from __future__ import annotations

import hashlib
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_hash(salt: str, unit: Column) -> Column:
    """SHA-256 of salt, NUL and unit as hex; hex order is the order of the 256-bit numbers."""
    return F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), unit.cast("string")), 256)


def hash_bound(share: Fraction) -> str:
    """The largest hex digest below ``share`` of the range, so that ``h <= bound`` is exactly ``h < share * 2**256``."""
    n = -(-share.numerator * 2**256 // share.denominator) - 1
    return f"{n:064x}"


def digest_partition(h: Column, train: Fraction = Fraction(7, 10), calibration: Fraction = Fraction(17, 20)) -> Column:
    return F.when(h <= hash_bound(train), "train").when(h <= hash_bound(calibration), "calibration").otherwise("test")


def in_pool(h: Column, share: Fraction = Fraction(4, 5)) -> Column:
    return h <= hash_bound(share)


def seeded_priority(seed: str, unit: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"priority-v1|{seed}|"), unit.cast("string")), 256)


def hash_number(salt: str, unit: Column, digits: int = 8) -> Column:
    """The first hex digits of the salted hash as a number."""
    return F.conv(F.substring(salted_hash(salt, unit), 1, digits), 16, 10).cast("long")


def derive_seed(*parts: object) -> int:
    """The first 128 bits of SHA-256 over length-prefixed parts."""
    h = hashlib.sha256()
    for part in parts:
        data = str(part).encode()
        h.update(len(data).to_bytes(8, "big") + data)
    return int.from_bytes(h.digest()[:16], "big")


def source_unit(kind: str, record_id: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """The service unit of a record: a compact JSON pair of native ids, a domain, or the record alone where ids are missing."""
    alone = F.concat(F.lit("unknown:"), record_id.cast("string"))
    if kind == "domain":
        return F.when(F.trim(a) != "", F.concat(F.lit("domain:"), a)).otherwise(alone)
    known = a.isNotNull() & b.isNotNull() & (F.trim(a.cast("string")) != "") & (F.trim(b.cast("string")) != "")
    if kind == "account":  # system accounts are no source
        known = known & ~F.coalesce(b.cast("string").try_cast("bigint") <= 0, F.lit(False))
    prefix = {"publication": "civil:", "account": "account:"}[kind]
    pair = F.to_json(F.struct(a.alias("a"), b.alias("b")))
    compact = F.concat(F.lit("["), F.regexp_extract(pair, r'^\{"a":(.*),"b":', 1), F.lit(","), F.regexp_extract(pair, r',"b":(.*)\}$', 1), F.lit("]"))
    return F.when(known, F.concat(F.lit(prefix), compact)).otherwise(alone)


def canonical_digest(*cols: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive state digest: rows, and the exclusive or and sum of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("hash_xor"), F.sum(F.shiftright(h, 32)).alias("hash_sum"))


# The Poisson distribution with mean 1 at 0 to 6.
POISSON_STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def resample_weight(salt: str, replicate: Column, unit: Column) -> Column:
    """How often a unit is in a replicate: Poisson with mean 1, read off a hash."""
    u = hash_number(salt, F.concat_ws("|", replicate.cast("string"), unit.cast("string"))) / F.lit(float(2**32))
    out = F.lit(0)
    for step in POISSON_STEPS:
        out = out + (u >= step).cast("int")
    return out
