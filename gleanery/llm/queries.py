"""One query for each operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.decontaminate import find_contamination
from gleanery.llm.embedding_dedup import embedding_groups
from gleanery.llm.html_extract import extract_text
from gleanery.llm.language_id import fit_languages, fold_of, predict_languages
from gleanery.llm.mixing import mix_sources
from gleanery.llm.sharding import ring_shards
from gleanery.llm.simhash import simhash_groups
from gleanery.llm.substring_dedup import drop_repeated_windows
from gleanery.llm.url_filter import filter_urls
from gleanery.llm.warc import build_derivatives, responses_of

WEIGHTS = [5, 2, 1]
SHARDS, VNODES = 8, 64
#: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_read(spark, sf_dir, "embeddings"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"), WEIGHTS)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(responses_of(_read(spark, sf_dir, "pages"))).withColumn("source_headers", F.to_json("source_headers"))


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = ring_shards(rows, F.col("doc_id"), ["doc_id", "size", "text_crc32"], SHARDS, VNODES)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(_read(spark, sf_dir, "pages"), rules)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_windows(_read(spark, sf_dir, "documents"), 35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = predict_languages(docs, fit_languages(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_source_mix, op3_simhash_dedup, op4_warc_derivatives, op5_ring_shards, op6_url_filter, op7_html_text, op8_substring_dedup, op9_language_id, op10_decontamination)
}


# SQL ---------------------------------------------------------------------------------------------------------------

_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = v.vec_id), v.vec_id)) AS kept
FROM v
"""

# XXH64 over the bytes of a text, in whole numbers of 128 bits taken modulo 2**64. Fixed values: its five primes.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _whole(x: int) -> str:
    return f"{x % 2**64}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) % {2**64}::UHUGEINT)"


def _times(x: str, p: int) -> str:
    return _mod(f"{x} * {_whole(_P[p - 1])}")


def _let(x: str, name: str, body: str) -> str:
    return f"list_transform([{x}], lambda {name}: {body})[1]"


def _turned(x: str, bits: int) -> str:
    return f"({_mod(f'{x} * {_whole(1 << bits)}')} + ({x} >> {64 - bits}))"


def _lane(at: str, size: int) -> str:
    """Little-endian number of ``size`` bytes from a byte on, of text in hex."""
    return "CAST('0x' || " + " || ".join(f"substr(hx, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + " AS UBIGINT)::UHUGEINT"


def _mixed(acc: str, lane: str) -> str:
    return _let(_mod(f"{acc} + {_times(lane, 2)}"), "t", _times(_turned("t", 31), 1))


def _xxh64_sql(texts: str, seed: int) -> str:
    """CTEs up to ``hashed`` (s, h) from a relation of distinct texts s."""
    first = (seed + _P[0] + _P[1], seed + _P[1], seed, seed - _P[0])
    stripes = ", ".join(f"list_reduce(list_concat([{_whole(x)}], list_transform(range(0, n // 32), lambda i: {_lane(f'32 * i + {8 * k}', 8)})), lambda acc, l: {_mixed('acc', 'l')}) AS v{k}" for k, x in enumerate(first))
    joined = _mod(" + ".join(_turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    merged = _mod(f"{_times('xor(acc, ' + _mixed('0::UHUGEINT', 'v') + ')', 1)} + {_whole(_P[3])}")
    eights = _let(f"xor(acc, {_mixed('0::UHUGEINT', 'l')})", "u", _mod(f"{_times(_turned('u', 27), 1)} + {_whole(_P[3])}"))
    four = _let(f"xor(h, {_times(_lane('8 * (n // 8)', 4), 1)})", "u", _mod(f"{_times(_turned('u', 23), 2)} + {_whole(_P[2])}"))
    ones = _let(f"xor(acc, {_times('l', 5)})", "u", _times(_turned("u", 11), 1))
    return f"""x0 AS (
  SELECT s, hx, n, {stripes} FROM (SELECT s, hex(encode(s)) AS hx, strlen(s) AS n FROM {texts})
), x1 AS (
  SELECT s, hx, n, CASE WHEN n >= 32 THEN list_reduce([{joined}, v0, v1, v2, v3], lambda acc, v: {merged}) ELSE {_whole(seed + _P[4])} END AS h FROM x0
), x2 AS (
  SELECT s, hx, n, list_reduce(list_concat([{_mod('h + n::UHUGEINT')}], list_transform(range(4 * (n // 32), n // 8), lambda i: {_lane('8 * i', 8)})), lambda acc, l: {eights}) AS h FROM x1
), x3 AS (
  SELECT s, hx, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM x2
), x4 AS (
  SELECT s, list_reduce(list_concat([h], list_transform(range(4 * (n // 4), n), lambda i: {_lane('i', 1)})), lambda acc, l: {ones}) AS h FROM x3
), x5 AS (
  SELECT s, {_times('xor(h, h >> 33)', 2)} AS h FROM x4
), x6 AS (
  SELECT s, {_times('xor(h, h >> 29)', 3)} AS h FROM x5
), hashed AS (
  SELECT s, xor(h, h >> 32) AS h FROM x6
)"""


_BITS = " + ".join(f"CASE WHEN 2 * sum(CAST((h >> {k}) & 1::UHUGEINT AS BIGINT)) > count(*) THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))
_OP3 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents
), p AS (
  SELECT r, unnest(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM d WHERE len(w) > 0
), texts AS (
  SELECT DISTINCT s FROM p
), {_xxh64_sql('texts', 42)}, f AS (
  SELECT r, {_BITS} AS fp FROM p JOIN hashed USING (s) GROUP BY r
), e AS (
  SELECT d.doc_id, coalesce(fp, 0::UHUGEINT) AS fp FROM d LEFT JOIN f USING (r)
), u AS (
  SELECT fp, CAST(fp >> 32 AS BIGINT) AS hi, CAST(fp & 4294967295::UHUGEINT AS BIGINT) AS lo, min(doc_id) AS least_id FROM e GROUP BY fp
), links AS (
  SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4
), reach AS (
  SELECT a AS x, b AS y FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a
), c AS (
  SELECT x AS fp, min(least_id) AS component_id FROM reach JOIN u ON u.fp = reach.y GROUP BY x
)
SELECT doc_id, lower(lpad(to_hex(CAST(fp AS UBIGINT)), 16, '0')) AS fingerprint, component_id FROM e JOIN c USING (fp)
"""

_SIZES = r"""len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"""
_POINT = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"

#: The mix over a relation with doc_id, size and source; weights 5, 2, 1.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST({_SIZES} AS BIGINT) AS size, {_POINT.format("'mix:' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS key FROM {{docs}}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS seat FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][seat % 3 + 1] AS BIGINT) AS w, source_size * 3 AS top FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(top) OVER o, 0) AS BIGINT) AS rest, CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS heft, row_number() OVER (ORDER BY top / w, seat) AS pos
  FROM w WINDOW o AS (ORDER BY top / w, seat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, min(CASE WHEN CAST(rest AS HUGEINT) * w <= CAST(top AS HUGEINT) * heft THEN pos END) OVER () AS first FROM l
), t AS (
  SELECT f.source, f.source_size, CASE WHEN f.first IS NULL OR f.pos < f.first THEN CAST(f.top AS DOUBLE) ELSE CAST(g.rest * f.w AS DOUBLE) / CAST(g.heft AS DOUBLE) END AS target
  FROM f LEFT JOIN f g ON g.pos = f.first
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""

#: CRC-32 of a text, byte by byte through the table of the reflected polynomial 0xEDB88320.
_CRC_TABLE = "(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT))), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"



def _round(r: int) -> str:
    """A round of the ring's flow: every virtual node serves what waits at it, in ring order, while its shard has room; the rest goes on clockwise."""
    return f""", a{r} AS (
  SELECT w.seat, w.first, w.n, u.shard, u.used, u.bound - u.used AS room, sum(w.n) OVER (PARTITION BY u.shard ORDER BY w.seat, w.first) - w.n AS ahead FROM w{r} w JOIN n USING (seat) JOIN u{r} u ON n.shard = u.shard
), f{r} AS (
  SELECT *, greatest(0, least(n, room - ahead)) AS fits FROM a{r}
), u{r + 1} AS (
  SELECT u.shard, u.bound, u.used + coalesce((SELECT sum(fits) FROM f{r} f WHERE f.shard = u.shard), 0) AS used FROM u{r} u
), o{r} AS (
  SELECT n.seat FROM n JOIN u{r + 1} u USING (shard) WHERE u.used < u.bound
), w{r + 1} AS (
  SELECT coalesce((SELECT min(seat) FROM o{r} o WHERE o.seat > f.seat), (SELECT min(seat) FROM o{r})) AS seat, f.first + f.fits AS first, f.n - f.fits AS n FROM f{r} f WHERE f.n > f.fits
)"""


#: Each round with rows left fills a shard, so SHARDS rounds serve all.
SHARD_SQL = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS crc
), d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST({_CRC} AS BIGINT) AS text_crc32, {_POINT.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS point FROM {{docs}}, tab
), ring AS (
  SELECT i // {VNODES} AS shard, {_POINT.format(f"'shard-' || (i // {VNODES}) || '/' || (i % {VNODES})")} AS point FROM range({SHARDS * VNODES}) t(i)
), loads AS (
  SELECT coalesce((SELECT min(point) FROM ring WHERE ring.point >= p.point), (SELECT min(point) FROM ring)) AS point, count(*) AS load FROM (SELECT point FROM d) p GROUP BY 1
), n AS (
  SELECT shard, coalesce(load, 0) AS load, row_number() OVER (ORDER BY point) AS seat FROM ring LEFT JOIN loads USING (point)
), t AS (
  SELECT (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM d WHERE point <= (SELECT max(point) FROM ring)) AS start
), u0 AS (
  SELECT shard, total // {SHARDS} + CASE WHEN shard < total % {SHARDS} THEN 1 ELSE 0 END AS bound, 0 AS used FROM range({SHARDS}) r(shard), t
), w0 AS (
  SELECT seat, sum(load) OVER (ORDER BY seat) - load AS first, load AS n FROM n
){"".join(map(_round, range(SHARDS)))}, runs AS (
  {" UNION ALL ".join(f"SELECT first, fits, shard, used + ahead AS slot_first FROM f{r} WHERE fits > 0" for r in range(SHARDS))}
), k AS (
  SELECT doc_id, size, text_crc32, (row_number() OVER (ORDER BY point, {_POINT.format("concat_ws('/', doc_id, size, text_crc32)")}, doc_id NULLS FIRST, size, text_crc32) - 1 - start + total) % total AS place FROM d, t
)
SELECT k.doc_id, k.size, k.text_crc32, 'rows' AS law, CAST(runs.shard AS INTEGER) AS shard, CAST(k.place - runs.first + runs.slot_first AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM k JOIN runs ON k.place >= runs.first AND k.place < runs.first + runs.fits
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_OP6 = f"""
WITH rules(host, path, verdict) AS (VALUES {_RULES}
), u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), k AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
  SELECT k.page_id, k.host, k.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.verdict) AS place
  FROM k LEFT JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE place = 1
"""

_OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), h AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM p
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM rep
), g AS (
  SELECT r, list(i) AS gone FROM gone GROUP BY r
), o AS (
  SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (r)
), words AS (
  SELECT d.r, u.i, u.x FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i, unnest(d.w) AS x) u
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""

_FOLD = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: Contamination over any relation of documents.
DECONTAMINATE_SQL = f"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_FOLD} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda j: array_to_string(w[j:j + least(13, len(w)) - 1], ' '))) AS k FROM i WHERE len(w) > 0
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_FOLD} AS w FROM {{docs}}
), p AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS j, w FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n
), q AS (
  SELECT r, n, j, array_to_string(w[j:j + n - 1], ' ') AS k FROM p
), found AS (
  SELECT q.r, q.n, q.j, s.item_id FROM q JOIN s ON q.n = s.n AND q.k = s.k
), hit AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(j, j + n)) AS x FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": _OP1, "op2_source_mix": MIX_SQL.format(docs="documents"), "op3_simhash_dedup": _OP3, "op5_ring_shards": SHARD_SQL.format(docs="documents"),
    "op6_url_filter": _OP6, "op8_substring_dedup": _OP8, "op10_decontamination": DECONTAMINATE_SQL.format(docs="documents"),
}  # fmt: skip
