"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import exact, hashing, text, vectors
from gleanery.operators import evaluation, exact_states, graph, guards, inference, moments, selection, states, structure, windows, workload
from gleanery.session import checkpoint_folder, durable
from gleanery.sources.readers import explode_clusters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TAU, UNIT, HORIZON = 0.30, 3, 2
CUTS = [-0.2, 0.0, 0.1, 0.2, 0.3, 0.4]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


def edge_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vector_rows(spark, sf_dir)
    return rows, graph.blocker_edges(rows, TAU)


def written_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same, for plans that read the edges more than once: the join runs once."""
    rows, edges = edge_rows(spark, sf_dir)
    return rows, durable(edges)


def units(spark: SparkSession, *values: int) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "unit int")


def h(salt: str, x: str) -> str:
    return f"sha256(concat('{salt}', chr(0), CAST({x} AS VARCHAR)))"


def n(salt: str, x: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr({h(salt, x)}, 1, {digits}) AS BIGINT)"


_U = f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id AS id, label AS unit, sha256('priority-v1|0|' || vec_id) AS p, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS z FROM v)"""
_E = _U + f""",
edges AS (SELECT l.id AS rid, l.unit AS rown, r.id AS bid, r.unit AS bown, list_dot_product(l.z, r.z) AS score FROM u l JOIN u r ON (r.p < l.p OR (r.p = l.p AND r.id < l.id)) AND list_dot_product(l.z, r.z) > {TAU})"""
_T = _E + """,
tails AS (SELECT rid, list_sort(list(DISTINCT bown)) AS tail FROM edges GROUP BY rid),
terms AS (SELECT u.id, u.unit AS own, coalesce(tail, []) AS tail FROM u LEFT JOIN tails ON u.id = tails.rid)"""
_NORM = r"trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))"
_NFC = r"trim(regexp_replace(nfc_normalize(text), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
_PART = f"CASE WHEN {{0}} <= '{hashing.hash_bound(Fraction(7, 10))}' THEN 'train' WHEN {{0}} <= '{hashing.hash_bound(Fraction(17, 20))}' THEN 'calibration' ELSE 'test' END"
_PREC = "CASE {0} WHEN 'test' THEN 3 WHEN 'calibration' THEN 2 ELSE 1 END"


# Identity, splits, text ---------------------------------------------------------------------------------------------


@query(f"SELECT source, {h('split', 'source')} AS h, {_PART.format(h('split', 'source'))} AS part, count(*) AS n_docs FROM documents GROUP BY source")
def split_by_source_hash(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs")).withColumn("h", hashing.salted_hash("split", F.col("source")))
    return s.select("source", "h", hashing.digest_partition(F.col("h")).alias("part"), "n_docs")


@query(f"SELECT source, {h('pool', 'source')} <= '{hashing.hash_bound(Fraction(4, 5))}' AS in_pool, sha256('priority-v1|7|' || source) AS priority FROM documents GROUP BY source")
def pool_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.select("source", hashing.in_pool(hashing.salted_hash("pool", F.col("source"))).alias("in_pool"), hashing.seeded_priority("7", F.col("source")).alias("priority"))


@query("SELECT order_id, CASE WHEN clerk IS NOT NULL AND trim(clerk) <> '' THEN 'account:[\"' || prio || '\",\"' || clerk || '\"]' ELSE 'unknown:' || order_id END AS unit FROM (SELECT o_orderkey AS order_id, o_orderpriority AS prio, CASE WHEN o_orderkey % 3 = 0 OR o_custkey <= 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS clerk FROM orders)")
def source_units(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("prio"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("clerk"))
    return o.select("order_id", hashing.source_unit("account", F.col("order_id"), F.col("prio"), F.col("clerk")).alias("unit"))


@query(f"SELECT doc_id, {_NFC} AS norm, sha256({_NFC}) AS text_sha256, sha256({_NORM}) AS space_sha256 FROM documents")
def normalized_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalized_text(F.col("text")).alias("norm"), text.collapse_space(F.col("text")).alias("plain"))
    return d.select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"), F.sha2("plain", 256).alias("space_sha256"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_NFC} ORDER BY {h('priority', 'doc_id')}, doc_id) AS k FROM documents) WHERE k = 1")
def exact_text_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalized_text(F.col("text")), 256).alias("key"), hashing.salted_hash("priority", F.col("doc_id")).alias("p"))
    return selection.first_of_class(d, ["key"], ["p", "doc_id"]).select("doc_id")


@query("SELECT doc_id, len(t) AS n_tokens, CAST(ceil(len(t) / 256) AS INTEGER) AS n_chunks, len(t) - 256 * (CAST(ceil(len(t) / 256) AS BIGINT) - 1) AS last_size FROM (SELECT doc_id, list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> '') AS t FROM documents) WHERE len(t) > 0")
def token_windows(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", text.token_chunks(F.col("text")).alias("c")).where(F.size("c") > 0)
    total = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    return c.select("doc_id", total.alias("n_tokens"), F.size("c").alias("n_chunks"), F.size(F.element_at("c", -1)).cast("long").alias("last_size"))


@query(f"WITH t AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split(lower({_NORM}), ' '), lambda x: x <> '') AS w FROM conversations), g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM t), c AS (SELECT id, CAST(CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 64 AS INTEGER) AS slot, count(*) AS n FROM g GROUP BY 1, 2) SELECT id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM c")
def hashed_ngrams(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return text.hashed_ngrams(c, "id", "text", 64).withColumn("value", F.round("value", 6))


@query("SELECT page_id, regexp_extract(lower(url), '^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host FROM pages")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))


#: A small rule table: the suffixes that the test hosts need, with one wildcard and one exception.
SUFFIXES = [("com", "exact"), ("net", "exact"), ("org", "exact"), ("example.org", "wildcard"), ("ththth.example.org", "exception")]


@query(f"""WITH rules(suffix, kind) AS (VALUES {", ".join(f"('{s}', '{k}')" for s, k in SUFFIXES)}), hosts AS (SELECT DISTINCT regexp_extract(lower(url), '^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host FROM pages),
l AS (SELECT host, string_split(host, '.') AS l FROM hosts), p AS (SELECT host, l, unnest(range(0, len(l))) AS i FROM l), q AS (SELECT host, l, i, array_to_string(l[i + 1:], '.') AS suffix FROM p),
d AS (SELECT host, any_value(l) AS l, coalesce(max(CASE WHEN kind = 'exception' THEN len(l) - i - 1 END), max(CASE kind WHEN 'exact' THEN len(l) - i WHEN 'wildcard' THEN CASE WHEN i > 0 THEN len(l) - i + 1 END END)) AS d FROM q JOIN rules USING (suffix) GROUP BY host)
SELECT hosts.host, CASE WHEN d > 0 AND len(l) > d THEN array_to_string(l[len(l) - d:], '.') END AS domain FROM hosts LEFT JOIN d USING (host)""")
def registrable_domain(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(text.url_host(F.col("url")).alias("host")).distinct()
    return text.registrable_domains(hosts, spark.createDataFrame(SUFFIXES, "suffix string, kind string"))


@query()
def html_text(spark, sf_dir):
    body = text.html_body(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", body["text"].alias("text"), body["repairs"].alias("repairs"))


@query("SELECT o_orderkey, ['a', 'b'] AS x, CASE WHEN o_orderkey % 2 = 0 THEN ['a', 'b'] END AS tags, CASE WHEN o_orderkey % 2 = 0 THEN [1, 0, 1] END AS hot FROM orders".replace("['a', 'b'] AS x, ", ""))
def tag_encoding(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.parse_tags(F.when(F.col("o_orderkey") % 2 == 0, "<a><b>").otherwise("<a><a>")).alias("tags"))
    return o.select("o_orderkey", "tags", F.when(F.col("tags").isNotNull(), text.multi_hot(F.col("tags"), ["b", "c", "a"])).alias("hot"))


@query("SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, sum(n_chars) AS n_chars FROM documents")
def stream_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"), F.sum("n_chars").alias("n_chars"))


@query()
def table_digest(spark, sf_dir):
    return hashing.table_digest(table(spark, sf_dir, "documents"))


@query("SELECT c.conv_id AS event_id, CAST(t.ordinal AS INTEGER) AS ordinal, c2.text FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ordinal, text FROM conversations) t USING (conv_id), LATERAL (SELECT t.text) c2")
def event_articles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    articles = F.transform("a", lambda x: F.struct(x["role"].alias("title"), x["text"].alias("text"), F.lit(None).cast("string").alias("url")))
    clusters = c.select(F.col("conv_id").cast("string").alias("id"), F.lit("2020-01-01").alias("date"), F.lit("x").alias("collection"), articles.alias("articles"))
    return explode_clusters(clusters).select(F.col("event_id").cast("long").alias("event_id"), "ordinal", "text")


# Guards -------------------------------------------------------------------------------------------------------------


def _partitioned(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("record_id"), "text", "source", hashing.digest_partition(hashing.salted_hash("split", F.col("doc_id"))).alias("partition"))


@query(f"WITH r AS (SELECT doc_id AS record_id, {_NFC} AS k, {_PREC.format('(' + _PART.format(h('split', 'doc_id')) + ')')} AS prec FROM documents) SELECT record_id, 'exact_text' AS reason FROM (SELECT *, max(prec) OVER (PARTITION BY k) AS top FROM r) WHERE prec < top")
def exact_guard(spark, sf_dir):
    return guards.exact_text_guard(_partitioned(spark, sf_dir), text.normalized_text(F.col("text")))


@query(f"WITH r AS (SELECT conv_id * 1000 + turn AS record_id, conv_id * 1000 + turn - 1 AS parent, turn, {_PART.format(h('split', 'conv_id * 1000 + turn'))} AS part FROM conversations) SELECT c.record_id, 'heldout_parent' AS reason FROM r c WHERE c.part = 'train' AND c.turn > 0 AND c.parent IN (SELECT record_id FROM r WHERE part <> 'train')")
def parent_guard(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("record_id", F.col("conv_id") * 1000 + F.col("turn"))
    part = hashing.digest_partition(hashing.salted_hash("split", F.col("record_id")))
    return guards.parent_guard(c.select("record_id", part.alias("partition"), F.when(F.col("turn") > 0, F.col("record_id") - 1).otherwise(-1).alias("parent_id")))


_LINKS = "(SELECT doc_id AS a, doc_id + 7 AS b FROM documents)"


def _links(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 7).alias("b"))


@query(f"WITH r AS (SELECT doc_id, {_PREC.format('(' + _PART.format(h('split', 'doc_id')) + ')')} AS prec FROM documents) SELECT DISTINCT CASE WHEN x.prec < y.prec THEN l.a ELSE l.b END AS record_id, 'duplicate_link' AS reason FROM {_LINKS} l JOIN r x ON x.doc_id = l.a JOIN r y ON y.doc_id = l.b WHERE x.prec <> y.prec")
def link_guard(spark, sf_dir):
    return guards.link_guard(_partitioned(spark, sf_dir), _links(spark, sf_dir))[0]


@query(f"SELECT l.a, l.b FROM {_LINKS} l WHERE l.b NOT IN (SELECT doc_id FROM documents)")
def unresolved_links(spark, sf_dir):
    return guards.link_guard(_partitioned(spark, sf_dir), _links(spark, sf_dir))[1]


@query(f"WITH r AS (SELECT doc_id AS record_id, doc_id, text, {_PREC.format('(' + _PART.format(h('split', 'doc_id')) + ')')} AS prec FROM documents), e AS (SELECT record_id FROM (SELECT *, max(prec) OVER (PARTITION BY {_NFC}) AS top FROM r) WHERE prec < top), k AS (SELECT DISTINCT CASE WHEN x.prec < y.prec THEN l.a ELSE l.b END AS record_id FROM {_LINKS} l JOIN r x ON x.doc_id = l.a JOIN r y ON y.doc_id = l.b WHERE x.prec <> y.prec) SELECT record_id, list_sort(list(reason)) AS reasons FROM (SELECT record_id, 'exact_text' AS reason FROM e UNION ALL SELECT record_id, 'duplicate_link' FROM k) GROUP BY record_id")
def united_reasons(spark, sf_dir):
    return guards.unite_reasons(exact_guard(spark, sf_dir), link_guard(spark, sf_dir))


_SPLIT_U = _U + f", s AS (SELECT *, {_PART.format(h('split', 'id'))} AS part FROM u)"


def _sides(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("part", hashing.digest_partition(hashing.salted_hash("split", F.col("id"))))
    return rows.where("part = 'train'").drop("part"), rows.where("part <> 'train'").drop("part")


@query(f"WITH {_SPLIT_U} SELECT id, arg_min(w, w) AS witness, round(arg_min(score, w), 6) AS score FROM (SELECT a.id, b.id AS w, list_dot_product(a.z, b.z) AS score FROM s a JOIN s b ON a.part = 'train' AND b.part <> 'train' AND list_dot_product(a.z, b.z) > {TAU}) GROUP BY id")
def semantic_guard(spark, sf_dir):
    return guards.semantic_guard(*_sides(spark, sf_dir), TAU).withColumn("score", F.round("score", 6))


@query(f"WITH {_SPLIT_U} SELECT id, round(max(score), 6) AS top, min(CASE WHEN score > 0.25 THEN w END) AS w0, min(CASE WHEN score > 0.30 THEN w END) AS w1, min(CASE WHEN score > 0.35 THEN w END) AS w2 FROM (SELECT a.id, b.id AS w, list_dot_product(a.z, b.z) AS score FROM s a JOIN s b ON a.part = 'train' AND b.part <> 'train' AND list_dot_product(a.z, b.z) > 0.25) GROUP BY id")
def semantic_guard_grid(spark, sf_dir):
    return guards.semantic_guard_grid(*_sides(spark, sf_dir), [0.25, 0.30, 0.35]).withColumn("top", F.round("top", 6))


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND length(b.text) > 0")
def benchmark_containment(spark, sf_dir):
    return guards.benchmark_containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).distinct()


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type IS NULL THEN 'missing_type' WHEN value < 20 THEN 'low_value' WHEN user_id % 7 = 0 THEN 'held_user' ELSE 'kept' END AS reason FROM events) GROUP BY reason")
def exclusion_ledger(spark, sf_dir):
    kept, out = guards.split_ledger(table(spark, sf_dir, "events"), guards.first_reason((F.col("event_type").isNull(), "missing_type"), (F.col("value") < 20, "low_value"), (F.col("user_id") % 7 == 0, "held_user")))
    return kept.select(F.lit("kept").alias("reason")).union(out.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT 'finite' AS rule, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS n_violations FROM embeddings UNION ALL SELECT 'length', count(*) FILTER (len(embedding) <> 64) FROM embeddings UNION ALL SELECT 'label', count(*) FILTER (NOT label BETWEEN 0 AND 8) FROM embeddings")
def input_contract(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return guards.contract_violations(e, {"finite": F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), "length": F.size("embedding") == 64, "label": F.col("label").between(0, 8)})


@query(f"WITH d AS (SELECT doc_id, source, {_NFC} AS k FROM documents) SELECT doc_id FROM d WHERE source IS DISTINCT FROM 'src1' AND (k IS NULL OR k NOT IN (SELECT k FROM d WHERE source = 'src1' AND k IS NOT NULL))")
def text_semi_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(text.normalized_text(F.col("text")), 256).alias("key"))
    return guards.text_guard(d.where(~F.col("source").eqNullSafe(F.lit("src1"))), d.where("source = 'src1'"), "key").select("doc_id")


# Blocker graph and selection ----------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT rid, bid, round(score, 6) AS score FROM edges")
def blocker_edges(spark, sf_dir):
    return edge_rows(spark, sf_dir)[1].select("rid", "bid", F.round("score", 6).alias("score"))


@query(f"WITH {_E} SELECT id FROM u WHERE id NOT IN (SELECT rid FROM edges)")
def initial_selection(spark, sf_dir):
    return selection.initial_selection(*edge_rows(spark, sf_dir)).select("id")


@query(f"WITH {_E}, c AS (SELECT u.id, count(rid) AS n FROM u LEFT JOIN edges ON u.id = rid GROUP BY u.id) SELECT n AS n_blockers, count(*) AS n_records FROM c GROUP BY n")
def blocker_histogram(spark, sf_dir):
    rows, edges = edge_rows(spark, sf_dir)
    return structure.blocker_histogram(edges, rows)


@query(f"WITH {_E} SELECT rid, count(DISTINCT bown) AS n_owners, count(*) AS n_blockers FROM edges GROUP BY rid")
def distinct_owners(spark, sf_dir):
    return structure.distinct_owners(edge_rows(spark, sf_dir)[1])


_AFTER = f"SELECT id FROM u WHERE unit <> {UNIT} AND id NOT IN (SELECT rid FROM edges WHERE bown <> {UNIT})"


@query(f"WITH {_E} {_AFTER}")
def selection_after_source_delete(spark, sf_dir):
    return selection.selection_after(*edge_rows(spark, sf_dir), units(spark, UNIT)).select("id")


@query(f"WITH {_E} {_AFTER} AND id IN (SELECT rid FROM edges)")
def admissions_after_source_delete(spark, sf_dir):
    return selection.admissions_after(*written_edges(spark, sf_dir), units(spark, UNIT)).select("id")


@query(f"WITH {_E} SELECT id FROM u WHERE unit <> {UNIT} AND id NOT IN (SELECT rid FROM edges)")
def frozen_selection(spark, sf_dir):
    return selection.frozen_selection(*edge_rows(spark, sf_dir), units(spark, UNIT)).select("id")


@query(f"WITH {_E} SELECT id FROM u WHERE id NOT IN (SELECT rid FROM edges GROUP BY rid HAVING count(DISTINCT bown) > {HORIZON} OR max(CASE WHEN bown = rown THEN 1 ELSE 0 END) = 1)")
def horizon_eligible(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    return selection.eligible(rows, edges, HORIZON).select("id")


_RANKED = _E + ", o AS (SELECT id, row_number() OVER (ORDER BY p, id) AS k FROM u), b AS (SELECT x.k AS k, list(y.k) AS bs FROM edges JOIN o x ON x.id = rid JOIN o y ON y.id = bid GROUP BY x.k), f AS (SELECT o.id, o.k, coalesce(bs, []) AS bs FROM o LEFT JOIN b USING (k))"


@query("WITH RECURSIVE " + _RANKED + ", g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS chosen UNION ALL SELECT f.k, CASE WHEN len(list_intersect(f.bs, g.chosen)) = 0 THEN list_append(g.chosen, f.k) ELSE g.chosen END FROM g JOIN f ON f.k = g.k + 1) SELECT id FROM f WHERE list_contains((SELECT arg_max(chosen, k) FROM g), f.k)")
def greedy_selection(spark, sf_dir):
    return selection.greedy_selection(*edge_rows(spark, sf_dir)).select("id")


@query(f"WITH {_U}, m AS (SELECT unit, i, avg(z[i]) AS c FROM u, range(1, 65) t(i) GROUP BY unit, i), s AS (SELECT id, u.unit, z, round(sum(z[i] * c), 9) AS sim FROM u JOIN m ON u.unit = m.unit GROUP BY id, u.unit, z), o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY sim DESC, id) AS k FROM s) SELECT a.id, round(max(list_dot_product(a.z, b.z)), 6) AS top FROM o a JOIN o b ON a.unit = b.unit AND b.k < a.k AND list_dot_product(a.z, b.z) > 0.25 GROUP BY a.id")
def cluster_suppression(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return graph.cluster_suppression(rows.withColumn("cluster", F.col("unit")), "cluster", 0.25).withColumn("top", F.round("top", 6))


_PLANES = vectors.planes(64, 4, 6)

def _signature_sql(planes: list[list[int]]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN list_dot_product(z, CAST([{', '.join(map(str, p))}] AS DOUBLE[])) >= 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(planes)) + " AS BIGINT)"


_CAND = _U + ", sig AS (" + " UNION ALL ".join(f"SELECT id, {t} AS tab, {_signature_sql(p)} AS sig FROM u" for t, p in enumerate(_PLANES)) + "), cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM sig x JOIN sig y ON x.tab = y.tab AND x.sig = y.sig AND x.id < y.id)"


@query(f"WITH {_CAND} SELECT a, b FROM cand")
def lsh_candidates(spark, sf_dir):
    return graph.signature_candidates(vector_rows(spark, sf_dir), _PLANES)


@query(f"""WITH {_E}, {_CAND.split(_U + ", ")[1]}, f AS (SELECT e.rid, count(*) AS n, count(c.a) AS k FROM edges e LEFT JOIN cand c ON c.a = least(e.rid, e.bid) AND c.b = greatest(e.rid, e.bid) GROUP BY e.rid), x AS (SELECT u.id, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM u LEFT JOIN f ON f.rid = u.id)
SELECT CAST(sum(n) AS BIGINT) AS n_edges, CAST(sum(k) AS BIGINT) AS n_found, sum(k) / sum(n) AS recall, count(*) FILTER (n = k) AS complete_records, count(*) FILTER (n = k) / count(*) AS complete_rate, count(*) FILTER (n = k AND n > 0) / count(*) FILTER (n > 0) AS nonempty_complete_rate, count(*) FILTER (n > 0 AND k = 0) AS selection_difference FROM x""")
def lsh_recall(spark, sf_dir):
    rows, edges = edge_rows(spark, sf_dir)
    return graph.retrieval_audit(rows, graph.signature_hits(edges, rows, _PLANES, "rid", "bid"))


@query(f"WITH {_E}, s AS (SELECT * FROM u WHERE id NOT IN (SELECT rid FROM edges)), x AS (SELECT * FROM u WHERE id IN (SELECT rid FROM edges)) SELECT lid, rid, round(score, 6) AS score FROM (SELECT x.id AS lid, s.id AS rid, list_dot_product(x.z, s.z) AS score, row_number() OVER (PARTITION BY x.id ORDER BY list_dot_product(x.z, s.z) DESC, s.id) AS k FROM x, s) WHERE k = 1")
def nearest_selected(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    chosen = selection.initial_selection(rows, edges)
    return graph.nearest(rows.join(chosen.select("id"), "id", "left_anti"), chosen).withColumn("score", F.round("score", 6))


@query(f"WITH {_E}, a AS (SELECT id FROM u WHERE id NOT IN (SELECT rid FROM edges)), b AS ({_AFTER}) SELECT (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS only_b, (SELECT count(*) FROM a JOIN b USING (id)) AS common, round(1 - (SELECT count(*) FROM a JOIN b USING (id)) / greatest((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 9) AS total_variation")
def selection_difference(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    return evaluation.selection_distance(selection.initial_selection(rows, edges), selection.selection_after(rows, edges, units(spark, UNIT))).withColumn("total_variation", F.round("total_variation", 9))


@query(f"WITH {_U}, p AS (SELECT list_dot_product(l.z, r.z) AS score FROM u l JOIN u r ON l.id < r.id) SELECT least(19, greatest(0, CAST(floor(round((score + 1) * 10, 9)) AS INTEGER))) AS bin, count(*) AS n_pairs FROM p GROUP BY 1")
def score_bins(spark, sf_dir):
    return graph.score_histogram(vector_rows(spark, sf_dir))


@query(f"WITH {_U}, p AS (SELECT list_dot_product(l.z, r.z) AS score FROM u l JOIN u r ON l.id < r.id) SELECT cut, (SELECT count(*) FROM p WHERE score > cut) AS n_pairs FROM (SELECT CAST(unnest({CUTS}) AS DOUBLE) AS cut)")
def tail_census(spark, sf_dir):
    return graph.tail_census(vector_rows(spark, sf_dir), CUTS)


@query(f"WITH {_E} SELECT CASE WHEN (score - {TAU}) / (1 - {TAU}) < 0.25 THEN 0 WHEN (score - {TAU}) / (1 - {TAU}) < 0.5 THEN 1 WHEN (score - {TAU}) / (1 - {TAU}) < 0.75 THEN 2 ELSE 3 END AS band, CASE WHEN rown = bown THEN 'equal' ELSE 'unequal' END AS relation, count(*) AS n FROM edges GROUP BY 1, 2")
def similarity_bands(spark, sf_dir):
    e = edge_rows(spark, sf_dir)[1]
    return e.groupBy(vectors.similarity_band(F.col("score"), TAU).alias("band"), vectors.label_relation(F.col("rown"), F.col("bown")).alias("relation")).agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT round(min(abs(score - {TAU})), 6) AS margin, round(max(score), 6) AS top FROM edges")
def threshold_margin(spark, sf_dir):
    return edge_rows(spark, sf_dir)[1].agg(F.round(F.min(F.abs(F.col("score") - TAU)), 6).alias("margin"), F.round(F.max("score"), 6).alias("top"))


# Structure and polynomials ------------------------------------------------------------------------------------------

_POLY = _T + ", ends AS (SELECT tail AS key, 1 AS s FROM terms WHERE NOT list_contains(tail, own) UNION ALL SELECT list_sort(list_append(tail, own)), -1 FROM terms WHERE NOT list_contains(tail, own)), poly AS (SELECT key, CAST(sum(s) AS BIGINT) AS coefficient FROM ends GROUP BY key HAVING sum(s) <> 0)"


def _terms(spark, sf_dir):
    return structure.terms(*edge_rows(spark, sf_dir))


def _named(polynomial: DataFrame) -> DataFrame:
    return polynomial.withColumn("key", structure.key_text(F.col("key")))


@query(f"WITH {_POLY} SELECT array_to_string(key, ',') AS key, coefficient FROM poly")
def count_polynomial_by_source(spark, sf_dir):
    return _named(structure.count_polynomial(_terms(spark, sf_dir)))


@query(f"WITH {_POLY} SELECT array_to_string(k, ',') AS key, CAST(sum(coefficient) AS BIGINT) AS coefficient FROM (SELECT list_filter(key, lambda x: x <> {UNIT}) AS k, coefficient FROM poly) GROUP BY k HAVING sum(coefficient) <> 0")
def polynomial_after_delete(spark, sf_dir):
    return _named(structure.substitute(structure.count_polynomial(_terms(spark, sf_dir)), [UNIT]))


@query(f"WITH {_POLY} SELECT CAST(coalesce(sum(coefficient), 0) AS BIGINT) AS n_selected FROM poly WHERE len(list_filter(key, lambda x: x <> {UNIT})) = 0")
def polynomial_query(spark, sf_dir):
    return structure.evaluate(structure.count_polynomial(_terms(spark, sf_dir)), [UNIT])


@query(f"WITH {_T}, ends AS (SELECT id, tail AS key, 1 AS s FROM terms WHERE NOT list_contains(tail, own) AND len(tail) <= {HORIZON} UNION ALL SELECT id, list_sort(list_append(tail, own)), -1 FROM terms WHERE NOT list_contains(tail, own) AND len(tail) < {HORIZON}) SELECT array_to_string(key, ',') AS key, id, CAST(sum(s) AS BIGINT) AS coefficient FROM ends GROUP BY key, id HAVING sum(s) <> 0")
def membership_polynomial(spark, sf_dir):
    return _named(structure.membership_polynomial(_terms(spark, sf_dir), HORIZON))


_CENSUS = _T + f""", usable AS (SELECT * FROM terms WHERE NOT list_contains(tail, own) AND len(tail) <= {HORIZON}),
links AS (SELECT DISTINCT 'k:' || array_to_string(tail, ',') AS a, CASE WHEN len(tail) < {HORIZON} THEN 'k:' || array_to_string(list_sort(list_append(tail, own)), ',') ELSE 'ground' END AS b FROM usable),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a), lab AS (SELECT x, min(y) AS label FROM reach GROUP BY x)"""


@query(f"WITH RECURSIVE {_CENSUS} SELECT (SELECT count(*) FROM terms WHERE list_contains(tail, own)) AS own_blocked, (SELECT count(*) FROM usable) AS eligible, (SELECT count(*) FROM usable WHERE len(tail) < {HORIZON}) AS interior, (SELECT count(*) FROM usable WHERE len(tail) = {HORIZON}) AS boundary, (SELECT count(*) FROM lab WHERE x <> 'ground') AS n_keys, (SELECT count(DISTINCT label) FROM lab WHERE label NOT IN (SELECT label FROM lab WHERE x = 'ground')) AS ungrounded_components, (SELECT count(*) FROM lab WHERE x <> 'ground') - (SELECT count(DISTINCT label) FROM lab WHERE label NOT IN (SELECT label FROM lab WHERE x = 'ground')) AS query_rank")
def incidence_census(spark, sf_dir):
    return structure.incidence_census(_terms(spark, sf_dir), HORIZON)


def _profile_sql(horizon: int) -> str:
    census = _CENSUS.split(", usable AS")[1].replace(f"len(tail) <= {HORIZON}", f"len(tail) <= {horizon}").replace(f"len(tail) < {HORIZON}", f"len(tail) < {horizon}")
    for name in ("usable", "links", "both_ways", "reach", "lab"):
        census = re.sub(rf"\b{name}\b", f"{name}{horizon}", census)
    return f", usable{horizon} AS{census}"


@query(f"WITH RECURSIVE {_T}{''.join(map(_profile_sql, range(4)))} " + " UNION ALL ".join(f"SELECT {h_} AS horizon, (SELECT count(*) FROM lab{h_} WHERE x <> 'ground') - (SELECT count(DISTINCT label) FROM lab{h_} WHERE label NOT IN (SELECT label FROM lab{h_} WHERE x = 'ground')) AS query_rank" for h_ in range(4)))
def rank_profile(spark, sf_dir):
    return structure.rank_profile(_terms(spark, sf_dir), [0, 1, 2, 3])


@query(f"WITH {_T}, g AS (SELECT len(tail) AS b, count(*) AS n FROM terms WHERE len(tail) > 0 AND NOT list_contains(tail, own) GROUP BY 1) SELECT CAST(b AS INTEGER) AS n_blockers, n AS n_records, CASE WHEN b > 4 THEN 0.0 ELSE round(list_product(list_transform(range(0, b), lambda i: greatest(0.0, (4.0 - i) / (10.0 - i)))) * (10.0 - 4.0) / (10.0 - b), 9) END AS probability FROM g")
def expected_admissions(spark, sf_dir):
    return structure.expected_admissions(_terms(spark, sf_dir), 10, 4).withColumn("probability", F.round("probability", 9))


@query(f"WITH {_T} SELECT tail[1] AS unit, count(*) AS n_admitted FROM terms WHERE len(tail) = 1 AND NOT list_contains(tail, own) GROUP BY 1")
def source_singletons(spark, sf_dir):
    return structure.source_singletons(_terms(spark, sf_dir))


@query(f"WITH RECURSIVE {_E}, both_ways AS (SELECT rid AS a, bid AS b FROM edges UNION SELECT bid, rid FROM edges), reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a) SELECT x AS node, min(y) AS label FROM reach GROUP BY x")
def graph_components(spark, sf_dir):
    return graph.components(edge_rows(spark, sf_dir)[1], "rid", "bid")


# Prefixes, calendars, workloads -------------------------------------------------------------------------------------


@query(f"WITH s AS (SELECT source, count(*) AS n, {h('panel', 'source')} AS h FROM documents GROUP BY source), o AS (SELECT *, CAST(sum(n) OVER (ORDER BY h, source) AS BIGINT) AS upto FROM s) SELECT source, n, upto FROM o WHERE upto - n < 400")
def whole_source_prefix(spark, sf_dir):
    return windows.whole_group_prefix(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", 400, "panel")


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), t AS (SELECT *, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS upto FROM d), o AS (SELECT *, CAST(sum(CASE WHEN upto > 2000 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS BIGINT) AS c FROM t) SELECT day, n, upto, CASE WHEN c = 0 THEN 'applied' WHEN c = 1 THEN 'blocked' ELSE 'waiting' END AS status FROM o")
def chronological_batches(spark, sf_dir):
    return windows.chronological_batches(table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), 2000)


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT *, substr(month, 6) <> '08' AS complete FROM m), x AS (SELECT *, min(CASE WHEN complete AND n >= 100000 THEN month END) OVER () AS alone, min(CASE WHEN NOT complete THEN month END) OVER () AS gap, sum(n) OVER (ORDER BY month) AS upto FROM f) SELECT month, n, CASE WHEN alone IS NOT NULL THEN 'earliest_complete_month' ELSE 'complete_prefix' END AS rule FROM x WHERE CASE WHEN alone IS NOT NULL THEN month = alone ELSE (gap IS NULL OR month < gap) AND upto - n < 100000 END")
def calendar_prefix(spark, sf_dir):
    m = windows.month_counts(table(spark, sf_dir, "orders"), "o_orderdate").withColumn("complete", F.substring("month", 6, 2) != "08")
    return windows.calendar_prefix(m, 100_000)


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def month_counts(spark, sf_dir):
    return windows.month_counts(table(spark, sf_dir, "events"), "ts")


@query(f"SELECT source, CAST((row_number() OVER (ORDER BY {h('folds', 'source')}, source) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM documents)")
def source_folds(spark, sf_dir):
    return windows.source_folds(table(spark, sf_dir, "documents").select("source").distinct(), "source", 5, "folds")


@query("SELECT CAST(q AS DOUBLE) AS share, CAST(CASE q WHEN 0.25 THEN (SELECT percentile_disc(0.25) WITHIN GROUP (ORDER BY n) FROM s) WHEN 0.5 THEN (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY n) FROM s) ELSE (SELECT percentile_disc(0.9) WITHIN GROUP (ORDER BY n) FROM s) END AS BIGINT) AS value FROM (SELECT unnest([0.25, 0.5, 0.9]) AS q), (SELECT 1)".replace("FROM s)", "FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))"))
def size_quantiles(spark, sf_dir):
    return windows.size_quantiles(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n", [0.25, 0.5, 0.9])


@query("WITH s AS (SELECT source, sum(n_chars) AS w FROM documents GROUP BY source), o AS (SELECT *, sum(w) OVER (ORDER BY source) - w AS b, sum(w) OVER () AS t FROM s) SELECT source, CAST(w AS BIGINT) AS w, CAST(least(3, floor(b * 4 / t)) AS INTEGER) AS shard FROM o")
def balanced_ranges(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("w"))
    return windows.balanced_ranges(s, "source", "w", 4)


@query(f"WITH w AS (SELECT lang, unnest(list_distinct(list_filter(string_split({_NORM}, ' '), lambda x: length(x) > 3))) AS tag FROM documents) SELECT tag, count(*) AS n FROM w GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def top_vocabulary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(F.split(text.collapse_space(F.col("text")), " "), lambda x: F.length(x) > 3)).alias("tags"))
    return evaluation.top_vocabulary(d, "doc_id", "tags", 20)


_PATHS = f"""paths AS (SELECT trajectory_id, pos, unit FROM (SELECT t AS trajectory_id, unit, row_number() OVER (PARTITION BY t ORDER BY {h("paths", "'S|' || t || '|' || unit")}, unit) AS pos FROM (SELECT DISTINCT unit FROM u), range(6) r(t)) WHERE pos <= 8),
at_k AS (SELECT trajectory_id, k, unit FROM paths, (SELECT unnest([1, 2, 4, 8]) AS k) WHERE pos <= k)"""


def _paths(spark, sf_dir, rows):
    return workload.trajectories(rows.select("unit").distinct(), "S", 6, 8, "paths")


@query(f"""WITH {_T}, {_PATHS}, d AS (SELECT trajectory_id, k, list(unit) AS gone FROM at_k GROUP BY 1, 2),
x AS (SELECT trajectory_id, k, count(*) FILTER (list_contains(gone, own)) AS deleted_records, count(*) FILTER (list_contains(gone, own) AND len(tail) = 0) AS lost, count(*) FILTER (len(tail) > 0 AND NOT list_contains(gone, own) AND list_has_all(gone, tail)) AS admitted FROM d, terms GROUP BY 1, 2)
SELECT CAST(trajectory_id AS INTEGER) AS trajectory_id, k, deleted_records, lost, admitted, deleted_records - lag(deleted_records, 1, 0) OVER (PARTITION BY trajectory_id ORDER BY k) AS new_deletions FROM x""")
def trajectory_observations(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    return workload.observations(_paths(spark, sf_dir, rows), rows, edges, workload.clipped_checkpoints([1, 2, 4, 8, 32], 8))


@query(f"WITH {_E} SELECT 'R' AS arm, CAST(id AS VARCHAR) AS member FROM u UNION ALL (SELECT DISTINCT 'S', CAST(unit AS VARCHAR) FROM u WHERE unit >= 2) UNION ALL SELECT 'U', CAST(id AS VARCHAR) FROM u WHERE id IN (SELECT rid FROM edges)")
def arm_request_frames(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    return workload.arm_frames(rows, edges, F.col("unit") >= 2)


@query(f"""WITH {_U}, {_PATHS}, vol AS (SELECT a.trajectory_id, a.k, count(*) AS deleted_records FROM at_k a JOIN u USING (unit) WHERE a.k <= 2 GROUP BY 1, 2), o AS (SELECT t AS trajectory_id, id, row_number() OVER (PARTITION BY t ORDER BY {h("control", "t || '|' || id")}) AS pos FROM u, range(6) r(t)) SELECT CAST(o.trajectory_id AS INTEGER) AS trajectory_id, vol.k, o.id FROM o JOIN vol USING (trajectory_id) WHERE pos <= deleted_records""")
def volume_matched_control(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    volumes = workload.observations(_paths(spark, sf_dir, rows), rows, edges, [1, 2]).select("trajectory_id", "k", "deleted_records")
    return workload.volume_matched(rows, volumes, "control")


@query(f"WITH {_E}, c AS (SELECT rid FROM (SELECT DISTINCT rid FROM edges) ORDER BY {h('stress', 'rid')} LIMIT 64), s AS (SELECT DISTINCT c.rid AS candidate, bid FROM c JOIN edges USING (rid)), need AS (SELECT rid, count(DISTINCT bid) AS n FROM edges GROUP BY rid), have AS (SELECT candidate, e.rid, count(*) AS m FROM s JOIN (SELECT DISTINCT rid, bid FROM edges) e USING (bid) GROUP BY 1, 2) SELECT candidate, count(*) AS n_admitted FROM have JOIN need USING (rid) WHERE m = n AND NOT EXISTS (SELECT 1 FROM s WHERE s.candidate = have.candidate AND s.bid = have.rid) GROUP BY candidate")
def stress_candidates(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    return workload.stress_candidates(edges, rows, 64, "stress")


@query(f"WITH m AS (SELECT source, CAST(count(*) AS BIGINT) AS mass FROM documents GROUP BY source), k AS (SELECT *, row_number() OVER (ORDER BY -ln(({n('pps', 'source', 12)} + 0.5) / CAST(281474976710656 AS DOUBLE)) / mass, source) AS pos FROM m) SELECT source, mass, CAST(pos AS INTEGER) AS pos FROM k WHERE pos <= 8")
def pps_sources(spark, sf_dir):
    return workload.successive_sources(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("mass")), "pps", 8)


_BIN = f"least(19, greatest(0, CAST(floor(round((score + 1) * 10, 9)) AS INTEGER)))"
_PAIRS = _U + f", p AS (SELECT l.id AS a, r.id AS b, list_dot_product(l.z, r.z) AS score FROM u l JOIN u r ON l.id < r.id), q AS (SELECT a, b, a || '|' || b AS pair_id, {_BIN} AS bin FROM p)"


def _pairs(spark, sf_dir, tau):
    p = graph.theta_pairs(vector_rows(spark, sf_dir), tau)
    return p.select(F.least("lid", "rid").alias("a"), F.greatest("lid", "rid").alias("b"), "score").withColumn("pair_id", F.concat_ws("|", "a", "b"))


@query(f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {h('bins', 'pair_id')}) AS draw, count(*) OVER (PARTITION BY bin) AS size FROM q) SELECT pair_id, bin, least(30, size) AS num, size AS den FROM k WHERE draw <= 30")
def stratified_pair_sample(spark, sf_dir):
    return graph.binned_pair_sample(vector_rows(spark, sf_dir), 30, "bins")


@query(f"WITH {_E}, q AS (SELECT least(rid, bid) || '|' || greatest(rid, bid) AS pair_id FROM edges) SELECT pair_id FROM q ORDER BY {h('validation', 'pair_id')} LIMIT 200")
def threshold_pair_sample(spark, sf_dir):
    return workload.simple_sample(_pairs(spark, sf_dir, TAU).select("pair_id"), F.col("pair_id"), 200, "validation")


@query(f"WITH {_CAND}, e AS (SELECT l.id AS a, r.id AS b FROM u l JOIN u r ON l.id < r.id AND list_dot_product(l.z, r.z) > {TAU}) SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.a = e.a AND c.b = e.b) ORDER BY {h('missed', 'a || chr(124) || b')} LIMIT 50")
def missed_pair_sample(spark, sf_dir):
    hits = graph.signature_hits(_pairs(spark, sf_dir, TAU).select("a", "b"), vector_rows(spark, sf_dir), _PLANES)
    return workload.missed_pairs(hits, 50, "missed")


@query(f"WITH {_E}, q AS (SELECT least(rid, bid) AS a, greatest(rid, bid) AS b FROM edges), g AS (SELECT a || '|' || b AS pair_id, a, b, CAST(r AS INTEGER) AS rater FROM q, range(3) t(r)) SELECT pair_id, rater, CASE WHEN {n('sides', chr(39).join(['pair_id || ', '|', ' || rater']))} % 2 = 1 THEN b ELSE a END AS first, CASE WHEN {n('sides', chr(39).join(['pair_id || ', '|', ' || rater']))} % 2 = 1 THEN a ELSE b END AS second FROM g")
def blinded_assignments(spark, sf_dir):
    return workload.assignments(_pairs(spark, sf_dir, TAU).select("pair_id", "a", "b"), 3, "sides")


@query(f"WITH {_E}, q AS (SELECT least(rid, bid) AS a, greatest(rid, bid) AS b FROM edges) SELECT a || '|' || b AS pair_id, b AS a, a AS b FROM q ORDER BY {h('swap', 'a || chr(124) || b')} LIMIT (SELECT CAST(ceil(count(*) / 10) AS BIGINT) FROM q)")
def swap_diagnostics(spark, sf_dir):
    return workload.swapped_share(_pairs(spark, sf_dir, TAU).select("pair_id", "a", "b"), 0.1, "swap")


@query("WITH c AS (SELECT doc_id, 'source|' || source AS stratum FROM documents UNION ALL SELECT doc_id, 'lang|' || lang FROM documents UNION ALL SELECT doc_id, 'both|' || source || '|' || lang FROM documents), k AS (SELECT * FROM c WHERE stratum IS NOT NULL), z AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS m, row_number() OVER (PARTITION BY stratum ORDER BY " + h("audit", "doc_id") + ") AS k FROM k) SELECT doc_id, round(CASE WHEN max(CASE WHEN m <= 2 THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 1 - exp(sum(ln(1 - least(2.0 / m, 1 - 1e-12)))) END, 9) AS probability FROM z GROUP BY doc_id HAVING min(k) <= 2")
def admission_audit_sample(spark, sf_dir):
    """Two documents of each source, of each language and of each pair of both, and the chance that any of them takes a document."""
    d = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.concat_ws("|", F.lit(name), *cols) for name, cols in (("source", ["source"]), ("lang", ["lang"]), ("both", ["source", "lang"]))])
    known = F.array(F.col("source").isNotNull(), F.col("lang").isNotNull(), F.col("source").isNotNull() & F.col("lang").isNotNull())
    cells = d.select("doc_id", F.explode(F.arrays_zip(kinds.alias("stratum"), known.alias("known"))).alias("x")).where("x.known").select("doc_id", "x.stratum")
    return workload.audit_sample(cells, ["stratum"], 2, "doc_id", "audit").withColumn("probability", F.round("probability", 9))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations) WHERE upto <= 400")
def context_budget(spark, sf_dir):
    return workload.context_budget(table(spark, sf_dir, "conversations").withColumn("size", F.length("text")), "conv_id", "turn", "size", 400).select("conv_id", "turn")

#: How often a unit is in a replicate: steps of the Poisson distribution at or below the hash.
def _draws(salt: str, rep: str, unit: str) -> str:
    u = n(salt, f"{rep} || '|' || {unit}") + " / 4294967296.0"
    return "(" + " + ".join(f"CASE WHEN {u} >= CAST({x!r} AS DOUBLE) THEN 1 ELSE 0 END" for x in hashing.POISSON_STEPS) + ")"


_ENDS = "round(quantile_cont({x}, 0.025), 9) AS low, round(quantile_cont({x}, 0.975), 9) AS high"


@query(f"""WITH {_T}, {_PATHS}, d AS (SELECT trajectory_id, list(unit) AS gone FROM paths GROUP BY 1), a AS (SELECT trajectory_id, count(*) FILTER (len(tail) > 0 AND NOT list_contains(gone, own) AND list_has_all(gone, tail)) AS s FROM d, terms GROUP BY 1),
r AS (SELECT rep, sum(w * s) / nullif(sum(w), 0) AS m FROM (SELECT rep, s, {_draws('bootstrap', 'rep', 'trajectory_id')} AS w FROM a, range(1, 501) r(rep)) GROUP BY rep) SELECT {_ENDS.format(x='m')}, round((SELECT avg(s) FROM a), 9) AS mean FROM r""")
def path_bootstrap(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    obs = workload.observations(_paths(spark, sf_dir, rows), rows, edges, [8])
    found = workload.bootstrap(obs.withColumn("admitted", F.col("admitted").cast("double")), "trajectory_id", "admitted", 500, "bootstrap")
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


# Ratings, metrics, registries ---------------------------------------------------------------------------------------

_RATE = f"CASE {n('rate', chr(39).join(['pair_id || ', '|', ' || rater']))} % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsure' END"
_RATINGS = _E + f", q AS (SELECT least(rid, bid) || '|' || greatest(rid, bid) AS pair_id, score FROM edges), ratings AS (SELECT pair_id, score, CAST(r AS INTEGER) AS rater, {_RATE.replace('rater', 'r')} AS label FROM q, range(3) t(r))"


def _ratings(spark, sf_dir):
    g = _pairs(spark, sf_dir, TAU).withColumn("rater", F.explode(F.sequence(F.lit(0), F.lit(2))))
    draw = F.pmod(hashing.hash_number("rate", F.concat_ws("|", "pair_id", "rater")), F.lit(3))
    return g.select("pair_id", "score", "rater", F.when(draw == 0, "yes").when(draw == 1, "no").otherwise("unsure").alias("label"))


@query(f"WITH {_RATINGS}, c AS (SELECT pair_id, label, count(*) AS n FROM ratings GROUP BY 1, 2) SELECT pair_id, coalesce(max(CASE WHEN n >= 2 THEN label END), 'no_majority') AS label FROM c GROUP BY pair_id")
def majority_labels(spark, sf_dir):
    return evaluation.majority_labels(_ratings(spark, sf_dir), "pair_id", "label")


@query(f"WITH {_RATINGS} SELECT pair_id, CASE WHEN count(*) FILTER (label = 'yes') = 2 THEN 1 ELSE 0 END AS lower, CASE WHEN count(*) FILTER (label = 'no') = 0 THEN 1 ELSE 0 END AS upper FROM ratings WHERE rater < 2 GROUP BY pair_id")
def conservative_labels(spark, sf_dir):
    return evaluation.conservative_labels(_ratings(spark, sf_dir).where("rater < 2"), "pair_id", "label")


_RATED = _RATINGS + ", rated AS (SELECT pair_id, any_value(score) AS score, CASE WHEN count(*) FILTER (label = 'yes') >= 2 THEN 1 ELSE 0 END AS label, 1.0 + CAST(substr(pair_id, 1, 1) AS INTEGER) AS weight FROM ratings GROUP BY pair_id)"


def _rated(spark, sf_dir):
    return _ratings(spark, sf_dir).groupBy("pair_id").agg(F.first("score").alias("score"), (F.sum((F.col("label") == "yes").cast("int")) >= 2).cast("int").alias("label")).withColumn("weight", 1.0 + F.substring("pair_id", 1, 1).cast("int"))


@query(f"WITH {_RATED} SELECT cut, round((SELECT sum(weight * label) / sum(weight) FROM rated WHERE score > cut), 9) AS precision, round((SELECT sum(weight) * sum(weight) / sum(weight * weight) FROM rated WHERE score > cut), 6) AS effective_n FROM (SELECT CAST(unnest([0.30, 0.32, 0.35]) AS DOUBLE) AS cut)")
def weighted_precision_grid(spark, sf_dir):
    return evaluation.precision_by_cut(_rated(spark, sf_dir), [0.30, 0.32, 0.35]).select("cut", F.round("precision", 9).alias("precision"), F.round("effective_n", 6).alias("effective_n"))


@query(f"WITH {_RATED} SELECT min(CASE WHEN p >= 0.25 THEN cut END) AS threshold FROM (SELECT cut, (SELECT sum(weight * label) / sum(weight) FROM rated WHERE score > cut) AS p FROM (SELECT CAST(unnest([0.30, 0.32, 0.35]) AS DOUBLE) AS cut))")
def threshold_selection(spark, sf_dir):
    return evaluation.select_threshold(evaluation.precision_by_cut(_rated(spark, sf_dir), [0.30, 0.32, 0.35]), 0.25)


@query(f"WITH {_RATED}, s AS (SELECT 1.0 / weight AS probability, CASE WHEN label = 1 THEN 1.0 WHEN weight > 4 THEN NULL ELSE 0.0 END AS outcome FROM rated), t AS (SELECT count(*) AS sampled, count(outcome) AS observed, sum(1 / probability) AS w, sum(CASE WHEN outcome IS NOT NULL THEN 1 / probability END) AS kw, sum(outcome / probability) AS yes FROM s) SELECT sampled, observed, CASE WHEN sampled = observed THEN round(yes / 10000.0, 6) END AS ht, CASE WHEN sampled = observed THEN round(yes / w, 6) END AS hajek, round(yes / kw, 6) AS observed_only, round(yes / 10000.0, 6) AS ht_low, round((yes + w - kw) / 10000.0, 6) AS ht_high, round(yes / w, 6) AS hajek_low, round((yes + w - kw) / w, 6) AS hajek_high FROM t")
def weighted_prevalence(spark, sf_dir):
    s = _rated(spark, sf_dir).select((1 / F.col("weight")).alias("probability"), F.when(F.col("label") == 1, 1.0).when(F.col("weight") > 4, None).otherwise(0.0).alias("outcome"))
    r = evaluation.weighted_prevalence(s, 10_000)
    return r.select("sampled", "observed", *[F.round(c, 6).alias(c) for c in r.columns[2:]])


@query(f"WITH {_RATINGS}, c AS (SELECT pair_id, label, count(*) AS n, 1.0 + CAST(substr(pair_id, 1, 1) AS INTEGER) AS w FROM ratings GROUP BY pair_id, label), t AS (SELECT pair_id, any_value(w) AS w, sum(n * (n - 1)) AS agree FROM c GROUP BY pair_id), a AS (SELECT count(*) AS units, sum(w) AS sw, sum(w * agree) / 6 / sum(w) AS agreement FROM t), m AS (SELECT label, sum(w * n / 3) AS m FROM c GROUP BY label), x AS (SELECT sum(m * m) AS mm FROM m) SELECT units, round(agreement, 6) AS agreement, round((agreement - mm / (sw * sw)) / (1 - mm / (sw * sw)), 6) AS kappa FROM a, x")
def rater_agreement(spark, sf_dir):
    r = _ratings(spark, sf_dir).withColumn("weight", 1.0 + F.substring("pair_id", 1, 1).cast("int"))
    return evaluation.weighted_agreement(r, "pair_id", "label").select("units", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(f"WITH {_RATINGS} SELECT rater, count(*) FILTER (label = 'yes') AS yes, count(*) FILTER (label = 'no') AS no, count(*) FILTER (label = 'unsure') AS unsure FROM ratings GROUP BY rater")
def rating_tallies(spark, sf_dir):
    r = _ratings(spark, sf_dir).withColumnRenamed("label", "status")
    return evaluation.status_table(r, ["rater"], ["yes", "no", "unsure"])


@query(f"WITH {_RATINGS}, m AS (SELECT pair_id, max(CASE WHEN rater = 0 THEN label END) AS label, max(CASE WHEN rater = 1 THEN label END) AS again FROM ratings GROUP BY pair_id) SELECT pair_id, label, again FROM m WHERE label <> again")
def changed_labels(spark, sf_dir):
    r = _ratings(spark, sf_dir)
    return evaluation.changed_labels(r.where("rater = 0").select("pair_id", "label"), r.where("rater = 1").select("pair_id", "label"))


@query(f"WITH {_RATINGS} SELECT q.pair_id, m AS rater, coalesce(CASE WHEN r.rater IS NOT NULL THEN r.label END, 'missing') AS status FROM q CROSS JOIN (SELECT unnest(['0', '1', 'x']) AS m) LEFT JOIN ratings r ON r.pair_id = q.pair_id AND CAST(r.rater AS VARCHAR) = m")
def panel_grid(spark, sf_dir):
    r = _ratings(spark, sf_dir).where("rater < 2").select("pair_id", F.col("rater").cast("string").alias("rater"), F.col("label").alias("status"))
    return evaluation.panel_grid(_pairs(spark, sf_dir, TAU).select("pair_id"), ["0", "1", "x"], r)


_SCORED = f"s AS (SELECT doc_id, CAST(toxic AS BIGINT) AS target, CAST(quality AS BIGINT) AS quality, floor({n('score', 'doc_id', 4)} / 1311.0) / 50 AS score FROM labels)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("target"), F.col("quality").cast("long").alias("quality"), (F.floor(hashing.hash_number("score", F.col("doc_id"), 4) / 1311.0) / 50).alias("score"))


_CURVE = _SCORED + ", g AS (SELECT score, sum(target) AS p, sum(1 - target) AS m FROM s GROUP BY score), c AS (SELECT score, p, m, sum(p) OVER (ORDER BY score DESC) AS tp, sum(m) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(m) OVER () AS neg FROM g)"


@query(f"WITH {_CURVE} SELECT round(sum(p * tp / (tp + fp)) / nullif(max(pos), 0), 9) AS average_precision, round(sum(m * (tp - p / 2)) / nullif(max(pos) * max(neg), 0), 9) AS auroc FROM c")
def average_precision(spark, sf_dir):
    return evaluation.ranking_metrics(_scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"), F.round("auroc", 9).alias("auroc"))


@query(f"WITH {_CURVE} SELECT score AS threshold, CAST(tp AS BIGINT) AS true_positives, CAST(tp + fp AS BIGINT) AS predicted, CAST(pos AS BIGINT) AS positives FROM c ORDER BY 2 * tp / (pos + tp + fp) DESC, score DESC LIMIT 1")
def best_f1_threshold(spark, sf_dir):
    return evaluation.best_f1_threshold(_scored(spark, sf_dir))


_OUT = _SCORED + ", o AS (SELECT 'toxic' AS output, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted, target FROM s UNION ALL SELECT 'quality', CASE WHEN score < 0.5 THEN 1 ELSE 0 END, quality FROM s), e AS (SELECT output, sum(predicted * target) AS tp, sum(predicted + target) AS d FROM o GROUP BY output)"


@query(f"WITH {_OUT} SELECT round(coalesce(2 * sum(tp) / nullif(sum(d), 0), 0), 9) AS micro_f1, round(avg(coalesce(2 * tp / nullif(d, 0), 0)), 9) AS macro_f1 FROM e")
def micro_macro_f1(spark, sf_dir):
    s = _scored(spark, sf_dir)
    rows = s.select(F.lit("toxic").alias("output"), (F.col("score") >= 0.5).cast("int").alias("predicted"), "target").union(s.select(F.lit("quality"), (F.col("score") < 0.5).cast("int"), "quality"))
    return evaluation.f1_scores(rows).select(F.round("micro_f1", 9).alias("micro_f1"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {_SCORED}, x AS (SELECT doc_id % 4 AS weight, score, target FROM s) SELECT round(sum(weight * (score - target) * (score - target)) / sum(weight), 9) AS mse, round(sum(weight * abs(score - target)) / sum(weight), 9) AS mae FROM x WHERE weight > 0")
def weighted_errors(spark, sf_dir):
    r = evaluation.weighted_errors(_scored(spark, sf_dir).withColumn("weight", F.col("doc_id") % 4))
    return r.select(F.round("mse", 9).alias("mse"), F.round("mae", 9).alias("mae"))


@query(f"WITH {_SCORED}, x AS (SELECT target AS y, score AS before, score * 0.9 AS frozen, score * 0.8 + 0.1 AS oracle FROM s), m AS (SELECT avg((before - y) * (before - y)) AS b, stddev_pop(before) AS sd, avg((frozen - y) * (frozen - y)) AS f, avg((oracle - y) * (oracle - y)) AS o, sqrt(avg((frozen - oracle) * (frozen - oracle))) AS r FROM x) SELECT round(b, 6) AS predelete_mse, round(sd, 6) AS predelete_score_sd, round(f, 6) AS frozen_mse, round(o, 6) AS oracle_mse, round(f - o, 6) AS signed_raw_loss, round((f - o) / b, 6) AS signed_normalized_loss, round(r, 6) AS prediction_rms, round(r / sd, 6) AS normalized_prediction_rms FROM m")
def effect_metrics(spark, sf_dir):
    x = _scored(spark, sf_dir).select(F.col("target").alias("y"), F.col("score").alias("before"), (F.col("score") * 0.9).alias("frozen"), (F.col("score") * 0.8 + 0.1).alias("oracle"))
    r = evaluation.effect_metrics(x)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(median(v), 6) AS median, round(max(v), 6) AS max, count(v) AS defined, count(*) - count(v) AS undefined FROM (SELECT event_type, CASE WHEN user_id % 3 > 0 THEN value END AS v FROM events) GROUP BY event_type")
def trajectory_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 3 > 0, F.col("value")).alias("v"))
    r = evaluation.trajectory_summary(e, "v", ["event_type"])
    return r.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "median", "max")], "defined", "undefined")


@query("WITH p AS (SELECT n_nationkey, s FROM nation, (SELECT unnest(['A', 'B', 'C']) AS s)), o AS (SELECT DISTINCT c_nationkey AS n_nationkey, c_mktsegment FROM customer), d AS (SELECT n_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN 'B' ELSE 'Z' END AS s FROM o), e AS (SELECT DISTINCT n_nationkey, s FROM d WHERE s <> 'Z') SELECT p.n_nationkey, count(e.s) AS complete, count(*) - count(e.s) AS missing FROM p LEFT JOIN e ON p.n_nationkey = e.n_nationkey AND p.s = e.s GROUP BY p.n_nationkey")
def planned_vs_observed(spark, sf_dir):
    planned = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("s"))
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "A").when(F.col("c_mktsegment") == "MACHINERY", "B")
    observed = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), segment.alias("s")).where("s is not null").distinct().withColumn("status", F.lit("complete"))
    return evaluation.status_table(evaluation.planned_vs_observed(planned, observed, ["n_nationkey", "s"]), ["n_nationkey"], ["complete", "missing"])


@query("WITH t AS (SELECT n_name AS name, (n_nationkey * 7 % 25 + 1) / 500.0 AS p FROM nation), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t) SELECT name, CAST(p AS DOUBLE) AS p, round(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY k), 9) AS adjusted FROM k")
def holm_adjustment(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") * 7 % 25 + 1) / 500.0).alias("p"))
    return evaluation.holm(t).withColumn("adjusted", F.round("adjusted", 9))


@query(f"WITH {_E}, o AS (SELECT id FROM u WHERE id NOT IN (SELECT rid FROM edges)), x AS (SELECT id FROM u ORDER BY {h('utility', 'id')} LIMIT (SELECT count(*) FROM o)) SELECT 'curated' AS method, count(*) AS n, sum(unit) AS units FROM u WHERE id IN (SELECT id FROM o) UNION ALL SELECT 'hash', count(*), sum(unit) FROM u WHERE id IN (SELECT id FROM x) UNION ALL SELECT 'uncurated', count(*), sum(unit) FROM u")
def selection_variants(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    chosen = selection.initial_selection(rows, edges).select("id", "unit")
    same = workload.simple_sample(rows.select("id", "unit"), F.col("id"), chosen.count(), "utility")
    every = chosen.withColumn("method", F.lit("curated")).unionByName(same.withColumn("method", F.lit("hash"))).unionByName(rows.select("id", "unit").withColumn("method", F.lit("uncurated")))
    return every.groupBy("method").agg(F.count("*").alias("n"), F.sum("unit").alias("units"))


@query(f"""WITH {_T}, {_PATHS}, d AS (SELECT trajectory_id, list(unit) AS gone FROM paths GROUP BY 1), a AS (SELECT trajectory_id, count(*) FILTER (len(tail) > 0 AND NOT list_contains(gone, own) AND list_has_all(gone, tail)) AS admitted FROM d, terms GROUP BY 1),
o AS (SELECT trajectory_id, string_agg(unit, ',' ORDER BY pos) AS o, string_agg(unit, ',' ORDER BY unit) AS s FROM paths GROUP BY trajectory_id) SELECT 'S' AS arm, count(DISTINCT o) AS n_orders, count(DISTINCT s) AS n_sets, count(*) FILTER (admitted = 0) AS n_zero FROM o JOIN a USING (trajectory_id)""")
def arm_summary(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    paths = _paths(spark, sf_dir, rows)
    return evaluation.arm_summary(paths, workload.observations(paths, rows, edges, [8]))


@query(f"WITH {_SCORED}, r AS (SELECT doc_id, 1 AS k, 'base' AS method, score AS value FROM s UNION ALL SELECT doc_id, 1, 'half', score / 2 FROM s) SELECT a.doc_id, a.k, a.method, round(a.value - b.value, 9) AS difference FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.method = 'base' WHERE a.method <> 'base'")
def paired_effects(spark, sf_dir):
    s = _scored(spark, sf_dir)
    r = s.select("doc_id", F.lit(1).alias("k"), F.lit("base").alias("method"), F.col("score").alias("value")).union(s.select("doc_id", F.lit(1), F.lit("half"), F.col("score") / 2))
    return evaluation.paired_effects(r, ["doc_id", "k"], "base").withColumn("difference", F.round("difference", 9))


# Vectors, moments, models -------------------------------------------------------------------------------------------


@query(f"WITH {_U} SELECT id, round(z[1], 9) AS first, round(sqrt(list_dot_product(z, z)), 9) AS length FROM u")
def unit_vectors(spark, sf_dir):
    r = vector_rows(spark, sf_dir)
    return r.select("id", F.round(F.get("z", F.lit(0)), 9).alias("first"), F.round(vectors.norm(F.col("z")), 9).alias("length"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings")
def sign_words(spark, sf_dir):
    packed = vectors.pack_bits(vectors.sign_bits(F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", packed.alias("w")).select("vec_id", vectors.unpack_bits(F.col("w")).alias("bits"))


@query("WITH c AS (SELECT label, vec_id % 5 + 1 AS w, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT label, w, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS z FROM c), m AS (SELECT label, i, sum(z[i] * w) / sum(w) AS x FROM n, range(1, 65) t(i) GROUP BY label, i) SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM m")
def pooled_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 5 + 1)
    return vectors.pooled_chunks(c, "label", "w", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


@query(f"WITH {_SCORED}, x AS (SELECT doc_id, score * 8 - 4 AS z, target AS y FROM s) SELECT doc_id, round(CASE WHEN z >= 0 THEN ln(1 + exp(-z)) + (1 - y) * z ELSE ln(1 + exp(z)) - y * z END, 9) AS loss FROM x")
def logistic_losses(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.round(vectors.logistic_loss(F.col("score") * 8 - 4, F.col("target")), 9).alias("loss"))


#: All numbers of a packed statistic: the Gram triangle, cross products with the target as column 65, the count at (65, 65).
_MOM = (
    "SELECT {g}CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum({s}z[i] * z[j]), 6) + 0.0 AS value FROM {r}, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY {g}i, j "
    "UNION ALL SELECT {g}CAST(i AS INTEGER), 65, round(sum({s}z[i] * unit), 6) + 0.0 FROM {r}, range(1, 65) a(i) GROUP BY {g}i UNION ALL SELECT {g}65, 65, round(sum({s}1.0), 6) + 0.0 FROM {r} {e}"
)


def _cells(found: DataFrame, dims: int = 64) -> DataFrame:
    """Packed moments with the places that _MOM gives them: d * d places, whatever the rows."""
    places = [(i, j) for i in range(dims) for j in range(i, dims)] + [(i, dims) for i in range(dims)] + [(dims, dims)]
    names = found.sparkSession.createDataFrame([(p, i + 1, j + 1) for p, (i, j) in enumerate(places)], "pos int, i int, j int")
    return found.join(F.broadcast(names), "pos").select("grp", "i", "j", (F.round("value", 6) + 0.0).alias("value"))


@query(f"WITH {_E}, s AS (SELECT z, unit FROM u WHERE id NOT IN (SELECT rid FROM edges)) " + _MOM.format(s="", r="s", g="", e=""))
def ridge_moments(spark, sf_dir):
    chosen = selection.initial_selection(*edge_rows(spark, sf_dir))
    return _cells(moments.packed_moments(chosen, "z", "unit")).drop("grp")


@query(f"WITH {_E}, a AS (SELECT id FROM u WHERE unit <> {UNIT} AND id IN (SELECT rid FROM edges) AND id NOT IN (SELECT rid FROM edges WHERE bown <> {UNIT})), g AS (SELECT id FROM u WHERE unit = {UNIT} AND id NOT IN (SELECT rid FROM edges)), s AS (SELECT z, unit, 1.0 AS w FROM u JOIN a USING (id) UNION ALL SELECT z, unit, -1.0 FROM u JOIN g USING (id)) " + _MOM.format(s="w * ", r="s", g="", e=""))
def signed_moment_delta(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    came = selection.admissions_after(rows, edges, units(spark, UNIT)).select("z", "unit", F.lit(1).alias("w"))
    went = selection.initial_selection(rows, edges).where(F.col("unit") == UNIT).select("z", "unit", F.lit(-1).alias("w"))
    return _cells(moments.packed_moments(came.union(went), "z", "unit", sign="w")).drop("grp")


@query(f"WITH {_U}, f AS (SELECT *, CAST(unit % 5 AS VARCHAR) AS fold FROM u) " + _MOM.format(s="", r="f", g="fold, ", e="GROUP BY fold"))
def fold_moments(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("fold", F.col("unit") % 5)
    return _cells(moments.packed_moments(rows, "z", "unit", group="fold")).withColumnRenamed("grp", "fold")


@query(f"WITH {_U}, m AS (" + _MOM.format(s="", r="u", g="", e="") + ") SELECT i, j, true AS within FROM m")
def single_precision_moments(spark, sf_dir):
    """Whether single precision stays within a relative 1e-5 of double precision, for each number of the statistic."""
    rows = vector_rows(spark, sf_dir)
    single = _cells(moments.packed_moments(rows, "z", "unit", single=True)).select("i", "j", F.col("value").alias("rough"))
    both = _cells(moments.packed_moments(rows, "z", "unit")).join(single, ["i", "j"])
    return both.select("i", "j", (F.abs(F.col("rough") - F.col("value")) <= 1e-5 * F.greatest(F.lit(100.0), F.abs("value"))).alias("within"))


@query()
def ridge_weights(spark, sf_dir):
    chosen = selection.initial_selection(*edge_rows(spark, sf_dir))
    gram, cross, count = moments.unpack(moments.packed_moments(chosen, "z", "unit"), 64)["0"]
    w = moments.solve_gated(gram, cross, count, 1e-2)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "pos int, weight double")


@query()
def ridge_grid(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("fold", F.col("unit") % 5)
    grid = moments.ridge_grid(rows, "z", "unit", "fold", 64, [10.0**-k for k in range(6, 0, -1)])
    return spark.createDataFrame(grid, "parameter double, loss double")


@query()
def logistic_weights(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("y", (F.col("unit") < 5).cast("double"))
    w = moments.fit_logistic(rows, "z", "y", 64, 1e-2)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "pos int, weight double")


@query()
def spherical_clusters(spark, sf_dir):
    _, rows = moments.spherical_kmeans(vector_rows(spark, sf_dir).select("id", "z"), "z", 4)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"))


def _lower_sql(asked: str) -> str:
    """(name, lower) of (name, pop, n, x, alpha): the least number of successes in ``pop`` under which x or more of n have a chance over alpha, by the sum of all their chances."""
    choose = lambda a, b: f"lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1)"
    chance = f"list_sum(list_transform(range(x, n + 1), lambda j: CASE WHEN j <= k AND n - j <= pop - k THEN exp({choose('k', 'j')} + {choose('(pop - k)', '(n - j)')} - ({choose('pop', 'n')})) ELSE 0.0 END))"
    return f"(SELECT name, min(k) AS lower FROM (SELECT *, unnest(range(x, pop + 1)) AS k FROM {asked}) WHERE {chance} > alpha GROUP BY name)"


@query(f"WITH {_E}, t AS (SELECT count(*) AS pop FROM edges), a AS (SELECT n AS name, pop, CAST(n AS BIGINT) AS n, CAST(n - n // 20 AS BIGINT) AS x, 0.05 AS alpha FROM t, (SELECT unnest([50, 100, 200]) AS n) WHERE n <= pop) SELECT pop AS population, CAST(n AS INTEGER) AS sample, CAST(x AS INTEGER) AS successes, lower, 10 * lower >= 9 * pop AS passes FROM a JOIN {_lower_sql('a')} USING (name)")
def population_bounds(spark, sf_dir):
    """Lower bounds on the share of confirmed pairs in a census of edges, from samples of several sizes."""
    total = edge_rows(spark, sf_dir)[1].count()
    rows = [(total, k, k - k // 20, exact.population_lower_bound(total, k, k - k // 20)) for k in (50, 100, 200) if k <= total]
    return spark.createDataFrame([(*r, exact.quality_gate(r[3], r[0])) for r in rows], "population long, sample int, successes int, lower long, passes boolean")


@query()
def repeated_deletes(spark, sf_dir):
    """Selected records after deleting units 3, 1 and 7: one batch after the other through the versioned state, and at once."""
    from uuid import uuid4

    from gleanery.streaming.deletes import DeletionState

    rows, edges = written_edges(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/deletes-{uuid4().hex}"
    state = DeletionState(spark, folder, 8)
    state.create(rows, edges)
    for version, unit in enumerate((3, 1, 7)):
        state.apply(version, units(spark, unit))
    at_once = selection.selection_after(rows, edges, units(spark, 3, 1, 7)).select("id", F.lit(True).alias("at_once"))
    return state.selection(3).select("id", F.lit(True).alias("in_steps")).join(at_once, "id", "full").select("id", F.coalesce("in_steps", F.lit(False)).alias("in_steps"), F.coalesce("at_once", F.lit(False)).alias("at_once"))


ORACLE_SQL["repeated_deletes"] = f"WITH {_E} SELECT id, true AS in_steps, true AS at_once FROM u WHERE unit NOT IN (3, 1, 7) AND id NOT IN (SELECT rid FROM edges WHERE bown NOT IN (3, 1, 7))"


@query(f"WITH {_E.replace(str(TAU) + ')', '0.28)')} SELECT id, id NOT IN (SELECT rid FROM edges WHERE bown <> {UNIT}) AS certain FROM u WHERE unit <> {UNIT} AND id NOT IN (SELECT rid FROM edges WHERE bown <> {UNIT} AND score > 0.32)")
def selection_envelope(spark, sf_dir):
    return inference.envelope(vector_rows(spark, sf_dir), TAU, 0.02, units(spark, UNIT))


@query(f"""WITH {_T}, {_PATHS}, d AS (SELECT trajectory_id, k, list(unit) AS gone FROM at_k WHERE k = 4 GROUP BY 1, 2), x AS (SELECT trajectory_id, count(*) FILTER (len(tail) > 0 AND NOT list_contains(gone, own) AND list_has_all(gone, tail)) AS admitted, count(*) FILTER (list_contains(gone, own)) AS del FROM d, terms GROUP BY 1)
SELECT CAST(trajectory_id AS INTEGER) AS trajectory_id, admitted, admitted > 0 AS any_admitted, round(admitted / nullif(del, 0), 9) AS per_deleted FROM x""")
def admission_metrics(spark, sf_dir):
    rows, edges = written_edges(spark, sf_dir)
    obs = workload.observations(_paths(spark, sf_dir, rows), rows, edges, [4])
    return obs.select("trajectory_id", "admitted", (F.col("admitted") > 0).alias("any_admitted"), F.round(F.col("admitted") / F.nullif("deleted_records", F.lit(0)), 9).alias("per_deleted"))


@query(f"""WITH c AS (SELECT lang, source, sum(CAST(quality AS DOUBLE)) AS a, count(quality) AS b FROM labels JOIN documents USING (doc_id) GROUP BY lang, source), g AS (SELECT *, {_draws('crossed/paths', 'rep', 'lang')} * {_draws('crossed/sources', 'rep', 'source')} AS w FROM c, range(1, 201) r(rep) WHERE lang IS NOT NULL AND source IS NOT NULL),
r AS (SELECT rep, sum(w * a) / nullif(sum(w * b), 0) AS m FROM g GROUP BY rep) SELECT {_ENDS.format(x='m')}, round((SELECT sum(a) / sum(b) FROM c), 9) AS ratio FROM r""")
def crossed_bootstrap(spark, sf_dir):
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").select("source", "lang", F.col("quality").cast("double").alias("q"), F.when(F.col("quality").isNotNull(), 1.0).alias("one"))
    found = inference.crossed_bootstrap(t, "lang", "source", "q", "one", 200, "crossed")
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(f"""WITH e AS (SELECT lang, source, sum(CAST(quality AS DOUBLE)) AS s, count(quality) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang, source), g AS (SELECT *, {_draws('arms', 'rep', "concat_ws('/', lang, source)")} AS w FROM e, range(1, 201) r(rep)),
a AS (SELECT rep, lang, sum(w * s) / nullif(sum(w * n), 0) AS m FROM g GROUP BY rep, lang), r AS (SELECT rep, avg(m) AS m FROM a GROUP BY rep) SELECT {_ENDS.format(x='m')}, round((SELECT avg(m) FROM (SELECT sum(s) / sum(n) AS m FROM e GROUP BY lang)), 9) AS mean FROM r""")
def equal_arm_mean(spark, sf_dir):
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").withColumn("q", F.col("quality").cast("double"))
    found = inference.equal_arm_bootstrap(t, "lang", "source", "q", 200, "arms")
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query()
def logistic_thresholds(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).select("z", F.col("unit").alias("fold"), (F.col("unit") % 2).alias("y")).withColumn("fold", F.col("fold") % 3)
    return inference.logistic_thresholds(rows, "z", "y", "fold", 64, 1e-2)


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {h('strata', 'doc_id')}) AS k, count(*) OVER (PARTITION BY quality) AS pop FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
s AS (SELECT quality, any_value(pop) AS pop, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS x FROM l WHERE k <= 20 GROUP BY quality), a AS (SELECT quality AS name, pop, n, x, 0.05 / (2 * (SELECT count(*) FROM s)) AS alpha FROM s), b AS (SELECT name, pop, n, n - x AS x, alpha FROM a)
SELECT CAST(sum(y.lower) AS BIGINT) AS lower, CAST(sum(a.pop - z.lower) AS BIGINT) AS upper FROM a JOIN {_lower_sql('a')} y USING (name) JOIN {_lower_sql('b')} z USING (name)""")
def stratified_bounds(spark, sf_dir):
    """Bounds on toxic documents by quality stratum, from a hash sample of the labels."""
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    drawn = workload.stratified_sample(rows, ["quality"], F.col("doc_id"), 20, "strata").groupBy("quality").agg(F.first("stratum_rows").alias("n"), F.count("*").alias("k"), F.sum("toxic").alias("x"))
    found = [(r["n"], r["k"], r["x"], 0) for r in drawn.collect()]
    return spark.createDataFrame([inference.stratified_interval(found)], "lower long, upper long")


# Compressed states and utility --------------------------------------------------------------------------------------


def _factors(spark, sf_dir):
    rows, edges = edge_rows(spark, sf_dir)
    stats = rows.select("id", F.array_append("z", F.col("unit").cast("double")).alias("w"))
    return states.factor_polynomial(structure.terms(rows, edges), stats, 65)


@query(f"WITH {_E}, s AS (SELECT z, unit FROM u WHERE unit <> {UNIT} AND id NOT IN (SELECT rid FROM edges WHERE bown <> {UNIT})) " + _MOM.format(s="", r="s", g="", e="").split(" UNION ALL SELECT 65")[0] + " UNION ALL SELECT 65, 65, round(sum(unit * unit), 6) + 0.0 FROM s")
def factored_moments_after_delete(spark, sf_dir):
    """The weights are the vector and, last, the unit; so the last cell is the sum of its squares."""
    gone = states.evaluate_factors(_factors(spark, sf_dir), [UNIT], 65)
    return states.dense_rows(gone, 65).select("i", "j", (F.round("value", 6) + 0.0).alias("value"))


@query()
def joint_span_ranks(spark, sf_dir):
    spans = states.joint_spans(states.substitute_factors(_factors(spark, sf_dir), [UNIT], 65), 65, 64)
    return spans.groupBy("rank").agg(F.count("*").alias("n_keys"))


_GRID = 20


@query(f"""WITH {_E}, g AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {2**_GRID} + 0.5) AS BIGINT)) AS w FROM embeddings),
s AS (SELECT w FROM u JOIN g USING (id) WHERE unit <> {UNIT} AND id NOT IN (SELECT rid FROM edges WHERE bown <> {UNIT}))
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(sum(CAST(w[i] AS HUGEINT) * w[j]) AS VARCHAR) AS coefficient
FROM s, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY i, j HAVING sum(CAST(w[i] AS HUGEINT) * w[j]) <> 0""")
def exact_moments_after_delete(spark, sf_dir):
    rows, edges = edge_rows(spark, sf_dir)
    stats = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), exact_states.to_grid(F.col("embedding"), _GRID).alias("w"))
    state = exact_states.exact_polynomial(structure.terms(rows, edges), stats, _GRID)
    moved = exact_states.substitute_exact(state, [UNIT])
    return exact_states.evaluate_exact(moved, []).select("i", "j", F.col("coefficient").cast("string").alias("coefficient"))


_SHORT = _CENSUS + f""", ends AS (SELECT tail AS key, 1 AS s FROM usable UNION ALL SELECT list_sort(list_append(tail, own)), -1 FROM usable WHERE len(tail) < {HORIZON}),
poly AS (SELECT array_to_string(key, ',') AS key, CAST(sum(s) AS BIGINT) AS coefficient FROM ends GROUP BY key HAVING sum(s) <> 0)"""


@query(f"WITH RECURSIVE {_SHORT} SELECT key, coefficient FROM poly WHERE 'k:' || key NOT IN (SELECT label FROM lab WHERE label <> 'ground')")
def rank_coordinates(spark, sf_dir):
    found = _terms(spark, sf_dir)
    return _named(states.rank_coordinates(structure.count_polynomial(found, HORIZON), found, HORIZON)[0])


@query(f"WITH RECURSIVE {_SHORT} SELECT key AS name, coefficient FROM poly")
def restored_polynomial(spark, sf_dir):
    found = _terms(spark, sf_dir)
    return states.restore_keys(*states.rank_coordinates(structure.count_polynomial(found, HORIZON), found, HORIZON))


@query(f"SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY {h('illustrative', 'doc_id')}) AS k FROM labels) WHERE k <= 3")
def illustrative_picks(spark, sf_dir):
    picked = workload.stratified_sample(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"], F.col("doc_id"), 3, "illustrative")
    return picked.select("doc_id", "quality", "toxic")


@query()
def utility_panel(spark, sf_dir):
    """Ridge models of the curated, a hash subset of the same size and all rows of four folds, scored on the fifth."""
    rows, edges = edge_rows(spark, sf_dir)
    train, test = rows.where("unit % 5 <> 0"), rows.where("unit % 5 = 0")
    curated = selection.initial_selection(train, edges).select("id", "unit", "z")
    same = workload.simple_sample(train.select("id", "unit", "z"), F.col("id"), curated.count(), "utility")
    every = [found.select("z", "unit", F.lit(name).alias("method")) for name, found in (("curated", curated), ("hash", same), ("uncurated", train))]
    return moments.utility_panel(every[0].union(every[1]).union(every[2]), test, "z", "unit", "method", 64, 1e-2)


@query()
def refit_arms(spark, sf_dir):
    return moments.refit_arms(vector_rows(spark, sf_dir), units(spark, UNIT), 8, 0.25).groupBy("arm").agg(F.count("*").alias("n"))


# Further workloads, audits and states -------------------------------------------------------------------------------

_MASS = f"""m AS (SELECT unit, CAST(count(*) AS BIGINT) AS mass FROM u GROUP BY unit),
paths AS (SELECT trajectory_id, pos, unit FROM (SELECT t AS trajectory_id, unit, row_number() OVER (PARTITION BY t ORDER BY -ln(({n('mass', "'S-mass|' || t || '|' || unit", 12)} + 0.5) / CAST(281474976710656 AS DOUBLE)) / mass, unit) AS pos FROM m, range(6) r(t)) WHERE pos <= 8),
at_k AS (SELECT trajectory_id, k, unit FROM paths, (SELECT unnest([1, 2, 4, 8]) AS k) WHERE pos <= k)"""


@query(f"""WITH {_T}, {_MASS}, d AS (SELECT trajectory_id, k, list(unit) AS gone FROM at_k GROUP BY 1, 2),
x AS (SELECT trajectory_id, k, count(*) FILTER (list_contains(gone, own)) AS deleted_records, count(*) FILTER (list_contains(gone, own) AND len(tail) = 0) AS lost, count(*) FILTER (len(tail) > 0 AND NOT list_contains(gone, own) AND list_has_all(gone, tail)) AS admitted FROM d, terms GROUP BY 1, 2)
SELECT CAST(trajectory_id AS INTEGER) AS trajectory_id, k, deleted_records, lost, admitted, deleted_records - lag(deleted_records, 1, 0) OVER (PARTITION BY trajectory_id ORDER BY k) AS new_deletions FROM x""")
def mass_source_observations(spark, sf_dir):
    """Deletion paths that take sources by their number of records."""
    rows, edges = written_edges(spark, sf_dir)
    paths = workload.mass_trajectories(rows.groupBy("unit").agg(F.count("*").alias("mass")), 6, 8, "mass")
    return workload.observations(paths, rows, edges, [1, 2, 4, 8])


_PERCENT = f"""hz AS (SELECT CAST(ceil(count(*) / 100) AS INTEGER) AS h FROM u),
paths AS (SELECT trajectory_id, pos, unit FROM (SELECT t AS trajectory_id, id AS unit, row_number() OVER (PARTITION BY t ORDER BY {h("percent", "'R|' || t || '|' || id")}, id) AS pos FROM u, range(6) r(t)) WHERE pos <= (SELECT h FROM hz)),
ks AS (SELECT DISTINCT CAST(least(k, h) AS INTEGER) AS k FROM hz, (SELECT unnest([1, 8, 32, 128, 2147483647]) AS k)), at_k AS (SELECT trajectory_id, k, unit FROM paths, ks WHERE pos <= k)"""


@query(f"""WITH {_E}, {_PERCENT}, need AS (SELECT rid, count(*) AS n FROM edges GROUP BY rid), have AS (SELECT trajectory_id, k, rid, count(*) AS m FROM at_k JOIN edges ON bid = unit GROUP BY 1, 2, 3),
adm AS (SELECT trajectory_id, k, count(*) AS admitted FROM have JOIN need USING (rid) WHERE m = n AND NOT EXISTS (SELECT 1 FROM at_k z WHERE z.trajectory_id = have.trajectory_id AND z.k = have.k AND z.unit = have.rid) GROUP BY 1, 2),
gone AS (SELECT trajectory_id, k, count(*) AS deleted_records, count(*) FILTER (unit NOT IN (SELECT rid FROM edges)) AS lost FROM at_k GROUP BY 1, 2)
SELECT CAST(trajectory_id AS INTEGER) AS trajectory_id, k, deleted_records, lost, coalesce(admitted, 0) AS admitted FROM gone LEFT JOIN adm USING (trajectory_id, k)""")
def one_percent_record_observations(spark, sf_dir):
    """Deletion paths over a hundredth of the records, each record its own unit."""
    rows, edges = written_edges(spark, sf_dir)
    horizon, checkpoints = workload.one_percent_horizon(rows.count())
    alone = rows.select("id", F.col("id").alias("unit"))
    links = edges.select("rid", F.col("rid").alias("rown"), "bid", F.col("bid").alias("bown"))
    paths = workload.trajectories(alone.select("unit"), "R", 6, horizon, "percent")
    return workload.observations(paths, alone, links, checkpoints).drop("new_deletions")


@query(f"""WITH {_E}, l AS (SELECT DISTINCT rid, bid FROM edges), need AS (SELECT rid, count(*) AS n FROM l GROUP BY rid), pool AS (SELECT rid FROM need WHERE n <= 16),
drawn AS (SELECT t, rid FROM (SELECT t, rid, row_number() OVER (PARTITION BY t ORDER BY {h("stress", "'candidate|' || t || '|' || rid")}) AS k FROM pool, range(4) r(t)) WHERE k <= 32),
have AS (SELECT c.rid AS candidate, e.rid, count(*) AS m FROM (SELECT DISTINCT rid FROM drawn) c JOIN l s ON s.rid = c.rid JOIN l e ON e.bid = s.bid GROUP BY 1, 2),
score AS (SELECT candidate, count(*) AS s FROM have JOIN need USING (rid) WHERE m = n AND NOT EXISTS (SELECT 1 FROM l WHERE l.rid = candidate AND l.bid = have.rid) GROUP BY 1),
best AS (SELECT t, candidate FROM (SELECT t, candidate, row_number() OVER (PARTITION BY t ORDER BY s DESC, candidate) AS k FROM drawn JOIN score ON candidate = rid) WHERE k = 1),
o AS (SELECT b.t, b.candidate, u.id, CASE WHEN l.bid IS NOT NULL THEN 0 ELSE 1 END AS late FROM best b CROSS JOIN u LEFT JOIN l ON l.rid = b.candidate AND l.bid = u.id)
SELECT CAST(t AS INTEGER) AS trajectory_id, 'A' AS arm, CAST(pos AS INTEGER) AS pos, id AS unit, candidate FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY late, CASE WHEN late = 1 THEN {h("stress", "'padding|' || t || '|' || id")} ELSE '' END, id) AS pos FROM o) WHERE pos <= 16""")
def stress_request_paths(spark, sf_dir):
    """Paths that delete the blockers of a record that its deletion admits with most others, then records at random."""
    rows, edges = written_edges(spark, sf_dir)
    return workload.stress_paths(rows, edges, 16, 4, 32, "stress")


_RANKS = f"""m AS (SELECT unit, i, avg(z[i]) AS c FROM u, range(1, 65) t(i) GROUP BY unit, i), s AS (SELECT id, u.unit, z, round(sum(z[i] * c), 9) AS sim FROM u JOIN m ON u.unit = m.unit GROUP BY id, u.unit, z),
o AS (SELECT 'hard' AS policy, *, row_number() OVER (PARTITION BY unit ORDER BY sim, id) AS k FROM s UNION ALL SELECT 'random', *, row_number() OVER (PARTITION BY unit ORDER BY {h('cluster', 'id')}, id) FROM s)"""


@query(f"WITH {_U}, {_RANKS} SELECT policy, a.id, round(max(list_dot_product(a.z, b.z)), 6) AS top FROM o a JOIN o b USING (policy) WHERE a.unit = b.unit AND b.k < a.k AND list_dot_product(a.z, b.z) > 0.25 GROUP BY policy, a.id")
def cluster_policies(spark, sf_dir):
    """What suppression inside clusters drops if the rows farthest from the centre, or random rows, go first."""
    rows = vector_rows(spark, sf_dir).withColumn("cluster", F.col("unit"))
    found = [graph.cluster_suppression(rows, "cluster", 0.25, graph.cluster_ranks(rows, "cluster", p)).select(F.lit(p).alias("policy"), "id", F.round("top", 6).alias("top")) for p in ("hard", "random")]
    return found[0].union(found[1])


@query(f"WITH {_POLY} SELECT count(*) AS n_keys, CAST(8 * count(*) * (64 * 65 / 2 + 64 + 1) AS BIGINT) AS state_bytes FROM poly")
def state_forecast(spark, sf_dir):
    """Bytes that packed statistics of every key would take."""
    return structure.count_polynomial(_terms(spark, sf_dir)).agg(F.count("*").alias("n_keys")).withColumn("state_bytes", exact.state_bytes(F.col("n_keys"), 64, 1))


@query()
def vector_digests(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.vector_hash(F.col("embedding")).alias("sha256"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"quality\":' || quality || ',\"toxic\":' || toxic || '}') AS digest FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL UNION ALL SELECT doc_id, sha256('{\"doc_id\":' || doc_id || coalesce(',\"quality\":' || quality, '') || coalesce(',\"toxic\":' || toxic, '') || '}') FROM labels WHERE quality IS NULL OR toxic IS NULL")
def json_digests(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", hashing.canonical_digest("toxic", "doc_id", "quality").alias("digest"))


@query(f"WITH {_SCORED}, g AS (SELECT CAST(p AS DOUBLE) AS p, avg((least(score, p) - target) * (least(score, p) - target)) AS l FROM s, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS p) GROUP BY p) SELECT p AS parameter, round(l, 9) AS loss FROM g ORDER BY l, p DESC LIMIT 1")
def best_parameter(spark, sf_dir):
    """The cap on scores with the least squared error."""
    grid = _scored(spark, sf_dir).withColumn("parameter", F.explode(F.array(*[F.lit(p) for p in (0.1, 0.3, 0.5, 0.7, 0.9)])))
    error = F.least("score", "parameter") - F.col("target")
    return evaluation.best_by_loss(grid.groupBy("parameter").agg(F.avg(error * error).alias("loss"))).select("parameter", F.round("loss", 9).alias("loss"))


@query(f"WITH {_U} SELECT id, unit FROM u WHERE unit IN ({UNIT}, 1)")
def owned_records(spark, sf_dir):
    return selection.owned_records(vector_rows(spark, sf_dir), units(spark, UNIT, 1)).select("id", "unit")


_THREE = "(3, 1, 7)"


@query(f"WITH {_T}, ends AS (SELECT tail AS key, 1 AS s FROM terms WHERE NOT list_contains(tail, own) AND len(tail) <= 5 UNION ALL SELECT list_sort(list_append(tail, own)), -1 FROM terms WHERE NOT list_contains(tail, own) AND len(tail) < 5), k AS (SELECT list_filter(key, lambda x: x NOT IN {_THREE}) AS key, s FROM ends) SELECT array_to_string(key, ',') AS key, CAST(sum(s) AS BIGINT) AS coefficient FROM k WHERE len(key) <= 2 GROUP BY key HAVING sum(s) <> 0")
def indexed_deletes(spark, sf_dir):
    """The polynomial within the rest of a horizon of 5 after units 3, 1 and 7 went, one batch after the other, through the indexed state."""
    from uuid import uuid4

    from gleanery.streaming.deletes import IndexedState

    rows, edges = written_edges(spark, sf_dir)
    state = IndexedState(spark, f"{checkpoint_folder(spark)}/indexed-{uuid4().hex}", 5)
    state.create(rows, structure.terms(rows, edges))
    for version, unit in enumerate((3, 1, 7)):
        state.apply(version, units(spark, unit))
    return _named(state.polynomial(3))


@query()
def certified_release(spark, sf_dir):
    """Ridge weights of the first four coordinates after a deletion, released with their version."""
    from uuid import uuid4

    from gleanery.streaming.deletes import CertifiedState

    rows, edges = written_edges(spark, sf_dir)
    stats = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), exact_states.to_grid(F.concat(F.slice("embedding", 1, 4).cast("array<double>"), F.array(F.col("label").cast("double"))), _GRID).alias("w"))
    state = CertifiedState(spark, f"{checkpoint_folder(spark)}/certified-{uuid4().hex}", HORIZON, _GRID, 4, Fraction(1, 100), Fraction(1, 10**10))
    state.create(rows, structure.terms(rows, edges), stats)
    state.apply(0, units(spark, UNIT))
    return spark.createDataFrame(list(enumerate(state.weights(1))), "pos int, weight double")


@query(f"""WITH {_E}, b AS ({_AFTER}), a AS (SELECT id FROM b WHERE id IN (SELECT rid FROM edges)),
f AS (SELECT rid AS id, bid AS former, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, bid) AS k FROM edges WHERE bown = {UNIT} AND rid IN (SELECT id FROM a)),
n AS (SELECT x.id, y.id AS survivor, list_dot_product(x.z, y.z) AS score, row_number() OVER (PARTITION BY x.id ORDER BY list_dot_product(x.z, y.z) DESC, y.id) AS k FROM u x JOIN a USING (id), u y WHERE y.id IN (SELECT id FROM b) AND y.id <> x.id)
SELECT f.id, former, round(f.score, 6) AS former_score, survivor, round(n.score, 6) AS survivor_score FROM f LEFT JOIN n ON n.id = f.id AND n.k = 1 WHERE f.k = 1""")
def admission_contexts(spark, sf_dir):
    """What stood in the way of each record that the deletion of a unit admits, and what is closest to it now."""
    rows, edges = written_edges(spark, sf_dir)
    gone = units(spark, UNIT)
    chosen, came = selection.selection_after(rows, edges, gone), selection.admissions_after(rows, edges, gone)
    found = graph.admission_contexts(rows, edges, gone, chosen, came)
    return found.select("id", "former", F.round("former_score", 6).alias("former_score"), "survivor", F.round("survivor_score", 6).alias("survivor_score"))


@query(f"WITH {_E} SELECT id, true AS rebuilt, true AS repaired FROM u WHERE unit <> {UNIT} AND id NOT IN (SELECT rid FROM edges WHERE bown <> {UNIT})")
def oracle_selection(spark, sf_dir):
    """The selection after a deletion from the graph of the rows that stay, and from the graph that is there."""
    rows, edges = written_edges(spark, sf_dir)
    gone = units(spark, UNIT)
    rebuilt = selection.rebuilt_selection(rows, gone, TAU).select("id", F.lit(True).alias("rebuilt"))
    both = rebuilt.join(selection.selection_after(rows, edges, gone).select("id", F.lit(True).alias("repaired")), "id", "full")
    return both.select("id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("rebuilt", "repaired")])


@query(f"WITH {_E}, s AS (SELECT z, unit FROM u WHERE unit NOT IN (3, 1) AND id NOT IN (SELECT rid FROM edges WHERE bown NOT IN (3, 1))) " + _MOM.format(s="", r="s", g="", e=""))
def moments_on_release(spark, sf_dir):
    """Moments of the selection after units 3 and 1 went through the versioned state, which holds no moments."""
    from uuid import uuid4

    from gleanery.streaming.deletes import DeletionState

    rows, edges = written_edges(spark, sf_dir)
    state = DeletionState(spark, f"{checkpoint_folder(spark)}/payload-{uuid4().hex}", 8)
    state.create(rows, edges)
    state.apply(0, units(spark, 3, 1))
    return _cells(state.moments(1, rows, "z", "unit")).drop("grp")


@query()
def three_arms(spark, sf_dir):
    """Fresh, warm and frozen logistic models along a deletion path, scored on the rows of even ids."""
    rows, edges = written_edges(spark, sf_dir)
    rows = rows.withColumn("y", (F.col("unit") < 5).cast("double"))
    found = inference.convex_program(rows, edges, [UNIT, 1, 7], [1, 3], rows.where("id % 2 = 0"), "z", ["y"], 64, 1e-2)
    return spark.createDataFrame([(r["checkpoint"], r["arm"], r["bce"], r["mse"], r["released"]) for r in found], "checkpoint int, arm string, bce double, mse double, released boolean")
