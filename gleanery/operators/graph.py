"""Similarity graphs: exhaustive theta joins as a grid of bounded tiles, sign-signature candidates, neighbours, components.

Each row goes to the tiles of its hash bucket's grid row and column, so two rows meet in exactly one tile and no plan has a
cartesian product. A tile scores its pairs with one matrix product and decides the few near or above the threshold by
the ordered double-precision dot product, whose value doesn't depend on the tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.hashing import hash_bound, salted_hash, seeded_priority
from gleanery.functions.vectors import bin_places, plane_signature, unit_vector
from gleanery.session import durable

TILE_ROWS = 4096


def nodes(df: DataFrame, id_col: str, unit_col: str, vector_col: str, seed: str = "0") -> DataFrame:
    """(id, unit, p, z): service unit, priority hash, unit vector. Vectors without a direction are left out."""
    out = df.select(F.col(id_col).alias("id"), F.col(unit_col).alias("unit"), seeded_priority(seed, F.col(id_col)).alias("p"), unit_vector(F.col(vector_col)).alias("z"))
    return out.where("z is not null")


def _tiles(rows: DataFrame, count: int, right_side: bool | None) -> DataFrame:
    """Rows with their tiles (ti, tj) and side; right_side None deals both sides of a self join, ti <= tj."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    other = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    if right_side is None:
        rows = rows.withColumn("other", other)
        mine = F.array(
            F.when(F.col("bucket") <= F.col("other"), F.struct(F.col("bucket").alias("ti"), F.col("other").alias("tj"), F.lit(False).alias("right"))),
            F.when(F.col("other") <= F.col("bucket"), F.struct(F.col("other").alias("ti"), F.col("bucket").alias("tj"), F.lit(True).alias("right"))),
        )
        return rows.withColumn("tile", F.explode(F.filter(mine, lambda x: x.isNotNull()))).select("tile.*", "id", "unit", "p", "z")
    rows = rows.withColumn("other", other)
    ti, tj = ("other", "bucket") if right_side else ("bucket", "other")
    return rows.select(F.col(ti).alias("ti"), F.col(tj).alias("tj"), F.lit(right_side).alias("right"), "id", "unit", "p", "z")


def _buckets(df: DataFrame, tile_rows: int) -> int:
    n = df.count()
    return max(1, -(-n // tile_rows), min(4, n // 256))


def _dealt(left: DataFrame, right: DataFrame | None, tile_rows: int) -> DataFrame:
    """Rows with tiles of at most about ``tile_rows`` rows a side, and some tiles for every core once there are a thousand rows."""
    if right is None:
        return _tiles(left, _buckets(left, tile_rows), None)
    count = max(_buckets(left, tile_rows), _buckets(right, tile_rows))
    return _tiles(left, count, False).unionByName(_tiles(right, count, True))


def _dealt_within(rows: DataFrame, group: str, tile_rows: int) -> DataFrame:
    """Rows with tiles of a self join inside each value of ``group``; small groups are one tile, large ones a grid."""
    sizes = rows.groupBy(F.col(group).alias("_of")).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_buckets"))
    placed = rows.join(sizes, F.col(group).eqNullSafe(F.col("_of"))).withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("_buckets")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)))
    mine = F.array(
        F.when(F.col("bucket") <= F.col("other"), F.struct(F.col("bucket").alias("ti"), F.col("other").alias("tj"), F.lit(False).alias("right"))),
        F.when(F.col("other") <= F.col("bucket"), F.struct(F.col("other").alias("ti"), F.col("bucket").alias("tj"), F.lit(True).alias("right"))),
    )
    return placed.withColumn("tile", F.explode(F.filter(mine, lambda x: x.isNotNull()))).select("tile.*", F.col(group).alias("grp"), "id", "unit", "p", "z")


class _Tile:
    """Both sides of a tile, and the scores between chunks of the left and all of the right."""

    def __init__(self, table: pa.Table, own: bool):
        side = np.asarray(table["right"].combine_chunks().cast(pa.int8())).astype(bool)
        z = table["z"].combine_chunks()
        self.x = np.asarray(z.flatten()).reshape(len(z), -1)
        self.ids = np.asarray(table["id"].combine_chunks())
        self.left, self.right = np.flatnonzero(~side), np.flatnonzero(side)
        #: Both sides of a diagonal tile of a self join hold the same rows; a pair counts where the left id is smaller.
        self.twice = own and table["ti"][0] == table["tj"][0]

    def chunks(self):
        far = self.x[self.right].T
        for i in range(0, len(self.left), 512):
            part = self.left[i : i + 512]
            near = self.x[part] @ far
            if self.twice:
                near[self.ids[part][:, None] >= self.ids[self.right][None, :]] = -np.inf
            yield part, near

    def exact(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Dot products in coordinate order."""
        score = np.zeros(len(u))
        for k in range(self.x.shape[1]):
            score += self.x[u, k] * self.x[v, k]
        return score

    def places(self, part: np.ndarray, near: np.ndarray, bins: int) -> np.ndarray:
        """Bins of a chunk's scores; ``bins`` for pairs that don't count."""
        with np.errstate(invalid="ignore"):
            at = (near + 1) * (bins / 2)
            place = np.clip(np.floor(at), 0, bins - 1).astype(np.int16)
            # Near an inner edge rounding decides, so the score is taken exactly.
            u, v = np.nonzero((np.abs(at - np.rint(at)) <= 1e-7) & (at > 0.5) & (at < bins - 0.5))
        place[u, v] = bin_places(self.exact(part[u], self.right[v]), bins)
        if self.twice:
            place[near == -np.inf] = bins
        return place


def theta_pairs(left: DataFrame, tau: float, right: DataFrame | None = None, tile_rows: int = TILE_ROWS, within: str | None = None) -> DataFrame:
    """(lid, lunit, rid, runit, score) with score > tau, strictly. Without ``right``: each unordered pair once, the row of higher priority (smaller p, then id) on the right.

    ``within`` names a column of ``left`` whose values keep to themselves: other pairs are never looked at.
    """
    own = right is None
    types = dict(left.dtypes)
    schema = f"lid {types['id']}, lunit {types['unit']}, rid {types['id']}, runit {types['unit']}, score double"

    def join(table: pa.Table) -> pa.Table:
        tile = _Tile(table, own)
        none = tile.left[:0]
        found = [(none, none, np.zeros(0))]
        for part, near in tile.chunks():
            u, v = np.nonzero(near > tau - 1e-9)
            u, v = part[u], tile.right[v]
            score = tile.exact(u, v)
            keep = score > tau
            found.append((u[keep], v[keep], score[keep]))
        u, v, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if own:
            p = np.array(table["p"].to_pylist(), str)
            rank = np.empty(len(p), np.int64)
            rank[np.lexsort((tile.ids, p))] = np.arange(len(p))
            # Copies of a row on both sides rank next to each other, so the order of different rows is right.
            later = rank[u] > rank[v]
            u, v = np.where(later, u, v), np.where(later, v, u)
        take = lambda name, at: table[name].combine_chunks().take(pa.array(at))
        return pa.table({"lid": take("id", u), "lunit": take("unit", u), "rid": take("id", v), "runit": take("unit", v), "score": pa.array(score)})

    if within:
        return _dealt_within(left, within, tile_rows).groupBy("grp", "ti", "tj").applyInArrow(join, schema)
    return _dealt(left, right, tile_rows).groupBy("ti", "tj").applyInArrow(join, schema)


def witnesses(left: DataFrame, right: DataFrame, taus: list[float], tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, top, w0, s0, w1, s1, …): of each left row with a score over the least threshold, its largest score, and for each threshold the smallest right id over it and its score.

    Tiles send a row for each of their left rows at most, never pairs.
    """
    kind, lowest = dict(right.dtypes)["id"], min(taus)
    columns = [x for i in range(len(taus)) for x in (f"w{i}", f"s{i}")]
    schema = f"id {dict(left.dtypes)['id']}, top double, " + ", ".join(f"w{i} {kind}, s{i} double" for i in range(len(taus)))

    def find(table: pa.Table) -> pa.Table:
        tile = _Tile(table, False)
        tile.right = tile.right[np.argsort(tile.ids[tile.right], kind="stable")]
        out: dict[str, list] = {n: [] for n in ("id", "top", *columns)}
        for part, near in tile.chunks():
            if not near.shape[1]:
                continue
            # The few scores that rounding could put on the other side of a threshold are taken exactly.
            close = np.zeros(near.shape, bool)
            for tau in taus:
                close |= np.abs(near - tau) <= 1e-9
            u, v = np.nonzero(close)
            near[u, v] = tile.exact(part[u], tile.right[v])
            rows = np.flatnonzero(near.max(axis=1) > lowest)
            u, v = np.nonzero(near[rows] >= near[rows].max(axis=1, keepdims=True) - 1e-9)
            top = np.full(len(rows), -np.inf)
            np.maximum.at(top, u, tile.exact(part[rows[u]], tile.right[v]))
            out["id"].append(part[rows])
            out["top"].append(top)
            for i, tau in enumerate(taus):
                over = near[rows] > tau
                some, first = over.any(axis=1), over.argmax(axis=1)
                out[f"w{i}"].append(np.where(some, tile.right[first], -1))
                out[f"s{i}"].append(np.where(some, tile.exact(part[rows], tile.right[first]), np.nan))
        ids = table["id"].combine_chunks()
        joined = {n: np.concatenate(x) if x else np.zeros(0, np.int64 if n[0] in "iw" else np.float64) for n, x in out.items()}
        take = lambda at: ids.take(pa.array(np.where(at < 0, 0, at), mask=at < 0))
        return pa.table({n: take(x) if n[0] in "iw" else pa.array(x, mask=np.isnan(x)) for n, x in joined.items()})

    found = _dealt(left, right, tile_rows).groupBy("ti", "tj").applyInArrow(find, schema)
    best = [F.min(F.when(F.col(f"w{i}").isNotNull(), F.struct(f"w{i}", f"s{i}"))).alias(f"m{i}") for i in range(len(taus))]
    merged = found.groupBy("id").agg(F.max("top").alias("top"), *best)
    return merged.select("id", "top", *[F.col(f"m{n[1:]}.{n}").alias(n) for n in columns])


def binned_pair_sample(rows: DataFrame, n: int, salt: str, bins: int = 20, tile_rows: int = TILE_ROWS, reach: int = 4) -> DataFrame:
    """(pair_id, bin, num, den): at most ``n`` unordered pairs of each score bin in the order of their salted hashes, with the inclusion probability num / den.

    A tile names its pairs in runs of one smaller id and one bin, and the engine hashes the names and keeps those up to the bound of the tile's bin,
    some ``reach`` times ``n`` of them. Should a bin not have ``n`` pairs up to its least bound, the bounds widen. Pairs are named by their smaller and larger id.
    """
    chosen = None
    while chosen is None:
        found = durable(_pairs_to_bounds(rows, n * reach, salt, bins, tile_rows))
        sizes = found.groupBy("bin").agg(F.sum("n").alias("den"), F.min("bound").alias("least"))
        pairs = found.where("pair_id is not null").join(F.broadcast(sizes), "bin")
        sure = pairs.where("h <= least").groupBy("bin").agg(F.count("*").alias("sure"))
        if sizes.join(sure, "bin", "left").where(F.coalesce("sure", F.lit(0)) < F.least(F.lit(n), "den")).isEmpty():
            chosen = pairs.withColumn("draw", F.row_number().over(Window.partitionBy("bin").orderBy("h"))).where(F.col("draw") <= n)
        reach *= 64
    return chosen.select("pair_id", "bin", F.least(F.lit(n).cast("long"), F.col("den")).alias("num"), "den")


def _pairs_to_bounds(rows: DataFrame, wanted: int, salt: str, bins: int, tile_rows: int) -> DataFrame:
    """(bin, pair_id, h, n, bound): pairs of each tile and bin with a hash up to the bound that about ``wanted`` of them meet, and a row without a pair for their number."""
    schema = pa.schema([("bin", pa.int32()), ("head", pa.string()), ("bound", pa.string()), ("tails", pa.list_(pa.string())), ("n", pa.int64())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _Tile(pa.Table.from_batches(batches), True)
        tile.left, tile.right = (x[np.argsort(tile.ids[x], kind="stable")] for x in (tile.left, tile.right))
        names = [str(x) for x in tile.ids.tolist()]
        heads, tails = pa.array([f"{x}|" for x in names], pa.string()), pa.array(names, pa.string())

        def runs(near: np.ndarray, far: np.ndarray, place: np.ndarray, here: np.ndarray, bounds: pa.Array) -> pa.RecordBatch:
            """The pairs of ``here`` in order of bin and near row, a row for each of both."""
            at = np.flatnonzero(here)
            order = np.argsort(place.ravel()[at], kind="stable")
            at = at[order]
            u = np.repeat(np.arange(len(near)), np.count_nonzero(here, axis=1))[order]
            b = place.ravel()[at]
            start = np.flatnonzero((np.diff(u, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
            bin_of = pa.array(b[start].astype(np.int32))
            pairs = pa.ListArray.from_arrays(pa.array(np.append(start, len(at)), pa.int32()), tails.take(pa.array(far[at - u * len(far)])))
            return pa.RecordBatch.from_arrays([bin_of, heads.take(pa.array(near[u[start]])), bounds.take(bin_of), pairs, pa.array(np.zeros(len(start), np.int64))], schema=schema)

        places = [(part, tile.places(part, near, bins).astype(np.int8)) for part, near in tile.chunks()]
        counts = sum((np.bincount(x.ravel(), minlength=bins + 1) for _, x in places), np.zeros(bins + 1, np.int64))[:bins]
        some = np.flatnonzero(counts)
        bound = pa.array([hash_bound(min(Fraction(1), Fraction(wanted, max(1, c)))) for c in counts.tolist()])
        none = [None] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(none, pa.string()), bound.take(pa.array(some)), pa.array(none, schema.field("tails").type), pa.array(counts[some])], schema=schema)
        for part, place in places:
            first = tile.ids[part][:, None] < tile.ids[tile.right][None, :]
            yield runs(part, tile.right, place, first, bound)
            if not tile.twice:
                yield runs(tile.right, part, np.ascontiguousarray(place.T), ~first.T, bound)

    count = _buckets(rows, tile_rows)
    # Tiles are long tasks, so each is one: dealt to twice as many partitions as there are tiles.
    dealt = _tiles(rows, count, None).repartition(min(count * (count + 1), 4096), "ti", "tj")
    found = dealt.groupBy("ti", "tj").applyInArrow(name, "bin int, head string, bound string, tails array<string>, n long")
    pairs = found.select("bin", "head", "bound", "n", F.explode_outer("tails").alias("tail"))
    pair = F.concat("head", "tail")
    return pairs.where(F.col("tail").isNull() | (salted_hash(salt, pair) <= F.col("bound"))).select("bin", pair.alias("pair_id"), salted_hash(salt, pair).alias("h"), "n", "bound")


def pair_counts(rows: DataFrame, cuts: list[float], strict: bool = True, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row with n0, n1, …: unordered pairs with a score over (or, not strict, at least) each cut. Tiles send counts, never pairs."""

    def count(table: pa.Table) -> pa.Table:
        tile = _Tile(table, True)
        total = np.zeros(len(cuts), np.int64)
        for part, near in tile.chunks():
            for i, cut in enumerate(cuts):
                total[i] += np.count_nonzero(near > cut + 1e-9)
                u, v = np.nonzero(np.abs(near - cut) <= 1e-9)
                score = tile.exact(part[u], tile.right[v])
                total[i] += np.count_nonzero(score > cut if strict else score >= cut)
        return pa.table({"i": pa.array(np.arange(len(cuts), dtype=np.int32)), "n": pa.array(total)})

    counts = _dealt(rows, None, tile_rows).groupBy("ti", "tj").applyInArrow(count, "i int, n long")
    return counts.agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(len(cuts))])


def tail_census(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """(cut, n_pairs): pairs over each cut, in one pass."""
    counts = pair_counts(rows, cuts)
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"n{i}").alias("n_pairs")) for i, c in enumerate(cuts)])).alias("x")).select("x.*")


def score_histogram(rows: DataFrame, bins: int = 20, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(bin, n_pairs) of the bins of [-1, 1] that aren't empty. Tiles send counts, never pairs."""

    def count(table: pa.Table) -> pa.Table:
        tile = _Tile(table, True)
        total = np.zeros(bins + 1, np.int64)
        for part, near in tile.chunks():
            total += np.bincount(tile.places(part, near, bins).ravel(), minlength=bins + 1)
        some = np.flatnonzero(total[:bins])
        return pa.table({"bin": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    found = _dealt(rows, None, tile_rows).groupBy("ti", "tj").applyInArrow(count, "bin int, n long")
    return found.groupBy("bin").agg(F.sum("n").alias("n_pairs"))


def blocker_edges(rows: DataFrame, tau: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(rid, rown, bid, bown, score): every record with each earlier record within ``tau``, and their units."""
    pairs = theta_pairs(rows, tau, tile_rows=tile_rows)
    return pairs.select(F.col("lid").alias("rid"), F.col("lunit").alias("rown"), F.col("rid").alias("bid"), F.col("runit").alias("bown"), "score")


def signature_candidates(rows: DataFrame, tables: list[list[list[int]]]) -> DataFrame:
    """(a, b), a < b: pairs that share a signature in any table, each once. A signature's rows meet by an equi join."""
    signed = rows.select("id", F.posexplode(F.array(*[plane_signature(F.col("z"), t) for t in tables])).alias("tab", "sig"))
    other = signed.select(F.col("id").alias("b"), "tab", "sig")
    return signed.select(F.col("id").alias("a"), "tab", "sig").join(other, ["tab", "sig"]).where("a < b").select("a", "b").distinct()


def signature_hits(pairs: DataFrame, rows: DataFrame, tables: list[list[list[int]]], a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with ``hit``: whether both ends share a signature in any table. Each end's signatures come by its id, so candidates aren't made."""
    signs = rows.select("id", F.array(*[plane_signature(F.col("z"), t) for t in tables]).alias("signs"))
    side = lambda c: signs.select(F.col("id").alias(c), F.col("signs").alias(f"_{c}"))
    same = F.exists(F.zip_with(f"_{a}", f"_{b}", lambda x, y: x == y), lambda x: x)
    return pairs.join(side(a), a).join(side(b), b).withColumn("hit", same).drop(f"_{a}", f"_{b}")


def retrieval_audit(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row on the graph that is left of the exact one, edges (rid, bid, hit): edges and those found, records with all of their blockers found, of all records and of those that have some, and records that only one of the two selects at first."""
    each = found.groupBy("rid").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("k"))
    each = rows.select(F.col("id").alias("rid")).join(each, "rid", "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    whole = F.col("n") == F.col("k")
    sums = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_found"), F.count("*").alias("n_records"), count(whole).alias("complete_records"), count(F.col("n") > 0).alias("nonempty_records"),
        count(whole & (F.col("n") > 0)).alias("nonempty_complete"), count((F.col("n") > 0) & (F.col("k") == 0)).alias("selection_difference"),
    )
    rate = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return sums.select("n_edges", "n_found", rate("n_found", "n_edges").alias("recall"), "complete_records", rate("complete_records", "n_records").alias("complete_rate"), rate("nonempty_complete", "nonempty_records").alias("nonempty_complete_rate"), "selection_difference")


def nearest(queries: DataFrame, candidates: DataFrame, tile_rows: int = TILE_ROWS, keep_self: bool = True) -> DataFrame:
    """(lid, rid, score) of the candidate with the largest score, the smaller id on ties; without ``keep_self`` of another id. A tile sends one row for each of its queries."""
    kind = dict(queries.dtypes)["id"]

    def best(table: pa.Table) -> pa.Table:
        tile = _Tile(table, False)
        lid, rid, top = [], [], []
        for part, near in tile.chunks():
            if not keep_self:
                near[tile.ids[part][:, None] == tile.ids[tile.right][None, :]] = -np.inf
            if near.shape[1]:
                u, v = np.nonzero((near >= near.max(axis=1, keepdims=True) - 1e-9) & (near > -np.inf))
                score = tile.exact(part[u], tile.right[v])
                order = np.lexsort((tile.ids[tile.right[v]], -score, u))
                first = order[np.unique(u[order], return_index=True)[1]]
                lid.append(part[u[first]])
                rid.append(tile.right[v[first]])
                top.append(score[first])
        at = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        ids = table["id"].combine_chunks()
        return pa.table({"lid": ids.take(at(lid)), "rid": ids.take(at(rid)), "score": pa.array(np.concatenate(top) if top else np.zeros(0))})

    found = _dealt(queries, candidates, tile_rows).groupBy("ti", "tj").applyInArrow(best, f"lid {kind}, rid {kind}, score double")
    top = found.groupBy("lid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("rid").alias("rid"))).alias("m"))
    return top.select("lid", F.col("m.rid").alias("rid"), (-F.col("m.s")).alias("score"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): smallest node reachable, for every node of a link. Minima spread along links and jump through labels until nothing changes."""
    both = durable(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = durable(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels.node == near.x).select("node", F.least("label", "m").alias("label"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = durable(spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label")))
        moved = after.alias("n").join(labels.alias("o"), "node").where("n.label <> o.label").limit(1).count()
        if not moved:
            return after
        labels = after


def cluster_ranks(rows: DataFrame, cluster: str, policy: str = "easy", salt: str = "cluster") -> DataFrame:
    """(id, rank): the order in a cluster by closeness to its centroid, then id: ``easy`` nearest first, ``hard`` farthest first; ``random`` is hash order."""
    if policy == "random":
        return rows.select("id", F.row_number().over(Window.partitionBy(cluster).orderBy(salted_hash(salt, F.col("id")), "id")).alias("rank"))
    spread = rows.select("id", cluster, F.posexplode("z").alias("pos", "x"))
    centre = spread.groupBy(cluster, "pos").agg(F.avg("x").alias("m"))
    near = spread.join(centre, [cluster, "pos"]).groupBy("id", cluster).agg(F.round(F.sum(F.col("x") * F.col("m")), 9).alias("sim"))
    order = {"easy": F.desc("sim"), "hard": F.asc("sim")}[policy]
    return near.select("id", F.row_number().over(Window.partitionBy(cluster).orderBy(order, "id")).alias("rank"))


def cluster_suppression(rows: DataFrame, cluster: str, tau: float, ranked: DataFrame | None = None) -> DataFrame:
    """(id, top): rows whose largest score with an earlier row of their cluster is over ``tau``, in the order of ``ranked`` or else of these rows."""
    ranked = cluster_ranks(rows, cluster) if ranked is None else ranked
    pairs = theta_pairs(rows.select("id", F.col(cluster).alias("unit"), "p", "z"), tau, within="unit")
    side = lambda c: ranked.select(F.col("id").alias(c), F.col("rank").alias(f"{c}_rank"))
    placed = pairs.join(side("lid"), "lid").join(side("rid"), "rid")
    late = F.when(F.col("lid_rank") > F.col("rid_rank"), F.col("lid")).otherwise(F.col("rid"))
    return placed.groupBy(late.alias("id")).agg(F.max("score").alias("top"))


def admission_contexts(rows: DataFrame, edges: DataFrame, deleted: DataFrame, chosen: DataFrame, came: DataFrame) -> DataFrame:
    """(id, former, former_score, survivor, survivor_score) of each record that a deletion admits: its closest deleted blocker, and the closest other record selected after it, the smaller id on ties."""
    gone = edges.join(deleted.select(F.col("unit").alias("bown")), "bown", "left_semi").join(came.select(F.col("id").alias("rid")), "rid", "left_semi")
    former = gone.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("s"), "bid")).alias("m")).select(F.col("rid").alias("id"), F.col("m.bid").alias("former"), (-F.col("m.s")).alias("former_score"))
    full = rows.select("id", "unit", "p", "z")
    near = nearest(full.join(came.select("id"), "id", "left_semi"), full.join(chosen.select("id"), "id", "left_semi"), keep_self=False)
    return former.join(near.select(F.col("lid").alias("id"), F.col("rid").alias("survivor"), F.col("score").alias("survivor_score")), "id", "left")
