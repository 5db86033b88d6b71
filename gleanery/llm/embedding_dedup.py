"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into blocks of a few dimensions. Two vectors within squared
distance r differ in some block by its proportional share of r at most, so per block a range join under that budget
finds every pair. In a block, rows are dealt over strips of its first coordinate, twice a budget's radius wide; rows that
close to a border go to the strip nearer the middle, too. Dense strips are cut into a grid of bounded tiles. In a tile, rows
fall into boxes by halving the widest coordinate, and boxes farther apart than the budget aren't compared.

Turned vectors travel as 16-bit numbers. From these a pair's cosine is known to a few ten-thousandths, and whether it is in the first
block that finds it exactly, so the union needs no exchange of pairs: tiles give counts per vector and a spanning forest of the links. The few
pairs within rounding of the threshold are verified in double precision from the vectors themselves; a tile with very many of them
is joined again, from its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpoint, spanning_links
from gleanery.llm.components import connected_components, with_least

BLOCK_DIMS = 16
#: Rows that one side of a tile holds, about.
TILE_ROWS = 65536
#: Rows in a box of a tile, about.
BOX_ROWS = 1024
#: Coordinates travel as whole numbers of this part of the unit.
SCALE = 32767
#: Pairs for each of its rows that a tile may leave to be verified elsewhere; with more it is joined again from its whole vectors.
UNSURE = 8
#: Rounding of single-precision products; adds candidates and loses none.
SLACK = 1e-5

_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if dims not in _ROTATIONS:
        _ROTATIONS[dims] = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]
    return _ROTATIONS[dims]


def blocks_of(dims: int) -> list[tuple[int, int]]:
    n = max(1, round(dims / BLOCK_DIMS))
    edges = [dims * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: str):
    """Whether a vector can link: not null or empty, no null or non-finite component, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def codes_of(x: np.ndarray) -> np.ndarray:
    """Unit vectors, turned and rounded to 16 bits."""
    return np.rint((x @ rotation(x.shape[1])) * SCALE).astype(np.int16)


class Budget:
    """What two codes of a length may differ by: per block, and in their product."""

    def __init__(self, dims: int, cosine: float):
        self.blocks = blocks_of(dims)
        half = 0.5 / SCALE
        #: Radii of the blocks between codes: a rounding for each end is added.
        self.radius = [np.sqrt((2.0 - 2.0 * cosine) * (hi - lo) / dims) + 2 * half * np.sqrt(hi - lo) + 1e-9 for lo, hi in self.blocks]
        unsure = 2 * half * np.sqrt(dims) + dims * half * half + 1e-9
        self.least, self.sure = (cosine - unsure) * SCALE**2, (cosine + unsure) * SCALE**2


def _strips(first: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of first coordinates: the strip, the strip nearer the middle, and whether the border to it is within the radius."""
    width = 2 * radius
    strip = np.floor(first / width + 0.5).astype(np.int64)
    inner = strip - np.sign(strip)
    return strip, inner, (strip != 0) & (np.abs(first) - (np.abs(strip) - 0.5) * width <= radius)


FOUND = "kind int, a long, b long, n long, dims int, block int, strip long, ti int, tj int"
#: What a tile finds: linked weight of a vector, a link of the forest, a pair to verify, and a row of a tile to be joined again.
COUNT, LINK, PAIR, AGAIN = range(4)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(node, n) partial counts of linked weight, and (a, b) links that join all that is linked, for a table of distinct vectors (node long, weight long, vector)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strips of each vector in each block, with its codes."""
        for batch in batches:
            for dims, rows in _by_length(batch):
                codes = codes_of(unit(_matrix(batch.column("vector").take(pa.array(rows)), dims)))
                held = [batch.column(c).take(pa.array(rows)) for c in ("node", "weight")]
                binary = pa.array([c.tobytes() for c in codes], pa.binary())
                budget, n = Budget(dims, cosine), len(rows)
                for b, (lo, _) in enumerate(budget.blocks):
                    strip, inner, border = _strips(codes[:, lo] / SCALE, budget.radius[b])
                    yield pa.RecordBatch.from_arrays(
                        [*held, binary, pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(strip), pa.array(inner, mask=~border)],
                        names=["node", "weight", "codes", "dims", "block", "strip", "inner"],
                    )

    placed = vectors.select("node", "weight", "vector").mapInArrow(place, "node long, weight long, codes binary, dims int, block int, strip long, inner long")
    # A row for each length, block and strip of [-1, 1]: some five strips a block, whatever the rows.
    counts = placed.groupBy("dims", "block", "strip", "inner").agg(F.count("*").alias("n")).collect()
    homes: dict[tuple, int] = {}
    borders: dict[tuple, int] = {}
    for r in counts:
        homes[r["dims"], r["block"], r["strip"]] = homes.get((r["dims"], r["block"], r["strip"]), 0) + r["n"]
        if r["inner"] is not None:
            borders[r["dims"], r["block"], r["inner"]] = borders.get((r["dims"], r["block"], r["inner"]), 0) + r["n"]
    spark = vectors.sparkSession
    if not homes:
        empty = spark.createDataFrame([], "node long, n long, a long, b long")
        return empty.select("node", "n"), empty.select("a", "b")
    grid = spark.createDataFrame([(*k, -(-n // tile_rows), max(1, -(-borders.get(k, 0) // tile_rows))) for k, n in homes.items()], "dims int, block int, strip long, parts int, outer int")
    # Tiles (i, j): parts i and j of a strip's rows, i = j with the first part of its border rows, or j past its parts with another of these.
    draw = F.xxhash64(F.lit(7), "node")
    tile = lambda i, j, role: F.struct(i.cast("int").alias("ti"), j.cast("int").alias("tj"), F.lit(role).cast("byte").alias("role"))
    upto = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    zero, one, part, parts, outer = F.lit(0), F.lit(1), F.col("part"), F.col("parts"), F.col("outer")
    home = placed.join(F.broadcast(grid), ["dims", "block", "strip"]).withColumn("part", F.pmod(draw, parts).cast("int"))
    home = home.withColumn("tiles", F.concat(F.transform(upto(zero, part - 1), lambda i: tile(i, part, 1)), F.transform(upto(part, parts - 1), lambda j: tile(part, j, 0)), F.transform(upto(one, outer - 1), lambda p: tile(part, parts + p, 0))))
    border = placed.where("inner is not null").drop("strip").withColumnRenamed("inner", "strip").join(F.broadcast(grid), ["dims", "block", "strip"]).withColumn("part", F.pmod(draw, outer).cast("int"))
    border = border.withColumn("tiles", F.transform(upto(zero, parts - 1), lambda i: tile(i, F.when(part == 0, i).otherwise(parts + part), 1)))
    keys = ["dims", "block", "strip", "ti", "tj"]
    both = home.drop("inner").union(border.select(*home.drop("inner").columns)).withColumn("t", F.explode("tiles")).select("dims", "block", "strip", "t.ti", "t.tj", "t.role", "node", "weight", "codes")

    def join(table: pa.Table) -> pa.Table:
        return _found(table, cosine, None)

    def join_again(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        return _found(table, cosine, unit(_matrix(table["vector"].combine_chunks(), dims)))

    found = checkpoint(both.groupBy(*keys).applyInArrow(join, FOUND))
    full = vectors.select(F.col("node").alias("a"), "weight", "vector")
    again = found.where(F.col("kind") == AGAIN)
    if not again.isEmpty():
        rows = again.select(*keys, F.col("n").cast("byte").alias("role"), "a").join(full, "a").withColumnRenamed("a", "node")
        found = found.union(checkpoint(rows.groupBy(*keys).applyInArrow(join_again, FOUND)))
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").join(full, "a").withColumnsRenamed({"weight": "weight_a", "vector": "vector_a"})
    pairs = pairs.join(full.withColumnsRenamed({"a": "b", "weight": "weight_b", "vector": "vector_b"}), "b")
    kinds = dict(vectors.dtypes)["vector"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = {c: np.asarray(batch.column(c)) for c in ("a", "b", "weight_a", "weight_b")}
            for dims, rows in _by_length(batch, "vector_a"):
                x, y = (unit(_matrix(batch.column(c).take(pa.array(rows)), dims)) for c in ("vector_a", "vector_b"))
                at = rows[np.einsum("ij,ij->i", x, y) >= cosine]
                yield pa.RecordBatch.from_arrays([pa.array(ends[c][at]) for c in ends], names=list(ends))

    true = pairs.select("a", "b", "weight_a", "weight_b", F.col("vector_a").cast(kinds), "vector_b").mapInArrow(verify, "a long, b long, weight_a long, weight_b long")
    true = checkpoint(true)
    more = true.select(F.col("a").alias("node"), F.col("weight_b").alias("n")).union(true.select("b", "weight_a"))
    return found.where(F.col("kind") == COUNT).select(F.col("a").alias("node"), "n").union(more), found.where(F.col("kind") == LINK).select("a", "b").union(true.select("a", "b"))


def _by_length(batch: pa.RecordBatch, column: str = "vector"):
    lengths = np.asarray(pc.list_value_length(batch.column(column)))
    for dims in np.unique(lengths).tolist():
        yield dims, np.flatnonzero(lengths == dims)


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(-1, dims)


def _found(table: pa.Table, cosine: float, whole: np.ndarray | None) -> pa.Table:
    """What a tile finds, as rows of FOUND; ``whole`` are its unit vectors where it is joined again."""
    key = [table[c][0].as_py() for c in ("dims", "block", "strip", "ti", "tj")]
    nodes, weights, role = (np.asarray(table[c].combine_chunks()) for c in ("node", "weight", "role"))
    codes = codes_of(whole) if whole is not None else np.frombuffer(b"".join(table["codes"].to_pylist()), np.int16).reshape(-1, key[0])
    tile = Tile(codes, nodes, weights, key[1], cosine, whole)
    done = tile.join(np.flatnonzero(role == 0), np.flatnonzero(role == 1), key[3] == key[4])
    none = np.zeros(0, np.int64)
    if not done:
        parts = [(AGAIN, nodes, np.zeros_like(nodes), role.astype(np.int64))]
    else:
        some = np.flatnonzero(tile.counts)
        a, b = tile.forest()
        u, v = (np.concatenate([none, *x]) for x in ((p for p, _ in tile.unsure), (q for _, q in tile.unsure)))
        parts = [(COUNT, nodes[some], np.zeros_like(some), tile.counts[some]), (LINK, a, b, np.zeros_like(a)), (PAIR, nodes[u], nodes[v], np.zeros_like(u))]
    kind = np.concatenate([np.full(len(x), k, np.int32) for k, x, _, _ in parts])
    columns = [pa.array(kind), *[pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in (1, 2, 3)]]
    columns += [pa.array(np.full(len(kind), x, t)) for x, t in zip(key, (np.int32, np.int32, np.int64, np.int32, np.int32), strict=True)]
    return pa.table(columns, names=["kind", "a", "b", "n", "dims", "block", "strip", "ti", "tj"])


class Tile:
    """The range join of one block between rows of a tile."""

    def __init__(self, codes: np.ndarray, nodes: np.ndarray, weights: np.ndarray, block: int, cosine: float, whole: np.ndarray | None):
        self.codes, self.nodes, self.weights, self.block, self.cosine, self.whole = codes, nodes, weights, block, cosine, whole
        self.budget = Budget(codes.shape[1], cosine)
        lo, hi = self.budget.blocks[block]
        self.own = (codes[:, lo:hi] / SCALE).astype(np.float32)
        squares = (self.own * self.own).sum(axis=1)
        ones = np.ones_like(squares)
        # The product of these is the squared distance in the block.
        self.near = np.column_stack((self.own, squares, ones))
        self.far = np.column_stack((-2 * self.own, ones, squares))
        self.counts = np.zeros(len(nodes), np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.unsure: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.open = 0

    def boxes(self, rows: np.ndarray) -> list[np.ndarray]:
        """The rows by halves of their widest coordinate, until a box holds few."""
        out, work = [], [rows] if len(rows) else []
        while work:
            some = work.pop()
            if len(some) <= BOX_ROWS:
                out.append(some)
                continue
            x = self.own[some]
            wide = np.ptp(x, axis=0).argmax()
            order = np.argpartition(x[:, wide], len(some) // 2)
            work += [some[order[: len(some) // 2]], some[order[len(some) // 2 :]]]
        return out

    def join(self, left: np.ndarray, right: np.ndarray, own: bool) -> bool:
        """Left rows with right ones and, if ``own``, with each other; False where too many pairs are unsure."""
        a, b = self.boxes(left), self.boxes(right)
        every = a + b
        sides = [(self.own[x].min(axis=0), self.own[x].max(axis=0)) for x in every]
        for i, x in enumerate(a):
            for j in [*(range(i, len(a)) if own else ()), *range(len(a), len(a) + len(b))]:
                apart = np.maximum(0, np.maximum(sides[i][0] - sides[j][1], sides[j][0] - sides[i][1]))
                if (apart * apart).sum() <= self.budget.radius[self.block] ** 2 + SLACK:
                    self._compare(x, every[j], i == j)
                    if self.whole is None and self.open > UNSURE * len(self.nodes) + 1024:
                        return False
        return True

    def _compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        close = self.near[a] @ self.far[b].T <= np.float32(self.budget.radius[self.block] ** 2 + SLACK)
        if same:
            close = np.triu(close, 1)
        n = np.count_nonzero(close)
        if n > close.size // 50:
            x, y = (self.codes[at].astype(np.float32) for at in (a, b))
            close &= x @ y.T >= np.float32(self.budget.least - 1e-4 * SCALE**2)
        i, j = np.nonzero(close)
        for k in range(0, len(i), 1 << 15):
            self._take(a[i[k : k + (1 << 15)]], b[j[k : k + (1 << 15)]])

    def _take(self, u: np.ndarray, v: np.ndarray) -> None:
        """Counts the pairs that link and that no earlier block finds. Sums of whole numbers, so every tile decides alike."""
        x, y = self.codes[u].astype(np.float64), self.codes[v].astype(np.float64)
        product = np.einsum("ij,ij->i", x, y)
        apart = (x - y) ** 2
        keep = product >= self.budget.least
        for at, (lo, hi) in enumerate(self.budget.blocks[: self.block + 1]):
            within = apart[:, lo:hi].sum(axis=1) <= (self.budget.radius[at] * SCALE) ** 2
            keep &= within if at == self.block else ~within
        u, v, sure = u[keep], v[keep], product[keep] >= self.budget.sure
        if self.whole is not None:
            good = np.einsum("ij,ij->i", self.whole[u], self.whole[v]) >= self.cosine
            u, v = u[good], v[good]
        elif not sure.all():
            self.unsure.append((u[~sure], v[~sure]))
            self.open += np.count_nonzero(~sure)
            u, v = u[sure], v[sure]
        np.add.at(self.counts, u, self.weights[v])
        np.add.at(self.counts, v, self.weights[u])
        self.links.append((self.nodes[u], self.nodes[v]))
        self.held += len(u)
        if self.held > 1 << 21:
            self.links, self.held = [self.forest()], 0

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return spanning_links(*(np.concatenate([none, *side]) for side in ([p for p, _ in self.links], [q for _, q in self.links])))


def embedding_groups(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Rows link from cosine ``cosine`` on, in double precision. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different length. Equal vectors collapse to one node
    with a weight, so that copies are never paired. n_links counts linked rows; component_id is the smallest id
    reachable, the row's own included; null ids don't count for it. Repeated rows are linked copies; other columns are left out, whatever
    their names. An empty table gives no rows.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector")).withColumn("usable", usable("vector"))
    # Equal vectors are told by two independent hashes; their node is a number that is fixed by being written.
    good = rows.where("usable").withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    classes = good.groupBy("h1", "h2", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
    classes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    counts, links = near_vectors(classes.select("node", "weight", "vector"), cosine, tile_rows)
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected_components(links)
    nodes = classes.select("node", "h1", "h2", "weight", "first_id").join(counts, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = with_least(nodes, "label", "node", "first_id").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    out = good.select("vec_id", "h1", "h2").join(nodes, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
