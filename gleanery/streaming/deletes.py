"""Repair of a curated selection under a stream of deletion requests.

State is two versioned tables: the records still alive and not selected with their live blocker units, and the ids selected.
A micro-batch is a set of units, so the order within it can't matter; it touches only records that a deleted unit owns
or blocks. Each batch writes the next version, and a batch that comes again finds its version written and does nothing.

An indexed state writes what a batch changes, and reads only the part of its index that may hold the batch's units. A certified
state releases weights with the version that they belong to, or neither.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.exact import ridge_certificate
from gleanery.operators.exact_states import evaluate_exact, exact_matrix, exact_polynomial, substitute_exact
from gleanery.operators.moments import packed_moments
from gleanery.operators.selection import eligible, initial_selection, validate_request
from gleanery.operators.structure import count_polynomial
from gleanery.session import durable


class VersionedState:
    """Tables in a folder for each version; a version counts once its mark is written, after its tables."""

    def __init__(self, spark: SparkSession, path: str, horizon: int, mode: str = "idempotent"):
        self.spark, self.path, self.horizon, self.mode = spark, path, horizon, mode

    def _folder(self, version: int, name: str) -> str:
        return f"{self.path}/v{version}/{name}"

    def _read(self, version: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(version, name))

    def _exists(self, version: int) -> bool:
        j = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(version, "done"))
        return j.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(j)

    def _write(self, version: int, **tables: DataFrame) -> None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(self._folder(version, name))
        self.spark.range(1).write.mode("overwrite").parquet(self._folder(version, "done"))


class DeletionState(VersionedState):
    """Blocked records within the horizon as (rid, rown, bown), and the selection as (id, unit)."""

    def create(self, rows: DataFrame, edges: DataFrame) -> None:
        """Version 0. Only records that the horizon can admit keep their blockers."""
        fit = eligible(rows, edges, self.horizon).select(F.col("id").alias("rid"))
        blocked = edges.join(fit, "rid", "left_semi").select("rid", "rown", "bown").distinct()
        self._write(0, blocked=blocked, selected=initial_selection(rows, edges).select("id", "unit"), units=rows.select("unit").distinct(), deleted=rows.select("unit").limit(0))

    def apply(self, version: int, request: DataFrame) -> None:
        """Version + 1 from a request of units. The horizon only falls, and records over what is left of it are pruned."""
        if self._exists(version + 1):
            return
        blocked, selected, units, deleted = (self._read(version, n) for n in ("blocked", "selected", "units", "deleted"))
        fresh = validate_request(units, request, self.horizon, deleted, self.mode)
        gone = fresh.select("unit")
        alive = blocked.join(gone.withColumnRenamed("unit", "rown"), "rown", "left_anti")
        still = alive.join(gone.withColumnRenamed("unit", "bown"), "bown", "left_anti")
        opened = alive.select("rid", "rown").distinct().join(still.select("rid").distinct(), "rid", "left_anti")
        after = deleted.union(gone)
        left = self.horizon - deleted.count() - gone.count()
        within = still.groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") <= left).select("rid")
        chosen = selected.join(gone, "unit", "left_anti").select("id", "unit").union(opened.select(F.col("rid").alias("id"), F.col("rown").alias("unit")))
        self._write(version + 1, blocked=still.join(within, "rid", "left_semi").select("rid", "rown", "bown"), selected=chosen, units=units, deleted=after)

    def selection(self, version: int) -> DataFrame:
        return self._read(version, "selected")

    def moments(self, version: int, payload: DataFrame, vector: str, target: str) -> DataFrame:
        """Packed moments of a version's selection, made on release from (id, vector, target): the state itself holds none."""
        return packed_moments(payload.join(self.selection(version).select("id"), "id", "left_semi"), vector, target)

    def follow(self, requests: DataFrame, checkpoint: str):
        """A streaming query that applies each micro-batch of (unit) as the next version."""
        return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, at: self.apply(at, batch.select("unit"))).trigger(availableNow=True).start()


class ExactState(VersionedState):
    """An exact polynomial under batches of deletions. A batch is checked as a whole before any table of its version is written."""

    def create(self, rows: DataFrame, found: DataFrame, stats: DataFrame, bits: int) -> None:
        polynomial = exact_polynomial(found, stats, bits, self.horizon)
        self._write(0, polynomial=polynomial, units=rows.select("unit").distinct(), deleted=rows.select("unit").limit(0))

    def apply(self, version: int, request: DataFrame) -> None:
        """Version + 1 from a request of units, of which the horizon bounds the number."""
        if self._exists(version + 1):
            return
        polynomial, units, deleted = (self._read(version, n) for n in ("polynomial", "units", "deleted"))
        fresh = validate_request(units, request, self.horizon, deleted, self.mode)
        gone = [r["unit"] for r in fresh.collect()]
        moved = substitute_exact(polynomial, gone, self.horizon - deleted.count())
        self._write(version + 1, polynomial=moved, units=units, deleted=deleted.union(fresh))

    def moments(self, version: int) -> DataFrame:
        """(i, j, coefficient) of the records that the version selects."""
        return evaluate_exact(self._read(version, "polynomial"), [])


class IndexedState(VersionedState):
    """A count polynomial whose versions are changes: (key, change) by the size of keys, and an index (unit, key, change) by buckets of units.

    A deletion moves each key that holds a deleted unit to the key without it: it reads the index of its units, writes the moves, and
    leaves all other keys alone. Keys that cancel, and keys over what is left of the horizon, are dead weight until changes since the
    base exceed ``compact`` of its rows; then the version is written whole, as the next base.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, horizon: int, mode: str = "idempotent", compact: float = 0.5):
        super().__init__(spark, path, horizon, mode)
        self.compact = compact

    def create(self, rows: DataFrame, found: DataFrame) -> None:
        cells = durable(count_polynomial(found, self.horizon).withColumnRenamed("coefficient", "change"))
        self._write_cells(0, cells)
        self._write(0, about=self._about(0, cells.count(), 0), units=rows.select("unit").distinct(), deleted=rows.select("unit").limit(0))

    def _about(self, base: int, base_rows: int, changed: int) -> DataFrame:
        return self.spark.createDataFrame([(base, base_rows, changed)], "base int, base_rows long, changed long")

    def _write_cells(self, version: int, cells: DataFrame) -> None:
        cells.withColumn("size", F.size("key")).repartition("size").write.mode("overwrite").partitionBy("size").parquet(self._folder(version, "cells"))
        index = cells.select(F.explode("key").alias("unit"), "key", "change").withColumn("at", self._bucket())
        index.repartition("at").sortWithinPartitions("unit").write.mode("overwrite").partitionBy("at").parquet(self._folder(version, "index"))

    def _bucket(self):
        return F.pmod(F.xxhash64("unit"), F.lit(self.BUCKETS)).cast("int")

    def _since_base(self, version: int, name: str) -> DataFrame:
        kinds = {"cells": "key {0}, change long, size int", "index": "unit {1}, key {0}, change long, at int"}
        unit = dict(self._read(0, "units").dtypes)["unit"]
        schema = kinds[name].format(f"array<{unit}>", unit)  # tables without rows have no files to tell it
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(self._folder(v, name)) for v in range(self._read(version, "about").first()["base"], version + 1)])

    def left(self, version: int) -> int:
        return self.horizon - self._read(version, "deleted").count()

    def polynomial(self, version: int) -> DataFrame:
        """(key, coefficient) of a version, zeros dropped."""
        cells = self._since_base(version, "cells").where(F.col("size") <= self.left(version))
        return cells.groupBy("key").agg(F.sum("change").alias("coefficient")).where("coefficient <> 0")

    def n_selected(self, version: int) -> int:
        """The coefficient of the empty key; other sizes aren't read."""
        return self._since_base(version, "cells").where("size = 0").agg(F.coalesce(F.sum("change"), F.lit(0)).alias("n")).first()["n"]

    def apply(self, version: int, request: DataFrame) -> None:
        """Version + 1 from a request of units, checked as a whole before anything is written."""
        if self._exists(version + 1):
            return
        about, units, deleted = self._read(version, "about").first(), self._read(version, "units"), self._read(version, "deleted")
        fresh = validate_request(units, request, self.horizon, deleted, self.mode)
        gone = [(r["unit"], r["at"]) for r in fresh.withColumn("at", self._bucket()).collect()]  # the horizon bounds them
        held = self._since_base(version, "index").where(F.col("at").isin(sorted({at for _, at in gone})) & F.col("unit").isin([u for u, _ in gone]) & (F.size("key") <= self.left(version)))
        held = held.groupBy("unit", "key").agg(F.sum("change").alias("change")).where("change <> 0").dropDuplicates(["key"])
        without = F.array_except("key", F.array(*[F.lit(u) for u, _ in gone]).cast(dict(held.dtypes)["key"]))
        moves = held.select(F.explode(F.array(F.struct("key", (-F.col("change")).alias("change")), F.struct(without.alias("key"), "change"))).alias("m")).select("m.*")
        moves = durable(moves.groupBy("key").agg(F.sum("change").alias("change")).where("change <> 0"))
        base, base_rows, changed = about["base"], about["base_rows"], about["changed"] + moves.count()
        self._write_cells(version + 1, moves)
        after = deleted.union(fresh)
        if changed > self.compact * base_rows:
            left = self.horizon - after.count()
            whole = self._since_base(version, "cells").select("key", "change").union(moves).where(F.size("key") <= left)
            whole = durable(whole.groupBy("key").agg(F.sum("change").alias("change")).where("change <> 0"))
            self._write_cells(version + 1, whole)
            base, base_rows, changed = version + 1, whole.count(), 0
        self._write(version + 1, about=self._about(base, base_rows, changed), units=units, deleted=after)


class CertifiedState(ExactState):
    """An exact polynomial of vectors, each with its target last, whose versions hold ridge weights with a certain bound on their error.

    A batch is repaired, solved from the weights before it, certified and written in one step: over ``tolerance`` nothing is.
    """

    def __init__(self, spark: SparkSession, path: str, horizon: int, bits: int, features: int, ridge: Fraction, tolerance: Fraction, mode: str = "idempotent"):
        super().__init__(spark, path, horizon, mode)
        self.bits, self.features, self.ridge, self.tolerance = bits, features, ridge, tolerance

    def create(self, rows: DataFrame, found: DataFrame, stats: DataFrame) -> None:
        self._release(0, durable(exact_polynomial(found, stats, self.bits, self.horizon)), [0.0] * self.features, units=rows.select("unit").distinct(), deleted=rows.select("unit").limit(0))

    def apply(self, version: int, request: DataFrame) -> None:
        if self._exists(version + 1):
            return
        polynomial, units, deleted = (self._read(version, n) for n in ("polynomial", "units", "deleted"))
        fresh = validate_request(units, request, self.horizon, deleted, self.mode)
        moved = durable(substitute_exact(polynomial, [r["unit"] for r in fresh.collect()], self.horizon - deleted.count()))
        self._release(version + 1, moved, self.weights(version), units=units, deleted=deleted.union(fresh))

    def _release(self, version: int, polynomial: DataFrame, start: list[float], **tables: DataFrame) -> None:
        matrix = exact_matrix(evaluate_exact(polynomial, []), self.features + 1, self.bits)
        gram, cross = [row[:-1] for row in matrix[:-1]], [[row[-1]] for row in matrix[:-1]]
        a = np.array([[float(x) for x in row] for row in gram]) + float(self.ridge) * np.eye(self.features)
        w = np.array(start)
        for _ in range(2):  # the residual is exact, so a step corrects the one before
            residual = [float(c[0] - self.ridge * Fraction(x) - sum(g * Fraction(y) for g, y in zip(row, w.tolist(), strict=True))) for row, c, x in zip(gram, cross, w.tolist(), strict=True)]
            w = w + np.linalg.solve(a, residual)
        bound = ridge_certificate(gram, cross, self.ridge, [[Fraction(x)] for x in w.tolist()])
        if bound > self.tolerance:
            raise ArithmeticError(f"weights are certain to {float(bound)} only; nothing is released")
        weights = self.spark.createDataFrame([(i, x, float(bound)) for i, x in enumerate(w.tolist())], "pos int, weight double, bound double")
        self._write(version, polynomial=polynomial, weights=weights, **tables)

    def weights(self, version: int) -> list[float]:
        """The weights that a version released."""
        return [r["weight"] for r in self._read(version, "weights").orderBy("pos").collect()]


def stream_requests(spark: SparkSession, path: str, schema: str = "request_id long, unit long", files: int = 1) -> DataFrame:
    """Requests from a folder of JSON lines, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
