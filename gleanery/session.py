"""Sessions, and this package on the executors' import path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for one machine, with the settings that the tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    # addPyFile copies it to every executor through the driver's file server, so the folder may be the driver's own.
    target = Path(tempfile.mkdtemp(prefix="gleanery-")) / "gleanery.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"gleanery/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the one that is set, else the one that spark.checkpoint.dir names, else on one machine a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleanery-checkpoints-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop's state, or of a table that several branches read, in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
