"""Session defaults and the helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join up to this many rows may be broadcast; the size is checked first.
SMALL_ROWS = 100_000

TUNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(master: str = "local[8]", app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with the engine's defaults; anything in ``conf`` wins."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**TUNING, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers once per context, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_quill_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quill-")) / f"{here.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(path))  # Spark copies it to every executor
    context._quill_shipped = True


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{base}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.environ.get("QUILL_CHECKPOINTS") or tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after the size was checked; else leave the join to Catalyst."""
    return F.broadcast(df) if is_small(df, rows) else df


def dedup(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """One row per key over the needed columns. Repeats are equal in those columns."""
    return df.select(*dict.fromkeys([*keys, *columns])).dropDuplicates(keys)
