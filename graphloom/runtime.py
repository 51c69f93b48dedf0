"""Scratch tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import OpenFailed

_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, unless PYTHONPATH does."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or any(Path(p).resolve() == package.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
        return
    out = Path(tempfile.mkdtemp()) / "engine.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def scratch_path(spark: SparkSession, label: str) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise OpenFailed("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{at.rstrip('/')}/graph-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def table_path(spark: SparkSession, label: str, root: str | None = None) -> str:
    """A path of its own for a table: in a store's folder, or in the scratch folder."""
    return f"{root}/tables/{label}-{uuid.uuid4().hex[:12]}" if root else scratch_path(spark, label)


def materialise_at(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder."""
    return materialise_at(df, scratch_path(df.sparkSession, label))


#: Stored bytes whose rows one task gathers. Parquet holds a quad in a few bytes, a hash table in some hundreds.
PART_BYTES = 1 << 20


def stored_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads, as their files have it; tables of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 50)


def spread(df: DataFrame, by: str, *tables: DataFrame) -> DataFrame:
    """``df`` by a column in parts whose number grows with the tables that it is made of.

    Rows that are gathered by that column then need no aggregation before the
    exchange, where a task's share is what its files unpack to, and a task
    after it holds as much whatever the size of the whole. Small ones stay as they are.
    """
    n = sum(map(stored_bytes, tables)) // PART_BYTES
    return df.repartition(n, by) if n > 1 else df


def sweep(spark: SparkSession) -> None:
    """Deletes this application's scratch tables, once no snapshot or result reads them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x").rsplit("/", 1)[0])
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
