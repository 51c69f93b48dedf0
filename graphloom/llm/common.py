"""What the operators share: scratch tables, bounded filters, components.

Scratch tables go under ``spark.checkpoint.dir`` (a folder all executors see).
The setting is read from the session; only where it is unset, as in tests, a
folder of our own is configured.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one native bitmap of ``bitmap_construct_agg``.
BITMAP_BITS = 32768
#: A filter is never broadcast with more bits than this: 4,096 bitmaps, 32 MB as sent.
MAX_FILTER_BITS = 1 << 27

#: Characters that end a word, and the same as Spark's translate() wants them.
SPACES = " \t\n\x0b\x0c\r"

_shipped: set[str] = set()
_own_folder: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Does nothing where PYTHONPATH or the working folder already provides it;
    else a zip of the package is handed to Spark once per application.
    """
    root = Path(__file__).resolve().parents[2]
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == root for p in paths):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for scratch tables in the shared checkpoint folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _own_folder.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="scratch-")
        _own_folder[app] = at
    return f"{at.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()
_writers: dict[str, tuple[int, str]] = {}


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when a write is done; the setting comes back after the last of several writers."""
    app = spark.sparkContext.applicationId
    with _cleaning:
        n, before = _writers.get(app, (0, spark.conf.get(_CLEAN, "false")))
        _writers[app] = (n + 1, before)
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _cleaning:
            n, before = _writers.pop(app)
            if n > 1:
                _writers[app] = (n - 1, before)
            else:
                spark.conf.set(_CLEAN, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a scratch Parquet table and read it back.

    Cuts the lineage with files that outlive any executor; the shuffle files of
    the write go as soon as it is done. The caller's plan reads the table
    lazily, so it stays until :func:`discard` or :func:`sweep`.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    if path := getattr(table, "_scratch", None):
        _delete(table.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete this application's scratch tables once no result depends on them."""
    _delete(spark, scratch_root(spark))


def filter_bits(n: int, per_key: int = 16) -> int:
    """Bits for a filter over ``n`` keys: a power of two, never over MAX_FILTER_BITS."""
    return min(MAX_FILTER_BITS, max(1 << 17, 1 << (max(1, n) * per_key - 1).bit_length()))


def _place(key, bits: int):
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.shiftright(h, 15).cast("int"), F.pmod(h, F.lit(BITMAP_BITS)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, as no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def maybe_in(df: DataFrame, key: str, keys: DataFrame, bits: int, flag: str = "_maybe") -> DataFrame:
    """``df`` with a boolean ``flag``: false only where ``key`` is surely not in ``keys``.

    A one-hash Bloom filter out of native bitmaps of 4 KB each; at most
    ``bits / 32768`` of them exist, so the broadcast has a fixed bound whatever
    the number of keys. Beyond the bound the filter lets more rows through and
    the exact step after it does more; results never change.
    """
    bucket, bit = _place(F.col(keys.columns[0]), bits)
    maps = keys.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    maps = maps.select("_bucket", F.expr("transform(sequence(0, 1023), i -> cast(conv(hex(substring(_map, i * 4 + 1, 4)), 16, 10) as bigint))").alias("_map"))
    bucket, bit = _place(F.col(key), bits)
    at, in_map, words = unused(df, "_bucket"), unused(df, "_bit"), unused(df, "_map")
    maps = maps.select(F.col("_bucket").alias(at), F.col("_map").alias(words))
    # Four bytes a word, first byte highest; within a byte the lowest bit comes first.
    hit = F.expr(f"(shiftright({words}[cast(shiftright({in_map}, 5) as int)], cast((3 - (shiftright({in_map}, 3) & 3)) * 8 + ({in_map} & 7) as int)) & 1) = 1")
    out = df.withColumn(at, bucket).withColumn(in_map, bit).join(F.broadcast(maps), at, "left")
    return out.select(*(out[f"`{c}`"] for c in df.columns), F.coalesce(hit, F.lit(False)).alias(flag))


def rows_without(docs: DataFrame, dropped: DataFrame, bits: int) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``dropped`` (one column, doc_id).

    The bounded filter splits ``docs``: rows surely not in ``dropped`` pass
    without a shuffle, only the rest meets the exact anti join.
    """
    flag = unused(docs, "_maybe")
    marked = maybe_in(docs, "doc_id", dropped, bits, flag)
    own = [f"`{c}`" for c in docs.columns]
    rest = marked.where(flag).drop(flag).join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(*own)
    return marked.where(~F.col(flag)).select(*own).unionByName(rest)


def tidy(run):
    """A mapInArrow function that gives memory back when its task ends.

    Workers live on from task to task, and what their allocators keep for
    themselves counts against the executor.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass

    return wrapped


#: Edges that one task contracts: 16 MB as numbers.
LOCAL_EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: each node with the smallest it reaches there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = root(u), root(v)
            if p != q:
                up[max(p, q)] = min(p, q)
    stars = [(x, root(x)) for x in list(up)]
    stars = [(x, r) for x, r in stars if x != r]
    for k in range(0, len(stars), 100_000):
        part = stars[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: DataFrame ``node, component``.

    ``component`` is the smallest node reached. Each task first contracts the
    edges that it holds to stars; up to ``LOCAL_EDGES`` of them fit one task and
    are then done. Beyond that bound, large and small stars alternate: each
    round joins the edges with the minimum neighbour of each node, so a hub of
    any degree is a skewed join that AQE splits, never a list. Nodes without an
    edge to another node are absent.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = materialise(e, "edges")
    tasks = -(-e.count() // LOCAL_EDGES)
    if tasks:
        whole = e
        e = materialise(e.repartition(tasks).mapInArrow(_forest, "u long, v long"), "forest")
        discard(whole)
    if tasks <= 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    while True:
        # Stars already: each u has one v, and no v is a u.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("n")))
        if ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("low")).where("n > 1 or (n = 1 and low = 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large, old = materialise(large, "large"), e
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        discard(large)
