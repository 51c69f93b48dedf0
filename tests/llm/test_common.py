"""Bounded filters and connected components."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import common


@pytest.mark.parametrize("per_task", [1_000_000, 20])
def test_components(spark, monkeypatch, per_task):
    """Chains, hubs, cycles and loose pairs; with 20 edges a task, by the star rounds."""
    monkeypatch.setattr(common, "LOCAL_EDGES", per_task)
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(2000 + k, 2000 + (k + 1) % 7) for k in range(7)]
    edges += [(r.randrange(3000, 3100), r.randrange(3000, 3100)) for _ in range(60)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    want = {x: root(x) for a, b in edges for x in (a, b) if a != b}
    df = spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in edges], "a long, b long").repartition(5)
    got = [tuple(x) for x in common.components(df).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert common.components(df.where("false")).collect() == []


def test_filter_lets_every_key_through(spark):
    df = spark.range(5000).withColumn("_bucket", F.lit("clash")).withColumn("_map", F.lit(1))
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    marked = common.maybe_in(df, "id", keys, common.filter_bits(700))
    assert marked.columns == [*df.columns, "_maybe"]
    through = {r["id"] for r in marked.where("_maybe").collect()}
    assert set(range(0, 5000, 7)) <= through and len(through) < 2000


def test_rows_without(spark):
    df = spark.createDataFrame([(k, "x") for k in range(50)] + [(None, "y"), (3, "again")], "doc_id long, _maybe string")
    gone = spark.createDataFrame([(3,), (7,), (99,)], "doc_id long")
    out = common.rows_without(df, gone, 1 << 17)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect()) == [-1] + [k for k in range(50) if k not in (3, 7)]
