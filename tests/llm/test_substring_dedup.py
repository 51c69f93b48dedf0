"""Words under windows that start in smaller documents, against brute force."""

import hashlib

import numpy as np
from edges import documents, local, nothing
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm.substring_dedup import _sliding_min, covered, remove_repeats


def brute(rows, window=13):
    firsts: dict = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                firsts[g] = min(i, firsts.get(g, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and firsts[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_edge_documents(spark):
    df = documents(spark)
    got = local(remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_small_windows_over_few_words(spark):
    rows = [(k, " ".join(str((k * j * 7 + j) % 3) for j in range(k % 19))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert local(remove_repeats(df, window=4), "doc_id", "n_words", "n_removed", "kept_sha256") == brute(rows, 4)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = local(remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_texts_and_spans(spark):
    a = " ".join(f"a{k}" for k in range(20))
    df = spark.createDataFrame([(1, a), (2, f"start here {a} stop")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(df, texts=True).collect()}
    assert got[1]["kept_text"] == a and got[1]["spans"] == []
    assert got[2]["kept_text"] == "start here stop" and [tuple(s) for s in got[2]["spans"]] == [(2, 21)]


def test_empty_table(spark):
    assert remove_repeats(nothing(spark)).collect() == []


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_minimum(x, n):
    if len(x) >= n:
        assert _sliding_min(np.array(x), n).tolist() == [min(x[k : k + n]) for k in range(len(x) - n + 1)]


@given(st.lists(st.booleans(), max_size=30), st.integers(1, 8))
def test_covered(hits, n):
    size = len(hits) + n - 1
    want = [any(hits[j] for j in range(max(0, k - n + 1), min(k + 1, len(hits)))) for k in range(size)]
    assert covered(np.array(hits, bool), size, n).tolist() == want
