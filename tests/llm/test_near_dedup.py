"""Components of documents with Jaccard 0.8 or more, against all pairs."""

import numpy as np
import pytest
from edges import documents, local, near, nothing, words
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import near_dedup
from graphloom.llm.near_dedup import K, _overlaps, drop_near_copies, list_keys, near_groups, union_estimate
from graphloom.llm.wordhash import shingle_set


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + min(width, len(w))]) for k in range(len(w) - min(width, len(w)) + 1)} if w else set()


def brute(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    low: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return sorted(((i, len(sets[k]), None if i is None else low[root(k)], i is None or low[root(k)] == i) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_edge_documents(spark, width):
    df = documents(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert local(near_groups(df, width), "doc_id", "n_shingles", "component_id", "kept") == brute(rows, width)


@pytest.mark.parametrize("per_node", [300, 0])
def test_chains_and_many_variants(spark, monkeypatch, per_node):
    """Drifting copies link only to neighbours; per_node 0 forces the pivot rounds."""
    monkeypatch.setattr(near_dedup, "WORK_PER_NODE", per_node)
    base = words(3, 120)
    rows = [(k, " ".join(base[k // 2 : k // 2 + 100] if k % 2 else base[k // 2 : k // 2 + 100] + ["end"])) for k in range(40)]
    rows += [(1000 + k, near(50 + k % 4, 60, k % 9)) for k in range(80)]
    rows += [(2000 + k, " ".join(words(60 + k % 30, 2 + k % 9))) for k in range(90)]
    # Texts of 30 to 47 words: their sets change from one family of keys to the next.
    rows += [(3000 + k, " ".join(words(90, 47)[: 30 + k % 18] + [f"z{k % 5}"])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert local(near_groups(df, 2), "doc_id", "n_shingles", "component_id", "kept") == brute(rows, 2)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert local(near_groups(df, 5), "doc_id", "n_shingles", "component_id", "kept") == brute(rows, 5)


def test_one_of_each_group_stays(spark):
    df = documents(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    out = drop_near_copies(df, 5)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((i for i, _, _, kept in brute(rows, 5) if kept), key=repr)


def test_empty_table(spark):
    assert near_groups(nothing(spark)).collect() == [] and drop_near_copies(nothing(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 64), st.randoms(use_true_random=False))
def test_linked_sets_with_unions_up_to_64_always_share_a_list(union, r):
    """The pigeonhole claim: any two sets with Jaccard 0.8 have a key in common."""
    shared = -(-80 * union // 100)
    split = r.randint(0, union - shared)
    values = r.sample(range(1 << 32), union)
    r.shuffle(values)
    a = np.array(sorted(values[: shared + split]), np.uint64)
    b = np.array(sorted(values[:shared] + values[shared + split :]), np.uint64)
    if len(a) != len(b) or (a != b).any():
        pad = lambda s: np.concatenate([s, np.full(K, 2**32 - 1, np.uint64)])[None, :K]
        both = np.intersect1d(list_keys(pad(a), np.array([len(a)])), list_keys(pad(b), np.array([len(b)])))
        assert (both != np.uint64(2**64 - 1)).any()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=100), st.sets(st.integers(0, 400), max_size=100))
def test_union_estimate(a, b):
    pad = lambda s: np.array([(sorted(s) + [2**32 - 1] * K)[:K]], np.uint32)
    shared, k, whole = union_estimate(pad(a), pad(b))
    assert not whole[0] or int(k[0]) == len(a | b)
    low = sorted(a | b)[: int(k[0])]
    assert int(shared[0]) == len([x for x in low if x in a and x in b])
    assert int(k[0]) >= min(K, len(a | b)) or len(a) <= K or len(b) <= K


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 6), st.integers(1, 5), st.integers(0, 9), st.randoms(use_true_random=False))
def test_overlaps(rows_a, wide_a, rows_b, wide_b, r):
    """Rows of distinct values, blocks of different widths, empty ones too."""
    make = lambda n, m: np.array([r.sample(range(15), m) for _ in range(n)], np.uint32).reshape(n, m)
    a, b = make(rows_a, wide_a), make(rows_b, wide_b)
    want = [[len(set(x) & set(y) - {7}) for y in b.tolist()] for x in a.tolist()]
    assert _overlaps(a, b, 7).tolist() == want


def test_shingle_set_sizes():
    for text in ("", "a", "A a", "a b a b a", "x " * 50):
        assert len(shingle_set(text.encode(), 2)) == len(shingles(text, 2))
