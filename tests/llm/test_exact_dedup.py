"""Groups of equal normalised texts, and the counting quotient filter."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from edges import documents, local, nothing
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.exact_dedup import CountingQuotientFilter, drop_copies, exact_groups, merge


def normal(t):
    return (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i))
    out, kept = [], set()
    for i, t in rows:
        g = groups[normal(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        first = i == keep and (keep, normal(t)) not in kept
        if first:
            kept.add((keep, normal(t)))
        out.append((i, keep, len(g), first, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 6])
def test_edge_documents(spark, bits):
    """With 6-bit fingerprints nearly all collide; verification parts them."""
    df = documents(spark)
    got = local(exact_groups(df, fp_bits=bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_one_of_each_group_stays(spark):
    df = documents(spark)
    out = drop_copies(df)
    assert out.columns == df.columns
    got = out.select("doc_id", "text").collect()
    assert sorted(normal(r["text"]) for r in got) == sorted({normal(r["text"]) for r in df.collect()})
    kept = {(i, sha) for i, _, _, k, sha in brute([tuple(r) for r in df.select("doc_id", "text").collect()]) if k}
    assert {(r["doc_id"], hashlib.sha256(normal(r["text"]).encode()).hexdigest()) for r in got} == kept


def test_empty_table(spark):
    assert exact_groups(nothing(spark)).collect() == [] and drop_copies(nothing(spark)).collect() == []


@settings(max_examples=60)
@given(st.lists(st.lists(st.integers(0, 2**20 - 1) | st.integers(0, 7), max_size=60), min_size=1, max_size=5))
def test_filters_merge_without_loss(parts):
    filters = []
    for p in parts:
        values, counts = np.unique(np.array(p, np.uint64), return_counts=True)
        f = CountingQuotientFilter.build(values, counts, 20)
        again = CountingQuotientFilter.from_bytes(f.to_bytes())
        assert again.entries()[0].tolist() == values.tolist() and again.entries()[1].tolist() == counts.tolist()
        filters.append(again)
    values, counts = np.unique(np.array(sum(parts, []), np.uint64), return_counts=True)
    got = merge(filters).entries()
    assert got[0].tolist() == values.tolist() and got[1].tolist() == counts.tolist()
