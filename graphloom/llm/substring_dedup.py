"""Substring dedup by relative Lempel-Ziv parsing.

A document is factored against all documents with smaller ids. A factor is a
maximal run of its 13-word windows that each start in a smaller document; so
every factor has at least 13 words, and windows that straddle the boundary of
two greedy matches are judged like any other. Words under a factor go.

Reference blocks are indexed by anchors: the anchor of a window is its
smallest 3-word hash, the same wherever the same window stands, so a document
stores about one anchor per five words. Only windows whose anchor occurs in
more than one document are hashed whole and looked up.

Texts move at most twice, by doc_id, and only those that have such an anchor,
then those that have a match. Anchors and windows are aggregated to the
smallest and largest doc_id with partial sums in each task, so a passage that
a third of all rows share is one row a task.

Defined cases: null and empty texts have no words; texts under 13 words lose
nothing; a window that occurs only within rows of one doc_id stays; a row
without a doc_id neither loses words nor takes any from others; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, filter_bits, materialise, maybe_in, ship_package
from .wordhash import among, gram_hashes, word_hashes

WINDOW = 13
GRAM = 3
#: Bytes up to which a word counts as short; grams of longer words make better anchors.
SHORT = 3


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every run of ``n`` values."""
    done = 1
    while done * 2 <= n:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def parsed(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    words = (text or b"").split()
    return words, word_hashes(words)


def window_anchors(words: list[bytes], h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The anchor of each window: its least 3-word hash, grams of long words first."""
    if len(h) < window:
        return np.zeros(0, np.uint64)
    short = np.fromiter(map(len, words), np.int64, len(words)) <= SHORT
    m = len(h) - GRAM + 1
    shorts = sum(short[j : j + m].astype(np.uint64) for j in range(GRAM))
    rank = (gram_hashes(h, GRAM) >> np.uint64(2)) | (shorts << np.uint64(62))
    return _sliding_min(rank, window - GRAM + 1)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _pairs(names: list[str], parts: list[np.ndarray], ids: np.ndarray) -> pa.RecordBatch:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(ids, [len(p) for p in parts]))], names)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            parts = [np.unique(window_anchors(*parsed(t.as_py()), window)) for t in batch.column(1)]
            yield _pairs(["anchor", "doc_id"], parts, batch.column(0).to_numpy())

    return run


def _windows(window: int):
    """Windows under one of the document's shared anchors: (window, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            parts = []
            for t, shared in zip(batch.column(1), batch.column(2)):
                words, h = parsed(t.as_py())
                at = among(window_anchors(words, h, window).view(np.int64), shared.values.to_numpy())
                parts.append(np.unique(gram_hashes(h, window)[at]) if at.any() else np.zeros(0, np.uint64))
            yield _pairs(["window", "doc_id"], parts, batch.column(0).to_numpy())

    return run


def covered(matched: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie under a matched window."""
    steps = np.zeros(n_words + 1, np.int64)
    starts = np.flatnonzero(matched)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _remove(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            n, gone, sha, spans, kept = [], [], [], [], []
            for t, found in zip(batch.column(1), batch.column(2)):
                text = t.as_py()
                words = (text or b"").split()
                mask = None
                if found.is_valid:
                    h = word_hashes(words)
                    mask = covered(among(gram_hashes(h, window).view(np.int64), found.values.to_numpy()), len(words), window)
                rest = words if mask is None else [w for w, m in zip(words, mask) if not m]
                edges = [] if mask is None else np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
                joined = b" ".join(rest)
                n.append(len(words))
                gone.append(len(words) - len(rest))
                sha.append(hashlib.sha256(joined).hexdigest())
                spans.append([{"first": a, "last": b - 1} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(joined.decode("utf-8", "replace") if texts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
            )

    return run


def duplicate_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the hashes of its windows that start in a smaller document."""
    ids = docs.where("doc_id is not null")
    anchors = ids.select("doc_id", "text").mapInArrow(_anchors(window), "anchor long, doc_id long")
    several = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    shared = materialise(several.select("anchor"), "anchors")
    own = maybe_in(anchors, "anchor", shared, filter_bits(shared.count(), 12)).where("_maybe").drop("_maybe")
    need = own.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    need = materialise(need, "need")
    some = maybe_in(ids, "doc_id", need.select("doc_id"), filter_bits(need.count())).where("_maybe").drop("_maybe")
    hashed = some.join(need, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_windows(window), "window long, doc_id long")
    hashed = materialise(hashed, "windows")
    discard(shared)
    several = hashed.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    firsts = materialise(several.select("window", "lo"), "firsts")
    later = maybe_in(hashed, "window", firsts.select("window"), filter_bits(firsts.count(), 12)).where("_maybe").drop("_maybe")
    matched = later.join(firsts, "window").where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    matched = materialise(matched, "matched")
    for table in (need, hashed, firsts):
        discard(table)
    return matched


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (first and last word removed)
    and, with ``texts``, kept_text for every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    matched = duplicate_windows(rows, window)
    marked = maybe_in(rows, "doc_id", matched.select("doc_id"), filter_bits(matched.count()))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>, kept_text string"
    clean = marked.where("not _maybe").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("windows"))
    rest = marked.where("_maybe").drop("_maybe").join(matched, "doc_id", "left").select("doc_id", "text", "windows")
    out = clean.mapInArrow(_remove(window, texts), kind).unionByName(rest.mapInArrow(_remove(window, texts), kind))
    return out if texts else out.drop("kept_text")
