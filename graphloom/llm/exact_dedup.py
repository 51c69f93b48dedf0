"""Exact dedup: counting quotient filters, then byte verification.

1. Every row gets a 64-bit fingerprint of its normalised text. Each partition
   builds one counting quotient filter (CQF) a segment of the fingerprint
   space: copies inside a partition become one entry with a count.
2. The filters of a segment merge losslessly by their sorted remainders. A
   segment receives at most one entry a fingerprint and partition, so a text
   that a third of all rows share weighs as little there as any other.
3. Fingerprints with a count above one route their rows to byte verification:
   rows group by fingerprint *and normalised text*, combined in each task
   before the shuffle. Equal fingerprints of different texts part here.
4. Group sizes and keepers join back on narrow rows (fingerprint, SHA-256).

Defined cases: a null text counts as empty; empty texts form one group; ties
go to the smallest doc_id, a null doc_id last; of rows repeated with the same
doc_id exactly one is kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, discard, filter_bits, materialise, maybe_in, rows_without, ship_package, unused

#: Fingerprints that one segment's merge should hold.
PER_SEGMENT = 1 << 20


@dataclass
class CountingQuotientFilter:
    """Sorted fingerprints split into quotient and remainder, with counts.

    The quotient (top ``q`` bits) picks a slot. ``occupied`` has a bit a slot
    that has a run, ``run_ends`` a bit an entry that ends its run; remainders
    lie in order, so runs lie in order of their quotients. Counts over one are
    kept apart as (entry, count).
    """

    q: int
    width: int
    n: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    counted: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, width: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints of ``width`` bits and their counts."""
        n = len(values)
        q = min(width - 1, max(1, int(n).bit_length()))
        r = np.uint64(width - q)
        quotient = (values >> r).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_ends = np.ones(n, bool)
        if n:
            run_ends[:-1] = quotient[1:] != quotient[:-1]
        many = np.flatnonzero(counts > 1)
        rest = values & np.uint64((1 << int(r)) - 1)
        return cls(q, width, n, np.packbits(occupied), np.packbits(run_ends), rest, many.astype(np.uint32), counts[many].astype(np.int64))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts, just as they went in."""
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q)).astype(np.uint64)
        ends = np.unpackbits(self.run_ends, count=self.n).astype(np.int64)
        run = np.cumsum(ends) - ends
        counts = np.ones(self.n, np.int64)
        counts[self.counted] = self.counts
        return (quotients[run] << np.uint64(self.width - self.q)) | self.remainders if self.n else self.remainders, counts

    def to_bytes(self) -> bytes:
        keep = (self.width - self.q + 7) // 8
        rest = self.remainders.astype("<u8").view(np.uint8).reshape(self.n, 8)[:, :keep].tobytes()
        head = np.array([self.q, self.width, self.n, len(self.counts)], np.int64).tobytes()
        return head + self.occupied.tobytes() + self.run_ends.tobytes() + rest + self.counted.tobytes() + self.counts.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        q, width, n, m = (int(x) for x in np.frombuffer(blob, np.int64, 4))
        at, keep = 32, (width - q + 7) // 8

        def take(size: int, kind) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(blob[at - size : at], kind)

        occupied, ends = take(((1 << q) + 7) // 8, np.uint8), take((n + 7) // 8, np.uint8)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :keep] = take(n * keep, np.uint8).reshape(n, keep)
        return cls(q, width, n, occupied, ends, rest.view("<u8").reshape(n), take(4 * m, np.uint32), take(8 * m, np.int64))


def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """One filter with every entry of all; counts of equal fingerprints add up."""
    parts = [f.entries() for f in filters]
    values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(first)
    return CountingQuotientFilter.build(values[starts], np.add.reduceat(counts, starts) if len(starts) else counts, filters[0].width)


def _filters(segment_bits: int):
    """mapInArrow: fingerprints of a partition to (segment, filter)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new: list[np.ndarray] = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([values, *new])
            out, where = np.unique(every, return_inverse=True)
            return out, np.bincount(where, np.concatenate([counts, np.ones(len(every) - len(values), np.int64)]), len(out)).astype(np.int64)

        for batch in batches:
            new.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, new)) > max(1 << 18, len(values)):  # as much again: each value is sorted a few times only
                (values, counts), new = fold(), []
        values, counts = fold()
        width = 64 - segment_bits
        segment = (values >> np.uint64(width)).astype(np.int64) if segment_bits else np.zeros(len(values), np.int64)
        low = values & np.uint64((1 << width) - 1)
        cuts = np.flatnonzero(np.diff(segment)) + 1
        ids, blobs = [], []
        for part in np.split(np.arange(len(values)), cuts) if len(values) else []:
            ids.append(int(segment[part[0]]))
            blobs.append(CountingQuotientFilter.build(low[part], counts[part], width).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["segment", "filter"])

    return build


def _repeated(segment_bits: int):
    """applyInPandas on one segment: the fingerprints counted more than once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = merge([CountingQuotientFilter.from_bytes(b) for b in pdf["filter"]]).entries()
        many = counts > 1
        whole = values[many] | (np.uint64(int(pdf["segment"].iloc[0])) << np.uint64(64 - segment_bits) if segment_bits else np.uint64(0))
        return pd.DataFrame({"fp": whole.view(np.int64), "n": counts[many]})

    return run


def fingerprint(norm, bits: int = 64):
    """64-bit fingerprint; fewer bits only in tests, to force collisions."""
    h = F.xxhash64(norm)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def exact_groups(docs: DataFrame, fp_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.translate(text, SPACES, "")
    rows = docs.select("doc_id", F.length(text).alias("n_cp"), norm.alias("norm"))
    narrow = materialise(rows.select("doc_id", "n_cp", fingerprint(F.col("norm"), fp_bits).alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")), "fingerprints")
    n = narrow.count()
    segment_bits = max(4, (n // PER_SEGMENT).bit_length())
    blobs = narrow.select("fp").mapInArrow(_filters(segment_bits), "segment int, filter binary")
    repeated = materialise(blobs.groupBy("segment").applyInPandas(_repeated(segment_bits), "fp long, n long"), "repeated")
    bits = filter_bits(repeated.count())
    routed = maybe_in(rows.withColumn("fp", fingerprint(F.col("norm"), fp_bits)), "fp", repeated.select("fp"), bits).where("_maybe")
    best = F.min(F.struct((-F.col("n_cp")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
    groups = routed.groupBy("fp", "norm").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    found = groups.select(F.col("fp").alias("g_fp"), F.unhex(F.sha2("norm", 256)).alias("g_sha"), "group_size", F.col("best.d").alias("keep_id"))
    groups = materialise(found, "groups")
    discard(repeated)
    copy = Window.partitionBy("doc_id", "fp", "sha").orderBy(F.desc("n_cp"))
    told = narrow.withColumn("copy", F.row_number().over(copy)).join(groups, (F.col("fp") == F.col("g_fp")) & (F.col("sha") == F.col("g_sha")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return told.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep.eqNullSafe(F.col("doc_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged."""
    told = materialise(exact_groups(docs), "exact")
    by_id = told.groupBy("doc_id").agg(F.max("kept").alias("any"), F.count("*").alias("n"))
    gone = materialise(by_id.where("not any or n > 1").select("doc_id", F.coalesce(F.col("any"), F.lit(False)).alias("any")), "gone")
    bits = filter_bits(gone.count())
    kept = rows_without(docs.where("doc_id is not null"), gone.select("doc_id"), bits)
    # Rows repeated under one doc_id, and rows without one: few, settled by their text.
    flag, copy, sha, own_id, own_sha = (unused(docs, n) for n in ("_maybe", "_copy", "_sha", "_own_id", "_own_sha"))
    own = [f"`{c}`" for c in docs.columns]
    again = maybe_in(docs, "doc_id", gone.where("any").select("doc_id"), bits, flag).where(flag).join(gone.where("any").select("doc_id"), "doc_id", "left_semi")
    rest = again.select(*own).unionByName(docs.where("doc_id is null"))
    norm = F.translate(F.coalesce(F.col("text"), F.lit("")), SPACES, "")
    one = Window.partitionBy("doc_id", F.sha2(norm, 256)).orderBy(F.desc(F.length("text")))
    rest = rest.withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).withColumn(sha, F.sha2(norm, 256))
    keepers = told.where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha)).distinct()
    rest = rest.join(keepers, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(own_sha)), "left_semi")
    return kept.unionByName(rest.select(*own))
