"""MinHash near-dedup with bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles, hashed by one 64-bit
   function; its sketch is the high halves of the k smallest values, in order.
   Documents with equal sets collapse into one node.
2. Inverted lists: runs of consecutive retained values are the list keys. Two
   sets with Jaccard 0.8 agree on 80 % of the values of their union in order,
   so some run of four among the first 64 is whole in both. For unions of up
   to 64 shingles this is certain (pigeonhole; shorter runs for small sets);
   beyond, all runs fail with probability about 1e-6 exactly at the threshold
   and far less above it.
3. Each list tests its members against one pivot, so a list of n members
   gives n - 1 pairs and a hot one is a skewed join, never all pairs. The
   union-sketch estimate filters pairs; survivors are confirmed on full sets.
4. Lists that still hold several components go on in blocks: members of
   different components are compared, each pair in one list only. Where that
   would be much work, further pivots from a list's largest component come
   first, which joins more members to it. No member is dropped either way.
5. Connected components over confirmed links.

Defined cases: a null or empty text has no set and links with nothing; fewer
words than a shingle count as one shingle; rows repeated under one doc_id
count as one node; a row without a doc_id links with nothing and is kept; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import components, discard, filter_bits, materialise, maybe_in, rows_without, ship_package, tidy
from .wordhash import gram_hashes, shingle_set

#: Retained values: the first ``K`` make the list keys, all ``WIDE`` the estimate.
K, WIDE = 64, 256
#: Members of a block of a list that are compared at once.
BLOCK = 128
#: Comparisons a node, on average, up to which lists are finished in blocks;
#: above, further pivots come first. Either way every member is compared.
WORK_PER_NODE = 2000
MAX_PIVOT_ROUNDS = 12


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n, ids, kept = [], [], []
                for t in batch.column(1):
                    s = shingle_set(t.as_py(), width)
                    n.append(len(s))
                    ids.append(xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    kept.append((s[:WIDE] >> np.uint64(32)).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_shingles", "set_id", "sketch"])

    return run


_NO_KEY = np.uint64(2**64 - 1)


def list_keys(sketches: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By row, keys of the inverted lists that a set of ``n`` shingles joins, else _NO_KEY.

    Sets of up to 3 link only with equal sets. Runs of 2, 3 and 4 serve sizes
    up to 5, up to 40 and from 33: any linked pair has one of them in common.
    """
    values, n, out = sketches[:, :K].astype(np.uint64), n[:, None], []
    for run, low, high in ((2, 4, 5), (3, 4, 40), (4, 33, None)):
        rows = (n >= low) & (n <= (high or n))
        if rows.any():
            keys = gram_hashes(values[:, : min(K, high or K)], run) ^ np.uint64(run)
            out.append(np.where(rows & (np.arange(keys.shape[1]) + run <= n), keys, _NO_KEY))
    return np.concatenate(out, axis=1) if out else np.zeros((len(n), 0), np.uint64)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            keys = np.sort(list_keys(_padded(batch.column(2).to_pylist(), K), batch.column(1).to_numpy()), axis=1)
            first = keys != _NO_KEY
            first[:, 1:] &= keys[:, 1:] != keys[:, :-1]
            nodes = np.repeat(batch.column(0).to_numpy(), first.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(nodes)], ["key", "node"])


_NONE = np.iinfo(np.uint32).max


def _padded(blobs: list[bytes], width: int = WIDE) -> np.ndarray:
    out = np.full((len(blobs), width), _NONE, np.uint32)
    for k, b in enumerate(blobs):
        v = np.frombuffer(b, np.uint32, min(width, len(b) // 4))
        out[k, : len(v)] = v
    return out


def _least_shared() -> np.ndarray:
    """For k values of a union, the fewest shared ones that Jaccard 0.8 still
    gives but once in a million: least c with P(Binomial(k, 0.8) < c) > 1e-6."""
    out = np.zeros(2 * WIDE + 1, np.int64)
    for k in range(1, 2 * WIDE + 1):
        below = 0.0
        for c in range(k + 1):
            below += comb(k, c) * 0.8**c * 0.2 ** (k - c)
            if below > 1e-6:
                out[k] = c
                break
    return out


_LEAST = _least_shared()


def union_estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row: how many of the k smallest values of the union are in both, k,
    and whether k is all of the union."""
    s = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = s != np.iinfo(s.dtype).max
    first = real.copy()
    first[:, 1:] &= s[:, 1:] != s[:, :-1]
    rank = np.cumsum(first, axis=1)
    full = [(x != np.iinfo(s.dtype).max).sum(axis=1) for x in (a, b)]
    # A sketch that isn't full holds its whole set, so only full ones bound the rank.
    bound = np.minimum(*[np.where(f == a.shape[1], f, np.iinfo(np.int64).max) for f in full])
    k = np.minimum(rank[:, -1], bound)
    both = np.zeros_like(real)
    both[:, 1:] = (s[:, 1:] == s[:, :-1]) & real[:, 1:]
    return (both & (rank <= k[:, None])).sum(axis=1), k, np.maximum(*full) < a.shape[1]


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether two sketches may be those of a link.

    Sketches that hold whole sets give the overlap itself; two shingles more
    are allowed for halves of hashes that coincide.
    """
    shared, k, whole = union_estimate(a, b)
    return np.where(whole, 100 * (shared + 2) >= 80 * k, shared >= _LEAST[k])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sketches to those that may be links."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4000):
            batch = whole.slice(at, 4000)
            keep = plausible(_padded(batch.column(2).to_pylist()), _padded(batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[keep]), pa.array(batch.column(1).to_numpy()[keep])], ["a", "b"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "shingles"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                s = np.sort(np.concatenate([p, q]), kind="stable")
                both = int((s[1:] == s[:-1]).sum())
                keep.append(100 * both >= percent * (len(s) - both))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[keep]), pa.array(batch.column(1).to_numpy()[keep])], ["a", "b"])

    return run


class _Search:
    """The nodes of one run and how pairs of them become links."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int):
        self.docs, self.nodes, self.width = docs, nodes, width

    def links(self, pairs: DataFrame) -> DataFrame:
        """Confirmed links (a, b) among distinct pairs (a, b)."""
        pairs = materialise(pairs, "pairs")
        used = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x")))
        n = maybe_in(self.nodes.select("node", "n_shingles", "sketch"), "node", used, filter_bits(2 * pairs.count())).where("_maybe")
        a = n.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
        b = n.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
        both = pairs.join(a, "a").join(b, "b").where("100 * least(na, nb) >= 80 * greatest(na, nb)")
        maybe = materialise(both.select("a", "b", "sa", "sb").mapInArrow(tidy(_plausible), "a long, b long"), "plausible")
        discard(pairs)
        return self.confirmed(maybe)

    def confirmed(self, maybe: DataFrame) -> DataFrame:
        """The pairs whose full sets have Jaccard 0.8 or more."""
        ids = maybe.select(F.col("a").alias("doc_id")).unionByName(maybe.select(F.col("b").alias("doc_id")))
        held = maybe_in(self.docs.select("doc_id", F.col("text").cast("binary").alias("text")), "doc_id", ids, filter_bits(2 * maybe.count())).where("_maybe")
        sets = materialise(held.select("doc_id", "text").mapInArrow(tidy(_sets(self.width)), "doc_id long, shingles binary"), "sets")
        known = maybe.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        found = materialise(known.select("a", "b", "sa", "sb").mapInArrow(tidy(_confirmed(80)), "a long, b long"), "links")
        discard(sets)
        discard(maybe)
        return found


def _overlaps(a: np.ndarray, b: np.ndarray, none) -> np.ndarray:
    """For each row of ``a`` and each of ``b``, how many values but ``none`` are in both."""
    values, where = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    sides = where[: a.size], where[a.size :]
    held = [np.zeros(len(values), bool) for _ in sides]
    for h, w in zip(held, sides):
        h[w] = True
    common = held[0] & held[1] & (values != none)
    column, width = np.cumsum(common) - 1, int(common.sum())
    out = []
    for x, w in zip((a, b), sides):
        w = w.ravel()
        m = np.zeros((len(x), width), np.float32)
        hit = common[w]
        m[np.repeat(np.arange(len(x)), x.shape[1])[hit], column[w[hit]]] = 1
        out.append(m)
    return out[0] @ out[1].T


def _members(column, k: int):
    """Nodes, labels, set sizes and padded sketches of one block."""
    part = column[k].values
    return *(part.field(f).to_numpy(zero_copy_only=False) for f in ("node", "label", "n_shingles")), _padded(part.field("sketch").to_pylist())


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two blocks of one list (key, i, xs, j, ys; i <= j) to the pairs that may link
    two components.

    Members of one component are known to be connected already. A pair that
    shares several lists is told in the one with the smallest key only.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            key = np.int64(batch.column(0)[k].as_py()).view(np.uint64)
            (xn, xl, xs, xw), (yn, yl, ys, yw) = _members(batch.column(2), k), _members(batch.column(4), k)
            maybe = (xl[:, None] != yl[None, :]) & (100 * np.minimum(xs[:, None], ys[None, :]) >= 80 * np.maximum(xs[:, None], ys[None, :]))
            if batch.column(1)[k].as_py() == batch.column(3)[k].as_py():
                maybe &= xn[:, None] < yn[None, :]
            a = b = np.zeros(0, np.int64)
            if maybe.any():
                # Overlap of sketches bounds the shared values: a cheap test before the estimate.
                maybe &= _overlaps(xw[:, :K], yw[:, :K], _NONE) >= _LEAST[np.minimum(K, np.maximum(xs[:, None], ys[None, :]))]
            if maybe.any():
                # Lists with smaller keys have had the pair.
                before = [np.where(keys < key, keys, _NO_KEY) for keys in (list_keys(xw, xs), list_keys(yw, ys))]
                maybe &= _overlaps(*before, _NO_KEY) == 0
                at, to = np.nonzero(maybe)
                parts = range(0, len(at), 4000)
                keep = np.concatenate([plausible(xw[at[c : c + 4000]], yw[to[c : c + 4000]]) for c in parts]) if len(at) else np.zeros(0, bool)
                a, b = xn[at[keep]], yn[to[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _stars(labels: DataFrame) -> DataFrame:
    """Known components as edges (a, b)."""
    return labels.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_groups(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    ``width`` words make a shingle; documents link at Jaccard 0.8 or more.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    sketched = materialise(raw.mapInArrow(tidy(_sketches(width)), "doc_id long, n_shingles long, set_id long, sketch binary"), "sketches")
    known = sketched.where("n_shingles > 0 and doc_id is not null")
    # The lowest value beside the set's hash and size: equal sets, with 128 bits and a size agreeing.
    low = F.xxhash64("sketch")
    nodes = known.groupBy("set_id", "n_shingles", low.alias("low")).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes, "nodes")
    entries = nodes.select("node", "n_shingles", "sketch").mapInArrow(tidy(_entries), "key long, node long")
    lists = materialise(entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "lists")
    shared = maybe_in(entries, "key", lists.select("key"), filter_bits(lists.count(), 8)).where("_maybe").select("key", "node")
    members = materialise(shared.join(lists, "key").where("node != pivot"), "members")
    search = _Search(rows, nodes, width)
    links = search.links(members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())

    # Lists of three and more may hold links that the pivot did not show.
    several = members.where("n > 2").select("key", "node").unionByName(lists.where("n > 2").select("key", F.col("pivot").alias("node")))
    limit = WORK_PER_NODE * nodes.count()
    labels = components(links)
    for turn in range(MAX_PIVOT_ROUNDS + 1):
        labelled = materialise(several.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "labelled")
        by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("p"))
        main = by_label.groupBy("key").agg(F.max(F.struct("c", "label", F.col("p").alias("pivot"))).alias("m"), F.count("*").alias("labels"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("known")).where("labels > 1")
        main = materialise(main.select("key", "n", ((F.col("n") * F.col("n") - F.col("known")) / 2).alias("work"), F.col("m.label").alias("main"), F.col("m.pivot").alias("pivot")), "main")
        work, undecided = main.agg(F.sum("work"), F.count("*")).first()
        if not undecided:
            break
        if work > limit and turn < MAX_PIVOT_ROUNDS:
            outside = labelled.join(main, "key").where("label != main")
            more = search.links(outside.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct())
            if more.isEmpty():
                limit = work  # pivots find no more: what is left goes through blocks
                continue
            labels = components(_stars(labels).unionByName(more))
            continue
        open_lists = maybe_in(labelled, "key", main.select("key"), filter_bits(undecided)).where("_maybe").drop("_maybe").join(main.select("key", "n"), "key")
        held = open_lists.join(nodes.select("node", "n_shingles", "sketch"), "node")
        blocks = held.groupBy("key", F.pmod(F.xxhash64("node"), F.floor(F.col("n") / BLOCK) + 1).alias("block")).agg(F.collect_list(F.struct("node", "label", "n_shingles", "sketch")).alias("members"))
        blocks = materialise(blocks, "blocks")
        xs = blocks.select("key", F.col("block").alias("i"), F.col("members").alias("xs"))
        met = xs.join(blocks.select("key", F.col("block").alias("j"), F.col("members").alias("ys")), "key").where("i <= j")
        found = materialise(met.select("key", "i", "xs", "j", "ys").mapInArrow(tidy(_block_pairs), "a long, b long"), "met")
        discard(blocks)
        more = search.confirmed(found)
        if not more.isEmpty():
            labels = components(_stars(labels).unionByName(more))
        break

    for table in (lists, members, labelled, main):
        discard(table)
    named = nodes.join(labels, "node", "left").select("set_id", "n_shingles", "low", F.coalesce("component", "node").alias("component_id"))
    told = sketched.withColumn("low", low).join(named, ["set_id", "n_shingles", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(component)
    return told.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group, columns unchanged."""
    gone = materialise(near_groups(docs, width).where("not kept").select("doc_id").distinct(), "near")
    return rows_without(docs, gone, filter_bits(gone.count()))
