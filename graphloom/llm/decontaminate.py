"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items form an inverted index; every passage of every document is a
query. Impacts are BM25 divided by the item's score for its own text and by the
share of it that retrieval asks for, so one threshold serves all items. That
share is ``THRESHOLD``, or less where a passage with the words that the check
below asks for could score less: an item whose score lies in a few rare words
is found without them. So retrieval loses nothing that the check confirms. Each posting list is cut into blocks of items with
the largest impact in each. A passage first sums its terms' block maxima: only
blocks that reach the threshold are walked by WAND over the terms they hold; it
skips on list bounds and block maxima, and every item over the threshold is retrieved. There is no
limit on how many.

A retrieved item counts as leaked if the document holds at least 80 % of its
five-word shingles, and the passage's surroundings at least 80 % of the words
of its question and of its answer (the part after the last sentence end, or
the last third).

No item is cut. Items of up to ``MAX_ITEM_WORDS`` words form one length class,
longer ones a class for each doubling, so that a long item does not lengthen
the passages of short ones. Passages overlap by the longest item of a class, so
an item lies whole in some passage. The index is cut into shards of at most
``SHARD`` items, fewer where items are longer; documents meet each
shard in turn, so memory is bounded by a shard or one item, and every item is
used. Lists and block maxima are sparse, so an index takes a bounded multiple
of its text; where the text of the test set exceeds ``MAX_BENCHMARK_BYTES``, it
is read and applied in parts of about that size, scored by the statistics of
the whole.

Defined cases: null and empty texts hold no item; items without words are
skipped; items with fewer than five words count as one shingle; an item given
twice is reported under each id; an empty table gives an empty result; extra
columns are ignored. Rows come back for leaks only.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, ship_package

THRESHOLD = 0.4
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 4
SHARD = 1024
#: Passages of a document whose bounds are summed at once; fewer where passages are longer.
SEGMENT = 512
#: Words of the longest item of the first length class.
MAX_ITEM_WORDS = 256
#: Text of the test set that is indexed and broadcast at once.
MAX_BENCHMARK_BYTES = 16 << 20
K1, B = 1.2, 0.75


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(words: list[bytes]) -> set[bytes]:
    n = min(SHINGLE, len(words))
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


_SENTENCE = re.compile(rb"[.?!:]\s+(?=\S)")


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[bytes, ...]
    question: tuple[bytes, ...]
    answer: tuple[bytes, ...]

    @classmethod
    def of(cls, item_id: int, text: bytes) -> Item | None:
        """The whole item; None if it has no words."""
        words = words_of(text)
        if not words:
            return None
        ends = [m.end() for m in _SENTENCE.finditer(text)]
        tail = len(words_of(text[ends[-1] :])) if ends else 0
        return cls.split(item_id, words, tail)

    @classmethod
    def split(cls, item_id: int, words: list[bytes], tail: int) -> Item:
        cut = len(words) - tail if SHINGLE <= tail <= len(words) - SHINGLE else (2 * len(words) + 2) // 3
        return cls(item_id, tuple(words), tuple(words[:cut]), tuple(words[cut:]) or tuple(words))


def length_class(words: int) -> int:
    """0 for items of up to MAX_ITEM_WORDS words, one more for each doubling."""
    return (max(1, (words + MAX_ITEM_WORDS - 1) // MAX_ITEM_WORDS) - 1).bit_length()


def least_share(item: Item, tf: Counter, raw: dict[bytes, float]) -> float:
    """Share of its own score that an item keeps in any passage with OVERLAP of
    its question's and of its answer's words.

    The words that such a passage lacks number at most what both may miss; the
    best use of that number, words counted in parts, bounds what is lost.
    """
    spare = float(sum(len(x) - ceil(OVERLAP * len(x) - 1e-9) for x in (item.question, item.answer)))
    kept = own = sum(raw.values())
    for w in sorted(raw, key=lambda w: -raw[w] / tf[w]):
        gone = min(1.0, spare / tf[w])
        kept -= raw[w] * gone
        spare -= gone * tf[w]
        if spare <= 0:
            break
    return max(kept / own, 1e-6)


class Index:
    """Inverted lists of impacts over one shard of items, with block maxima.

    ``stride`` is the length of a chunk: at least that of the longest item."""

    def __init__(self, items: list[Item], df: Counter, total: int, mean: float, stride: int):
        self.items = items
        self.stride = stride
        self.terms: dict[bytes, int] = {}
        self.blocks = (len(items) + BLOCK - 1) // BLOCK
        #: Share of an item's own score that retrieval asks for.
        self.least: list[float] = []
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, item in enumerate(items):
            tf = Counter(item.words)
            raw = {}
            for w, c in tf.items():
                idf = np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5))
                raw[w] = float(idf * c * (K1 + 1) / (c + K1 * (1 - B + B * len(item.words) / mean)))
            own = sum(raw.values())
            self.least.append(min(THRESHOLD, least_share(item, tf, raw)))
            for w, s in raw.items():
                lists[self.terms.setdefault(w, len(self.terms))].append((k, s / own / self.least[k]))
        self.postings = [(array("i", (k for k, _ in lists[t])), array("d", (s for _, s in lists[t]))) for t in range(len(self.terms))]
        #: Largest impact of each list, and of each of its blocks by rows of a sparse matrix.
        self.tops = [max(impacts) for _, impacts in self.postings]
        starts, blocks, highest = [0], [], []
        for ids, impacts in self.postings:
            best: dict[int, float] = {}
            for k, s in zip(ids, impacts):
                best[k // BLOCK] = max(best.get(k // BLOCK, 0.0), s)
            blocks += best
            highest += best.values()
            starts.append(len(blocks))
        self.starts, self.block_of, self.highest = np.array(starts), np.array(blocks, np.int32), np.array(highest, np.float32)

    def maxima(self, terms: np.ndarray) -> np.ndarray:
        """maxima[term, block] of some terms: largest impact of the term in the block."""
        size = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out = np.zeros((len(terms), self.blocks), np.float32)
        out[np.repeat(np.arange(len(terms)), size), self.block_of[at]] = self.highest[at]
        return out

    def retrieve(self, terms: list[int], allowed: set[int], threshold: float, maxima: np.ndarray | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: items with impacts summing to the threshold or more.

        ``allowed`` are the blocks whose bound reaches it. Cursors stay sorted
        by item; the pivot is the first list at which list bounds add up to the
        threshold. A pivot outside the allowed blocks moves all cursors to the
        next of them, one whose block bounds fall short moves them past it.
        """
        if maxima is None:
            maxima = self.maxima(np.array(terms, np.int64))
        lists = [self.postings[t] for t in terms]
        bounds = [self.tops[t] for t in terms]
        open_blocks = sorted(allowed)
        at = [0] * len(lists)
        done = len(self.items)
        where = [ids[0] for ids, _ in lists]
        out: list[tuple[int, float]] = []
        eps = 1e-6

        def skip(k: int, target: int) -> None:
            posting, i = lists[k][0], at[k]
            while i < len(posting) and posting[i] < target:
                i += 1
            at[k] = i
            where[k] = posting[i] if i < len(posting) else done

        order = list(range(len(lists)))
        while True:
            order.sort(key=where.__getitem__)
            bound, pivot = 0.0, done
            for k in order:
                if where[k] >= done:
                    break
                bound += bounds[k]
                if bound >= threshold - eps:
                    pivot = where[k]
                    break
            if pivot >= done:
                return out
            block = pivot // BLOCK
            if block not in allowed:
                at_block = bisect_left(open_blocks, block)
                if at_block == len(open_blocks):
                    return out
                target = open_blocks[at_block] * BLOCK
                for k in order:
                    if where[k] < target:
                        skip(k, target)
                continue
            if sum(float(maxima[k, block]) for k in order if where[k] <= pivot) < threshold - eps:
                for k in order:
                    if where[k] <= pivot:
                        skip(k, pivot + 1)
                continue
            score = 0.0
            for k in order:
                if where[k] < pivot:
                    skip(k, pivot)
                if where[k] == pivot:
                    score += lists[k][1][at[k]]
                    skip(k, pivot + 1)
            if score >= threshold - eps:
                out.append((pivot, score))


@dataclass
class Stats:
    """Of the whole test set: items that hold each word, items with words, their
    mean length, and the longest of each length class."""

    df: Counter
    total: int
    mean: float
    longest: dict[int, int]

    @classmethod
    def of(cls, items: list[Item]) -> Stats:
        longest: dict[int, int] = defaultdict(int)
        for i in items:
            c = length_class(len(i.words))
            longest[c] = max(longest[c], len(i.words))
        return cls(Counter(w for i in items for w in set(i.words)), len(items), sum(len(i.words) for i in items) / max(1, len(items)), longest)


@dataclass
class Benchmark:
    """All shards; a passage fits the longest item of the shard's length class twice."""

    shards: list[Index]

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], stats: Stats | None = None) -> Benchmark:
        ordered = sorted(rows, key=lambda r: (str(type(r[0])), r[0] if r[0] is not None else 0, r[1]))
        items = [i for k, t in ordered if (i := Item.of(k, t))]
        stats = stats or Stats.of(items)
        classes: dict[int, list[Item]] = defaultdict(list)
        for i in items:
            classes[length_class(len(i.words))].append(i)
        shards = []
        for c, own in sorted(classes.items()):
            # A quarter more than the longest item, for words put into a copy.
            size, stride = max(1, SHARD >> c), max(32, stats.longest[c] + stats.longest[c] // 4)
            shards += [Index(own[k : k + size], stats.df, stats.total, stats.mean, stride) for k in range(0, len(own), size)]
        return cls(shards)

    def _passages(self, index: Index, ids: np.ndarray, chunk: np.ndarray, threshold: float) -> Iterator[tuple[int, list[int], set[int], np.ndarray]]:
        """Passages with a block whose maxima sum to the threshold: (passage, the
        terms that those blocks hold, those blocks, the terms' maxima).

        Passage p covers the words of chunks p and p + 1; a term counts once in
        it. Long documents go in segments, so memory does not grow with them.
        """
        last, size = int(chunk[-1]), max(1, SEGMENT * MAX_ITEM_WORDS // max(MAX_ITEM_WORDS, index.stride))
        for first in range(0, last + 1, size):
            n = min(size, last + 1 - first)
            a, b = np.searchsorted(chunk, [first, first + n + 1])
            if a == b:
                continue
            column = np.zeros(len(index.terms), np.int64)
            column[ids[a:b]] = 1
            terms = np.flatnonzero(column)
            column[terms] = np.arange(len(terms))
            held = np.zeros((n + 1, len(terms)), np.float32)
            held[chunk[a:b] - first, column[ids[a:b]]] = 1
            held = np.maximum(held[:-1], held[1:])
            maxima = index.maxima(terms)
            reach = held @ maxima >= threshold - 1e-4
            for p in np.flatnonzero(reach.any(axis=1)):
                blocks = np.flatnonzero(reach[p])
                useful = (held[p] > 0) & (maxima[:, blocks] > 0).any(axis=1)
                yield first + int(p), terms[useful].tolist(), set(blocks.tolist()), maxima[useful]

    def leaks(self, text: bytes | None, threshold: float = 1.0) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, shingle, question and answer overlap) of each leaked item."""
        words = words_of(text)
        if not words:
            return []
        found: dict[int, tuple[float, ...]] = {}
        held: set[bytes] | None = None
        for index in self.shards:
            known = index.terms
            terms = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            spots = np.flatnonzero(terms >= 0)
            if not len(spots):
                continue
            ids = terms[spots]
            for p, terms, allowed, maxima in self._passages(index, ids, spots // index.stride, threshold):
                for k, score in index.retrieve(terms, allowed, threshold, maxima):
                    item, score = index.items[k], score * index.least[k]
                    if held is None:
                        held = shingles(words) if len(words) >= SHINGLE else {b" ".join(words)}
                    if len(item.words) < SHINGLE:
                        n = len(item.words)
                        shared = float(any(tuple(words[j : j + n]) == item.words for j in range(len(words) - n + 1)))
                    else:
                        some = shingles(list(item.words))
                        shared = len(some & held) / len(some)
                    if shared < OVERLAP:
                        continue
                    near = Counter(words[p * index.stride : (p + 2) * index.stride])
                    q, a = _held(item.question, near), _held(item.answer, near)
                    if q >= OVERLAP and a >= OVERLAP and score > found.get(item.item_id, (0.0,))[0]:
                        found[item.item_id] = (score, shared, q, a)
        return [(k, *v) for k, v in found.items()]


def _held(part: tuple[bytes, ...], near: Counter) -> float:
    want = Counter(part)
    return sum(min(c, near[w]) for w, c in want.items()) / len(part)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [n for t in batch.column(0).to_pylist() if (n := len(words_of(t)))]
        yield pa.RecordBatch.from_arrays([pa.array([length_class(n) for n in sizes], pa.int32()), pa.array(sizes, pa.int64())], ["class", "words"])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(list(set(words_of(t))), pa.binary())], ["word"])


def benchmarks(items: DataFrame) -> Iterator[Benchmark]:
    """The test set as one Benchmark, or several where its text is over the bound.

    Parts share the statistics of the whole, and an id lies in one part, so
    rows don't depend on the number of parts."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // MAX_BENCHMARK_BYTES) + 1
    if parts == 1:
        yield Benchmark.of([(r["item_id"], bytes(r["text"])) for r in rows.collect()])
        return
    ship_package(items.sparkSession)
    lengths = rows.select("text").mapInArrow(_lengths, "class int, words long").groupBy("class").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest")).collect()
    total, longest = sum(r["n"] for r in lengths), {r["class"]: r["longest"] for r in lengths}
    mean = sum(r["words"] for r in lengths) / max(1, total)
    df = materialise(rows.select("text").mapInArrow(_distinct_words, "word binary").groupBy("word").agg(F.count("*").alias("n")), "df")
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        held = df.join(own.select("text").mapInArrow(_distinct_words, "word binary").distinct(), "word").collect()
        stats = Stats(Counter({bytes(r["word"]): r["n"] for r in held}), total, mean, longest)
        yield Benchmark.of([(r["item_id"], bytes(r["text"])) for r in own.collect()], stats)
    discard(df)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, shingle_overlap, question_overlap, answer_overlap)
    of every leaked item in every document; no shuffle."""
    ship_package(docs.sparkSession)
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def against(bench: Benchmark) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = held.value
            for whole in batches:
                ids, out = whole.column(0).to_pylist(), []
                for k in range(whole.num_rows):
                    out += [(ids[k], *x) for x in b.leaks(whole.column(1)[k].as_py())]
                cols = list(zip(*out)) if out else [()] * 6
                types = [whole.schema.field(0).type, pa.int32() if kinds[1] == "int" else pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "item_id", "score", "shingle_overlap", "question_overlap", "answer_overlap"])

        return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, shingle_overlap double, question_overlap double, answer_overlap double")

    out = None
    for bench in benchmarks(items):
        out = against(bench) if out is None else out.unionByName(against(bench))
    return out


def drop_leaky(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a test item; a filter where they are read."""
    ship_package(docs.sparkSession)
    for bench in benchmarks(items):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(bench))(F.col("text").cast("binary")))
    return docs


def _clean(held):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([t is None or not held.value.leaks(bytes(t)) for t in texts], dtype=bool)

    return clean
