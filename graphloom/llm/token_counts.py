"""Token counts of whole texts, exactly as the tokenizer's library gives them.

A text of more than one chunk is encoded in overlapping chunks. The pieces of
both chunks, with their offsets, are aligned in the overlap and spliced at a
common boundary: the start of a piece that both see whole, clear of the left
chunk's end and of the right one's start. Where none exists the overlap
doubles, up to encoding both chunks as one.

Boundaries have to be stable: what stands before one must not change what
comes after. Where the tokenizer drops white space before it merges (this is
tested on the file, see :func:`splits_at_spaces`), the pieces are runs between
ASCII white space; a bounded cache in each worker encodes a repeated run once.
A run of more than a chunk, and every text of a tokenizer that keeps white
space, is aligned by the library's own pre-tokens and their ids instead.

Defined cases: null and empty texts have 0 tokens; repeated rows count each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

#: Bytes (of runs between white space) or characters (of pre-tokens) of a chunk and of an overlap.
CHUNK = 4096
OVERLAP = 128
LIMIT = 2048
#: Units a worker remembers in each of two generations.
CACHE = 300_000
#: A run that has white space on both sides.
_WHOLE = re.compile(rb"[ \t\n\x0b\x0c\r]([^ \t\n\x0b\x0c\r]+)[ \t\n\x0b\x0c\r]")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def splits_at_spaces(path: str) -> bool:
    """Whether a text's tokens are those of its runs between ASCII white space.

    The pre-tokenizer must drop white space, and for probes of letters, digits,
    marks, quotes and special strings, joined by each white space character,
    the ids must be those of the parts.
    """
    t = load(path)
    ids = lambda text: t.encode(text, add_special_tokens=False).ids
    if t.pre_tokenizer is None or t.normalizer is not None and ids(" ") != []:
        return False
    pieces = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(" ab  'c\td1\n")]
    if any(p.strip() != p or not p.isascii() or not p.strip() for p in pieces):
        return False
    special = [a.content for a in t.get_added_tokens_decoder().values()]
    if any(re.search(r"\s", x) for x in special) or any(a.lstrip or a.rstrip for a in t.get_added_tokens_decoder().values()):
        return False
    probes = ["a", "Ab", "'s", "s'", "1", "12", "-", "...", "é", "\u0301", "\u0301x", "ß", "中文", "\u200d", "\U0001f600", "<", "|>", "a-b", *special[:4]]
    return all(ids(x + w + y) == ids(x) + ids(y) for x in probes for y in probes for w in (" ", "\n", " \t ", "\r\n", "\x0b\x0c"))


class Resync:
    """Encodes a text in overlapping chunks aligned by pre-tokens."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        self.widened = 0

    def _encode(self, text: str, start: int, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """Pre-tokens as (start, end, ids), offsets in the whole text."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        out: list[tuple[int, int, tuple[int, ...]]] = []
        last = object()
        for token, word, (a, b) in zip(e.ids, e.word_ids, e.offsets):
            if word is not None and word == last:
                out[-1] = (out[-1][0], start + b, (*out[-1][2], token))
            else:
                out.append((start + a, start + b, (token,)))
            last = word
        return out

    @staticmethod
    def _common(left: list, right: list, edge: int) -> tuple[int, int] | None:
        """Indices of a pre-token that both have, clear of left's end and right's start.

        It begins where the one before it has ended: one character may be
        normalised to several pre-tokens, and no cut goes through it.
        """
        at = {x[0]: k for k, x in enumerate(left)}
        for j in range(2, len(right) - 1):
            k = at.get(right[j][0])
            if k and max(left[k - 1][1], right[j - 1][1]) <= right[j][0] and k + 1 < len(left) and left[k] == right[j] and left[k + 1] == right[j + 1] and left[k + 1][1] < edge:
                return k, j
        return None

    def ids(self, text: str) -> list[int]:
        if len(text) <= self.chunk:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        start, end = 0, min(len(text), self.chunk)
        left = self._encode(text, start, end)
        while end < len(text):
            overlap, far = self.overlap, min(len(text), end + self.chunk)
            while True:
                begin = max(start, end - overlap)
                if begin == start:
                    left, start = self._encode(text, start, far), start
                    break
                right = self._encode(text, begin, far)
                if cut := self._common(left, right, end):
                    for x in left[: cut[0]]:
                        out.extend(x[2])
                    left, start = right[cut[1] :], right[cut[1]][0]
                    break
                overlap *= 2
                self.widened += 1
            end = far
        for x in left:
            out.extend(x[2])
        return out


class UnitCounts:
    """Counts by run, remembered up to a bound."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer = load(path)
        self.chunk, self.overlap = chunk, overlap
        self.resync = Resync(self.tokenizer, chunk, overlap)
        self.by_runs = splits_at_spaces(path)
        self.known: dict[bytes, int] = {}
        self.aged: dict[bytes, int] = {}

    def runs(self, text: bytes) -> list[bytes]:
        """The runs of a text, chunk by chunk."""
        if len(text) <= self.chunk:
            return text.split()
        out: list[bytes] = []
        start, end = 0, self.chunk
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(start, end - overlap)
                # Both chunks hold text[begin:end]; a run that is whole in it is the same piece in both.
                if both := _WHOLE.search(text, begin, end):
                    out += text[start : both.start(1)].split()
                    start = both.start(1)
                    break
                if begin == start:
                    break
                overlap *= 2
            end = (start if both else end) + self.chunk
        return out + text[start:].split()

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.by_runs:
            return [len(self.resync.ids(t.decode("utf-8", "replace"))) for t in texts]
        split = [self.runs(t) for t in texts]
        if len(self.known) > CACHE:  # what was asked for since the last turn survives the next
            self.known, self.aged = {}, self.known
        known, aged = self.known, self.aged
        new = {u for units in split for u in units if u not in known}
        if aged:
            known.update((u, aged[u]) for u in new & aged.keys())
        new = [u for u in new if u not in known]
        long = [u for u in new if len(u) > self.chunk]
        new = [u for u in new if len(u) <= self.chunk] if long else new
        for u in long:
            known[u] = len(self.resync.ids(u.decode("utf-8", "replace")))
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            for u, e in zip(part, self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in part], add_special_tokens=False)):
                known[u] = len(e)
        out = [sum(map(known.__getitem__, units)) for units in split]
        for u in long:  # too large to remember
            del known[u]
        return out


@lru_cache(maxsize=2)
def _unit_counts(path: str) -> UnitCounts:
    return UnitCounts(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; no shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _unit_counts(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [x or b"" for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(units.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
