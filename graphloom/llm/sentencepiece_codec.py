"""SentencePiece encoding and decoding over an Aho-Corasick automaton.

The automaton over all pieces reads a text once. At each position its output
links name the pieces that end there, longest first, and each relaxes the best
path to that position from where it starts.

Two kinds of model share that pass. For a unigram model the relaxation takes
the highest sum of scores (Viterbi). A BPE model's scores are merge priorities,
not log probabilities, and their sum does not give the library's ids; there a
piece relaxes a position only if it and the piece before it are what merging
their joined text yields. Exactly one piece passes at each position, so the
pass still goes once over the text and its ids equal the library's.

No piece has a word mark after another character, so texts fall apart before
each run of marks, and further wherever two characters stand side by side in no
piece. Bounded caches in each worker encode a repeated segment or unit once.
Characters without a piece become byte pieces.

Defined cases: null and empty texts have no ids; the mark itself (U+2581) in a
text is taken as a space, as the library does, so only such texts do not come
back whole; repeated rows are encoded each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, tidy

MARK = "▁"
#: Segments a worker remembers in each of two generations, and units.
#: Pairs of pieces whose fit it remembers.
CACHE = 200_000
PAIRS = 500_000
_NOTHING: dict = {}
_SEGMENT = re.compile("\n| *[^ \n]+| +")


class Codec:
    """Pieces, scores and byte pieces of a model, with encode and decode."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], bpe: bool):
        self.bpe, self.scores, self.byte_ids = bpe, scores, byte_ids
        self.ids: dict[str, int] = {}
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(pieces):
            if k not in special and p:
                self.ids[p] = k
                self.automaton.add_word(p, (k, len(p)))
        self.automaton.make_automaton()
        self.chars = {p for p in self.ids if len(p) == 1}
        #: Pairs of characters inside pieces.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.units: dict[str, bytes] = {}
        self.plain = [b"" if k in special else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        for b, k in byte_ids.items():
            self.plain[k] = bytes([b])
        #: For a piece (-1: none) those that may follow it, as far as they have been asked for.
        self.fits: dict[int, dict[int, bool]] = {}
        self.asked = 0
        self.known: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    @classmethod
    def from_model(cls, path: str) -> Codec:
        """From a model file; BPE where its scores are merge ranks 0, -1, -2, …"""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        pieces, scores = [m.id_to_piece(k) for k in range(n)], [m.get_score(k) for k in range(n)]
        byte_ids = {int(pieces[k][3:5], 16): k for k in range(n) if m.is_byte(k)}
        special = {k for k in range(n) if m.is_byte(k) or m.is_control(k) or m.is_unknown(k) or m.is_unused(k)}
        whole = all(s == int(s) for s in scores)
        return cls(pieces, scores, byte_ids, special, whole)

    def merged(self, text: str) -> list[int]:
        """BPE by merging: the best-scored adjacent pair first, leftmost on ties."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                both = parts[i] + parts[after[i]]
                if (k := self.ids.get(both)) is not None:
                    heapq.heappush(heap, (-self.scores[k], i, after[i], both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [self.ids[p] for p in parts if p is not None]

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives just these two."""
        if self.asked > PAIRS:
            self.fits.clear()
            self.asked = 0
        self.asked += 1
        first = [] if a < 0 else [a]
        got = self.fits.setdefault(a, {})[b] = self.merged("".join(self.pieces[k] for k in first) + self.pieces[b]) == [*first, b]
        return got

    def _pass(self, text: str) -> list[int]:
        """One pass of the automaton over text whose characters all have pieces."""
        n = len(text)
        if self.bpe:
            if text.startswith(MARK * 3) or n > 400:
                return self.merged(text)  # long runs of marks tie in score; a huge unbroken run needs no pair cache
            last: list[int] = [-2] * (n + 1)  # -2: not reached, -1: the start
            last[0] = -1
            fits = self.fits
            for end, (k, size) in self.automaton.iter(text):
                end += 1
                if last[end] == -2 and (before := last[end - size]) != -2:
                    got = fits.get(before, _NOTHING).get(k)
                    if got or got is None and self._fits(before, k):
                        last[end] = k
            if last[n] < 0:
                return self.merged(text)
            start = None
        else:
            last, start = [-1] * (n + 1), [0] * (n + 1)
            best = [0.0] + [float("-inf")] * n
            for end, (k, size) in self.automaton.iter(text):
                end += 1
                score = best[end - size] + self.scores[k]
                if score > best[end]:
                    best[end], last[end], start[end] = score, k, end - size
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at = start[at] if start else at - len(self.pieces[last[at]])
        return out[::-1]

    def segment_ids(self, segment: str) -> bytes:
        """Ids of a segment as int32, unit by unit: no piece reaches from one unit to the next."""
        inner = self.inner
        cuts = [k + 1 for k in range(len(segment) - 1) if segment[k : k + 2] not in inner]
        if not cuts:
            return self._unit(segment)
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(segment)]):
            unit = segment[a:b]
            ids = self.units.get(unit)
            if ids is None:
                ids = self._unit(unit)
                if b - a < 64:
                    if len(self.units) > CACHE:
                        self.units.clear()
                    self.units[unit] = ids
            out.append(ids)
        return b"".join(out)

    def _unit(self, unit: str) -> bytes:
        """A character without a piece stands alone, as none of its pairs is in a piece."""
        return array("i", self._pass(unit) if unit[0] in self.chars else [self.byte_ids[b] for b in unit.encode("utf-8", "surrogatepass")]).tobytes()

    def forget(self) -> None:
        """Drops the units of a task; its segments stay."""
        self.units = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as int32; a leading mark is added as the model does."""
        if not text:
            return np.zeros(0, np.int32)
        if len(self.known) > CACHE:  # what was asked for since the last turn survives the next
            self.known, self.aged = {}, self.known
        if MARK in text:
            text = text.replace(MARK, " ")
        known, found = self.known, _SEGMENT.findall(" " + text)
        out = list(map(known.get, found))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            s = found[k]
            out[k] = known.get(s) or self.aged.get(s) or self.segment_ids(s.replace(" ", MARK))
            if len(s) < 64:
                known[s] = out[k]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> bytes:
        """UTF-8 bytes of the text; the leading mark's space is taken off."""
        text = b"".join(map(self.plain.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec.from_model(path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (ids decode to the very text); no shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, same = [], []
                for t in batch.column(1).to_pylist():
                    got = c.encode(t or "")
                    ids.append(got)
                    same.append(c.decode(got.tolist()) == (t or "").encode("utf-8", "surrogatepass"))
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same)], ["doc_id", "n_pieces", "ids", "round_trip"])
        c.forget()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text out of the ids of :func:`encode_documents`."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [c.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
