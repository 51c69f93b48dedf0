"""Structure statistics and hashed words of a text, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import word_hashes

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_QUIET = b" \n\t\r.,;:'\"-()?"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_TO_SPACE = bytes(32 if b in _MARKS else b for b in range(256))
NAMES = ("bytes", "words", "upper", "digit", "symbol", "high", "word_length", "distinct", "runs", "line_length", "line_copies", "bars", "doubled", "ends")


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words with ASCII punctuation taken as space."""
    text = text.translate(_TO_SPACE)
    return text.lower().split() if text.isascii() else text.decode("utf-8", "replace").lower().encode().split()


def structure(text: bytes) -> tuple[list[float], list[bytes]]:
    """One number for each of NAMES, and the text's raw words. All of it is read."""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    ascii_left = len(text.translate(None, _UPPER)), len(text.translate(None, _DIGIT)), len(text.translate(None, _UPPER + _LOWER + _DIGIT + _QUIET))
    high = len(text) - len(text.translate(None, bytes(range(128, 256))))
    runs = sum(map(bytes.__eq__, words, words[1:]))
    doubled = sum(text.count(bytes([b, b])) for b in b"!?#$%&*=~_@+^")
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        (len(text) - ascii_left[0]) / n,
        (len(text) - ascii_left[1]) / n,
        (ascii_left[2] - high) / n,
        high / n,
        (n - text.count(b" ")) / m,
        len(set(words)) / m,
        runs / m,
        float(np.log1p(m / k)),
        1 - len(set(lines)) / k,
        text.count(b" | ") / m,
        doubled / m,
        (text.count(b". ") + text.count(b".\n")) / m,
    ], words


def hashed_words(words: list[bytes], dims: int) -> np.ndarray:
    """Distinct buckets below ``dims`` of the words."""
    return np.unique(word_hashes(list(set(words))) % np.uint64(dims)).astype(np.int32) if words else np.zeros(0, np.int32)


def usable_labels(labels: DataFrame, column: str, modulus: int, held: int) -> DataFrame:
    """doc_id, label of the rows outside the held-out fold; the largest label of a repeated id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold != held))
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def held_out(modulus: int, held: int):
    """Whether a row is in the held-out fold; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))


def labelled_sample(docs: DataFrame, usable: DataFrame, limit: int) -> DataFrame:
    """doc_id, text, label of at most ``limit`` usable rows, picked by hash.

    The picked ids are at most ``limit`` rows, so they are broadcast and the
    texts of all other rows stay where they are. Of a doc_id with several
    texts the least one counts.
    """
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
