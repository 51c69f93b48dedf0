"""Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(300)]


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def near(seed: int, n: int, changed: int) -> str:
    w = words(seed, n)
    r = random.Random(seed * 1000 + changed)
    for k in r.sample(range(n), changed):
        w[k] = f"x{seed}_{k}_{changed}"
    return " ".join(w)


def rows() -> list[tuple]:
    shared = " ".join(words(1, 60))
    long = " ".join(words(2, 20_000))
    out = [
        (1, shared, "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (None, shared, "en", "c", 1),
        (None, None, None, None, None),
        (5, long, "de", "c", 1),
        (6, long + " tail", "de", "c", 1),
        (7, "Café  über naïve </s> <s> [INST] ▁ <|endoftext|> 你好 🙂 é", "fr", "d", 1),
        (8, "one", "en", "d", 3),
        (9, "one two", "en", "d", 7),
        (9, "one two", "en", "d", 7),
        (10, "o n e two", "en", "d", 9),
        (11, "ONE two", "en", "d", 7),
        (12, shared + " and then something else entirely", "en", "a", 1),
        (13, "x " + shared, "en", "a", 1),
        (14, "a" * 50_000, "en", "z", 50_000),
        (15, "same " * 3000, "en", "z", 15_000),
    ]
    out += [(100 + k, near(7, 80, k % 4), "en", "hot", 1) for k in range(40)]
    out += [(200 + k, "a copy that many rows share, word for word, and it goes on for a while", "en", "hot", 1) for k in range(60)]
    out += [(300 + k, near(40 + k % 5, 30 + k, k % 3), "de", "hot", 1) for k in range(40)]
    return out


def documents(spark, more: bool = True):
    df = spark.createDataFrame(rows(), SCHEMA)
    if more:  # names that operators use for their own columns
        for c in ("score", "kept", "label", "shard", "_maybe", "_bucket", "_map", "_copy", "fp", "norm", "node", "anchor", "window", "n_words", "toxic"):
            df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def local(df, *cols) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def auc(scores: list[float], labels: list[int]) -> float:
    pos, neg = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / max(1, len(pos) * len(neg))
