"""Counts as the tokenizer's library gives them; resynchronised ids equal whole encodings."""

import random

import public_tokenizers
import pytest
from edges import documents, nothing
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.token_counts import Resync, UnitCounts, count_tokens, load, splits_at_spaces

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(df, PATH).collect())
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := count(r["text"]), n > 2048) for r in df.collect())
    assert got == want
    texts = [(r["text"] or "").encode() for r in df.collect()]
    for chunk, overlap in ((60, 4), (200, 20), (1000, 128)):
        assert UnitCounts(PATH, chunk, overlap).counts(texts) == [count(t.decode()) for t in texts]
    assert count_tokens(nothing(spark), PATH).collect() == []


def test_a_tokenizer_that_keeps_white_space_is_aligned_by_its_pre_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert splits_at_spaces(PATH) and not splits_at_spaces(path)
    library, r = Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(r.choice(ODD + ["word ", " the", "\n\n", " <|endoftext|>"]) for _ in range(n)) for n in (0, 5, 100, 900)]
    want = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    for chunk, overlap in ((60, 8), (400, 40), (4096, 128)):
        assert UnitCounts(path, chunk, overlap).counts([t.encode() for t in texts]) == want


ODD = ["hello", "World's", " ", "  ", "\n", " ", "　", "\x1c", "\x85", "​", "é", "é", "́", "12", "!!", "<|endoftext|>", "<|startoftext|>", "'s", "你好", "🙂", "İ", "ß", "don't", "a" * 40]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from(ODD) | st.text(max_size=4), max_size=25))
def test_units_add_up(parts):
    text = "".join(parts)
    for chunk, overlap in ((4096, 128), (16, 3)):
        assert UnitCounts(PATH, chunk, overlap).counts([text.encode("utf-8", "replace")]) == [count(text.encode("utf-8", "replace").decode())]


@pytest.mark.parametrize("seed", range(12))
def test_resynchronised_chunks(seed):
    r = random.Random(seed)
    text = "".join(r.choice(ODD + ["word ", " the", "\n\n"]) for _ in range(400))
    for chunk, overlap in ((64, 8), (100, 20), (300, 50)):
        assert Resync(load(PATH), chunk, overlap).ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_overlaps_widen_where_nothing_aligns():
    resync = Resync(load(PATH), 64, 8)
    text = "x" * 1000 + " end " + "y" * 500
    assert resync.ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids and resync.widened > 0
