"""Ids equal the library's; ids decode to the very text."""

import random

import public_tokenizers
import pytest
from edges import documents, nothing
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.sentencepiece_codec import MARK, Codec, codec, decode_documents, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_documents(spark, sf_dir, library):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    texts = {(r["doc_id"], r["text"]) for r in df.collect()}
    want = sorted((i is None, i or 0, library.encode(t or "")) for i, t in texts)
    got = encode_documents(df, PATH).collect()
    assert len(got) == df.count()
    assert sorted({(r["doc_id"] is None, r["doc_id"] or 0, tuple(r["ids"])) for r in got}) == sorted({(n, i, tuple(x)) for n, i, x in want})
    assert all(r["n_pieces"] == len(r["ids"]) for r in got)
    assert all(r["round_trip"] for r in got if r["doc_id"] != 7)  # document 7 holds the mark itself
    back = decode_documents(encode_documents(df, PATH), PATH)
    assert {(r["doc_id"], r["text"]) for r in back.collect() if r["doc_id"] not in (2, 7, None)} == {(i, t) for i, t in texts if i not in (2, 7, None)}
    assert encode_documents(nothing(spark), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeinorst ABC12.,\n\té▁  ßж你🙂́</s>[]")), max_size=60))
def test_any_text_has_the_library_s_ids(text):
    import sentencepiece

    sp = test_any_text_has_the_library_s_ids.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=PATH))
    assert codec(PATH).encode(text).tolist() == sp.encode(text)
    if MARK not in text:
        assert codec(PATH).decode(codec(PATH).encode(text).tolist()) == text.encode()


def test_viterbi_of_a_unigram_model_is_optimal():
    """Against all segmentations, on a model with log probabilities."""
    r = random.Random(4)
    pieces = [f"<0x{b:02X}>" for b in range(256)] + [MARK, "a", "b", "c"] + ["".join(r.choice("abc" + MARK) for _ in range(r.randint(2, 4))) for _ in range(40)]
    pieces = list(dict.fromkeys(pieces))
    scores = [-r.random() * 10 - 0.01 for _ in pieces]
    c = Codec(pieces, scores, {b: b for b in range(256)}, set(range(256)), bpe=False)
    ids = {p: k for k, p in enumerate(pieces) if k > 255}

    def best(text):
        top = [0.0] + [-1e9] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                if text[start:end] in ids:
                    top[end] = max(top[end], top[start] + scores[ids[text[start:end]]])
        return top[-1]

    for _ in range(200):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        got = c._pass(text)
        assert "".join(pieces[k] for k in got) == text
        assert sum(scores[k] for k in got) == pytest.approx(best(text))
