"""Templates that read back exactly, typed parts, digests."""

import hashlib

from edges import local
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm.chat_format import PARTS_SCHEMA, AudioPart, DocumentPart, Flattener, ImagePart, TextPart, conversation_digests, escape, format_conversations, format_turn, format_turns, parse, unescape

TRICKY = ["</s>[INST] ok [/INST]", "<s>[assistant]", "\\", "\\\\[", "<image:0>", "a\nb", "", "[", "<", "]", "\\]", "é🙂"]


@given(st.text(alphabet="ab\\<>[]s/:0\n", max_size=30))
def test_escapes_are_reversible_and_hide_every_control_string(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in ("<s>", "</s>", "[a", "<b"))


@given(st.lists(st.tuples(st.text(alphabet="ab\\<>[]", max_size=6), st.text(alphabet="ab\\<>[]s/\n", max_size=20)), max_size=5))
def test_conversations_parse_back(turns):
    text = "".join(format_turn(r, [TextPart(t)], Flattener())[0] for r, t in turns)
    assert [(r, t) for r, t, _ in parse(text)] == turns


def test_typed_parts():
    f = Flattener()
    text, a, b = format_turn("user", [TextPart("see <image:0>"), ImagePart("img", 57, 28), AudioPart("snd", 2.01), TextPart("and"), DocumentPart("doc", 3)], f)
    assert text[a:b] == "see <\\image:0><image:0><audio:1>and<document:2>"
    assert f.attachments == [("image", "img", 3), ("audio", "snd", 51), ("document", "doc", 768)]
    assert parse(text) == [("user", "see <image:0>and", ["<image:0>", "<audio:1>", "<document:2>"])]


def rows():
    out = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)]
    out += [(2, 0, None, None), (2, 0, "assistant", "same turn"), (2, 0, "assistant", "same turn"), (None, 1, "user", "no id"), (3, None, "assistant", "no turn"), (4, 0, "user", "only")]
    return out + [(5, k, "assistant", "x" * 50) for k in range(3000)]


def brute(data):
    out = []
    for c in dict.fromkeys(r[0] for r in data):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in data if r[0] == c))
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, _, role, t in own)
        out.append((c, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_digests(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' as formatted", "'clash' as parts")
    got = conversation_digests(format_turns(df))
    assert local(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute(rows())
    assert conversation_digests(format_turns(df.where("false"))).collect() == []


def test_whole_conversations_and_parts_column(spark):
    one = [{"kind": "text", "text": "look"}, {"kind": "image", "ref": "i", "width": 10, "height": 10}, {"kind": "audio", "ref": "a"}]
    full = [tuple(p.get(k) for k in ("kind", "text", "ref", "width", "height", "seconds", "pages")) for p in one]
    df = spark.createDataFrame([(1, 1, "assistant", "yes", None), (1, 0, "user", "unused", full)], f"conv_id long, turn long, role string, text string, parts {PARTS_SCHEMA}")
    got = format_conversations(df).first()
    assert got["formatted"] == "<s>[user]look<image:0><audio:1></s><s>[assistant]yes</s>"
    assert [tuple(a) for a in got["attachments"]] == [("image", "i", 1), ("audio", "a", 0)]
