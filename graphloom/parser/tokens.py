"""Tokeniser."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

_NAME = r"[^\W\d]|_"
_LOCAL = r"(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]|\.(?=[\w:\-%\\·]|\.+[\w:\-%\\]))*"
_PREFIX = r"[^\W\d_](?:[\w\-·.]*[\w\-·])?"
_RULES = [
    ("space", r"(?:\s+|\#[^\n]*)+"),
    ("iri", r"<[^<>\"{}|^`\\\x00-\x20]*>"),
    ("string", r'"""(?:(?:"|"")?(?:[^"\\]|\\.))*"""|\'\'\'(?:(?:\'|\'\')?(?:[^\'\\]|\\.))*\'\'\'|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\.)*\''),
    ("double", r"(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+"),
    ("decimal", r"\d*\.\d+"),
    ("integer", r"\d+"),
    ("bnode", r"_:[\w](?:[\w\-.]*[\w\-])?"),
    ("pname", rf"(?:{_PREFIX})?:(?:{_LOCAL})?"),
    ("var", r"[?$]\w+"),
    ("param", r"~[A-Za-z]\w*"),
    ("lang", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"),
    ("word", r"[A-Za-z_][\w]*"),
    ("op", r"\^\^|\|\||&&|!=|<=|>=|[{}()\[\].,;=<>!+\-*/|^?]"),
]
_SCAN = re.compile("|".join(f"(?P<{n}>{r})" for n, r in _RULES), re.S)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", "\\": "\\", '"': '"', "'": "'"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1] or m[2], 16))
        if m[2]:
            return chr(int(m[2], 16))
        if m[3] not in _ESCAPES:
            raise ParseError(f"bad escape \\{m[3]}")
        return _ESCAPES[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            line = text.count("\n", 0, at) + 1
            raise ParseError(f"line {line}: unexpected {text[at : at + 12]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
