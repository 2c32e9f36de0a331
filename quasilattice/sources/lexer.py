"""Version sniffing and tokens of CIF 1.1 and 2.0 text. Problems become errors on tokens; nothing raises."""

from __future__ import annotations

import re
from collections.abc import Iterator

from . import types as T
from .types import ParseError, Token

_SPACE = re.compile(r"(?:[ \t\r\n]+|#[^\n]*)+")
_WORD = re.compile(r"[^ \t\r\n]+")
_WORD_2 = re.compile(r"[^ \t\r\n\[\]{}]+")
_FIELD_END = re.compile(r"\n;")
_MAGIC = re.compile(r"#\\#CIF_(\S+)")
_KEYWORD = {"loop_": "loop", "stop_": "stop", "global_": "global", "save_": "save_end"}
_QUOTES = {'"""': T.TRIPLE_DOUBLE, "'''": T.TRIPLE_SINGLE, '"': T.DOUBLE, "'": T.SINGLE}
_NOT_1 = re.compile(r"[^\t\n\r -~]")


def detect_version(source: str) -> tuple[str, str, int, list[ParseError]]:
    """(version, text after a byte-order mark, lines before the magic code, errors): no code means 1.1, an unknown one 2.0."""
    text = source.removeprefix("﻿")
    for n, line in enumerate(text.split("\n")):
        if not line.strip():
            continue
        m = _MAGIC.match(line.strip())
        if not m:
            return T.V1, text, n, []
        if m[1] in ("1.1", "1.0"):
            return T.V1, text, n, []
        if m[1] == "2.0":
            return T.V2, text, n, []
        return T.V2, text, n, [ParseError("unknown-version", f"unknown version {m[1]}, read as 2.0", n + 1, 1, "lexical")]
    return T.V1, text, 0, []


def classify(word: str) -> str:
    low = word.lower()
    if word.startswith("_"):
        return "tag"
    if low in _KEYWORD:
        return _KEYWORD[low]
    if low.startswith("data_"):
        return "data"
    return "save" if low.startswith("save_") else "value"


class Lexer:
    def __init__(self, source: str, version: str | None = None):
        found, self.text, _, self.errors = detect_version(source)
        self.text = self.text.replace("\r\n", "\n").replace("\r", "\n")
        self.version = version or found
        self.two = self.version == T.V2
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def tokens(self) -> Iterator[Token]:
        text, at, line = self.text, 0, 0
        depth: list[str] = []  # open containers, so that a colon in a table is seen
        closed = -1  # end of the last quoted value
        while True:
            m = _SPACE.match(text, at)
            # A comment starts only at the start of the text or after white space, where tokens start too.
            at = m.end() if m else at
            if at >= len(text):
                return
            while line + 1 < len(self.starts) and self.starts[line + 1] <= at:
                line += 1
            where, c = (line + 1, at - self.starts[line] + 1), text[at]

            def token(kind: str, value: str, value_type: str | None = None, *errors: tuple[str, str], where: tuple[int, int] = where) -> Token:
                found = [ParseError(code, message, *where, "lexical") for code, message in errors]
                if not self.two and (bad := _NOT_1.search(value)):
                    found.append(ParseError("illegal-character", f"character U+{ord(bad[0]):04X} isn't allowed in version 1.1", *where, "lexical"))
                return Token(kind, value, value_type, *where, tuple(found))

            if c == ";" and where[1] == 1:
                end = _FIELD_END.search(text, at)
                if end:
                    yield token("value", text[at + 1 : end.start()], T.MULTILINE)
                    at = end.end()
                else:
                    yield token("value", text[at + 1 :], T.MULTILINE, ("unterminated-text", "text field without an end"))
                    return
                continue
            if self.two and c in "[]{}":
                if c in "[{":
                    depth.append(c)
                elif depth:
                    depth.pop()
                yield token(c, c)
                at += 1
                continue
            if self.two and c == ":" and (closed == at or depth[-1:] == ["{"]):
                yield token(":", ":")
                at += 1
                continue
            if c in "'\"":
                value, kind, at, errors = self._quoted(at)
                yield token("value", value, kind, *errors)
                closed = at
                continue
            m = _WORD.match(text, at)
            word, errors = m[0], []
            kind = classify(word)
            if kind == "value":
                if self.two:
                    word = _WORD_2.match(text, at)[0]
                    if depth[-1:] == ["{"] and ":" in word:
                        word = word[: word.index(":")]
                    kind = classify(word)
                elif c in "[]$":
                    errors.append(("illegal-start", f"a bare value can't start with {c}"))
            if kind == "data":
                word = word[5:]
                if not word:
                    errors.append(("no-block-name", "data_ without a name"))
            elif kind == "save":
                word = word[5:]
            value_type = (T.PLACEHOLDER if word in (".", "?") else T.STRING) if kind == "value" else None
            yield token(kind, word, value_type, *errors)
            at += max(1, len(word) + 5 * (kind in ("data", "save")))

    def _quoted(self, at: int) -> tuple[str, str, int, list[tuple[str, str]]]:
        text, mark, errors = self.text, self.text[at : at + 3], []
        if mark in ('"""', "'''"):
            end = text.find(mark, at + 3)
            if self.two or end > 0 and text[at + 3 : at + 4] not in ("", " ", "\n", "\t"):
                if not self.two:
                    errors.append(("triple-quotes", "triple quotes aren't allowed in version 1.1"))
                if end < 0:
                    return text[at + 3 :], _QUOTES[mark], len(text), [*errors, ("unterminated-quote", "triple-quoted value without an end")]
                return text[at + 3 : end], _QUOTES[mark] if self.two else T.STRING, end + 3, errors
        quote = text[at]
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        end = at
        while True:
            end = text.find(quote, end + 1, stop)
            if end < 0:
                return text[at + 1 : stop], _QUOTES[quote], stop, [("unterminated-quote", f"value quoted with {quote} ends with its line")]
            if self.two or end + 1 >= len(text) or text[end + 1] in " \t\n":
                return text[at + 1 : end], _QUOTES[quote], end + 1, errors
