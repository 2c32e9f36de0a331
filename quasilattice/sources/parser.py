"""The grammar over tokens: events for a handler, with recovery from whatever comes."""

from __future__ import annotations

from dataclasses import dataclass

from . import types as T
from .lexer import Lexer
from .types import Handler, ParseError, Token


@dataclass
class _Table:
    key: Token | None = None
    colon: bool = False


class Parser:
    """Drives a handler over a text. Structure is decided on tokens, so a quoted bracket or colon is a plain value."""

    def __init__(self, handler: Handler):
        self.h = handler

    def parse(self, source: str, version: str | None = None) -> str:
        lexer = Lexer(source, version)
        for e in lexer.errors:
            self.h.on_error(e)
        self.block = self.frame = False
        self.tag: Token | None = None  # a scalar tag that waits for its value
        self.loop: Token | None = None
        self.header: list[str] | None = None  # while the loop's tags are read
        self.filled = False
        self.open: list[_Table | None] = []  # None: a list
        self.halted = False
        last = Token("end", "", None, 1, 1)
        stream = iter(lexer.tokens())
        for token in stream:
            for e in token.errors:
                self.h.on_error(e)
            self._take(token)
            last = token
            if self.halted:
                break
        self._end(last)
        return lexer.version

    # ---- helpers

    def _error(self, code: str, message: str, at: Token) -> None:
        self.h.on_error(ParseError(code, message, at.line, at.column))

    def _finish(self, at: Token, why: str) -> None:
        """Close what is open before a tag, a keyword or the end."""
        while self.open:
            table = self.open.pop()
            if table is None:
                self._error("unterminated-list", f"list is open at {why}", at)
                self.h.on_list_end()
            else:
                if table.key is not None:
                    self._pending_key(table, at)
                self._error("unterminated-table", f"table is open at {why}", at)
                self.h.on_table_end()
            self._closed()
        if self.tag is not None:
            self._error("missing-value", f"tag {self.tag.text} has no value", at)
            self.h.add_value("?", T.PLACEHOLDER)
            self.tag = None
        if self.header is not None:
            self._open_loop(at)
        if self.loop is not None:
            if not self.filled:
                self._error("empty-loop", "loop has no values", at)
            self.h.on_loop_end()
            self.loop = None

    def _open_loop(self, at: Token) -> None:
        tags, self.header = self.header, None
        if not tags:
            self._error("loop-without-tags", "loop_ isn't followed by a tag", at)
            self.loop = None
            return
        self.h.on_loop_start(tags)
        self.filled = False

    def _ready(self, at: Token) -> bool:
        """Make place for a value; False if there is no block for it."""
        if self.header is not None:
            self._open_loop(at)
        if self.open or self.tag is not None or self.loop is not None:
            return True
        if not self.block:
            self._error("outside-block", "value outside of a data block", at)
            return False
        self._error("orphan-value", f"value {at.text[:40]!r} has no tag", at)
        self.h.add_tag("_orphan.value")
        self.tag = at
        return True

    def _closed(self) -> None:
        """A whole value has come."""
        if self.open:
            table = self.open[-1]
            if table is not None:
                table.key, table.colon = None, False
            return
        self.tag = None
        if self.loop is not None:
            self.filled = True

    def _pending_key(self, table: _Table, at: Token) -> None:
        self._error("missing-value" if table.colon else "missing-colon", f"table key {table.key.text[:40]!r} has no value", at)
        self.h.on_table_key(table.key.text, table.key.value_type or T.STRING)
        self.h.add_value("?", T.PLACEHOLDER)
        table.key, table.colon = None, False

    def _enter(self, at: Token) -> bool:
        """A container opens: in a table it needs a key."""
        if not self._ready(at):
            return False
        if self.open and (table := self.open[-1]) is not None:
            if table.key is None:
                self._error("missing-key", "container in a table without a key", at)
                self.h.on_table_key("", T.STRING)
            else:
                if not table.colon:
                    self._error("missing-colon", f"no colon after table key {table.key.text[:40]!r}", at)
                self.h.on_table_key(table.key.text, table.key.value_type or T.STRING)
        return True

    # ---- tokens

    def _take(self, t: Token) -> None:
        kind = t.kind
        if kind == "value":
            self._value(t)
        elif kind in ("[", "{"):
            if self._enter(t):
                self.open.append(None if kind == "[" else _Table())
                self.h.on_list_start() if kind == "[" else self.h.on_table_start()
        elif kind in ("]", "}"):
            self._close(t)
        elif kind == ":":
            self._colon(t)
        elif kind == "tag":
            self._tag(t)
        else:
            self._keyword(t)

    def _value(self, t: Token) -> None:
        if not self._ready(t):
            return
        if self.open and (table := self.open[-1]) is not None:
            if table.key is None:
                if t.value_type in (T.STRING, T.PLACEHOLDER, T.MULTILINE):
                    self._error("unquoted-key", f"table key {t.text[:40]!r} isn't quoted", t)
                table.key = t
                return
            if not table.colon:
                self._pending_key(table, t)
                table.key = t
                return
            self.h.on_table_key(table.key.text, table.key.value_type or T.STRING)
        self.h.add_value(t.text, t.value_type or T.STRING)
        self._closed()

    def _colon(self, t: Token) -> None:
        table = self.open[-1] if self.open else None
        if table is None:
            self._value(Token("value", ":", T.STRING, t.line, t.column))
        elif table.key is None:
            self._error("missing-key", "colon without a table key", t)
        elif table.colon:
            self._error("extra-colon", "second colon after a table key", t)
        else:
            key = table.key
            width = len(key.text) + {T.TRIPLE_DOUBLE: 6, T.TRIPLE_SINGLE: 6, T.DOUBLE: 2, T.SINGLE: 2}.get(key.value_type or "", 0)
            if "\n" not in key.text and (t.line, t.column) != (key.line, key.column + width):
                self._error("space-before-colon", "white space between a table key and its colon", t)
            table.colon = True

    def _close(self, t: Token) -> None:
        if not self.open:
            self._error("unmatched-close", f"{t.text} closes nothing", t)
            return
        want = "]" if self.open[-1] is None else "}"
        if t.kind != want and not any((x is None) == (t.kind == "]") for x in self.open):
            self._error("unmatched-close", f"{t.text} closes nothing", t)
            return
        while True:
            table = self.open.pop()
            mine = (table is None) == (t.kind == "]")
            if not mine:
                self._error("unterminated-list" if table is None else "unterminated-table", f"closed by {t.text}", t)
            if table is None:
                self.h.on_list_end()
            else:
                if table.key is not None:
                    self._pending_key(table, t)
                self.h.on_table_end()
            self._closed()
            if mine:
                return

    def _tag(self, t: Token) -> None:
        if self.header is not None:
            self.header.append(t.text)
            return
        self._finish(t, f"tag {t.text}")
        if not self.block:
            self._error("outside-block", f"tag {t.text} outside of a data block", t)
            return
        self.h.add_tag(t.text)
        self.tag = t

    def _keyword(self, t: Token) -> None:
        if t.kind == "stop":
            if self.loop is None and self.header is None:
                self._error("stray-stop", "stop_ outside of a loop", t)
            self._finish(t, "stop_")
            return
        self._finish(t, t.kind)
        if t.kind == "loop":
            if not self.block:
                self._error("outside-block", "loop_ outside of a data block", t)
                return
            self.loop, self.header = t, []
        elif t.kind == "data":
            if self.frame:
                self.h.on_error(ParseError("frame-open", "data block starts in a save frame, which ends here", t.line, t.column, "warning"))
                self.h.on_save_frame_end()
            self.block, self.frame = True, False
            self.h.on_data_block(t.text)
        elif t.kind == "save":
            if self.frame:
                self._error("nested-frame", "save frame in a save frame", t)
                self.h.on_save_frame_end()
            if not self.block:
                self._error("outside-block", "save frame outside of a data block", t)
                return
            self.frame = True
            self.h.on_save_frame_start(t.text)
        elif t.kind == "save_end":
            if not self.frame:
                self._error("stray-save", "save_ closes nothing", t)
                return
            self.frame = False
            self.h.on_save_frame_end()
        else:
            self._error("global", "global_ isn't supported; reading stops", t)
            self.halted = True

    def _end(self, last: Token) -> None:
        self._finish(last, "the end of the text")
        if self.frame:
            self._error("frame-open", "save frame is open at the end of the text", last)
            self.h.on_save_frame_end()
