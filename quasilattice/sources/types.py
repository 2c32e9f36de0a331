"""Records of the text layer."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

V1, V2 = "1.1", "2.0"
#: How a value was written. Fixed values.
MULTILINE, TRIPLE_DOUBLE, TRIPLE_SINGLE, DOUBLE, SINGLE, STRING, PLACEHOLDER = "multiline", "triple_double", "triple_single", "double", "single", "string", "placeholder"


@dataclass(frozen=True)
class ParseError:
    code: str
    message: str
    line: int
    column: int
    kind: str = "syntactic"  # lexical, syntactic or semantic


@dataclass(frozen=True)
class Token:
    kind: str  # tag, value, data, save, save_end, loop, stop, global, or one of [ ] { } :
    text: str
    value_type: str | None
    line: int
    column: int
    errors: tuple[ParseError, ...] = field(default=())


class Handler(Protocol):
    """What a parse tells, in the order of the text."""

    def on_data_block(self, name: str) -> None: ...
    def on_save_frame_start(self, name: str) -> None: ...
    def on_save_frame_end(self) -> None: ...
    def add_tag(self, tag: str) -> None: ...
    def add_value(self, value: str, value_type: str) -> None: ...
    def on_list_start(self) -> None: ...
    def on_list_end(self) -> None: ...
    def on_table_start(self) -> None: ...
    def on_table_end(self) -> None: ...
    def on_table_key(self, key: str, value_type: str) -> None: ...
    def on_loop_start(self, tags: list[str]) -> None: ...
    def on_loop_end(self) -> None: ...
    def on_error(self, error: ParseError) -> None: ...
