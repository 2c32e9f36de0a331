"""The in-memory model of one text, and the builder that makes it from events.

A namespace (block or save frame) keeps, for each tag, its list of values; a scalar has one, or more if the tag is
repeated. Names are compared by NFC(casefold(NFD(name))). A value is text, a list or a dict. Quoted placeholders are kept
apart from bare ones by their double quotes.
"""

from __future__ import annotations

import copy
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

from . import types as T
from .parser import Parser
from .textfield import transform
from .types import ParseError

Value = "str | list | dict"


def fold(name: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", name).casefold())


class Scalar(str):
    """Text that remembers how it was written."""

    value_type: str

    def __new__(cls, value: str, value_type: str = T.STRING) -> Scalar:
        out = super().__new__(cls, value)
        out.value_type = value_type
        return out

    def __repr__(self) -> str:
        return f"Scalar({str.__repr__(self)}, {self.value_type!r})"


@dataclass
class Namespace:
    name: str
    values: dict[str, list] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)  # tags by first appearance
    loops: list[list[str]] = field(default_factory=list)

    @property
    def tags(self) -> list[str]:
        return list(self.order)

    def __contains__(self, tag: str) -> bool:
        return fold(tag) in self.values

    def __getitem__(self, tag: str) -> list:
        return self.values[fold(tag)]

    def get(self, tag: str, default: object = None) -> object:
        return self.values.get(fold(tag), default)

    def loop_of(self, tag: str) -> list[str] | None:
        return next((x for x in self.loops if fold(tag) in x), None)

    def scalars(self) -> list[str]:
        looped = {t for x in self.loops for t in x}
        return [t for t in self.order if t not in looped]


@dataclass
class Frame(Namespace):
    pass


@dataclass
class Block(Namespace):
    save_frames: list[Frame] = field(default_factory=list)

    def frame(self, name: str) -> Frame:
        return next(f for f in self.save_frames if fold(f.name) == fold(name))

    def __getitem__(self, key: str) -> object:
        if fold(key) in self.values:
            return self.values[fold(key)]
        for f in self.save_frames:
            if fold(f.name) == fold(key):
                return f
        raise KeyError(key)

    def get_all(self, name: str) -> list[Frame]:
        return [f for f in self.save_frames if fold(f.name) == fold(name)]


@dataclass
class CifFile:
    blocks: list[Block] = field(default_factory=list)
    version: str = T.V1

    def __getitem__(self, name: str) -> Block:
        for b in self.blocks:
            if fold(b.name) == fold(name):
                return b
        raise KeyError(name)

    def __contains__(self, name: str) -> bool:
        return any(fold(b.name) == fold(name) for b in self.blocks)

    def __iter__(self) -> Iterator[Block]:
        return iter(self.blocks)

    def get_all(self, name: str) -> list[Block]:
        return [b for b in self.blocks if fold(b.name) == fold(name)]

    def deepcopy(self) -> CifFile:
        return copy.deepcopy(self)


class Builder:
    """A handler that makes a CifFile. mode: `pad` fills a loop's last row with `?`, `strict` drops it."""

    def __init__(self, mode: str = "pad"):
        if mode not in ("pad", "strict"):
            raise ValueError(f"mode {mode!r}")
        self.mode, self.file, self.errors = mode, CifFile(), []
        self.space: Namespace | None = None
        self.block: Block | None = None
        self.tag: str | None = None
        self.loop: list[str] | None = None
        self.cells: list = []
        self.stack: list[tuple[object, str | None]] = []

    def _issue(self, code: str, message: str) -> None:
        self.errors.append(ParseError(code, message, 0, 0, "semantic"))

    def on_error(self, error: ParseError) -> None:
        self.errors.append(error)

    def on_data_block(self, name: str) -> None:
        if name in self.file:
            self._issue("repeated-block", f"block {name} is repeated")
        self.block = self.space = Block(name)
        self.file.blocks.append(self.block)

    def on_save_frame_start(self, name: str) -> None:
        self.space = Frame(name)
        self.block.save_frames.append(self.space)

    def on_save_frame_end(self) -> None:
        self.space = self.block

    def add_tag(self, tag: str) -> None:
        self.tag = fold(tag)
        if self.tag in self.space.values:
            self._issue("repeated-tag", f"tag {tag} is repeated")

    def _put(self, value: object) -> None:
        if self.stack:
            box, key = self.stack[-1]
            if isinstance(box, list):
                box.append(value)
            else:
                box[key] = value
            return
        if self.loop is not None:
            self.cells.append(value)
            return
        if self.tag not in self.space.values:
            self.space.values[self.tag] = []
            self.space.order.append(self.tag)
        self.space.values[self.tag].append(value)

    def add_value(self, value: str, value_type: str) -> None:
        if value_type == T.MULTILINE:
            value = transform(value)
        elif value in (".", "?") and value_type != T.PLACEHOLDER:
            value = f'"{value}"'
        self._put(Scalar(value, value_type))

    def on_list_start(self) -> None:
        self.stack.append(([], None))

    def on_table_start(self) -> None:
        self.stack.append(({}, None))

    def on_table_key(self, key: str, value_type: str) -> None:
        self.stack[-1] = (self.stack[-1][0], key)

    def on_list_end(self) -> None:
        self._put(self.stack.pop()[0])

    on_table_end = on_list_end

    def on_loop_start(self, tags: list[str]) -> None:
        self.loop, self.cells = [fold(t) for t in tags], []

    def on_loop_end(self) -> None:
        tags, n = self.loop, len(self.loop)
        self.loop = None
        over = len(self.cells) % n
        if over:
            self._issue("ragged-loop", f"loop of {n} tags has {len(self.cells)} values")
            if self.mode == "strict":
                self.cells = self.cells[: len(self.cells) - over]
            else:
                self.cells += [Scalar("?", T.PLACEHOLDER)] * (n - over)
        kept = []
        for i, t in enumerate(tags):
            if t in self.space.values:
                self._issue("repeated-tag", f"tag {t} is repeated by a loop; the loop's values get the number of the occurrence")
                n_th = next(k for k in range(2, len(self.space.values) + 3) if f"{t}#{k}" not in self.space.values)
                t = f"{t}#{n_th}"
            self.space.values[t] = self.cells[i::n]
            self.space.order.append(t)
            kept.append(t)
        if kept:
            self.space.loops.append(kept)


def build(source: str, *, mode: str = "pad") -> tuple[CifFile, list[ParseError]]:
    """The model of a text and its errors, in order. Never raises on text."""
    builder = Builder(mode)
    builder.file.version = Parser(builder).parse(source)
    return builder.file, builder.errors
