"""Editing models: checked changes of tags, loops, frames and blocks."""

from __future__ import annotations

import copy
import re
from collections.abc import Mapping, Sequence

from . import types as T
from .model import Block, CifFile, Frame, Namespace, Scalar, fold


def is_legal_name(name: str, version: str) -> bool:
    if not name:
        return False
    if version == T.V1:
        return bool(re.fullmatch(r"[!-~]+", name))
    return name.isprintable() and not re.search(r"\s", name)


def infer(value: object) -> object:
    """A stored value of text, a number, a truth value, a list or a dict."""
    if value is None:
        return Scalar("?", T.PLACEHOLDER)
    if isinstance(value, bool):
        return Scalar("yes" if value else "no")
    if isinstance(value, (list, tuple)):
        return [infer(v) for v in value]
    if isinstance(value, Mapping):
        return {str(k): infer(v) for k, v in value.items()}
    if isinstance(value, Scalar):
        return value
    text = str(value)
    return Scalar(text, T.PLACEHOLDER if text in (".", "?") else T.STRING)


def has_container(values: Sequence[object]) -> bool:
    return any(isinstance(v, (list, dict)) for v in values)


class SaveFrameWriter:
    """Edits a namespace in place. What isn't allowed raises ValueError and changes nothing."""

    def __init__(self, space: Namespace, version: str):
        self.space, self.version = space, version

    @property
    def tags(self) -> list[str]:
        return self.space.tags

    @property
    def loops(self) -> list[list[str]]:
        return [list(x) for x in self.space.loops]

    def __getitem__(self, tag: str) -> list:
        return self.space[tag]

    def get(self, tag: str, default: object = None) -> object:
        return self.space.get(tag, default)

    def _new(self, tag: str) -> str:
        if not tag.startswith("_") or not is_legal_name(tag, self.version) or len(tag) < 2:
            raise ValueError(f"not a tag: {tag!r}")
        if tag in self.space:
            raise ValueError(f"tag {tag} is there already")
        return fold(tag)

    def _loop(self, tag: str) -> list[str]:
        loop = self.space.loop_of(tag)
        if loop is None:
            raise ValueError(f"tag {tag} isn't in a loop")
        return loop

    def _put(self, tag: str, values: list) -> None:
        self.space.values[tag] = values
        self.space.order.append(tag)

    def _drop(self, tag: str) -> None:
        self.space.values.pop(tag)
        self.space.order.remove(tag)

    def set_tag(self, tag: str, value: object) -> SaveFrameWriter:
        self._put(self._new(tag), [infer(value)])
        return self

    def add_loop(self, columns: Mapping[str, Sequence[object]]) -> SaveFrameWriter:
        if not columns or len({len(v) for v in columns.values()}) > 1 or not all(len(v) for v in columns.values()):
            raise ValueError("a loop takes columns of one length, one value at least")
        tags = [self._new(t) for t in columns]
        if len(set(tags)) < len(tags):
            raise ValueError("a loop takes each tag once")
        for t, v in zip(tags, columns.values(), strict=True):
            self._put(t, [infer(x) for x in v])
        self.space.loops.append(tags)
        return self

    def add_loop_column(self, loop_tag: str, new_tag: str, values: Sequence[object]) -> SaveFrameWriter:
        loop, tag = self._loop(loop_tag), self._new(new_tag)
        if len(values) != len(self.space.values[loop[0]]):
            raise ValueError(f"the loop has {len(self.space.values[loop[0]])} rows")
        self._put(tag, [infer(v) for v in values])
        loop.append(tag)
        return self

    def reorder_loop_tags(self, loop_tag: str, new_order: Sequence[str]) -> SaveFrameWriter:
        loop, order = self._loop(loop_tag), [fold(t) for t in new_order]
        if sorted(order) != sorted(loop):
            raise ValueError("the new order must have the loop's tags, each once")
        loop[:] = order
        return self

    def get_loop_tags(self, loop_tag: str) -> list[str]:
        return list(self._loop(loop_tag))

    def add_loop_row(self, loop_tag: str, row: Mapping[str, object]) -> SaveFrameWriter:
        loop, cells = self._loop(loop_tag), {fold(t): v for t, v in row.items()}
        if set(cells) != set(loop):
            raise ValueError("a row takes the loop's tags, each once")
        for t in loop:
            self.space.values[t].append(infer(cells[t]))
        return self

    def reassign_tag(self, tag: str, value: object) -> SaveFrameWriter:
        name = fold(tag)
        if name not in self.space.values:
            raise ValueError(f"no tag {tag}")
        if self.space.loop_of(tag):
            if not isinstance(value, (list, tuple)) or len(value) != len(self.space.values[name]):
                raise ValueError(f"the loop has {len(self.space.values[name])} rows")
            self.space.values[name] = [infer(v) for v in value]
        else:
            self.space.values[name] = [infer(value)]
        return self

    def delete_tag(self, tag: str) -> SaveFrameWriter:
        name = fold(tag)
        if name not in self.space.values:
            raise ValueError(f"no tag {tag}")
        loop = self.space.loop_of(tag)
        self._drop(name)
        if loop is not None:
            loop.remove(name)
            self.space.loops[:] = [x for x in self.space.loops if x]
        return self

    def remove_loop_tag(self, loop_tag: str, tag: str) -> SaveFrameWriter:
        if fold(tag) not in self._loop(loop_tag):
            raise ValueError(f"tag {tag} isn't in the loop of {loop_tag}")
        return self.delete_tag(tag)


def _pick(items: list, name: str, which: str) -> int:
    at = [i for i, x in enumerate(items) if fold(x.name) == fold(name)]
    if not at:
        raise ValueError(f"nothing is named {name}")
    if which not in ("first", "last"):
        raise ValueError(f"which: first or last, not {which!r}")
    return at[0 if which == "first" else -1]


class BlockWriter(SaveFrameWriter):
    space: Block

    @property
    def save_frames(self) -> list[str]:
        return [f.name for f in self.space.save_frames]

    def _name(self, name: str) -> str:
        if not is_legal_name(name, self.version):
            raise ValueError(f"not a name: {name!r}")
        if any(fold(f.name) == fold(name) for f in self.space.save_frames):
            raise ValueError(f"save frame {name} is there already")
        return name

    def add_save_frame(self, name: str) -> SaveFrameWriter:
        frame = Frame(self._name(name))
        self.space.save_frames.append(frame)
        return SaveFrameWriter(frame, self.version)

    def get_save_frame(self, name: str, which: str = "first") -> SaveFrameWriter:
        return SaveFrameWriter(self.space.save_frames[_pick(self.space.save_frames, name, which)], self.version)

    def remove_save_frame(self, name: str, which: str = "first") -> BlockWriter:
        del self.space.save_frames[_pick(self.space.save_frames, name, which)]
        return self

    def rename_save_frame(self, name: str, new_name: str, which: str = "first") -> BlockWriter:
        at = _pick(self.space.save_frames, name, which)
        if fold(name) != fold(new_name):
            self._name(new_name)
        self.space.save_frames[at].name = new_name
        return self


class CifWriter:
    """Builds a model, or edits a copy of one."""

    def __init__(self, source: CifFile | None = None, version: str = T.V2):
        self.file = copy.deepcopy(source) if source is not None else CifFile(version=version)

    @property
    def version(self) -> str:
        return self.file.version

    @property
    def blocks(self) -> list[str]:
        return [b.name for b in self.file.blocks]

    def __getitem__(self, name: str) -> BlockWriter:
        return self.get_block(name)

    def __contains__(self, name: str) -> bool:
        return name in self.file

    def get(self, name: str, default: object = None) -> object:
        return self.get_block(name) if name in self.file else default

    def _name(self, name: str) -> str:
        if not is_legal_name(name, self.version):
            raise ValueError(f"not a name: {name!r}")
        if name in self.file:
            raise ValueError(f"block {name} is there already")
        return name

    def add_block(self, name: str) -> BlockWriter:
        block = Block(self._name(name))
        self.file.blocks.append(block)
        return BlockWriter(block, self.version)

    def get_block(self, name: str, which: str = "first") -> BlockWriter:
        return BlockWriter(self.file.blocks[_pick(self.file.blocks, name, which)], self.version)

    def remove_block(self, name: str, which: str = "first") -> CifWriter:
        del self.file.blocks[_pick(self.file.blocks, name, which)]
        return self

    def rename_block(self, name: str, new_name: str, which: str = "first") -> CifWriter:
        at = _pick(self.file.blocks, name, which)
        if fold(name) != fold(new_name):
            self._name(new_name)
        self.file.blocks[at].name = new_name
        return self

    def build(self) -> CifFile:
        """A checked copy; ValueError lists what is wrong."""
        wrong: list[str] = []
        for block in self.file.blocks:
            for space in (block, *block.save_frames):
                check_namespace(space, self.version, wrong)
        if wrong:
            raise ValueError("; ".join(wrong))
        return copy.deepcopy(self.file)


def check_namespace(space: Namespace, version: str, wrong: list[str]) -> None:
    for loop in space.loops:
        if len({len(space.values[t]) for t in loop}) > 1:
            wrong.append(f"{space.name}: columns of the loop of {loop[0]} differ in length")
    for tag in space.order:
        values = space.values[tag]
        if not values:
            wrong.append(f"{space.name}: {tag} has no value")
        if len(values) > 1 and not space.loop_of(tag):
            wrong.append(f"{space.name}: {tag} has {len(values)} values outside of a loop")
        if version == T.V1 and has_container(values):
            wrong.append(f"{space.name}: {tag} has a container, which version 1.1 hasn't")
