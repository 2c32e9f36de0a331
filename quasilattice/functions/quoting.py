"""Stored values as tokens: the lightest quoting that reads back the same, text fields, containers.

quote() takes stored values: `.` and `?` are placeholders, `"."` and `"?"` the quoted characters, a NUL with JSON a container.
"""

from __future__ import annotations

import re

from ..sources.types import V1, V2
from .values import decode_container, is_container

_RESERVED = re.compile(r"(data_|save_)|(loop_|stop_|global_)$", re.IGNORECASE)
LINE_LIMIT = 2048


def illegal_start(s: str) -> bool:
    """Whether a value can't stand bare because of how it starts, or at all."""
    return not s or s[0] in "_#$'\"[];{}" or s[0].isspace() or bool(_RESERVED.match(s))


def text_field(s: str) -> str:
    return f"\n;{s}\n;"


def prefixed_field(s: str) -> str:
    return "\n;>\\\n" + "\n".join(f">{x}" for x in s.split("\n")) + "\n;"


def fold_lines(lines: list[str], width: int) -> list[str]:
    """Lines cut at the last blank before width, or at width; every cut ends with a backslash. A line that would read as
    a fold gets an empty one after it."""
    out = []
    for line in lines:
        while len(line) > width:
            cut = line.rfind(" ", 1, width - 1) + 1
            cut = cut if cut > 1 else width - 1
            out.append(line[:cut] + "\\")
            line = line[cut:]
        if re.search(r"\\[ \t]*$", line):
            out += [line + "\\", ""]
        else:
            out.append(line)
    return out


def folded_field(s: str, width: int) -> str:
    return "\n;\\\n" + "\n".join(fold_lines(s.split("\n"), width)) + "\n;"


def prefixed_folded_field(s: str, width: int) -> str:
    return "\n;>\\\\\n" + "\n".join(f">{x}" for x in fold_lines(s.split("\n"), width - 1)) + "\n;"


def make_text_field(s: str, line_limit: int = LINE_LIMIT) -> str:
    """The plainest field that reads back as s: prefixed if a line starts with a semicolon or the first would be read as
    a protocol, folded if a line is too long."""
    lines = s.split("\n")
    inner = any(x.startswith(";") for x in lines[1:])
    protocol = lines[0].rstrip(" \t").endswith("\\")
    long = any(len(x) + (i == 0) > line_limit for i, x in enumerate(lines))
    if long:
        return prefixed_folded_field(s, line_limit) if inner or any(x.startswith(";") for x in fold_lines(lines, line_limit)) else folded_field(s, line_limit)
    return prefixed_field(s) if inner or protocol else text_field(s)


def _quote_2(s: str, line_limit: int) -> str:
    line = "\n" not in s and "\r" not in s
    if line and not illegal_start(s) and not re.search(r"[\s\[\]{}]", s):
        return s
    if line and "'" not in s:
        return f"'{s}'"
    if line and '"' not in s:
        return f'"{s}"'
    if "\n" not in s:
        for mark in ("'''", '"""'):
            if mark not in s and not s.endswith(mark[0]):
                return f"{mark}{s}{mark}"
    return make_text_field(s, line_limit)


def _quote_1(s: str, line_limit: int) -> str:
    line = "\n" not in s and "\r" not in s
    if line and not illegal_start(s) and not re.search(r"\s", s):
        return s
    for mark in "'\"":
        if line and not re.search(mark + r"(\s|$)", s):
            return f"{mark}{s}{mark}"
    return make_text_field(s, line_limit)


def quote_text(s: str, version: str = V2, line_limit: int = LINE_LIMIT) -> str:
    """The token of a plain text; a text that looks like a placeholder is quoted."""
    if s in (".", "?"):
        return f"'{s}'"
    return _quote_2(s, line_limit) if version == V2 else _quote_1(s, line_limit)


def is_table_key_quotable(key: str) -> bool:
    return not _inline(key).startswith("\n")


def _inline(s: str) -> str:
    token = quote_text(s)
    if token != s:
        return token
    mark = next((m for m in ("'", '"', "'''", '"""') if m[0] not in s or len(m) == 3 and m not in s and not s.endswith(m[0])), None)
    return make_text_field(s) if mark is None else f"{mark}{s}{mark}"


def format_container(value: object, version: str = V2) -> str:
    """A list or dict in the syntax of version 2.0."""
    if version != V2:
        raise ValueError("containers can't be written in version 1.1")
    if isinstance(value, list):
        return "[" + " ".join(format_container(v) for v in value) + "]"
    if isinstance(value, dict):
        parts = []
        for k, v in value.items():
            if not is_table_key_quotable(k):
                raise ValueError(f"table key can't be written on one line: {k[:40]!r}")
            parts.append(f"{_inline(k)}:{format_container(v)}")
        return "{" + " ".join(parts) + "}"
    return quote("?" if value is None else str(value), version)


def quote(stored: str | None, version: str = V2, line_limit: int = LINE_LIMIT) -> str:
    """The token of a stored value."""
    if stored is None:
        return "?"
    if stored in (".", "?"):
        return stored
    if stored in ('"."', '"?"'):
        return f"'{stored[1]}'"
    if is_container(stored):
        return format_container(decode_container(stored), version)
    return quote_text(stored, version, line_limit)


__all__ = ["V1", "V2", "format_container", "illegal_start", "is_table_key_quotable", "make_text_field", "quote", "quote_text"]
