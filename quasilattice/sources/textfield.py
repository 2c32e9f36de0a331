"""The two protocols of text fields: a prefix on every line, and folded long lines."""

from __future__ import annotations

import re


def transform(raw: str) -> str:
    """A text field's value: the prefix taken off, then folded lines joined. Text without such a first line stays as it is."""
    lines = raw.split("\n")
    first = lines[0].rstrip(" \t")
    folded = first.endswith("\\")
    if not folded:
        return raw
    prefix = first[:-1]
    if prefix.endswith("\\"):
        prefix, folded = prefix[:-1], True
    elif prefix:
        folded = False
    else:
        prefix = ""
    body = lines[1:]
    if prefix:
        if not all(x.startswith(prefix) for x in body):
            return raw
        body = [x[len(prefix) :] for x in body]
    if not folded:
        return "\n".join(body)
    return _unfold(body)


def _unfold(body: list[str]) -> str:
    out: list[str] = []
    joining = False
    for x in body:
        cut = re.search(r"\\[ \t]*$", x)
        text = x[: cut.start()] if cut else x
        if joining:
            out[-1] += text
        else:
            out.append(text)
        joining = bool(cut)
    return "\n".join(out)
