"""Values on the driver and at the Python edges: encoding, containers, uncertainties."""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation

NUL = "\x00"
_SU = re.compile(r"([+-]?)(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\((\d+)\)$")


def is_container(stored: str | None) -> bool:
    return bool(stored) and stored[0] == NUL


def encode_container(value: list | dict) -> str:
    return NUL + json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def decode_container(stored: str) -> object:
    return json.loads(stored[1:] if stored[:1] == NUL else stored)


def encode_value(value: object) -> tuple[str, str]:
    """(stored, type): placeholder, double_quoted, list, table or string."""
    if isinstance(value, list):
        return encode_container(value), "list"
    if isinstance(value, dict):
        return encode_container(value), "table"
    text = str(value)
    if text in (".", "?"):
        return text, "placeholder"
    return text, "double_quoted" if getattr(value, "value_type", None) == "double" else "string"


def split_su(raw: str) -> tuple[str, str | None]:
    """`num(su)` -> (num, su in units of one), exactly; other text -> (text, None)."""
    m = _SU.match(raw)
    if not m:
        return raw, None
    sign, body, exponent, su = m.groups()
    places = len(body.partition(".")[2]) - int((exponent or "e0")[1:])
    digits = su.lstrip("0") or "0"
    if places > 0:
        digits = digits.zfill(places + 1)
        scaled = f"{digits[:-places]}.{digits[-places:]}"
    else:
        scaled = digits if digits == "0" else digits + "0" * -places
    return sign + body + (exponent or ""), scaled


def split_su_container(stored: str) -> tuple[str, str | None]:
    """The same for every leaf; leaves without an uncertainty get `0`. None if no leaf has one."""
    value, found = decode_container(stored), False

    def walk(x: object) -> tuple[object, object]:
        nonlocal found
        if isinstance(x, list):
            pairs = [walk(v) for v in x]
            return [a for a, _ in pairs], [b for _, b in pairs]
        if isinstance(x, dict):
            pairs = {k: walk(v) for k, v in x.items()}
            return {k: a for k, (a, _) in pairs.items()}, {k: b for k, (_, b) in pairs.items()}
        number, su = split_su(str(x))
        found |= su is not None
        return number, su if su is not None else "0"

    number, su = walk(value)
    return (encode_container(number), encode_container(su)) if found else (stored, None)


def merge_su(measurand: str, su: str) -> str:
    """The inverse of split_su: the uncertainty in units of the measurand's last place."""
    try:
        places = -Decimal(measurand).as_tuple().exponent
        units = (Decimal(su).scaleb(places)).to_integral_value()
    except (InvalidOperation, TypeError, ValueError):
        return measurand
    return f"{measurand}({units:f})"


def canonical_real(value: str, is_su: bool = False) -> str:
    """A number's canonical text: uncertainty off, significant figures kept, exponent resolved; an uncertainty loses
    trailing zeros too. Other text stays."""
    try:
        d = Decimal(re.sub(r"\(\d+\)$", "", value))
    except InvalidOperation:
        return value
    if not d.is_finite():
        return value
    return f"{d.normalize():f}" if is_su else f"{d:f}"


def extract_leaves(value: object) -> list:
    if isinstance(value, list):
        return [x for v in value for x in extract_leaves(v)]
    if isinstance(value, dict):
        return [x for v in value.values() for x in extract_leaves(v)]
    return [value]
