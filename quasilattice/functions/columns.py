"""Scalar functions as Column expressions: they stay in whole-stage code generation.

Text is cast with try_ functions only, as ANSI mode is on by default and values are dirty. Integers are rounded half away
from zero, as the loaded values' casts are defined; `1d` and `0x10` aren't numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two placeholders, and the pattern of a number with optional exponent.
PLACEHOLDERS = (".", "?")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SU = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\((\d+)\)$"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CONTAINER = "\x00"


def is_sentinel(x: Column) -> Column:
    return x.isin(*PLACEHOLDERS)


def is_uuid(x: Column) -> Column:
    return x.rlike(UUID)


def split_su(x: Column) -> tuple[Column, Column]:
    """`num(su)` -> (num, su scaled to num's last place), as exact decimal text; other values -> (value, null).

    The place is the number of decimals less the exponent; digits are shifted as text, never as floating point."""
    has = F.contains(x, F.lit("(")) & x.rlike(SU)
    parts = F.struct(
        F.regexp_replace(F.regexp_extract(x, SU, 2), "^0+(?=.)", "").alias("digits"),
        (F.length(F.regexp_extract(x, r"\.(\d*)(?:[eE][+-]?\d+)?\(", 1)) - F.coalesce(F.regexp_extract(x, r"[eE]([+-]?\d+)\(", 1).try_cast("int"), F.lit(0))).alias("places"),
    )

    def scaled(p: Column) -> Column:
        places = p["places"]
        padded = F.lpad(p["digits"], F.greatest(places + 1, F.length(p["digits"])), F.lit("0"))
        below = F.concat(F.substring(padded, F.lit(1), F.length(padded) - places), F.lit("."), F.substring(padded, F.length(padded) - places + 1, places))
        above = F.when(p["digits"] == "0", p["digits"]).otherwise(F.concat(p["digits"], F.repeat(F.lit("0"), -places)))
        return F.when(places > 0, below).otherwise(above)

    # A one-element transform binds the parts: each regex runs once a value.
    su = F.element_at(F.transform(F.array(parts), scaled), 1)
    return F.when(has, F.regexp_extract(x, SU, 1)).otherwise(x), F.when(has, su)


def merged_su(measurand: Column, su: Column) -> Column:
    """The inverse of split_su for plain decimals: the uncertainty in units of the measurand's last place."""
    places = F.length(F.regexp_extract(measurand, r"\.(\d*)$", 1))
    units = F.round(su.try_cast("decimal(38,18)") * F.pow(F.lit(10.0), places).cast("decimal(38,0)"), 0).cast("decimal(38,0)").cast("string")
    return F.when(measurand.rlike(NUMBER) & su.rlike(NUMBER), F.concat(measurand, F.lit("("), units, F.lit(")"))).otherwise(measurand)


def to_integer(x: Column) -> Column:
    return F.when(x.rlike(NUMBER), F.round(x.try_cast("decimal(38,10)"), 0).try_cast("int"))


def to_real(x: Column) -> Column:
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def without_su(x: Column) -> Column:
    """A trailing (digits) removed; the regex runs only where there is a bracket."""
    return F.when(F.contains(x, F.lit("(")), F.regexp_replace(x, r"\(\d+\)$", "")).otherwise(x)


def typed(x: Column, contents: str) -> Column:
    """Placeholders become null, uncertainties go, then the cast for the type; other types stay text."""
    if contents not in ("Integer", "Real", "Float"):
        return x
    bare = F.when(~is_sentinel(x), without_su(x))
    return to_integer(bare) if contents == "Integer" else to_real(bare)


def leaves(x: Column) -> Column:
    """The JSON list of a stored container as an array of text; null if it is none. One level."""
    body = F.when(F.substring(x, 1, 1) == CONTAINER, F.substring(x, F.lit(2), F.length(x))).otherwise(x)
    return F.from_json(body, "array<string>")


def typed_list(x: Column, contents: str) -> Column:
    """A stored list with its leaves cast, as JSON text again."""
    return F.to_json(F.transform(leaves(x), lambda v: typed(v, contents)))


def sanitized(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9_]", "_"), "_+", "_"), F.lit("_"))


def block_name(keys: Column) -> Column:
    """array of (object, value) -> `object_value` in object order, joined by `_`."""
    return F.array_join(F.transform(F.array_sort(keys), lambda k: F.concat_ws("_", k[0], k[1])), "_")


#: Words that can't stand bare, and first characters that can't. Fixed values of the format.
RESERVED = "(?i)^(data_|save_|loop_$|stop_$|global_$)"
ILLEGAL_START = r"""^[_#$'"\[\]{};]"""


def bare(x: Column) -> Column:
    """Whether a value can stand without quotes in version 2.0."""
    return (F.length(x) > 0) & ~x.rlike(r"[\s\[\]{}]") & ~x.rlike(ILLEGAL_START) & ~x.rlike(RESERVED) & ~is_sentinel(x)


def quoted(x: Column) -> Column:
    """The version 2.0 token of a plain value, the lightest quoting first. Placeholders stand as they are."""
    line = ~x.rlike(r"[\r\n]")
    return (
        F.when(is_sentinel(x) | bare(x), x)
        .when(line & ~F.contains(x, F.lit("'")), F.concat(F.lit("'"), x, F.lit("'")))
        .when(line & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), x, F.lit('"')))
        .when(~F.contains(x, F.lit("'''")) & ~x.endswith("'"), F.concat(F.lit("'''"), x, F.lit("'''")))
        .when(~F.contains(x, F.lit('"""')) & ~x.endswith('"'), F.concat(F.lit('"""'), x, F.lit('"""')))
        .otherwise(F.concat(F.lit("\n;"), x, F.lit("\n;")))
    )


def integer_part(x: Column) -> Column:
    return F.substring_index(x, ".", 1)


#: The text rules of the dictionary language's content types. Fixed values; types without a rule take any text. A Range's
#: ends are numbers; a DateTime is a date of the calendar (see real_date) with or without a time.
CONTENTS = {
    "Word": r"^\S*$",
    "Code": r"^\S*$",
    "Name": r"^[A-Za-z0-9_]+$",
    "Tag": r"^_\S+$",
    "Uri": r"^\S*$",
    "Iri": r"^[^\t\n\r]*$",
    "Date": r"^\d{4}-\d{2}-\d{2}$",
    "DateTime": r"^(?:\d{4}-?\d{2}-?\d{2}|\d{4}-?W\d{2}(?:-?[1-7])?)(?:[\s\S](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?)?)?$",
    "Version": r"^\d+\.\d+\.\d+",
    "Dimension": r"^\[(\d+(,\d+)*)?\]$",
    "Range": r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)?:([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)?$",
    "Integer": r"^[+-]?\d+$",
    "Real": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?(\(\d+\))?$",
    "Symop": r"^\d+([_ ]\d{3,})?$",
}


def real_date(x: Column) -> Column:
    """Whether the date that a DateTime begins with is one: a day of the calendar, or of an ISO week that the year has."""
    year, digits = F.substring(x, 1, 4), F.regexp_replace(F.substring(x, 1, 10), "-", "")
    day = F.concat_ws("-", year, F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date").isNotNull()
    week = F.regexp_extract(x, r"W(\d{2})", 1).try_cast("int")
    last = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    return (year != "0000") & F.when(F.contains(x, F.lit("W")), week.between(1, last)).otherwise(day)


def contents_ok(x: Column, contents: str) -> Column:
    if contents not in CONTENTS:
        return F.lit(True)
    fits = x.rlike(CONTENTS[contents])
    return fits & F.coalesce(real_date(x), F.lit(False)) if contents == "DateTime" else fits


def in_range(x: Column, low: float | None, high: float | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (x >= low)
    if high is not None:
        out = out & (x <= high)
    return out


def in_states(x: Column, states: Sequence[str], fold: bool = False) -> Column:
    return F.lower(x).isin(*(s.lower() for s in states)) if fold else x.isin(*states)


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped id of content: equal wherever and however often it is computed."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
