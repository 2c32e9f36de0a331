"""Checks of loaded values against the dictionary.

All tables are unpivoted to (table, column, value); each column's rules are Column expressions. Only what built-in
functions can't judge, arbitrary nesting of containers, goes through an Arrow-batched Python function, and only for
containers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.quoting import is_table_key_quotable
from ..functions.values import decode_container, extract_leaves
from ..plans.schema import BLOCK, ID, ROW, Column, Schema, Table
from ..sources.model import CifFile, build
from . import relational as R
from .ingest import Dataset, IngestionError, ingest

ISSUES = "check_name string, severity string, table_name string, column_name string, block_id string, row_id long, value string, detail string"
FOLDED = ("Code", "Name")
NUMBERS = ("Integer", "Real")


@dataclass
class ValidationReport:
    passed: bool
    issues: DataFrame
    parse_errors: list = field(default_factory=list)


def parse_dimension(text: str | None) -> list[int | None] | None:
    """`[3,4]` -> [3, 4]; parts that aren't numbers are open."""
    m = re.fullmatch(r"\s*\[(.*)\]\s*", text or "")
    if not m:
        return None
    return [int(p) if p.strip().isdigit() else None for p in m[1].split(",")] if m[1].strip() else []


def parse_range(text: str | None) -> tuple[float | None, float | None]:
    low, _, high = (text or "").partition(":")
    number = lambda s: float(s) if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", s) else None
    return number(low), number(high)


def format_states(states: list[str]) -> str:
    return ", ".join(states[:10]) + (f", ... ({len(states)} in all)" if len(states) > 10 else "")


def leaf_rules(x: Col, column: Column) -> list[tuple[str, str, Col, str]]:
    """(check, severity, broken, detail) of one plain value. Placeholders and nulls break nothing."""
    out = []
    contents = column.type_contents or "Text"
    if contents in C.CONTENTS:
        out.append(("type_contents", "Error" if contents in NUMBERS else "Warning", ~C.contents_ok(x, contents), f"not {contents}"))
    if column.enumeration_range and contents in NUMBERS:
        low, high = parse_range(column.enumeration_range)
        out.append(("enumeration_range", "Error", ~C.in_range(C.to_real(C.without_su(x)), low, high), f"outside of {column.enumeration_range}"))
    if column.enumeration_states:
        out.append(("enumeration_states", "Error", ~C.in_states(x, column.enumeration_states, contents in FOLDED), f"not one of {format_states(column.enumeration_states)}"))
    return out


def container_rule(x: Col, column: Column) -> list[tuple[str, str, Col, str]]:
    kind, box = column.type_container or "Single", x.startswith(C.CONTAINER)
    first = F.substring(x, 2, 1)
    if kind == "Single":
        return [("type_container", "Error", box, "a container where a single value belongs")]
    if kind in ("List", "Array", "Matrix"):
        return [("type_container", "Error", ~box | (first != "["), f"not a {kind}")]
    if kind == "Table":
        return [("type_container", "Error", ~box | (first != "{"), "not a Table")]
    if kind == "Implied":
        return [("type_container", "Error", F.lit(True), "the dictionary gives no container")]
    return []


def column_issues(df: DataFrame, table: Table, column: Column) -> DataFrame:
    x = F.col(column.name)
    rows = df.where(x.isNotNull() & ~C.is_sentinel(x))
    plain = rows.where(~x.startswith(C.CONTAINER))
    boxed = rows.where(x.startswith(C.CONTAINER))
    rules = container_rule(x, column)
    out = _told(rows, table, column, rules)
    if column.type_container in (None, "Single"):
        out = out.unionByName(_told(plain, table, column, leaf_rules(x, column)))
    else:
        out = out.unionByName(_container_issues(boxed, table, column))
    return out


def _told(rows: DataFrame, table: Table, column: Column, rules: list[tuple[str, str, Col, str]]) -> DataFrame:
    parts = [F.when(broken, F.struct(F.lit(check).alias("c"), F.lit(severity).alias("s"), F.lit(detail).alias("d"))) for check, severity, broken, detail in rules]
    if not parts:
        return rows.sparkSession.createDataFrame([], ISSUES)
    found = rows.select(BLOCK, ROW, F.col(column.name).alias("value"), F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    return found.select(F.col("p.c").alias("check_name"), F.col("p.s").alias("severity"), F.lit(table.name).alias("table_name"), F.lit(column.name).alias("column_name"), F.col(BLOCK).alias("block_id"), F.col(ROW).cast("long").alias("row_id"), "value", F.col("p.d").alias("detail"))


def check_dimension(value: object, shape: list[int | None]) -> str | None:
    """The first place where a nested list hasn't the shape."""
    if not shape:
        return None
    if not isinstance(value, list):
        return f"{value!r} isn't a list of {shape[0]}"
    if shape[0] is not None and len(value) != shape[0]:
        return f"{len(value)} values instead of {shape[0]}"
    return next((m for v in value if (m := check_dimension(v, shape[1:]))), None)


def fits(value: str, contents: str) -> bool:
    """C.contents_ok() of a value inside a container."""
    if contents in C.CONTENTS and not re.search(C.CONTENTS[contents], value):
        return False
    if contents == "DateTime":
        try:
            datetime.fromisoformat(value)
        except ValueError:
            return False
    return True


def container_problems(stored: str, column: Column, strict_nulls: bool = False) -> list[tuple[str, str, str]]:
    """(check, severity, detail) of a stored container."""
    try:
        value = decode_container(stored)
    except json.JSONDecodeError:
        return [("type_container", "Error", "not readable")]
    out = []
    if isinstance(value, dict):
        out += [("type_container", "Error", f"table key {k[:40]!r} can't be written on one line") for k in value if not is_table_key_quotable(k)]
    shape = parse_dimension(column.type_dimension)
    if shape and (m := check_dimension(value, shape)):
        out.append(("type_dimension", "Error", m))
    contents = column.type_contents or "Text"
    low, high = parse_range(column.enumeration_range)
    states = {s.lower() if contents in FOLDED else s for s in column.enumeration_states}
    for leaf in extract_leaves(value):
        if leaf is None:
            if strict_nulls:
                out.append(("null_leaf", "Error", "a container with an empty place"))
            continue
        leaf = str(leaf)
        if leaf in C.PLACEHOLDERS:
            continue
        if not fits(leaf, contents):
            out.append(("type_contents", "Error" if contents in NUMBERS else "Warning", f"{leaf[:40]!r} is not {contents}"))
        elif contents in NUMBERS and column.enumeration_range:
            number = float(re.sub(r"\(\d+\)$", "", leaf))
            if low is not None and number < low or high is not None and number > high:
                out.append(("enumeration_range", "Error", f"{leaf} outside of {column.enumeration_range}"))
        if states and (leaf.lower() if contents in FOLDED else leaf) not in states:
            out.append(("enumeration_states", "Error", f"{leaf[:40]!r} is not one of {format_states(column.enumeration_states)}"))
    return out


def _container_issues(rows: DataFrame, table: Table, column: Column, strict_nulls: bool = False) -> DataFrame:
    name, own = column.name, table.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(c, s, own, name, block, row, value, d) for block, row, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for c, s, d in container_problems(value, column, strict_nulls)]
            kinds = [pa.string()] * 5 + [pa.int64()] + [pa.string()] * 2
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in ISSUES.split(", ")])

    return rows.select(BLOCK, F.col(ROW).cast("long"), name).mapInArrow(run, ISSUES)


def validate_database(data: Dataset, *, block_id: str | None = None) -> DataFrame:
    """ISSUES of all tables. A table that lacks is skipped, so that it can't hide others' issues."""
    spark = data.spark
    out = spark.createDataFrame([], ISSUES)
    fallback = data.infra["fallback"].select("tag", "block_id").distinct()
    none = F.lit(None).cast("string")
    out = out.unionByName(fallback.select(F.lit("unknown_tag").alias("check_name"), F.lit("Warning").alias("severity"), none.alias("table_name"), none.alias("column_name"), "block_id", F.lit(None).cast("long").alias("row_id"), none.alias("value"), F.concat(F.lit("unknown tag "), "tag").alias("detail")))
    for t, df in data.tables.items():
        table = data.schema.tables[t]
        if table.primary_keys == [ID]:
            many = R.repeated_groups(df, [BLOCK])
            out = out.unionByName(many.select(F.lit("cardinality").alias("check_name"), F.lit("Error").alias("severity"), F.lit(t).alias("table_name"), none.alias("column_name"), F.col(BLOCK).alias("block_id"), F.lit(None).cast("long").alias("row_id"), none.alias("value"), F.concat(F.col("n").cast("string"), F.lit(" rows of a Set in one block")).alias("detail")))
        for c in table.columns:
            if not c.is_synthetic and c.name in df.columns:
                out = out.unionByName(column_issues(df, table, c))
    return out if block_id is None else out.where(F.col("block_id") == block_id)


def ingest_issues(data: Dataset) -> DataFrame:
    """ISSUES of loading: all problems, not only those that messages lists."""
    if data.problems is None:
        return data.spark.createDataFrame([("ingest", "Warning", None, None, None, None, None, m) for m in data.messages], ISSUES)
    return data.problems.select(F.lit("ingest").alias("check_name"), F.lit("Warning").alias("severity"), "table_name", "column_name", "block_id", F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("string").alias("value"), "detail")


def validate(source: str | CifFile, schema: Schema, *, spark=None, block_id: str | None = None, dataset_id: str | None = None, propagate_fk: bool = True) -> ValidationReport:
    """Parse, load, check: one report. Never raises on what it is given."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession()
    cif, errors = build(source) if isinstance(source, str) else (source, [])
    rows = [("parse", "Warning" if e.kind == "warning" else "Error", None, None, None, None, None, f"line {e.line}: {e.message}") for e in errors]
    found = spark.createDataFrame(rows, ISSUES)
    try:
        data = ingest(cif, schema, spark=spark, dataset_id=dataset_id, propagate_fk=propagate_fk)
        found = found.unionByName(ingest_issues(data)).unionByName(validate_database(data, block_id=block_id))
    except IngestionError as e:
        found = found.unionByName(spark.createDataFrame([("ingest", "Error", None, None, None, None, None, str(e))], ISSUES))
    return ValidationReport(found.where("severity = 'Error'").isEmpty(), found, errors)
