"""Typed copies of loaded tables, and filling of dictionary defaults."""

from __future__ import annotations

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.schema import BLOCK, Column, Table
from . import relational as R
from .ingest import ITER, LOOP, ORDER, SHOWN, Dataset
from .storage import local_table, written

NUMERIC = ("Integer", "Real", "Float")
LOSSES = "kind string, table_name string, column_name string, value string"


def is_numeric(column: Column) -> bool:
    return column.type_contents in NUMERIC


def cast_expression(column: Column) -> Col:
    """The typed value of a column: numbers for single numeric columns, JSON with typed leaves for their containers."""
    x = F.col(column.name)
    if not is_numeric(column):
        return x
    if (column.type_container or "Single") in ("Single", "Implied"):
        return C.typed(x, column.type_contents)
    return F.when(x.startswith(C.CONTAINER), C.typed_list(x, column.type_contents)).otherwise(F.when(~C.is_sentinel(x), x))


def lost_uncertainties(df: DataFrame, table: Table) -> DataFrame:
    """column_name, value: distinct values whose uncertainty the typed copy drops."""
    wanted = [c.name for c in table.columns if is_numeric(c) and c.name in df.columns]
    if not wanted:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    long = R.unpivot_values(df, [], wanted).where(F.contains("value", F.lit("(")))
    single = long.where(~F.col("value").startswith(C.CONTAINER))
    leaves = long.where(F.col("value").startswith(C.CONTAINER)).select("column_name", F.explode(C.leaves(F.col("value"))).alias("value"))
    return single.unionByName(leaves).where(F.col("value").rlike(r"\(\d+\)$")).distinct()


def cast_failures(df: DataFrame, table: Table) -> DataFrame:
    """column_name, value: distinct values of single numeric columns that aren't numbers."""
    out = df.sparkSession.createDataFrame([], "column_name string, value string")
    for contents in NUMERIC:
        wanted = [c.name for c in table.columns if c.type_contents == contents and (c.type_container or "Single") == "Single" and c.name in df.columns]
        if wanted:
            long = R.unpivot_values(df, [], wanted).where(F.col("value").isNotNull() & ~C.is_sentinel(F.col("value")))
            out = out.unionByName(long.where(C.typed(F.col("value"), contents).isNull()).distinct())
    return out


def convert_database(data: Dataset, on_coercion_failure: str = "null") -> tuple[dict[str, DataFrame], list[str]]:
    """Typed DataFrames of all tables and what was lost: all of it as `_losses` (LOSSES), and texts for display, at most
    SHOWN of each table and kind. on_coercion_failure: `null` (or `keep`, which typed columns can't do otherwise), or `error`."""
    if on_coercion_failure not in ("null", "keep", "error"):
        raise ValueError(f"on_coercion_failure: {on_coercion_failure!r}")
    out, messages, losses = {}, [], data.spark.createDataFrame([], LOSSES)
    for t, df in data.tables.items():
        table = data.schema.tables[t]
        for kind, rows, text in (("cast_failure", cast_failures(df, table), "{!r} isn't a number"), ("lost_uncertainty", lost_uncertainties(df, table), "uncertainty of {!r} is dropped")):
            first = rows.orderBy("column_name", "value").limit(SHOWN + 1).collect()
            if first and kind == "cast_failure" and on_coercion_failure == "error":
                raise ValueError(f"{t}.{first[0]['column_name']}: {first[0]['value']!r} isn't a number")
            messages += [f"{t}.{r['column_name']}: {text.format(r['value'])}" for r in first[:SHOWN]]
            if len(first) > SHOWN:
                messages.append(f"{t}: {rows.count()} of {kind} in all, the first {SHOWN} are listed; _losses has all")
            losses = losses.unionByName(rows.select(F.lit(kind).alias("kind"), F.lit(t).alias("table_name"), "column_name", "value"))
        out[t] = df.select(*(cast_expression(c).alias(c.name) for c in table.columns if c.name in df.columns))
    return out | {f"_{k}": v for k, v in data.infra.items()} | {"_losses": losses}, messages


def _key_path(table: Table, column: Column, data: Dataset) -> list[tuple[str, str, str]] | None:
    """For each index of a keyed default: the column of the table itself or of a table that it links to."""
    places, out = data.schema.tag_to_column, []
    for index in column.enumeration_def_index_ids:
        place = places.get(index)
        if place is None:
            return None
        if place[0] == table.name:
            out.append((table.name, "", place[1]))
            continue
        key = next((k for k in table.foreign_keys if k.target_table == place[0] and len(k.source_columns) == 1), None)
        if key is None or place[0] not in data.tables:
            return None
        out.append((place[0], key.source_columns[0], place[1]))
    return out


def fill_keyed(df: DataFrame, table: Table, column: Column, data: Dataset) -> DataFrame:
    """Null values from the dictionary's table of defaults, by index values of the row or of its parents."""
    path = _key_path(table, column, data)
    rows = [tuple(r) for r in column.enumeration_defaults if len(r) == len(column.enumeration_def_index_ids) + 1]
    if not path or not rows:
        return df
    spark = df.sparkSession
    lookup = local_table(spark, rows, ", ".join([*(f"_i{i} string" for i in range(len(path))), "_default string"]))
    columns = df.columns
    for i, (where, link, value) in enumerate(path):
        if where == table.name:
            df = df.withColumn(f"_i{i}", F.col(value))
        else:
            parent = data.tables[where]
            key = next(k for k in table.foreign_keys if k.target_table == where and k.source_columns == (link,)).target_columns[0]
            found = parent.groupBy(F.col(key).alias(link)).agg(F.min(value).alias(f"_i{i}"))
            df = df.join(found, link, "left")
    df = df.join(lookup, [f"_i{i}" for i in range(len(path))], "left")
    return df.withColumn(column.name, F.coalesce(F.col(column.name), F.col("_default"))).select(*columns)


def generate_defaults(data: Dataset, max_iterations: int = 32) -> int:
    """Fill nulls with the dictionary's defaults, keyed ones before plain ones, until nothing changes; later rounds need only
    look at keyed ones. The filled tables replace data.tables at the end, all or none. Returns the number filled."""
    tables, filled = dict(data.tables), 0
    work = Dataset(data.spark, data.schema, tables, data.infra)
    nulls = {t: _null_count(df, data.schema.tables[t]) for t, df in tables.items()}
    for round_ in range(max_iterations):
        changed = False
        for t in list(tables):
            table, df = data.schema.tables[t], tables[t]
            keyed = [c for c in table.columns if c.enumeration_defaults and c.enumeration_def_index_ids and c.name in df.columns]
            plain = [c for c in table.columns if c.enumeration_default is not None and not c.is_primary_key and c.name in df.columns]
            if not keyed and (round_ or not plain) or not nulls[t]:
                continue
            for c in keyed:
                df = fill_keyed(df, table, c, work)
            if not round_:
                df = df.select(*(R.scalar_default(F.col(c), next(x.enumeration_default for x in plain if x.name == c)).alias(c) if any(x.name == c for x in plain) else F.col(c) for c in df.columns))
            df = written(df, f"defaults-{t}")
            now = _null_count(df, table)
            changed |= now != nulls[t]
            filled += nulls[t] - now
            tables[t], nulls[t] = df, now
        if not changed:
            break
    data.tables = tables
    return filled


def _null_count(df: DataFrame, table: Table) -> int:
    names = [c for c in table.data if c in df.columns]
    if not names:
        return 0
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names)).first()
    return sum(row[c] or 0 for c in names)


__all__ = ["BLOCK", "ITER", "LOOP", "ORDER", "cast_expression", "cast_failures", "convert_database", "generate_defaults", "lost_uncertainties"]
