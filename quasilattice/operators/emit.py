"""Writing a dataset as text.

What goes in which block is relational: every mode gives the rows of all tables a block key, and each block's rows are
then rendered in one stream of Arrow batches, a block at a time. A block's text is a value of one row, so output is a DataFrame of
(position, name, text); emit() joins it on the driver, emit_files() writes it where Spark can.
"""

from __future__ import annotations

import json
import re
import warnings
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quoting import LINE_LIMIT, make_text_field, quote
from ..functions.values import merge_su
from ..plans.output import BlockSpec, EmitMode, OutputPlan, accepted
from ..plans.schema import BLOCK, Schema, Table, topological
from ..sources.types import V1, V2
from . import relational as R
from .ingest import ITER, LOOP, ORDER, Dataset
from .storage import dealt, local_table, written

ROWS = "key string, position long, table_name string, ord string, loop_id int, row string"
RENDERED = "key string, position long, spec int, name string, body string"
PIECES = "position long, name string, piece long, head string, text string"
MAX_NAME_1 = 75
BATCH_CHARS = 4_000_000
#: Rows of a piece of a large block.
PIECE_ROWS = 20_000


def emit(data: Dataset, schema: Schema | None = None, *, mode: EmitMode = EmitMode.ORIGINAL, version: str = V2, plan: OutputPlan | None = None, reconstruct_su: bool = False, line_ending: str = "\n", pretty: bool = True, line_limit: int = LINE_LIMIT) -> str:
    """The whole text of a dataset that fits on the driver."""
    blocks = emit_blocks(data, schema, mode=mode, version=version, plan=plan, reconstruct_su=reconstruct_su, pretty=pretty, line_limit=line_limit).orderBy("position").collect()
    head = "#\\#CIF_2.0\n" if version == V2 else "#\\#CIF_1.1\n"
    return (head + "\n".join(b["text"] for b in blocks)).replace("\n", line_ending)


def emit_files(data: Dataset, path: str, **options) -> None:
    """One line-oriented text file set at path, blocks in order."""
    blocks = emit_blocks(data, **options).repartitionByRange("position").sortWithinPartitions("position")
    head = F.when(F.col("position") == 0, F.lit("#\\#CIF_2.0\n" if options.get("version", V2) == V2 else "#\\#CIF_1.1\n")).otherwise("")
    blocks.select(F.concat(head, "text").alias("value")).write.mode("overwrite").text(path)


def emit_blocks(data: Dataset, schema: Schema | None = None, *, mode: EmitMode = EmitMode.ORIGINAL, version: str = V2, plan: OutputPlan | None = None, reconstruct_su: bool = False, pretty: bool = True, line_limit: int = LINE_LIMIT) -> DataFrame:
    """(position, name, text) of each block."""
    schema, plan = schema or data.schema, plan or OutputPlan()
    if mode is EmitMode.ORIGINAL and plan.specs:
        warnings.warn("the original layout takes no plan", UserWarning, stacklevel=2)
        plan = OutputPlan()
    rows = {EmitMode.ORIGINAL: original_rows, EmitMode.GROUPED: grouped_rows, EmitMode.ONE_BLOCK: one_block_rows, EmitMode.ALL_BLOCKS: all_block_rows}[mode](data)
    render = _Renderer(schema, plan, mode, version, reconstruct_su, pretty, line_limit)
    rows = planned(rows, schema, plan) if plan.specs and mode in (EmitMode.GROUPED, EmitMode.ONE_BLOCK) else rows.withColumn("spec", F.lit(None).cast("int"))
    out = _placed(_whole(rows, render), mode)
    return out.select("position", "name", F.concat(F.lit("data_"), "name", F.lit("\n"), "body").alias("text"))


def _whole(rows: DataFrame, render: _Renderer) -> DataFrame:
    """RENDERED of rows with `spec`: a block in one task."""
    return rows.select("key", "position", "table_name", "loop_id", "ord", "row", "spec").repartition("key").sortWithinPartitions("key", "table_name", "ord").mapInArrow(render.blocks, RENDERED)


def _placed(made: DataFrame, mode: EmitMode) -> DataFrame:
    """RENDERED rows with their position and a name of their own."""
    order = ["_from", "key"] if mode is EmitMode.ORIGINAL else ["spec", "name", "_from", "key"]
    made = made.withColumnRenamed("position", "_from")
    n = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(*order))
    named = made.withColumn("_n", n).withColumn("_name", F.when(F.col("_n") > 1, F.concat_ws("_", "name", F.col("_n").cast("string"))).otherwise(F.col("name")))
    return R.dense_ids(named, order, "position", -1).select("position", "key", F.col("_name").alias("name"), "body")


# ---- large blocks in pieces


def emit_pieces(data: Dataset, schema: Schema | None = None, *, mode: EmitMode = EmitMode.ORIGINAL, version: str = V2, reconstruct_su: bool = False, pretty: bool = True, line_limit: int = LINE_LIMIT, size: int = PIECE_ROWS) -> DataFrame:
    """(position, name, piece, head, text): the texts of emit_blocks, those of more than size rows in pieces of as many.

    The texts of a block's pieces, one after the other, are one block with the same values as from emit_blocks; head and text together
    can be read alone: head repeats what a piece goes on with (block, loop, tags). Columns are chosen by the whole block;
    they are aligned within a piece, and no empty line follows a loop. One
    row for each table and kind of loop of a large block comes to the driver. A block is rendered whole, whatever its size, if
    its tables are in the original layout, share rows with other blocks or have unknown tags beside them, or if a
    loop has a tag twice."""
    schema, spark = schema or data.schema, data.spark
    rows = {EmitMode.ORIGINAL: original_rows, EmitMode.GROUPED: grouped_rows, EmitMode.ONE_BLOCK: one_block_rows, EmitMode.ALL_BLOCKS: all_block_rows}[mode](data)
    rows = written(rows.select("key", "position", "table_name", "ord", "loop_id", "row"), "emit-rows")
    render = _Renderer(schema, OutputPlan(), mode, version, reconstruct_su, pretty, line_limit)
    large = rows.groupBy("key").agg(F.count("row").alias("n")).where(F.col("n") > size).select("key")
    units = written(_units(rows.where("row IS NOT NULL").join(large, "key", "left_semi")), "emit-units")
    slots, blocks = render.layout(_profile(units, schema), size)
    whole = local_table(spark, [(b[0],) for b in blocks], "key string")
    made = _whole(rows.join(whole, "key", "left_anti").withColumn("spec", F.lit(None).cast("int")), render)
    made = made.unionByName(local_table(spark, [(*b, None) for b in blocks], RENDERED))
    placed = _placed(made, mode)
    title = F.concat(F.lit("data_"), "name", F.lit("\n"))
    out = placed.where("body IS NOT NULL").select("position", "name", F.lit(0).cast("long").alias("piece"), F.lit("").alias("head"), F.concat(title, "body").alias("text"))
    if not blocks:
        return out
    places = local_table(spark, [(s["key"], s["table"], s["unit"], i, s["before"], s["piece"]) for i, s in enumerate(slots)], "key string, table_name string, unit string, slot int, before long, first long")
    numbered = R.dense_ids(units.join(places, ["key", "table_name", "unit"]).select("slot", "ord", "row", "before", "first"), ["slot", "ord"], "n", -1)
    dealt_out = numbered.withColumn("piece", F.col("first") + F.floor((F.col("n") - F.col("before")) / size)).select("slot", "piece", "ord", "row")
    layouts = spark.sparkContext.broadcast((slots, {r["key"]: (r["position"], r["name"]) for r in placed.where("body IS NULL").select("key", "position", "name").collect()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return render.pieces(batches, *layouts.value)

    pieces = dealt(dealt_out, "piece").sortWithinPartitions("piece", "ord").mapInArrow(run, PIECES)
    return out.select(*pieces.columns).unionByName(pieces)


LOOSE_CELL = "tag string, value string, value_type string, row_id long, col_index int, ref_table string, block long"


def _units(rows: DataFrame) -> DataFrame:
    """key, position, table_name, unit, ord, row, beside: a row for each row to be written. Of tables unit is empty; of unknown tags it is
    the tags that stand together, and row the cells (a scalar has one)."""
    cells = rows.where("table_name = ''").withColumn("x", F.from_json("row", LOOSE_CELL))
    tables = rows.where("table_name <> ''").select("key", "position", "table_name", F.lit("").alias("unit"), "ord", "row", F.lit("").alias("beside"))
    tag, beside = F.to_json(F.array("x.tag")), F.coalesce("x.ref_table", F.lit(""))
    scalars = cells.where("loop_id IS NULL").select("key", "position", "table_name", tag.alias("unit"), F.concat(F.lit("0"), "ord").alias("ord"), F.to_json(F.array("x")).alias("row"), F.lit("").alias("beside"))
    place = ["key", "block", "loop_id"]
    looped = cells.where("loop_id IS NOT NULL").select("key", "position", "loop_id", "ord", "x", F.coalesce("x.block", F.lit(0)).alias("block"), beside.alias("beside"))
    tags = looped.groupBy(*place).agg(F.to_json(F.transform(F.sort_array(F.collect_set(F.struct(F.coalesce("x.col_index", F.lit(0)), "x.tag"))), lambda c: c["tag"])).alias("unit"))
    whole = looped.groupBy(*place, "x.row_id").agg(F.min("position").alias("position"), F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ord", "x"))), lambda c: c["x"])).alias("row"), F.max("beside").alias("beside"))
    ord_ = F.format_string("1%010d.%010d.%010d", "block", "loop_id", "row_id")
    loops = whole.join(tags.select(*(F.col(c).alias(f"_{c}") for c in place), "unit"), [F.col(c) == F.col(f"_{c}") for c in place]).select("key", "position", F.lit("").alias("table_name"), "unit", ord_.alias("ord"), "row", "beside")
    return tables.unionByName(scalars).unionByName(loops)


def _profile(units: DataFrame, schema: Schema) -> list:
    """For each key, table and unit: rows, columns, the first row, and whether links say one thing."""
    links = sorted({(t.name, c) for t in schema.tables.values() for k in t.foreign_keys for c in k.source_columns})
    value = {x: F.when(F.col("table_name") == x[0], F.get_json_object("row", f"$['{x[1]}']")) for x in links}
    sides = [F.struct(F.min(v), F.max(v), F.count(v)).alias(f"link{i}") for i, v in enumerate(value.values())]
    names = F.when(F.col("table_name") != "", F.array_join(F.expr("json_object_keys(row)"), "\n"))
    found = units.groupBy("key", "table_name", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position"), F.min("ord").alias("ord"), F.collect_set(names).alias("names"), F.min_by(F.when(F.col("table_name") != "", F.col("row")), "ord").alias("row"), F.collect_set("beside").alias("beside"), *sides)
    return [(r, {x: tuple(r[f"link{i}"]) for i, x in enumerate(links)}) for r in found.collect()]


# ---- which row goes where


def _json_row(table: Table, columns: list[str] | None = None) -> F.Column:
    return F.to_json(F.struct(*(F.col(c) for c in (columns or table.data)), F.col(ITER)))


def _table_rows(data: Dataset) -> list[DataFrame]:
    """For each table: _block_id, table_name, ord, loop_id, row and the key as JSON."""
    out = []
    for t, df in data.tables.items():
        table = data.schema.tables[t]
        ord_ = F.format_string("%010d.%010d.%010d.%s", F.col(f"{ORDER}.block"), F.col(f"{ORDER}.event"), F.col(f"{ORDER}.iter") + 1, F.col(f"{ORDER}.tie"))
        key = R.key_json(table.keys) if table.keys else F.lit(None).cast("string")
        out.append(df.select(F.col(BLOCK), F.lit(t).alias("table_name"), ord_.alias("ord"), F.col(LOOP).cast("int").alias("loop_id"), _json_row(table).alias("row"), key.alias("pk_json")))
    return out


def _fallback_rows(data: Dataset) -> DataFrame:
    """The values of unknown tags, each with its block's number: loops and rows are numbered within blocks."""
    f = data.infra["fallback"].join(data.infra["block_order"].select("block_id", F.col("position").alias("block")), "block_id", "left")
    ord_ = F.format_string("%010d.%010d.%010d.%010d", "block", F.coalesce("loop_id", F.lit(-1)) + 1, F.coalesce("col_index", F.lit(0)), F.col("row_id"))
    row = F.to_json(F.struct("tag", "value", "value_type", "row_id", "col_index", "ref_table", "block"))
    return f.select(F.col("block_id").alias(BLOCK), F.lit("").alias("table_name"), ord_.alias("ord"), "loop_id", row.alias("row"))


def placed_rows(data: Dataset) -> DataFrame:
    """_block_id, table_name, ord, loop_id, row, pk_json: each block's own part of each row. A row that several blocks gave
    values to appears for each of them, with the columns that it gave and the key."""
    frames = []
    seen = data.infra["tag_presence"].groupBy("table_name", "pk_json", "block_id").agg(F.sort_array(F.collect_list("column_name")).alias("cols"))
    shared = seen.groupBy("table_name", "pk_json").agg(F.collect_set("block_id").alias("givers"))
    for df in _table_rows(data):
        t = df.join(shared, ["table_name", "pk_json"], "left")
        owners = t.withColumn("b", F.explode(F.when(F.col("givers").isNull(), F.array(BLOCK)).otherwise(F.array_union("givers", F.array(BLOCK)))))
        part = owners.join(seen, (owners["table_name"] == seen["table_name"]) & (owners["pk_json"] == seen["pk_json"]) & (owners["b"] == seen["block_id"]), "left")
        frames.append(part.select(F.col("b").alias(BLOCK), owners["table_name"], "ord", "loop_id", "row", owners["pk_json"], F.when(F.col("givers").isNotNull(), F.coalesce("cols", F.array().cast("array<string>"))).alias("cols"), (F.col("b") == owners[BLOCK]).alias("own")))
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    if out is None:
        return data.spark.createDataFrame([], f"{BLOCK} string, table_name string, ord string, loop_id int, row string, pk_json string, cols array<string>, own boolean")
    return out


def _masked(df: DataFrame) -> DataFrame:
    """The columns that a block gave, as a field of the row that the renderer reads."""
    marked = F.when(F.col("cols").isNotNull(), F.concat(F.lit('{"_only":'), F.to_json("cols"), F.lit(","), F.substring(F.col("row"), F.lit(2), F.length("row")))).otherwise(F.col("row"))
    return df.withColumn("row", F.when(F.col("row") == "{}", F.col("row")).otherwise(marked))


def _with_positions(df: DataFrame, data: Dataset) -> DataFrame:
    return df.join(data.infra["block_order"].select(F.col("block_id").alias(BLOCK), F.col("position").cast("long").alias("position")), BLOCK, "left")


def original_rows(data: Dataset) -> DataFrame:
    rows = _masked(placed_rows(data)).select(BLOCK, "table_name", "ord", "loop_id", "row").unionByName(_fallback_rows(data))
    rows = _with_positions(rows, data)
    empty = data.infra["block_order"].select(F.col("block_id").alias("key"), F.col("position").cast("long").alias("position"), F.lit(None).cast("string").alias("table_name"), F.lit("").alias("ord"), F.lit(None).cast("int").alias("loop_id"), F.lit(None).cast("string").alias("row"))
    return rows.select(F.col(BLOCK).alias("key"), "position", "table_name", "ord", "loop_id", "row").unionByName(empty)


def one_block_rows(data: Dataset) -> DataFrame:
    rows = None
    for df in [*_table_rows(data), _fallback_rows(data)]:
        df = df.select(F.lit("output").alias("key"), F.lit(0).cast("long").alias("position"), "table_name", "ord", "loop_id", "row")
        rows = df if rows is None else rows.unionByName(df)
    return rows


def fingerprints(data: Dataset) -> DataFrame:
    """_block_id, fp: the sorted (Set table, key) pairs of each block; null for blocks without keyed Set rows."""
    sets = [t for t, x in data.schema.tables.items() if x.category_class == "Set" and x.keys]
    rows = placed_rows(data).where(F.col("table_name").isin(*sets)) if sets else placed_rows(data).limit(0)
    made = R.fingerprint(rows.withColumn("_v", F.concat_ws("=", "table_name", "pk_json")), [BLOCK], "_v", "fp")
    return data.infra["block_order"].select(F.col("block_id").alias(BLOCK)).join(made, BLOCK, "left")


def grouped_rows(data: Dataset) -> DataFrame:
    """Blocks with equal fingerprints together: each row once in a group. Blocks without one stay as they are."""
    keys = fingerprints(data).withColumn("key", F.coalesce(F.col("fp"), F.concat(F.lit("#"), BLOCK)))
    rows = placed_rows(data).drop("own").select(BLOCK, "table_name", "ord", "loop_id", "row", "pk_json", "cols")
    rows = _with_positions(rows.join(keys, BLOCK), data)
    # Parts of one row that blocks of a group gave come together again.
    whole = rows.where("pk_json IS NOT NULL").groupBy("key", "table_name", "pk_json").agg(
        F.min("position").alias("position"), F.min("ord").alias("ord"), F.min("loop_id").alias("loop_id"), F.first("row").alias("row"),
        F.when(F.max(F.col("cols").isNull()), F.lit(None)).otherwise(F.array_distinct(F.flatten(F.collect_list("cols")))).alias("cols"))
    loose = rows.where("pk_json IS NULL").select("key", "table_name", "pk_json", "position", "ord", "loop_id", "row", "cols")
    rest = _with_positions(_fallback_rows(data).join(keys, BLOCK), data).select("key", "position", "table_name", "ord", "loop_id", "row")
    return _masked(whole.unionByName(loose)).select("key", "position", "table_name", "ord", "loop_id", "row").unionByName(rest)


def set_key_columns(table: Table, schema: Schema) -> list[str]:
    """Key columns of a table that are (or lead, over one Loop, to) the key of a Set."""
    out = []
    for key in table.foreign_keys:
        target = schema.tables.get(key.target_table)
        for a, b in zip(key.source_columns, key.target_columns, strict=True):
            if a not in table.primary_keys or target is None or a in out:
                continue
            if target.category_class == "Set" or target.name != table.name and b in _direct_set_keys(target, schema):
                out.append(a)
    return out


def _direct_set_keys(table: Table, schema: Schema) -> list[str]:
    return [a for key in table.foreign_keys for a in key.source_columns if a in table.primary_keys and schema.tables.get(key.target_table) and schema.tables[key.target_table].category_class == "Set"]


def all_block_rows(data: Dataset) -> DataFrame:
    """A block for each Set row; a Loop gives a block for each combination of its Set keys. Data that can't be split so is
    refused: fallback rows, and Sets without a key."""
    if not data.infra["fallback"].isEmpty():
        raise ValueError("values of unknown tags can't be dealt out to blocks")
    keyless = [t for t in data.tables if data.schema.tables[t].category_class == "Set" and not data.schema.tables[t].keys]
    if keyless:
        raise ValueError(f"Sets without a key can't be dealt out to blocks: {', '.join(keyless)}")
    out = None
    for t, df in data.tables.items():
        table = data.schema.tables[t]
        split = table.keys if table.category_class == "Set" else set_key_columns(table, data.schema)
        key = F.concat(F.lit(t), R.key_json(split) if split else F.lit(""))
        ord_ = F.format_string("%010d.%010d.%010d", F.col(f"{ORDER}.block"), F.col(f"{ORDER}.event"), F.col(f"{ORDER}.iter") + 1)
        part = df.select(key.alias("key"), F.lit(0).cast("long").alias("position"), F.lit(t).alias("table_name"), ord_.alias("ord"), F.col(LOOP).cast("int").alias("loop_id"), _json_row(table).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else data.spark.createDataFrame([], ROWS)


def planned(rows: DataFrame, schema: Schema, plan: OutputPlan) -> DataFrame:
    """rows with `spec`, the index of the first spec that accepts their block (null: none). Blocks of a single_block spec get
    one key; those of an attach_to spec get the key of the first other block that the predicate accepts, by spec and key.
    One row a block is matched; only whether a target exists comes to the driver."""
    keyed = F.array(*(F.lit(t) for t, x in schema.tables.items() if x.category_class == "Set" and x.keys)).cast("array<string>")
    tables, anchors = F.col("tables"), F.array_intersect("tables", keyed)
    chosen = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(plan.specs))):
        chosen = F.when(accepted(s.matches, anchors, tables), F.lit(i)).otherwise(chosen)
    meta = rows.where("table_name <> ''").groupBy("key").agg(F.collect_set("table_name").alias("tables")).withColumn("spec", chosen)
    single = [i for i, s in enumerate(plan.specs) if s.single_block]
    attached = [i for i, s in enumerate(plan.specs) if s.attach_to is not None]
    meta = meta.withColumn("to", F.when(F.col("spec").isin(*single), F.concat(F.lit("spec:"), F.col("spec").cast("string"))).otherwise(F.col("key"))) if single else meta.withColumn("to", F.col("key"))
    for i in attached:
        others = meta.where(~F.coalesce(F.col("spec").isin(*attached), F.lit(False)))
        found = others.where(accepted(plan.specs[i].attach_to, anchors, tables)).orderBy(F.col("spec").asc_nulls_last(), "to").select("to", "spec").first()
        if found is None:
            if not meta.where(F.col("spec") == i).isEmpty():
                warnings.warn(f"no block for what spec {i} attaches; it stands alone", UserWarning, stacklevel=3)
            continue
        mine = F.coalesce(F.col("spec") == i, F.lit(False))
        meta = meta.withColumn("to", F.when(mine, F.lit(found["to"])).otherwise(F.col("to"))).withColumn("spec", F.when(mine, F.lit(found["spec"]).cast("int")).otherwise(F.col("spec")))
    placed = rows.join(meta.select("key", "to", "spec"), "key", "left")
    return placed.withColumn("key", F.coalesce("to", "key")).drop("to")


# ---- rendering


def sanitize(name: str) -> str:
    return re.sub("_+", "_", re.sub("[^A-Za-z0-9_]", "_", name)).strip("_")


def _rendered(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("key", pa.string()), ("position", pa.int64()), ("spec", pa.int32()), ("name", pa.string()), ("body", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


class _Renderer:
    """The rows of one block to its text. A plain object, so that it can be sent to the workers and tested without Spark."""

    def __init__(self, schema: Schema, plan: OutputPlan, mode: EmitMode, version: str, reconstruct_su: bool, pretty: bool, line_limit: int):
        self.schema, self.plan, self.mode, self.version = schema, plan, mode, version
        self.reconstruct_su, self.pretty, self.limit = reconstruct_su, pretty, line_limit
        self.rank = {t: i for i, t in enumerate(topological(schema))}

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """RENDERED of rows that come block by block: one block is held at a time."""
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, size = [], 0
        for key, group in groupby(rows, key=lambda r: r[0]):
            positions, own, said = set(), None, []
            for _, position, table, loop, ord_, row, spec in group:
                positions.add(position)
                own = spec if own is None else own
                if table is not None and row is not None:
                    said.append((table, ord_, loop, json.loads(row)))
            out.append((key, min((p for p in positions if p is not None), default=0), *self.render(key, said, own)))
            size += len(out[-1][4])
            if size > BATCH_CHARS:
                yield _rendered(out)
                out, size = [], 0
        if out:
            yield _rendered(out)

    def render(self, key: str, rows: list[tuple[str, str, int | None, dict]], matched: int | None = None) -> tuple[int, str, str]:
        tables: dict[str, list[tuple[str, int | None, dict]]] = defaultdict(list)
        loose: list[tuple[str, int | None, dict]] = []
        for table, ord_, loop, row in rows:
            if not table:
                loose.append((ord_, loop, row))
                continue
            keep, at = row.pop("_only", None), row.pop(ITER, None)
            if keep is not None:
                row = {c: v for c, v in row.items() if c in keep or c in self.schema.tables[table].keys}
            row["_at"] = (int(ord_[:10]) if ord_[:10].isdigit() else None, loop, at)
            tables[table].append((ord_, loop, row))
        for x in tables.values():
            x.sort(key=lambda r: r[0])
        loose.sort(key=lambda r: r[0])
        anchors = {t: x[0][2] for t, x in tables.items() if self.schema.tables[t].category_class == "Set" and self.schema.tables[t].keys}
        found = matched if matched is not None else None if self.mode is EmitMode.ORIGINAL else self.plan.match(frozenset(anchors), frozenset(tables))
        if self.mode is EmitMode.ALL_BLOCKS and self.plan.specs:
            found = 0  # the layout of the first spec, for all blocks
        spec = self.plan.specs[found] if found is not None else BlockSpec()
        self.written: set[str] = set()
        self.single = spec.single_block
        lines = self._conformance(tables, loose)
        loose = self._beside(tables, loose)
        for group in self._order(tables, spec):
            lines += self._group([t for t in group if t in tables], tables, anchors, spec)
        name = self._name(key, {t: [r for _, _, r in x] for t, x in tables.items() if t in anchors}, spec)
        for i, part in enumerate(self._fallback(loose)):
            lines += part if not i else ["", f"data_{name}_rest" + (f"_{i}" if i > 1 else ""), *part]
        return found if found is not None else len(self.plan.specs), name, "\n".join(lines) + "\n" if lines else ""

    def layout(self, found: list, size: int) -> tuple[list[dict], list[tuple]]:
        """Of the profile of large blocks: what is written in which order with which columns (slots, with the rows and pieces before
        each), and (key, position, spec, name) of the blocks. Blocks that have to be rendered whole are left out."""
        keys, slots, blocks = defaultdict(list), [], []
        for r, links in found:
            keys[r["key"]].append((r, links))
        before = piece = 0
        for key in sorted(keys):
            tables = {r["table_name"]: (r, links) for r, links in keys[key] if r["table_name"]}
            loose = [(tuple(json.loads(r["unit"])), r) for r, _ in keys[key] if not r["table_name"]]
            masked = any("_only" in x.split("\n") for r, _ in tables.values() for x in r["names"])
            beside = any(x in tables for _, r in loose for x in r["beside"])
            if masked or beside or self.mode is EmitMode.ORIGINAL and tables or any(len(set(t)) < len(t) for t, _ in loose):
                continue
            self.written, self.single, self.counts = set(), False, {t: r["n"] for t, (r, _) in tables.items()}
            anchors = {t: json.loads(r["row"]) for t, (r, _) in tables.items() if self.schema.tables[t].category_class == "Set" and self.schema.tables[t].keys}
            mine = []
            tags = [(None, None, {"tag": t[0]}) for t, _ in loose if len(t) == 1]
            lead = self._conformance(tables, tags)
            for (t,) in self._order({t: [] for t in tables}, BlockSpec()) if tables else []:
                r, links = tables[t]
                columns = self._chosen(self.schema.tables[t], r, links, anchors)
                self.written |= {self.schema.column_to_tag[t, c] for c in columns}
                mine.append({"key": key, "table": t, "unit": "", "columns": columns, "part": 0, "n": r["n"]})
            taken = [set(self.written)]
            for unit, r in sorted(loose, key=lambda x: ((0, x[0]) if x[1]["ord"][0] == "0" else (1, x[1]["ord"]))):
                i = next((i for i, x in enumerate(taken) if x.isdisjoint(unit)), len(taken))
                if i == len(taken):
                    taken.append(set())
                taken[i] |= set(unit)
                mine.append({"key": key, "table": "", "unit": r["unit"], "columns": list(unit), "part": i, "n": r["n"], "scalar": r["ord"][0] == "0"})
            name = self._name(key, {t: [a] for t, a in anchors.items()}, BlockSpec())
            blocks.append((key, min((r["position"] for r, _ in keys[key] if r["position"] is not None), default=0), 0, name))
            for i, s in enumerate(sorted(mine, key=lambda s: s["part"])):
                rest = f"data_{name}_rest" + (f"_{s['part']}" if s["part"] > 1 else "") + "\n" if s["part"] else ""
                opens = s["part"] != (slots[-1]["part"] if i else 0)
                slots.append(s | {"before": before, "piece": piece, "rest": rest, "opens": "\n" + rest if opens else "", "lead": lead if not i else [], "first": not i})
                before, piece = before + s["n"], piece - -s["n"] // size
        return slots, blocks

    def _chosen(self, table: Table, r: tuple, links: dict, anchors: dict[str, dict]) -> list[str]:
        """_columns of a profile."""
        have = {c for x in r["names"] for c in x.split("\n")}
        active = [c for c in table.data if c in have]
        if table.category_class == "Loop" or table.name not in anchors or r["n"] == 1:
            def rows(c: str) -> list[dict]:  # stand for all of them: equal if the smallest and the largest are, and none is null
                low, high, n = links.get((table.name, c), (None, None, 0))
                return [{c: low}, {c: high}, {c: low if n == r["n"] else None}]

            active = [c for c in active if not self._implied(table, c, rows(c), anchors)] or active
        if self.reconstruct_su:
            active = [c for c in active if not (table.column(c).is_su and self.schema.tag_to_column.get(table.column(c).linked_item_id or "", ("", ""))[1] in active)]
        return active

    def pieces(self, batches: Iterator[pa.RecordBatch], slots: list[dict], blocks: dict[str, tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        """PIECES of rows (slot, piece, ord, row) that come piece by piece. blocks: position and name by key."""
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (slot, piece), group in groupby(rows, key=lambda r: r[:2]):
            s = slots[slot]
            position, name = blocks[s["key"]]
            lines, begins = self._piece(s, [json.loads(r[3]) for r in group])
            title, opening, head = f"data_{name}\n", "", ""
            if piece == s["piece"]:
                opening = (title if s["first"] else "") + s["opens"] + "".join(x + "\n" for x in s["lead"])
                begins = 0
            if not (piece == s["piece"] and (s["first"] or s["opens"])):
                head = (s["rest"] or title) + "".join(x + "\n" for x in lines[:begins])
            values = {"position": [position], "name": [name], "piece": [piece], "head": [head], "text": [opening + "".join(x + "\n" for x in lines[begins:])]}
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("position", "piece") else pa.string()) for k, v in values.items()], names=list(values))

    def _piece(self, s: dict, rows: list) -> tuple[list[str], int]:
        """Lines, and how many of them are a loop's beginning."""
        columns = s["columns"]
        if s["table"]:
            table = self.schema.tables[s["table"]]
            tags = [self.schema.column_to_tag[table.name, c] for c in columns]
            cells = [[self._value(table, c, r) for c in columns] for r in rows]
            real = [table.column(c).type_contents in ("Real", "Integer") for c in columns]
            if not columns:
                return [], 0
            pair = table.category_class == "Set" and s["n"] == 1
        else:
            tags, real, cells = columns, [False] * len(columns), []
            pair = len(tags) == 1 and s["n"] == 1 and s["scalar"]
            for row in rows:
                have = defaultdict(list)
                for c in row:
                    have[c["tag"]].append(self._loose(c))
                for i in range(max(map(len, have.values()))):  # a cell given twice takes a row of its own
                    cells.append([have[t][i] if i < len(have[t]) else "?" if not i else "." for t in tags])
        return (self.pairs(tags, cells[0]), 0) if pair else (self.loop(tags, cells, real)[:-1], 1 + len(tags))

    def _conformance(self, tables: dict, loose: list) -> list[str]:
        """In one block for all: which dictionary the data follow, unless they say so themselves."""
        if self.mode is not EmitMode.ONE_BLOCK or "audit_conform" in tables or any(r["tag"].startswith("_audit_conform.") for _, _, r in loose):
            return []
        s = self.schema
        found = [(t, v) for t, v in (("_audit_conform.dict_name", s.dictionary_title), ("_audit_conform.dict_version", s.dictionary_version), ("_audit_conform.dict_location", s.dictionary_uri)) if v]
        if found and "audit" not in tables and not any(r["tag"] == "_audit.schema" for _, _, r in loose):
            found.insert(0, ("_audit.schema", "Custom"))
        return self.pairs([t for t, _ in found], [self._token(v) for _, v in found]) if found else []

    def _beside(self, tables: dict, loose: list) -> list:
        """Unrouted cells of a loop go beside the routed ones, as columns of the same loop row, where the block has all
        those rows. Returns the others."""
        self.extra: dict[str, dict[tuple[int, str], dict[tuple, dict]]] = defaultdict(lambda: defaultdict(dict))
        wanted: dict[tuple[str, int, int], list] = defaultdict(list)
        for x in loose:
            _, loop, row = x
            if loop is not None and row.get("ref_table") in tables:
                wanted[row["ref_table"], row.get("block"), loop].append(x)
        gone: set[int] = set()
        for (table, block, loop), cells in wanted.items():
            places = {r["_at"] for _, _, r in tables[table]}
            taken = {tag for t, tag in ((t, self.schema.column_to_tag.get((t, c))) for t in tables for c in self.schema.tables[t].data)}
            if all((block, loop, int(r["row_id"])) in places and r["tag"] not in taken for _, _, r in cells):
                for x in cells:
                    self.extra[table][int(x[2].get("col_index") or 0), x[2]["tag"]][block, loop, int(x[2]["row_id"])] = x[2]
                    gone.add(id(x))
            for _, _, r in cells:  # a tag that stands beside a table in part stands nowhere else in this block
                if any(t == r["tag"] for _, t in self.extra[table]):
                    self.written.add(r["tag"])
        return [x for x in loose if id(x) not in gone]

    def _extra_cells(self, table: str, rows: list[dict | None]) -> tuple[list[str], list[list[str]]]:
        """Tags, and for each row the cells, of unrouted values beside a table."""
        names = sorted(self.extra.get(table, {}))
        cells = [[self._loose(self.extra[table][n][r["_at"]]) if r is not None and r["_at"] in self.extra[table][n] else "." for n in names] for r in rows]
        return [t for _, t in names], cells

    def _name(self, key: str, anchors: dict[str, list[dict]], spec: BlockSpec) -> str:
        """anchors: the rows of the block's keyed Sets. A name-making function gets all values of their keys."""
        if self.mode is EmitMode.ORIGINAL:
            name = key
        else:
            values = {f"{t}.{k}": [str(row.get(k, "")) for row in rows] for t, rows in anchors.items() for k in self.schema.tables[t].keys}
            if self.single and not (spec.block_namer or self.plan.block_namer):
                return sanitize(key) or "block"
            make = spec.block_namer or self.plan.block_namer
            if make:
                name = make(values)
            elif self.mode is EmitMode.ONE_BLOCK:
                name = "output"
            elif self.mode is EmitMode.ALL_BLOCKS:
                name = key
            else:
                name = "_".join(f"{k}_{v[0]}" for k, v in sorted(values.items())) or key.removeprefix("#")
            name = sanitize(name)
        if self.version == V1 and len(name) > MAX_NAME_1:
            raise ValueError(f"block name of more than {MAX_NAME_1} characters: {name}")
        return name or "block"

    def _order(self, tables: dict, spec: BlockSpec) -> list[list[str]]:
        """Groups of tables in order: the plan's, then Sets, then Loops; in the original layout by first appearance, with
        tables of one source loop together."""
        done: set[str] = set()
        out: list[list[str]] = []
        for entry in spec.category_order:
            names = entry if isinstance(entry, (list, tuple)) else sorted(self.schema.descendants(entry[:-1])) if entry.endswith("*") else [entry]
            groups = [list(names)] if isinstance(entry, (list, tuple)) else [[n] for n in names]
            for g in groups:
                g = [t for t in g if t in tables and t not in done]
                if g:
                    out.append(g)
                    done |= set(g)
        rest = [t for t in tables if t not in done]
        if self.mode is not EmitMode.ORIGINAL:
            kind = lambda t: self.schema.tables[t].category_class != "Set"
            return out + [[t] for t in sorted(rest, key=lambda t: (kind(t), t))]
        by_loop: dict[object, list[str]] = defaultdict(list)
        for t in sorted(rest, key=lambda t: (tables[t][0][0], t)):
            loops = {loop for _, loop, _ in tables[t]}
            by_loop[next(iter(loops)) if len(loops) == 1 and None not in loops else t].append(t)
        return out + list(by_loop.values())

    def _columns(self, table: Table, rows: list[dict], anchors: dict[str, dict], alone: bool, spec: BlockSpec) -> list[str]:
        active = [c for c in table.data if any(r.get(c) is not None for r in rows)]
        if not self.single and (table.category_class == "Loop" or table.name not in anchors or len(rows) == 1):
            active = [c for c in active if not self._implied(table, c, rows, anchors)] or active
        if self.reconstruct_su:
            active = [c for c in active if not (table.column(c).is_su and self.schema.tag_to_column.get(table.column(c).linked_item_id or "", ("", ""))[1] in active)]
        first = spec.column_order.get(table.name, [])
        return [c for c in first if c in active] + [c for c in active if c not in first]

    def _implied(self, table: Table, column: str, rows: list[dict], anchors: dict[str, dict]) -> bool:
        """A foreign key column that says what the block's only row of a Set says."""
        for key in table.foreign_keys:
            target = anchors.get(key.target_table)
            if target is None or key.target_table == table.name or column not in key.source_columns or self.counts.get(key.target_table) != 1:
                continue
            want = target.get(key.target_columns[key.source_columns.index(column)])
            if want is not None and all(r.get(column) == want for r in rows):
                return True
        return False

    def _group(self, names: list[str], tables: dict, anchors: dict[str, dict], spec: BlockSpec) -> list[str]:
        if not names:
            return []
        self.counts = {t: len(x) for t, x in tables.items()}
        if len(names) > 1:
            return self._merged(names, tables, anchors, spec)
        table, rows = self.schema.tables[names[0]], [r for _, _, r in tables[names[0]]]
        columns = self._columns(table, rows, anchors, True, spec)
        if not columns:
            return []
        tags = [self.schema.column_to_tag[table.name, c] for c in columns]
        self.written |= set(tags)
        cells = [[self._value(table, c, r) for c in columns] for r in rows]
        real = [table.column(c).type_contents in ("Real", "Integer") for c in columns]
        if table.category_class == "Set" and len(rows) == 1:
            return self.pairs(tags, cells[0])
        more, beside = self._extra_cells(table.name, rows)
        return self.loop(tags + more, [a + b for a, b in zip(cells, beside, strict=True)], real + [False] * len(more))

    def _merged(self, names: list[str], tables: dict, anchors: dict[str, dict], spec: BlockSpec) -> list[str]:
        """Categories in one loop: a full outer join on their keys, in order of first appearance."""
        lead = self.schema.tables[min(names, key=self.rank.__getitem__)]  # whose key the others' keys follow from
        alike = [n for n in names if lead.keys and set(self.schema.tables[n].keys) == set(lead.keys)]
        places: dict[tuple, dict[str, dict]] = {}
        for n in names:
            for ord_, loop, row in tables[n]:
                k = tuple(row.get(c) for c in lead.keys) if n in alike else (n, loop, ord_)
                places.setdefault(k, {})[n] = row
        tags, real, getters = [], [], []
        for n in sorted(names, key=lambda n: (n != lead.name, names.index(n))):
            table, rows = self.schema.tables[n], [r for _, _, r in tables[n]]
            for c in self._columns(table, rows, anchors, False, spec):
                if n != lead.name and n in alike and c in table.keys:
                    continue
                tags.append(self.schema.column_to_tag[n, c])
                real.append(table.column(c).type_contents in ("Real", "Integer"))
                getters.append((n, c, n == lead.name and c in lead.keys))
        self.written |= set(tags)

        def cell(p: dict[str, dict], n: str, c: str, key: bool) -> str:
            owner = n if n in p else next((m for m in alike if m in p), None) if key else None
            return self._value(self.schema.tables[owner], c, p[owner]) if owner else "."

        cells = [[cell(p, *g) for g in getters] for p in places.values()]
        for n in names:
            more, beside = self._extra_cells(n, [p.get(n) for p in places.values()])
            tags, real, cells = tags + more, real + [False] * len(more), [a + b for a, b in zip(cells, beside, strict=True)]
        return self.loop(tags, cells, real) if tags else []

    def _value(self, table: Table, column: str, row: dict) -> str:
        value = row.get(column)
        if value is not None and self.reconstruct_su:
            su = next((c.name for c in table.columns if c.is_su and self.schema.tag_to_column.get(c.linked_item_id or "") == (table.name, column)), None)
            if su and row.get(su) not in (None, ".", "?"):
                value = merge_su(value, row[su])
        return self._token(value)

    def _token(self, stored: str | None) -> str:
        token = quote(stored, self.version, self.limit)
        if not token.startswith("\n") and len(token) > self.limit - 2 and stored and stored[0] != "\x00":
            token = make_text_field(stored, self.limit)
        return token

    def pairs(self, tags: list[str], tokens: list[str]) -> list[str]:
        width = max(map(len, tags)) + 2 if self.pretty else 0
        out = []
        for tag, token in zip(tags, tokens, strict=True):
            if token.startswith("\n"):
                out.append(tag + token)
            elif len(tag.ljust(width)) + 1 + len(token) > self.limit:
                out += [tag, token]
            else:
                out.append(f"{tag.ljust(width)} {token}")
        return out

    def loop(self, tags: list[str], cells: list[list[str]], real: list[bool]) -> list[str]:
        if self.pretty:
            columns = [list(c) for c in zip(*cells, strict=True)]
            columns = [align_decimals(c) if r else c for c, r in zip(columns, real, strict=True)]
            widths = [0 if any(x.startswith("\n") for x in c) else max(map(len, c)) for c in columns]
            cells = [[x.ljust(w) if w else x for x, w in zip(row, widths, strict=True)] for row in zip(*columns, strict=True)]
        return ["loop_", *tags, *(line for row in cells for line in pack_tokens(row, self.limit)), ""]

    def _fallback(self, rows: list[tuple[str, int | None, dict]]) -> list[list[str]]:
        """The lines of unknown tags, in parts: a block can't have a tag twice, so what is taken in one part goes to the
        next. A tag with several values is a loop of one column; loops with the same tags are one loop, block after block."""
        loops, scalars = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        for _, loop, row in rows:
            if loop is None:
                scalars[row["tag"]].append(row)
            else:
                loops[row.get("block"), loop][int(row["row_id"])].append(row)
        units: dict[tuple[str, ...], list[list[str]]] = {(tag,): [[self._loose(r)] for r in scalars[tag]] for tag in sorted(scalars)}
        for place in sorted(loops, key=lambda k: (k[0] or 0, k[1])):
            body = loops[place]
            columns = sorted({(int(r.get("col_index") or 0), r["tag"]) for row in body.values() for r in row})
            cells = []
            for _, row in sorted(body.items()):
                have = defaultdict(list)
                for r in row:
                    have[int(r.get("col_index") or 0), r["tag"]].append(self._loose(r))
                for i in range(max(map(len, have.values()))):  # a cell given twice takes a row of its own
                    cells.append([have[c][i] if i < len(have[c]) else "?" if not i else "." for c in columns])
            units.setdefault(tuple(t for _, t in columns), []).extend(cells)
        parts: list[list[str]] = [[]]
        taken = [set(self.written)]
        for tags, cells in units.items():
            i = next((i for i, x in enumerate(taken) if x.isdisjoint(tags)), len(parts))
            if i == len(parts):
                parts.append([])
                taken.append(set())
            taken[i] |= set(tags)
            one = len(tags) == 1 and len(cells) == 1 and tags[0] in scalars
            parts[i] += self.pairs(list(tags), cells[0]) if one else self.loop(list(tags), cells, [False] * len(tags))
        return parts

    def _loose(self, row: dict) -> str:
        return row["value"] if row.get("value_type") == "placeholder" else self._token(row.get("value"))


def pack_tokens(tokens: list[str], limit: int) -> list[str]:
    """Tokens on lines of at most limit characters; text fields take lines of their own."""
    out, line = [], ""
    for t in tokens:
        if t.startswith("\n"):
            if line.strip():
                out.append(line.rstrip())
            out += t[1:].split("\n")
            line = ""
        elif line and len(line) + 1 + len(t.rstrip()) > limit:
            out.append(line.rstrip())
            line = t
        else:
            line = f"{line} {t}" if line else t
    if line.strip():
        out.append(line.rstrip())
    return out


def align_decimals(tokens: list[str]) -> list[str]:
    """Numbers padded so that their points stand in one column. No number's text changes."""
    parts = []
    for t in tokens:
        bare = re.sub(r"\(\d+\)$", "", t)
        try:
            Decimal(bare)
        except InvalidOperation:
            parts.append(None)
            continue
        head = re.match(r"[+-]?\d*", t)[0]
        parts.append((head, t[len(head) :]))
    left = max((len(h) for p in parts if p for h in [p[0]]), default=0)
    return [t if p is None else p[0].rjust(left) + p[1] for t, p in zip(tokens, parts, strict=True)]
