"""Loading cells into category tables: route, split uncertainties, propagate keys, close references, merge.

Everything after the cells is a plan over one DataFrame for each table. Tables without data are never touched. Between the
stages tables are written to the shared folder: plans would otherwise grow with tables x keys x hops.

Rows carry `_order`, a struct of (block, event, iteration) that totally orders a table's rows; generated keys are
digests of where they stand, so loads are deterministic whatever the number of partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.values import split_su_container
from ..plans.schema import BLOCK, ID, INFRASTRUCTURE, ROW, Schema, Table, sibling_groups, topological
from ..sources.cells import cells_frame
from ..sources.model import CifFile
from . import relational as R
from .storage import at_once, local_table, written, written_all

DATASET_TAG = "_audit_dataset.id"
LOOP, ITER, ORDER = "_loop", "_iter", "_order"
META = [BLOCK, LOOP, ITER, ORDER]
MAX_HOPS = 8
PROBLEMS = "kind string, block_id string, table_name string, column_name string, detail string"
SHOWN = 1000
_NO_EVENT = 1 << 30


class IngestionError(ValueError):
    """The blocks of a source can't be loaded together."""


@dataclass
class Dataset:
    """Loaded tables: one DataFrame for each category with rows, and the infrastructure tables. problems: all that was odd on
    loading (PROBLEMS); messages: its text for display, at most SHOWN of each kind and table."""

    spark: SparkSession
    schema: Schema
    tables: dict[str, DataFrame] = field(default_factory=dict)
    infra: dict[str, DataFrame] = field(default_factory=dict)
    messages: list[str] = field(default_factory=list)
    problems: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name in INFRASTRUCTURE:
            return self.infra[name]
        raise AttributeError(name)

    def stored(self) -> dict[str, DataFrame]:
        """All DataFrames by the names they are kept under."""
        own = {} if self.problems is None else {"_problems": self.problems}
        return {**self.tables, **{f"_{k}": v for k, v in self.infra.items()}, **own}

    def save(self, database: str, mode: str = "overwrite") -> None:
        """As managed tables of a catalog database."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for name, df in self.stored().items():
            df.drop(ORDER, LOOP, ITER).write.mode(mode).saveAsTable(f"{database}.`{name}`")


def qualified(cells: DataFrame) -> DataFrame:
    """Cells of several sources with block ids and numbers made distinct across them."""
    first = cells.groupBy("source").agg((F.max("block_idx") + 1).alias("_n"))
    from pyspark.sql import Window

    before = first.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a file
    return cells.join(before, "source").withColumn("block_id", F.concat_ws("/", F.regexp_extract("source", "([^/]*)$", 1), "block_id")).withColumn("block_idx", (F.col("block_idx") + F.col("_base")).cast("int")).drop("_base")


def select_blocks(cells: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Cells of the blocks of one dataset and of blocks without a dataset. Without an id, all blocks, if those with ids
    have one in common."""
    ids = cells.where((F.col("tag") == DATASET_TAG) & ~F.col("value").isin(".", "?")).select("block_id", F.col("value").alias("_dataset")).distinct()
    if dataset_id is not None:
        return R.in_any_or_unlisted(cells, ids.withColumnRenamed("_dataset", "d"), "block_id", F.col("d") == dataset_id)
    n = ids.agg(F.count_distinct("block_id")).first()[0]
    if n and n != ids.groupBy("_dataset").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]:
        raise IngestionError("blocks belong to datasets that have none in common: choose one by dataset_id")
    return cells


def tag_routes(spark: SparkSession, schema: Schema) -> DataFrame:
    """tag, table_name, table_no, column_name, su_column, key_no, deprecated: a row for each tag and alias. Tables are numbered
    by name, sets of key names by their text. Dictionary-sized."""
    su, rows = schema.su_map, []
    tables = {t: i for i, t in enumerate(sorted(schema.tables))}
    keys = {t: "\x1f".join(sorted(x.keys)) for t, x in schema.tables.items()}
    sets = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    targets = {tag: (tag, *place) for tag, place in schema.tag_to_column.items()}
    targets |= {alias: targets[d] for alias, d in schema.alias_to_definition_id.items() if d in targets and alias not in targets}
    for tag, (definition, table, column) in targets.items():
        su_table, su_column = su.get(definition, (None, None))
        rows.append((tag, table, tables[table], column, su_column if su_table == table else None, sets[keys[table]], definition in schema.deprecated_ids))
    return local_table(spark, rows, "tag string, table_name string, table_no int, column_name string, su_column string, key_no int, deprecated boolean")


def route(cells: DataFrame, schema: Schema) -> DataFrame:
    """Cells with their table and column, null for those that go to the fallback: unknown tags, and whole loops over
    tables with different keys. ref_table: the table that a fallback cell of a loop belongs to or stood beside."""
    routed = R.route(cells.where("frame_idx IS NULL"), tag_routes(cells.sparkSession, schema), "tag")
    loops = routed.where("loop_idx IS NOT NULL AND table_no IS NOT NULL").groupBy("block_id", "loop_idx").agg(F.min("key_no").alias("_a"), F.max("key_no").alias("_b"), F.min("table_no").alias("_no"))  # numbers: hashed, not sorted
    names = local_table(cells.sparkSession, enumerate(sorted(schema.tables)), "_no int, _near string")
    mixed = loops.join(names, "_no").select("block_id", "loop_idx", (F.col("_a") < F.col("_b")).alias("_mixed"), "_near")
    routed = routed.join(mixed, ["block_id", "loop_idx"], "left").withColumn("mixed_loop", F.coalesce("_mixed", F.lit(False))).drop("_mixed", "table_no", "key_no")
    home = F.when(~F.col("mixed_loop"), F.col("table_name"))
    near = F.when(F.col("mixed_loop"), F.col("table_name")).otherwise(F.col("_near"))
    return routed.withColumn("ref_table", near).withColumn("table_name", home).drop("_near")


def container_su(value: Col) -> Col:
    """number, su of a stored container: of any depth, so by an Arrow-batched Python function."""

    def split(value: str):
        number, su = split_su_container(value) if value is not None and value.startswith(C.CONTAINER) else (value, None)
        return {"number": number, "su": su}

    return F.udf(split, "struct<number:string,su:string>", useArrow=True)(value)


def split_uncertainties(routed: DataFrame) -> DataFrame:
    """Cells of a column with an uncertainty column, split in two; given uncertainties come before split ones. Containers
    are split in Python, all else in one pass."""
    has = F.col("su_column").isNotNull()
    box = has & F.col("value").startswith(C.CONTAINER)

    def both(df: DataFrame, number: Col, su: Col, split: Col) -> DataFrame:
        cell = lambda c, v, r: F.struct(c.alias("c"), v.alias("v"), F.lit(r).alias("r"))
        pair = F.filter(F.array(cell(F.col("column_name"), number, 0), cell(F.col("su_column"), su, 1)), lambda p: p["v"].isNotNull())
        rows = df.withColumn("_p", F.explode(F.when(split, pair).otherwise(F.array(cell(F.col("column_name"), F.col("value"), 0)))))
        return rows.withColumn("column_name", F.col("_p.c")).withColumn("value", F.col("_p.v")).withColumn("rank", F.col("_p.r")).drop("_p")

    plain = both(routed.where(~F.coalesce(box, F.lit(False))), *C.split_su(F.col("value")), has)
    boxed = routed.where(box).withColumn("_s", container_su(F.col("value")))
    return plain.unionByName(both(boxed, F.col("_s.number"), F.col("_s.su"), F.lit(True)).drop("_s"))


def raw_table(cells: DataFrame, table: Table) -> DataFrame:
    """META and the table's columns: a row for each loop iteration, one for the block's scalars."""
    known = [c.name for c in table.columns if not c.is_synthetic]
    rows = cells.where((F.col("table_name") == table.name) & (F.col("loop_idx").isNotNull() | (F.col("iter_idx") == 0)))
    ids = [F.col("block_id").alias(BLOCK), F.col("loop_idx").alias(LOOP), F.when(F.col("loop_idx").isNotNull(), F.col("iter_idx")).alias(ITER), "block_idx"]
    wide = rows.groupBy(*ids).agg(F.min("event_pos").alias("_event"), *(R.first_non_null(F.when(F.col("column_name") == k, F.col("value")), F.struct("rank", "tag_pos")).alias(k) for k in known))
    synthetic = [F.lit(None).cast("string").alias(c.name) for c in table.columns if c.is_synthetic and not c.name.startswith("_")]
    return wide.select(BLOCK, LOOP, ITER, _order(F.col("block_idx"), F.col("_event"), F.col(ITER)), *known, *synthetic)


def _order(block: Col, event: Col, iteration: Col, tie: Col | None = None) -> Col:
    return F.struct(block.cast("int").alias("block"), event.cast("int").alias("event"), F.coalesce(iteration, F.lit(-1)).cast("int").alias("iter"), (tie if tie is not None else F.lit("")).alias("tie")).alias(ORDER)


# ---- propagation


class _Load:
    def __init__(self, spark: SparkSession, schema: Schema, raw: dict[str, DataFrame]):
        self.spark, self.schema, self.raw = spark, schema, raw
        self.topo = topological(schema)

    def cut(self) -> None:
        self.raw = written_all(self.raw, "raw")

    def _lookup(self, df: DataFrame, parent: str, column: str, source: str) -> DataFrame:
        """Null `column` from the parent's row of the same loop row, then any row of the block, the scalars first, then in
        order."""
        rows = self.raw[parent].select(BLOCK, LOOP, ITER, ORDER, F.col(source).alias("_source"))
        order = F.struct(F.col(LOOP).isNotNull(), F.col(ORDER))
        own = rows.where(F.col(LOOP).isNotNull())
        for on, part in (([BLOCK, LOOP, ITER], own), ([BLOCK], rows)):
            df = R.fill_from(df, part, on, column, "_source", order)
        return df

    def fill(self) -> None:
        """One pass over all tables, parents first."""
        for t in self.topo:
            if t not in self.raw:
                continue
            table, df = self.schema.tables[t], self.raw[t]
            for key in table.foreign_keys:
                if key.target_table in self.raw and key.target_table != t:
                    for a, b in zip(key.source_columns, key.target_columns, strict=True):
                        df = self._lookup(df, key.target_table, a, b)
            for column, linked, default in self.schema.propagation_links.get(t, []):
                for source_table, source in self._chain(linked):
                    if source_table in self.raw and source_table != t:
                        df = self._lookup(df, source_table, column, source)
                if default is not None:
                    df = df.withColumn(column, R.scalar_default(F.col(column), default))
            self.raw[t] = df

    def _chain(self, linked: str) -> list[tuple[str, str]]:
        """The tables and columns that a link leads to, hop by hop."""
        places, out, seen = self.schema.tag_to_column, [], set()
        while linked in places and linked not in seen and len(out) < MAX_HOPS:
            seen.add(linked)
            table, column = places[linked]
            out.append((table, column))
            linked = next((item for c, item, _ in self.schema.propagation_links.get(table, []) if c == column), "")
        return out

    def key_stubs(self) -> None:
        """A parent row with a generated key for each block whose child rows lack a key that links to it, where the block
        has no parent row."""
        for t in self.topo:
            if t not in self.raw:
                continue
            table = self.schema.tables[t]
            for key in table.foreign_keys:
                target = self.schema.tables[key.target_table]
                if key.target_table == t or not set(key.source_columns) <= set(table.primary_keys) or set(key.target_columns) != set(target.primary_keys):
                    continue
                lacking = self.raw[t].where(" OR ".join(f"`{c}` IS NULL" for c in key.source_columns)).groupBy(BLOCK).agg(F.min(ORDER).alias("_o"))
                if key.target_table in self.raw:
                    lacking = lacking.join(self.raw[key.target_table].select(BLOCK).distinct(), BLOCK, "left_anti")
                made = {c: C.stable_uuid(F.lit(key.target_table), F.lit(c), F.col(BLOCK)) for c in target.primary_keys}
                self._add(key.target_table, lacking, made)

    def _add(self, name: str, rows: DataFrame, values: dict[str, Col]) -> None:
        """Rows (BLOCK, _o) to a table, after all others of their block."""
        table = self.schema.tables[name]
        tie = F.concat_ws("\x1f", *values.values())
        columns = [c.name for c in table.columns if c.name not in (BLOCK, ROW, ID)]
        new = rows.select(F.col(BLOCK), F.lit(None).cast("int").alias(LOOP), F.lit(None).cast("int").alias(ITER), _order(F.col("_o.block"), F.lit(_NO_EVENT), F.lit(None), tie), *(values.get(c, F.lit(None).cast("string")).alias(c) for c in columns))
        self.raw[name] = self.raw[name].unionByName(new) if name in self.raw else new

    def generated_keys(self) -> None:
        """Null key parts: from a sibling table's row of the same loop row, else a digest of the place, equal for siblings."""
        for names, group in sibling_groups(self.schema).items():
            present = [t for t in self.topo if t in group and t in self.raw]
            for t in present[1:]:
                df = self.raw[t]
                for k in sorted(names):
                    rows = self.raw[present[0]].where(F.col(LOOP).isNotNull()).select(BLOCK, LOOP, ITER, F.col(k).alias("_s"))
                    df = R.fill_from(df, rows, [BLOCK, LOOP, ITER], k, "_s")
                self.raw[t] = df
        for t, df in self.raw.items():
            for k in self.schema.tables[t].keys:
                place = C.stable_uuid(F.lit(k), F.col(BLOCK), F.coalesce(F.col(LOOP).cast("string"), F.lit(t)), F.col(ITER))
                df = df.withColumn(k, F.coalesce(F.col(k), place))
            self.raw[t] = df

    def stub_parents(self) -> None:
        """Parents for foreign keys that point nowhere. A key that gives only a part of the parent's key makes none."""
        for t in reversed(self.topo):
            if t not in self.raw:
                continue
            for key in self.schema.tables[t].foreign_keys:
                target = self.schema.tables[key.target_table]
                if set(key.target_columns) != set(target.primary_keys):
                    continue
                present = " AND ".join(f"`{c}` IS NOT NULL AND `{c}` NOT IN ('.', '?')" for c in key.source_columns)
                renamed = [F.col(a).alias(f"_k{i}") for i, a in enumerate(key.source_columns)]
                wanted = self.raw[t].where(present).groupBy(*renamed).agg(F.min(F.struct(F.col(ORDER), F.col(BLOCK))).alias("_x")).select(*(f"_k{i}" for i in range(len(renamed))), F.col(f"_x.{ORDER}").alias("_o"), F.col(f"_x.{BLOCK}").alias(BLOCK))
                if key.target_table in self.raw:
                    there = self.raw[key.target_table].select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(key.target_columns)))
                    wanted = wanted.join(there, [f"_k{i}" for i in range(len(renamed))], "left_anti")
                self._add(key.target_table, wanted, {b: F.col(f"_k{i}") for i, b in enumerate(key.target_columns)})


# ---- merge


def merge_table(raw: DataFrame, table: Table, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final, conflicts, tag presence) of a table's raw rows. Keyed: the first non-null value of each column by order;
    what is there already wins. Keyless: every row is kept."""
    data = [c.name for c in table.columns if not c.name.startswith("_")]
    spark = raw.sparkSession
    empty = spark.createDataFrame([], INFRASTRUCTURE["tag_presence"]), spark.createDataFrame([], "column_name string")
    if not table.keys:
        rows = raw.select(BLOCK, ORDER, LOOP, ITER, *data)
        if ID in table.primary_keys:
            rows = rows.withColumn(ID, C.stable_uuid(F.lit(table.name), F.col(BLOCK), F.to_json(ORDER)))
        return _numbered(rows if existing is None else existing.unionByName(rows, allowMissingColumns=True), table), empty[1], empty[0]
    rest = [c for c in data if c not in table.keys]
    all_rows = raw.select(BLOCK, ORDER, LOOP, ITER, *data)
    if existing is not None:  # order: what is there comes first
        all_rows = existing.select(BLOCK, ORDER, LOOP, ITER, *data).unionByName(all_rows)
    final = R.natural_key_merge(all_rows, table.keys, rest, ORDER, first=[BLOCK, LOOP, ITER])
    presence = R.tag_presence(all_rows, table.keys, BLOCK, rest) if rest else None
    if presence is not None:
        presence = presence.select(F.col(BLOCK).alias("block_id"), F.lit(table.name).alias("table_name"), "column_name", "pk_json")
    conflicts = R.merge_conflicts(all_rows, table.keys, rest) if rest else empty[1]
    return _numbered(final, table), conflicts, presence if presence is not None else empty[0]


def _numbered(rows: DataFrame, table: Table) -> DataFrame:
    numbered = R.dense_ids(rows.drop(ROW), [ORDER], ROW)
    return numbered.select(*(F.col(c.name) for c in table.columns if c.name in numbered.columns), ORDER, LOOP, ITER)


def ingest(source: CifFile | DataFrame, schema: Schema | None = None, *, spark: SparkSession | None = None, dataset_id: str | None = None, propagate_fk: bool = True, into: Dataset | None = None) -> Dataset:
    """Load a model or cells. Without a schema all values go to the fallback table. into: a loaded dataset to add to, whose
    values win. What is odd is kept in problems, told in messages and in the validation table."""
    spark = spark or (into.spark if into else source.sparkSession if isinstance(source, DataFrame) else SparkSession.getActiveSession())
    cells = source if isinstance(source, DataFrame) else cells_frame(spark, source)
    schema = schema or (into.schema if into else Schema())
    cells = select_blocks(written(cells, "cells"), dataset_id)
    if into is not None:
        last = into.infra["block_order"].agg(F.max("position")).first()[0]
        cells = cells.withColumn("block_idx", (F.col("block_idx") + F.lit((last if last is not None else -1) + 1)).cast("int"))
    out = Dataset(spark, schema)
    routed = route(cells, schema)
    routed = written(split_uncertainties(routed) if schema.su_map else routed.withColumn("rank", F.lit(0)), "routed")
    populated = sorted(r[0] for r in routed.where("table_name IS NOT NULL").select("table_name").distinct().collect())  # table names
    problems = [mixed_loops(routed), deprecations(routed, schema)]
    load = _Load(spark, schema, {t: raw_table(routed, schema.tables[t]) for t in populated})
    load.cut()
    if propagate_fk and populated:
        load.fill()
        load.key_stubs()
        load.cut()
        load.fill()
    load.generated_keys()
    load.cut()
    if propagate_fk and populated:
        load.stub_parents()
        load.cut()
    presence, counts = [], []
    present = [t for t in load.topo if t in load.raw or into is not None and t in into.tables]

    def merged(t: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        old = into.tables.get(t) if into else None
        if t not in load.raw:
            return old, None, None
        final, conflicts, seen = merge_table(load.raw[t], schema.tables[t], old)
        return written(final, f"table-{t}"), conflicts, seen

    for t, (final, conflicts, seen) in zip(present, at_once(spark, merged, present), strict=True):
        out.tables[t] = final
        if seen is not None:
            presence.append(seen)
            problems.append(conflict_problems(conflicts, schema.tables[t]))
    for t, df in out.tables.items():
        counts.append(R.non_null_counts(df, schema.tables[t].data, "column_name", "n").select(F.lit(t).alias("table_name"), "column_name", "n"))
    found = spark.createDataFrame([], PROBLEMS)
    for p in problems:
        found = found.unionByName(p)
    _, out.problems = at_once(spark, lambda do: do(), [lambda: _infrastructure(out, cells, routed, presence, counts, into), lambda: written(found, "problems")])
    out.messages += told(out.problems)
    if into is not None and into.problems is not None:
        out.problems = written(into.problems.unionByName(out.problems).distinct(), "problems")
    return out


def mixed_loops(routed: DataFrame) -> DataFrame:
    """PROBLEMS: loops whose categories have different keys."""
    loops = routed.where("mixed_loop").select("block_id", "loop_idx").distinct()
    detail = F.format_string("block %s: loop %s has categories with different keys; it goes to the fallback", "block_id", F.col("loop_idx").cast("string"))
    return _problems(loops, "mixed_loop", detail, block_id=F.col("block_id"))


def deprecations(routed: DataFrame, schema: Schema) -> DataFrame:
    """PROBLEMS: deprecated tags of each block."""
    used = routed.where("deprecated").select("block_id", "tag").distinct()
    instead = [(tag, ", ".join(to)) for tag, to in schema.deprecated_replacements.items() if to]
    used = used.join(local_table(routed.sparkSession, instead, "tag string, _instead string"), "tag", "left")
    detail = F.concat(F.format_string("block %s: tag %s is deprecated", "block_id", "tag"), F.coalesce(F.concat(F.lit("; use "), "_instead"), F.lit("")))
    return _problems(used, "deprecated_tag", detail, block_id=F.col("block_id"))


def conflict_problems(conflicts: DataFrame, table: Table) -> DataFrame:
    """PROBLEMS: a row for each conflict of merge_table()."""
    if not table.keys:
        return conflicts.sparkSession.createDataFrame([], PROBLEMS)
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in table.keys if k in conflicts.columns]
    detail = F.concat(F.lit(f"table {table.name}, key "), F.concat_ws(", ", *keys), F.lit(": several values of "), F.col("column_name"), F.lit("; the first stays"))
    return _problems(conflicts, "merge_conflict", detail, table_name=F.lit(table.name), column_name=F.col("column_name"))


def _problems(rows: DataFrame, kind: str, detail: Col, **places: Col) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.lit(kind).alias("kind"), *(places.get(c, none).alias(c) for c in ("block_id", "table_name", "column_name")), detail.alias("detail"))


def told(problems: DataFrame) -> list[str]:
    """Texts for display: of each kind and table the first SHOWN, and if these aren't all, how many there are."""
    out = []
    groups = problems.groupBy("kind", "table_name").agg(F.count(F.lit(1)).alias("n")).collect()  # kinds and table names
    for g in sorted(groups, key=lambda g: (g["kind"] == "merge_conflict", g["kind"] != "mixed_loop", g["table_name"] or "")):
        rows = problems.where((F.col("kind") == g["kind"]) & F.col("table_name").eqNullSafe(F.lit(g["table_name"])))
        out += [r["detail"] for r in rows.orderBy("block_id", "column_name", "detail").limit(SHOWN).collect()]
        if g["n"] > SHOWN:
            out.append(f"{g['kind']}{' of table ' + g['table_name'] if g['table_name'] else ''}: {g['n']} in all, the first {SHOWN} are listed; problems has all")
    return out


def _union(spark: SparkSession, name: str, frames: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], INFRASTRUCTURE[name])
    for f in frames:
        out = out.unionByName(f.select(*out.columns))
    return out


def _infrastructure(out: Dataset, cells: DataFrame, routed: DataFrame, presence: list[DataFrame], counts: list[DataFrame], into: Dataset | None) -> None:
    spark = out.spark
    made: dict[str, DataFrame] = {}
    rows = routed.where("table_name IS NULL AND rank = 0")
    shape = F.col("loop_idx").cast("int").alias("loop_id")
    made["fallback"] = rows.select("block_id", F.col("iter_idx").cast("long").alias("row_id"), "tag", "value", "value_type", shape, "col_index", "ref_table")
    made["block_order"] = cells.groupBy("block_id").agg(F.min("block_idx").alias("position"))
    made["tag_presence"] = _union(spark, "tag_presence", presence).distinct()
    made["metatable"] = _union(spark, "metatable", counts)
    groups = [df.groupBy(BLOCK, LOOP).agg(F.min(f"{ORDER}.event").alias("event_pos")).select(F.col(BLOCK).alias("block_id"), F.lit(t).alias("table_name"), F.col(LOOP).cast("int").alias("loop_id"), F.when(F.col("event_pos") < _NO_EVENT, F.col("event_pos")).alias("event_pos")) for t, df in out.tables.items()]
    made["loop_groups"] = _union(spark, "loop_groups", groups)
    regimes = id_regimes(out, made["block_order"])
    ids = cells.where((F.col("tag") == DATASET_TAG) & ~F.col("value").isin(".", "?")).select("block_id", F.col("value").alias("dataset_id")).distinct()
    made["membership"] = ids.join(regimes, "block_id", "left")
    made["validation"] = regimes.where("id_regime = 'uuid'").select(F.lit("uuid_regime").alias("check_name"), F.lit("Warning").alias("severity"), "block_id", F.lit("all keys of the block are UUIDs").alias("detail"), "id_regime")
    for name, df in made.items():
        df = df.select(*spark.createDataFrame([], INFRASTRUCTURE[name]).columns)
        if into is not None:
            keys = {"fallback": ["block_id", "row_id", "tag", "loop_id"], "block_order": ["block_id"], "membership": ["block_id", "dataset_id"]}.get(name)
            old = into.infra[name]
            df = df if name == "metatable" else old.unionByName(df).distinct() if keys is None else _ignored(old, df, keys)
        made[name] = df
    out.infra |= written_all(made, "infra")


def _ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-ignore with keys that may be null."""
    there = old.select(*(F.col(k).alias(f"_o_{k}") for k in keys))
    on = [new[k].eqNullSafe(there[f"_o_{k}"]) for k in keys]
    return old.unionByName(new.join(there, on, "left_anti"))


def id_regimes(data: Dataset, blocks: DataFrame) -> DataFrame:
    """block_id, id_regime: `uuid` if all its key values, in all key columns, are UUIDs; `assumed` if not."""
    bad = [R.pattern_counts(df.select(BLOCK, F.explode(F.array(*data.schema.tables[t].keys)).alias("k")).where("k IS NOT NULL"), [BLOCK], "k", C.UUID) for t, df in data.tables.items() if data.schema.tables[t].keys]
    if not bad:
        return blocks.select("block_id", F.lit("assumed").alias("id_regime"))
    whole = bad[0]
    for b in bad[1:]:
        whole = whole.unionByName(b)
    whole = whole.groupBy(F.col(BLOCK).alias("block_id")).agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    return blocks.select("block_id").join(whole, "block_id", "left").select("block_id", F.when((F.col("bad") == 0) & (F.col("total") > 0), "uuid").otherwise("assumed").alias("id_regime"))
