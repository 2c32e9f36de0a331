"""The text layer and the loader on the driver's tables.

Texts and cells are made from the tables by DataFrame functions, then read, loaded, filled, checked and written by the
library; the SQL says what must come of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.quoting import quote_text
from ..operators import relational as R
from ..operators.convert import convert_database, generate_defaults
from ..operators.emit import emit_pieces
from ..operators.fidelity import compare_fallback, compare_tables
from ..operators.ingest import Dataset, container_su, ingest
from ..operators.validate import validate_database
from ..sources.cells import CELLS, cells_of_texts, errors_of_texts, tokens_of_texts
from .output import EmitMode
from .schema import BLOCK, ID, ROW, Column, ForeignKey, Schema, Table

ROWS_A_TEXT = 100


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def loop_texts(rows: DataFrame, key: str, tags: dict[str, Col], spare: int = 0) -> DataFrame:
    """(source, content): rows as loops, ROWS_A_TEXT key values a text; spare: values left out at each text's end."""
    text = F.floor(F.col(key) / ROWS_A_TEXT)
    cells = [C.quoted(F.coalesce(v.cast("string"), F.lit("?"))) for v in tags.values()]
    lines = rows.select(text.alias("n"), F.struct(F.col(key), F.concat_ws("\n", *cells).alias("x")).alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["x"]), "\n")
    head = "\nloop_\n" + "\n".join(tags) + "\n"
    grouped = lines.groupBy("n").agg(body.alias("body"))
    if spare:
        grouped = grouped.withColumn("body", F.regexp_replace("body", r"(\n[^\n]*){%d}$" % spare, ""))
    source = F.concat(F.lit("t"), F.col("n").cast("string"))
    return grouped.select(source.alias("source"), F.concat(F.lit("#\\#CIF_2.0\ndata_"), source, F.lit(head), "body", F.lit("\n")).alias("content"))


def cif_tokens(s: SparkSession, d: str) -> DataFrame:
    texts = loop_texts(_t(s, d, "part"), "p_partkey", {"_part.id": F.col("p_partkey"), "_part.name": F.col("p_name")})
    return tokens_of_texts(texts).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "value").alias("n_values"))


def cif_roundtrip(s: SparkSession, d: str) -> DataFrame:
    tags = {"_order.id": F.col("o_orderkey"), "_order.status": F.col("o_orderstatus"), "_order.priority": F.col("o_orderpriority")}
    cells = cells_of_texts(loop_texts(_t(s, d, "orders"), "o_orderkey", tags))
    wide = R.pivot_rows(cells, ["source", "iter_idx"], "tag", "value", list(tags))
    return wide.select(F.col("`_order.id`").cast("long").alias("o_orderkey"), F.col("`_order.status`").alias("o_orderstatus"), F.col("`_order.priority`").alias("o_orderpriority"))


def cif_malformed_recovery(s: SparkSession, d: str) -> DataFrame:
    """Texts that lack their last value: an error each, and all other values are read."""
    texts = loop_texts(_t(s, d, "part"), "p_partkey", {"_part.id": F.col("p_partkey"), "_part.brand": F.col("p_brand")}, spare=1)
    errors = errors_of_texts(texts).groupBy("source").agg(F.count(F.lit(1)).alias("n_errors"))
    values = cells_of_texts(texts).where("value <> '?'").groupBy("source").agg(F.count(F.lit(1)).alias("n_values"))
    return values.join(errors, "source", "left")


def text_field_protocols(s: SparkSession, d: str) -> DataFrame:
    """Whole documents written as values, in folded and prefixed text fields where they need them, and read back."""
    token = F.udf(lambda t: None if t is None else quote_text(t, line_limit=80), "string", useArrow=True)
    texts = _t(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("#\\#CIF_2.0\ndata_d\n_text "), token("text"), F.lit("\n")).alias("content"))
    return cells_of_texts(texts).select(F.col("source").cast("long").alias("doc_id"), F.md5("value").alias("digest"))


def container_split_su(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    stored = F.concat(F.lit('\x00["'), size, F.lit('.25(3)",["'), size, F.lit('"]]'))
    both = _t(s, d, "part").select("p_partkey", container_su(stored).alias("x"))
    return both.select("p_partkey", F.substring("x.number", 2, 100).alias("number"), F.substring("x.su", 2, 100).alias("su"))


# ---- loading


def _column(table: str, name: str, contents: str = "Text", **more) -> Column:
    return Column(name, f"_{table}.{name}", contents, "Single", **more)


def _table(name: str, kind: str, columns: list[Column], keys: list[str], links: tuple[ForeignKey, ...] = ()) -> Table:
    head = [Column(BLOCK, is_synthetic=True), Column(ROW, is_synthetic=True)] if keys else [Column(BLOCK, is_synthetic=True), Column(ID, is_synthetic=True), Column(ROW, is_synthetic=True)]
    for c in columns:
        c.is_primary_key = c.name in keys
    return Table(name, name, kind, head + columns, keys or [ID], list(links))


def shop_schema() -> Schema:
    """Customers (Set) with their orders (Loop): a block is a customer."""
    customer = _table("customer", "Set", [_column("customer", "id", "Integer"), _column("customer", "segment", enumeration_default="NONE")], ["id"])
    order = _table("order", "Loop", [_column("order", "id", "Integer"), _column("order", "customer_id", "Integer"), _column("order", "priority", "Code", enumeration_states=["1-URGENT", "2-HIGH", "3-MEDIUM"]), _column("order", "note")], ["id"], (ForeignKey("order", ("customer_id",), "customer", ("id",)),))
    tables = {t.name: t for t in (customer, order)}
    return Schema(tables=tables, column_to_tag={(t.name, c.name): c.definition_id for t in tables.values() for c in t.columns if c.definition_id})


def cells_of(rows: DataFrame, block_idx: Col, block: Col, loop: Col, iteration: Col, parts: list[tuple[str, Col]], event: int, source: str = "shop") -> DataFrame:
    """CELLS of rows: each of the parts (tag, value) of a row is a cell."""
    values = F.array(*(F.struct(F.lit(tag).alias("tag"), F.lit(event + i).alias("pos"), F.lit(i if len(parts) > 1 else None).cast("int").alias("col"), v.cast("string").alias("value")) for i, (tag, v) in enumerate(parts)))
    long = rows.select("*", F.explode(values).alias("x"))
    made = long.select(F.lit(source).alias("source"), block_idx.cast("int").alias("block_idx"), block.alias("block_id"), F.lit(None).cast("int").alias("frame_idx"), F.lit(None).cast("string").alias("frame_name"), loop.alias("loop_idx"), iteration.alias("iter_idx"), "x.tag", F.col("x.pos").alias("tag_pos"), F.col("x.col").alias("col_index"), "x.value", F.lit("string").alias("value_type"), F.lit(event).alias("event_pos"))
    return made.select([c.split()[0] for c in CELLS.split(", ")])


def shop_cells(s: SparkSession, d: str, unknown: bool = True) -> DataFrame:
    """Cells of a block for each customer with orders: its id as a scalar, its orders as a loop without the link; unknown:
    and a tag that no dictionary has."""
    o = _t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    who, block, none = o.select("o_custkey").distinct(), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit(None).cast("int")
    ids = cells_of(who, F.col("o_custkey"), block, none, F.lit(0), [("_customer.id", F.col("o_custkey"))], 0)
    # An order's key is its number in the loop: rows of a loop need numbers, not dense ones.
    rows = cells_of(o, F.col("o_custkey"), block, F.lit(0), F.col("o_orderkey").cast("int"), [("_order.id", F.col("o_orderkey")), ("_order.priority", F.col("o_orderpriority"))], 1)
    out = ids.unionByName(rows)
    return out.unionByName(cells_of(who, F.col("o_custkey"), block, none, F.lit(0), [("_shop.unknown", F.lit("u"))], 3)) if unknown else out


def _shop(s: SparkSession, d: str) -> Dataset:
    return ingest(shop_cells(s, d), shop_schema())


def propagate_full(s: SparkSession, d: str) -> DataFrame:
    """Orders take their customer from the block's scalar."""
    return _shop(s, d).tables["order"].select(F.col("id").cast("long").alias("o_orderkey"), F.col("customer_id").cast("long").alias("o_custkey"), F.col("priority").alias("o_orderpriority"))


def load_fallback(s: SparkSession, d: str) -> DataFrame:
    return _shop(s, d).infra["fallback"].select("block_id", "tag", "value")


def load_metatable(s: SparkSession, d: str) -> DataFrame:
    return _shop(s, d).infra["metatable"].select("table_name", "column_name", "n")


def defaults_fixpoint(s: SparkSession, d: str) -> DataFrame:
    data = _shop(s, d)
    generate_defaults(data)
    return data.tables["customer"].select(F.col("id").cast("long").alias("c_custkey"), "segment")


def typed_export(s: SparkSession, d: str) -> DataFrame:
    tables, _ = convert_database(_shop(s, d))
    return tables["order"].select(F.col("id").alias("o_orderkey"), F.col("customer_id").alias("o_custkey"))


def validate_states(s: SparkSession, d: str) -> DataFrame:
    return validate_database(_shop(s, d)).where("check_name = 'enumeration_states'").groupBy("value", "severity").agg(F.count(F.lit(1)).alias("n"))


def fidelity_self(s: SparkSession, d: str) -> DataFrame:
    """A dataset and one that lacks some orders."""
    a = _shop(s, d)
    b = Dataset(s, a.schema, dict(a.tables), dict(a.infra))
    b.tables["order"] = b.tables["order"].where("priority <> '1-URGENT'")
    out = compare_fallback(a, b)
    for f in compare_tables(a, b):
        out = out.unionByName(f)
    return out.groupBy("kind", "side", "table_name").agg(F.count(F.lit(1)).alias("n"))


def _emitted(s: SparkSession, d: str, mode: EmitMode) -> DataFrame:
    """How often each block has each tag and value, after writing and reading."""
    data = ingest(shop_cells(s, d, unknown=mode is not EmitMode.ALL_BLOCKS), shop_schema())  # unknown tags can't be dealt out to all blocks
    texts = emit_pieces(data, mode=mode).select(F.col("name").alias("source"), F.concat(F.lit("#\\#CIF_2.0\n"), "head", "text").alias("content"))
    return cells_of_texts(texts).groupBy("source", "tag", "value").agg(F.count(F.lit(1)).alias("n"))


def emit_original(s: SparkSession, d: str) -> DataFrame:
    """Written and read again: all values of each block."""
    return _emitted(s, d, EmitMode.ORIGINAL)


def emit_grouped(s: SparkSession, d: str) -> DataFrame:
    return _emitted(s, d, EmitMode.GROUPED)


def emit_one_block(s: SparkSession, d: str) -> DataFrame:
    return _emitted(s, d, EmitMode.ONE_BLOCK)


def emit_all_blocks(s: SparkSession, d: str) -> DataFrame:
    return _emitted(s, d, EmitMode.ALL_BLOCKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    cif_tokens, cif_roundtrip, cif_malformed_recovery, text_field_protocols, container_split_su, propagate_full, load_fallback, load_metatable, defaults_fixpoint,
    typed_export, validate_states, fidelity_self, emit_original, emit_grouped, emit_one_block, emit_all_blocks,
)}

_PER_TEXT = "SELECT 't' || (p_partkey // 100)::VARCHAR AS source, {} FROM part GROUP BY p_partkey // 100"
_VALUES = "SELECT {0} AS source, '_order.id' AS tag, o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT {0}, '_order.priority', o_orderpriority FROM orders"
_WHO = "SELECT DISTINCT o_custkey FROM orders"
_WRITTEN = "SELECT source, tag, value, count(*) AS n FROM (" + _VALUES.replace("{0}", "{0} || o_custkey::VARCHAR") + " UNION ALL SELECT {0} || o_custkey::VARCHAR, '_customer.id', o_custkey::VARCHAR FROM (" + _WHO + ") UNION ALL SELECT {0} || o_custkey::VARCHAR, '_shop.unknown', 'u' FROM (" + _WHO + ")) WHERE {1} GROUP BY ALL"
_ONE = "SELECT source, tag, value, count(*) AS n FROM (" + _VALUES + " UNION ALL SELECT {0}, '_order.customer_id', {1} FROM orders UNION ALL SELECT {0}, '_customer.id', {1} FROM (" + _WHO + ") UNION ALL SELECT {0}, '_shop.unknown', 'u' FROM (" + _WHO + ")) GROUP BY ALL"
_ALL = "SELECT source, tag, value, count(*) AS n FROM (" + _VALUES.format("'order'") + " UNION ALL SELECT 'order', '_order.customer_id', o_custkey::VARCHAR FROM orders UNION ALL SELECT 'customer_' || o_custkey::VARCHAR, '_customer.id', o_custkey::VARCHAR FROM (" + _WHO + ")) GROUP BY ALL"
ORACLE_SQL = {
    "cif_tokens": _PER_TEXT.format("4 + 2 * count(*) AS n, 2 * count(*) AS n_values"),
    "cif_roundtrip": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    "cif_malformed_recovery": _PER_TEXT.format("2 * count(*) - 1 AS n_values, 1::BIGINT AS n_errors"),
    "text_field_protocols": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "container_split_su": """SELECT p_partkey, '["' || p_size || '.25",["' || p_size || '"]]' AS number, '["0.03",["0"]]' AS su FROM part""",
    "propagate_full": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders",
    "load_fallback": "SELECT DISTINCT 'c' || o_custkey::VARCHAR AS block_id, '_shop.unknown' AS tag, 'u' AS value FROM orders",
    "load_metatable": "SELECT 'customer' AS table_name, 'id' AS column_name, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'customer', 'segment', 0 UNION ALL SELECT 'order', c, n FROM (SELECT unnest(['id', 'customer_id', 'priority', 'note']) AS c, unnest([count(*), count(*), count(*), 0]) AS n FROM orders)",
    "defaults_fixpoint": "SELECT DISTINCT o_custkey AS c_custkey, 'NONE' AS segment FROM orders",
    "typed_export": "SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey FROM orders",
    "validate_states": "SELECT o_orderpriority AS value, 'Error' AS severity, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1",
    "fidelity_self": "SELECT 'row_content' AS kind, 'a' AS side, 'order' AS table_name, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' HAVING count(*) > 0",
    "emit_original": _WRITTEN.format("'c'", "TRUE"),
    "emit_grouped": _WRITTEN.format("'customer_id_'", "TRUE"),
    "emit_one_block": _ONE.format("'output'", "o_custkey::VARCHAR"),
    "emit_all_blocks": _ALL,
}
