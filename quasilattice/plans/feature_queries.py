"""Whole features on the driver's tables: dictionaries, defaults, plans, checks and layouts, by the library's own calls.

Each query makes cells of a table, loads them under a schema or a dictionary's text, and returns what the feature gives;
the SQL says what must come of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.convert import generate_defaults
from ..operators.emit import emit_blocks, emit_pieces
from ..operators.fidelity import compare_places
from ..operators.ingest import id_regimes, ingest
from ..operators.validate import validate_database
from ..sources.cells import cells_of_texts
from .dictionary import DictionaryLoader
from .output import BlockSpec, EmitMode, OutputPlan
from .schema import ForeignKey, Schema, generate_schema
from .text_queries import _column, _shop, _t, _table, cells_of, shop_cells

#: A dictionary with a default for each kind of event, by the attributes' current names, and a plain one.
EVENT_DICTIONARY = """#\\#CIF_2.0
data_EVENT_DIC
_dictionary.title EVENT_DIC
save_EVENT
_definition.id EVENT
_definition.scope Category
_definition.class Loop
_name.category_id EVENT_DIC
_name.object_id EVENT
_category_key.name '_event.id'
save_
save_event.id
_definition.id '_event.id'
_name.category_id event
_name.object_id id
_type.contents Integer
_type.container Single
save_
save_event.kind
_definition.id '_event.kind'
_name.category_id event
_name.object_id kind
_type.contents Code
_type.container Single
save_
save_event.weight
_definition.id '_event.weight'
_name.category_id event
_name.object_id weight
_type.contents Integer
_type.container Single
_enumeration.def_index_ids ['_event.kind']
loop_
_enumeration_defaults.index
_enumeration_defaults.value
[click] 1
[view] 2
save_
save_event.note
_definition.id '_event.note'
_name.category_id event
_name.object_id note
_type.contents Text
_type.container Single
_enumeration.default none
save_
"""


def keyed_defaults_loaded(s: SparkSession, d: str) -> DataFrame:
    """From the dictionary's text: schema, loading, and defaults by the kind of each event."""
    schema = generate_schema(DictionaryLoader().load(EVENT_DICTIONARY))
    e = _t(s, d, "events")
    parts = [("_event.id", F.col("event_id")), ("_event.kind", F.col("event_type"))]
    data = ingest(cells_of(e, F.lit(0), F.lit("events"), F.lit(0), F.col("event_id").cast("int"), parts, 1), schema)
    generate_defaults(data)
    return data.tables["event"].select(F.col("id").cast("long").alias("event_id"), "kind", "weight", "note")


def schema_derivation(s: SparkSession, d: str) -> DataFrame:
    """The tables and columns that a dictionary gives."""
    schema = generate_schema(DictionaryLoader().load(EVENT_DICTIONARY))
    rows = [(t.name, t.category_class, c.name, c.type_contents, c.is_primary_key) for t in schema.tables.values() for c in t.columns if not c.is_synthetic]
    return s.createDataFrame(rows, "table_name string, kind string, column_name string, contents string, is_key boolean")


#: Values of each content type, by whether they are ones. Fixed values.
VALUES = [
    ("Word", "ab", True), ("Word", "a b", False), ("Code", "a-b", True), ("Code", "a\tb", False), ("Name", "a_1", True), ("Name", "a-b", False), ("Tag", "_a.b", True), ("Tag", "a.b", False),
    ("Uri", "https://x.y", True), ("Uri", "a b", False), ("Iri", "a b", True), ("Iri", "a\tb", False), ("Date", "2024-01-31", True), ("Date", "31/01/2024", False),
    ("DateTime", "2024-01-15", True), ("DateTime", "2024-01-15T12:00:00", True), ("DateTime", "2024-13-45", False), ("DateTime", "2024-02-30", False), ("DateTime", "2024-01-15T25:00", False),
    ("DateTime", "20240115", True), ("DateTime", "2024-W53-1", False), ("DateTime", "2020-W53-1", True), ("DateTime", "2024-01-15 10:00:00.5+02:00", True), ("DateTime", "soon", False),
    ("Version", "1.2.3", True), ("Version", "1.2.3-rc", True), ("Version", "1.2", False), ("Dimension", "[3,3]", True), ("Dimension", "[]", True), ("Dimension", "[abc]", False), ("Dimension", "3,3", False),
    ("Range", "0:10", True), ("Range", ":10", True), ("Range", "-1.5:", True), ("Range", "a:b", False), ("Range", "10", False), ("Integer", "-7", True), ("Integer", "3.5", False),
    ("Real", "-1.0e-3", True), ("Real", "1.5(2)", True), ("Real", "abc", False), ("Symop", "1_555", True), ("Symop", "7", True), ("Symop", "1_2", False), ("Symop", "x,y,z", False),
    ("Imag", "5", True), ("Complex", "7", True), ("Text", "any thing", True), ("Implied", "any", True),
]


def content_rules(s: SparkSession, d: str) -> DataFrame:
    """The rule of every content type on the listed values."""
    df = s.createDataFrame([v[:2] for v in VALUES], "contents string, value string")
    ok = F.lit(True)
    for kind in C.CONTENTS:
        ok = F.when(F.col("contents") == kind, C.contents_ok(F.col("value"), kind)).otherwise(ok)
    return df.select("contents", "value", ok.alias("valid"))


# ---- output


def _loose_cells(s: SparkSession, d: str) -> DataFrame:
    """A block for each order status: a tag with several values, and the orders as a loop; no tag is known."""
    o = _t(s, d, "orders")
    rank = F.dense_rank().over(_by("o_orderstatus")) - 1
    o = o.join(F.broadcast(o.select("o_orderstatus").distinct().withColumn("b", rank.cast("int"))), "o_orderstatus")  # a row a status
    block = F.concat(F.lit("s"), "o_orderstatus")
    said = o.select("b", "o_orderstatus", "o_orderpriority").distinct()
    scalars = cells_of(said, F.col("b"), block, F.lit(None).cast("int"), F.lit(0), [("_u.priority", F.col("o_orderpriority"))], 1)
    loop = cells_of(o, F.col("b"), block, F.lit(0), F.col("o_orderkey").cast("int"), [("_u.order", F.col("o_orderkey")), ("_u.customer", F.col("o_custkey"))], 2)
    return scalars.unionByName(loop)


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def emit_keeps_all(s: SparkSession, d: str) -> DataFrame:
    """All values written and read again, by mode: tags with several values, loops with the same tags in several blocks."""
    data, out = ingest(_loose_cells(s, d), spark=s), None
    for mode in (EmitMode.ORIGINAL, EmitMode.GROUPED, EmitMode.ONE_BLOCK):
        texts = emit_pieces(data, mode=mode).select(F.col("name").alias("source"), F.concat(F.lit("#\\#CIF_2.0\n"), "head", "text").alias("content"))
        rows = cells_of_texts(texts).groupBy("tag", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode.value))
        out = rows if out is None else out.unionByName(rows)
    return out


def _nations(s: SparkSession, d: str) -> DataFrame:
    """Two tables with one key, in one block: customers and suppliers of each nation."""
    out = None
    for i, (name, table, key) in enumerate((("cust", "customer", "c_nationkey"), ("supp", "supplier", "s_nationkey"))):
        n = _t(s, d, table).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        part = cells_of(n, F.lit(0), F.lit("nations"), F.lit(i), F.col("k").cast("int"), [(f"_{name}.k", F.col("k")), (f"_{name}.n", F.col("n"))], 1 + 2 * i)
        out = part if out is None else out.unionByName(part)
    return out


def merge_group_full_outer(s: SparkSession, d: str) -> DataFrame:
    """Categories with one key, that a plan puts in one loop, written and read again."""
    schema = _schema(_table("cust", "Loop", [_column("cust", "k", "Integer"), _column("cust", "n", "Integer")], ["k"]), _table("supp", "Loop", [_column("supp", "k", "Integer"), _column("supp", "n", "Integer")], ["k"], (ForeignKey("supp", ("k",), "cust", ("k",)),)))
    data = ingest(_nations(s, d), schema, propagate_fk=False)
    blocks = emit_blocks(data, mode=EmitMode.ONE_BLOCK, plan=OutputPlan([BlockSpec(category_order=[["cust", "supp"]])]))
    cells = cells_of_texts(blocks.select(F.col("name").alias("source"), F.concat(F.lit("#\\#CIF_2.0\n"), "text").alias("content")))
    pick = lambda tag: F.max(F.when((F.col("tag") == tag) & (F.col("value") != "."), F.col("value"))).cast("long")
    return cells.groupBy("loop_idx", "iter_idx").agg(pick("_cust.k").alias("k"), pick("_cust.n").alias("cn"), pick("_supp.n").alias("sn")).drop("loop_idx", "iter_idx")


def _schema(*tables) -> Schema:
    return Schema(tables={t.name: t for t in tables}, column_to_tag={(t.name, c.name): c.definition_id for t in tables for c in t.columns if c.definition_id})


def _price_lines(s: SparkSession, d: str) -> DataFrame:
    """The lines of a loop of parts with their prices."""
    schema = _schema(_table("part", "Loop", [_column("part", "id", "Text"), _column("part", "price", "Real")], ["id"]))
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    cells = cells_of(_t(s, d, "part"), F.lit(0), F.lit("parts"), F.lit(0), F.col("p_partkey").cast("int"), [("_part.id", F.col("p_partkey")), ("_part.price", price)], 1)
    text = emit_blocks(ingest(cells, schema), mode=EmitMode.ONE_BLOCK)
    return text.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\d"))


def decimal_align(s: SparkSession, d: str) -> DataFrame:
    """Columns of one width, numbers with their points below each other."""
    return _price_lines(s, d)


def col_widths(s: SparkSession, d: str) -> DataFrame:
    lines = _price_lines(s, d)
    return lines.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.instr("line", ".")).alias("places"), F.max(F.length("line")).cast("long").alias("w"))


# ---- checks


def block_filter(s: SparkSession, d: str) -> DataFrame:
    """Issues of one block of a whole load."""
    return validate_database(_shop(s, d), block_id="c7").groupBy("check_name", "severity", "block_id").agg(F.count(F.lit(1)).alias("n"))


def schema_mismatch(s: SparkSession, d: str) -> DataFrame:
    """Tags that one load has in the fallback and the other in a table."""
    return compare_places(_shop(s, d), ingest(shop_cells(s, d), spark=s)).select("kind", "side", "table_name", F.substring_index("detail", " ", 1).alias("tag"))


def keyless_cardinality(s: SparkSession, d: str) -> DataFrame:
    """A Set without a key that has several rows in a block."""
    docs = _t(s, d, "documents").where("lang IS NOT NULL").select("lang", "source", "doc_id")
    cells = cells_of(docs, F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1)), F.col("lang"), F.lit(0), F.col("doc_id").cast("int"), [("_props.source", F.coalesce("source", F.lit("?")))], 1)
    found = validate_database(ingest(cells, _schema(_table("props", "Set", [_column("props", "source")], []))))
    return found.where("check_name = 'cardinality'").select(F.col("block_id").alias("doc_lang"), F.substring_index("detail", " ", 1).cast("long").alias("n"))


def uuid_regime(s: SparkSession, d: str) -> DataFrame:
    """Blocks whose keys are all UUIDs: suppliers of every second nation have such names."""
    h = F.md5(F.col("s_suppkey").cast("string"))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    name = F.when(F.col("s_nationkey") % 2 == 0, made).otherwise(F.col("s_suppkey").cast("string"))
    cells = cells_of(_t(s, d, "supplier"), F.col("s_nationkey"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit(0), F.col("s_suppkey").cast("int"), [("_supp.id", name), ("_supp.balance", F.lit("1"))], 1)
    data = ingest(cells, _schema(_table("supp", "Loop", [_column("supp", "id"), _column("supp", "balance", "Real")], ["id"])))
    return id_regimes(data, data.infra["block_order"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    keyed_defaults_loaded, schema_derivation, content_rules, emit_keeps_all, merge_group_full_outer, decimal_align, col_widths, block_filter, schema_mismatch, keyless_cardinality, uuid_regime,
)}


def _literals(rows: list[tuple], names: str) -> str:
    def text(x: object) -> str:
        return str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


_LOOSE = "SELECT '_u.order' AS tag, o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT '_u.customer', o_custkey::VARCHAR FROM orders UNION ALL SELECT '_u.priority', o_orderpriority FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)"
_LINES = "SELECT rpad(p_partkey::VARCHAR, (max(length(p_partkey::VARCHAR)) OVER ())::INT, ' ') || ' ' || lpad(s, (max(length(s)) OVER ())::INT, ' ') AS line FROM (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS s FROM part)"
ORACLE_SQL = {
    "keyed_defaults_loaded": "SELECT event_id, event_type AS kind, CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' END AS weight, 'none' AS note FROM events",
    "schema_derivation": "SELECT 'event' AS table_name, 'Loop' AS kind, c AS column_name, t AS contents, c = 'id' AS is_key FROM (VALUES ('id', 'Integer'), ('kind', 'Code'), ('weight', 'Integer'), ('note', 'Text')) v(c, t)",
    "content_rules": _literals(VALUES, "contents, value, valid"),
    "emit_keeps_all": f"SELECT mode, tag, value, count(*) AS n FROM ({_LOOSE}) CROSS JOIN (VALUES ('original'), ('grouped'), ('one_block')) m(mode) GROUP BY ALL",
    "merge_group_full_outer": "SELECT COALESCE(a.k,b.k)::BIGINT AS k, a.n AS cn, b.n AS sn FROM (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) b ON a.k=b.k",
    "decimal_align": _LINES,
    "col_widths": f"SELECT count(*) AS n, count(DISTINCT strpos(line, '.')) AS places, max(length(line)) AS w FROM ({_LINES})",
    "block_filter": "SELECT 'enumeration_states' AS check_name, 'Error' AS severity, 'c7' AS block_id, count(*) AS n FROM orders WHERE o_custkey = 7 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') HAVING count(*) > 0 UNION ALL SELECT 'type_contents', 'Warning', 'c7', count(*) FROM orders WHERE o_custkey = 7 AND o_orderpriority LIKE '% %' HAVING count(*) > 0 UNION ALL SELECT 'unknown_tag', 'Warning', 'c7', count(DISTINCT o_custkey) FROM orders WHERE o_custkey = 7 HAVING count(*) > 0",
    "schema_mismatch": _literals([("schema_mismatch", "b", "customer", "_customer.id"), ("schema_mismatch", "b", "order", "_order.id"), ("schema_mismatch", "b", "order", "_order.priority")], "kind, side, table_name, tag"),
    "keyless_cardinality": "SELECT doc_lang, n FROM (SELECT lang doc_lang, count(*) n FROM documents WHERE lang IS NOT NULL GROUP BY 1) WHERE n>1",
    "uuid_regime": "SELECT DISTINCT 'n' || s_nationkey::VARCHAR AS block_id, CASE WHEN s_nationkey % 2 = 0 THEN 'uuid' ELSE 'assumed' END AS id_regime FROM supplier",
}
