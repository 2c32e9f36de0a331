"""Single operators on whole tables, by the library's own calls: text syntax, containers, links, stubs, merges, typed copies.

As in text_queries: texts and cells are made of the tables, the library does the rest, the SQL says what must come of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.quoting import is_table_key_quotable, quote, quote_text
from ..functions.values import canonical_real, decode_container, extract_leaves
from ..operators.convert import convert_database
from ..operators.emit import emit_blocks
from ..operators.ingest import ingest, select_blocks
from ..operators.validate import validate_database
from ..operators.storage import dealt
from ..sources.cells import cells_of_texts, events_of_texts, tokens_of_texts
from ..sources.clean import clean_cells
from ..sources.lexer import detect_version
from ..sources.types import V1
from .dictionary import DictionaryLoader, resolve_tag
from .output import EmitMode
from .schema import BLOCK, ROW, Column, ForeignKey, Schema, Table, generate_schema, topological
from .text_queries import _column, _shop, _t, _table, cells_of, loop_texts, shop_cells, shop_schema

HEAD_1, HEAD_2 = "#\\#CIF_1.1\ndata_d\n", "#\\#CIF_2.0\ndata_d\n"


def _schema(*tables: Table, **more) -> Schema:
    return Schema(tables={t.name: t for t in tables}, column_to_tag={(t.name, c.name): c.definition_id for t in tables for c in t.columns if c.definition_id}, **more)


def _text(x: Col | str) -> Col:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("?"))


def _part_texts(s: SparkSession, d: str, head: str, *pieces: Col | str) -> DataFrame:
    """(source, content): a text for each part; pieces: columns, and fixed text between them as given."""
    body = F.concat(F.lit(head), *(F.lit(p) if isinstance(p, str) else _text(p) for p in pieces), F.lit("\n"))
    return dealt(_t(s, d, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("source"), body.alias("content"))


def _key(df: DataFrame, *rest: str) -> DataFrame:
    return df.select(F.col("source").cast("long").alias("p_partkey"), *rest)


# ---- syntax


def cif_quoting_styles(s: SparkSession, d: str) -> DataFrame:
    """Each part's name in all ways to quote it, as tokens with their way."""
    n = F.col("p_name")
    texts = _part_texts(s, d, HEAD_2, "_a.bare ", F.col("p_partkey"), "\n_a.one '", n, "'\n_a.two \"", n, "\"\n_a.three '''", n, "'''\n_a.four \"\"\"", n, '"""\n_a.five\n;', n, "\n;")
    return _key(tokens_of_texts(texts).where("kind = 'value'"), "text", "value_type")


def cif11_quotes(s: SparkSession, d: str) -> DataFrame:
    """Version 1.1: a quote ends a value only before a blank; brackets are ordinary characters."""
    texts = _part_texts(s, d, HEAD_1, "_a.x 'it's ", F.col("p_brand"), "'\n_a.y x[", F.col("p_size"), "]")
    cells = cells_of_texts(texts)
    pick = lambda t: F.max(F.when(F.col("tag") == t, F.col("value")))
    return _key(cells.groupBy("source").agg(pick("_a.x").alias("x"), pick("_a.y").alias("y")), "x", "y")


def cif_containers(s: SparkSession, d: str) -> DataFrame:
    """Lists and tables, read into stored values, written as tokens, and their leaves."""
    texts = _part_texts(s, d, HEAD_2, "_a.l [", F.col("p_partkey"), " ['", F.col("p_name"), '\' "', F.col("p_brand"), "\"] {'k':", F.col("p_size"), "}]")
    token = F.udf(lambda x: quote(x), "string", useArrow=True)
    leaves = F.udf(lambda x: [str(v) for v in extract_leaves(decode_container(x))], "array<string>", useArrow=True)
    cells = cells_of_texts(texts).where("value_type = 'list'").withColumn("token", token("value")).withColumn("leaves", F.array_join(leaves("value"), "|"))
    return _key(cells.withColumn("stored", F.expr("substring(value, 2)")), "stored", "token", "leaves")


def cif_save_frames(s: SparkSession, d: str) -> DataFrame:
    """Frames with scalars and loops between a block's own values."""
    k = F.col("p_partkey")
    texts = _part_texts(s, d, HEAD_2, "_a.x ", k, "\nsave_f1\n_a.x f", k, "\nsave_\nsave_f2\nloop_\n_b.x\n_b.y\n1 ", k, " 3 ", F.col("p_size"), "\nsave_\n_c.z ", F.col("p_size"))
    return _key(cells_of_texts(texts), "frame_idx", "frame_name", "loop_idx", "iter_idx", "tag", "value")


def cif_two_loops(s: SparkSession, d: str) -> DataFrame:
    """Loops one after another and scalars behind them: loop numbers, rows and places of tags."""
    k = F.col("p_partkey")
    texts = _part_texts(s, d, HEAD_2, "loop_\n_a.x\n_a.y\n", k, " 2 3 4\nloop_\n_b.x\n", F.col("p_size"), "\n_C.Z ", k)
    return _key(cells_of_texts(texts), "loop_idx", "iter_idx", "tag", "col_index", "value")


def cif_events(s: SparkSession, d: str) -> DataFrame:
    """What the parser tells of the texts of all parts, counted."""
    texts = loop_texts(_t(s, d, "part"), "p_partkey", {"_part.id": F.col("p_partkey"), "_part.name": F.col("p_name")})
    return events_of_texts(texts).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


#: Beginnings of texts, with the version that they are read in. Fixed values.
BEGINNINGS = [("#\\#CIF_2.0\ndata_a", "2.0"), ("#\\#CIF_1.1\ndata_a", "1.1"), ("#\\#CIF_1.0", "1.1"), ("data_a", "1.1"), ("# a remark", "1.1"), ("\n#\\#CIF_2.0", "2.0"), ("#\\#CIF_3.0", "2.0"), ("", "1.1")]


def cif_versions(s: SparkSession, d: str) -> DataFrame:
    version = F.udf(lambda x: detect_version(x)[0], "string", useArrow=True)
    return s.createDataFrame(BEGINNINGS, "content string, want string").select(F.col("content").alias("begins"), version("content").alias("version"))


def clean_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts with a block twice, a tag twice and rows of padding, cleaned as cells."""
    k = F.col("p_partkey")
    texts = _part_texts(s, d, HEAD_2, "_a.x ", k, "\n_a.x ", F.col("p_size"), "\nloop_\n_b.i\n_b.j\n", k, " '", F.col("p_brand"), "' ? ?\ndata_D\n_a.x other")
    return _key(clean_cells(cells_of_texts(texts)), "tag", "value")


# ---- values


def su_merge(s: SparkSession, d: str) -> DataFrame:
    """Uncertainties split and put together again."""
    v = F.concat(F.col("l_partkey").cast("string"), F.lit(".25("), F.col("l_linenumber").cast("string"), F.lit(")"))
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.merged_su(*C.split_su(v)).alias("v"))


def canonical_reals(s: SparkSession, d: str) -> DataFrame:
    """Numbers with uncertainties and exponents in one way of writing; an uncertainty loses trailing zeros."""
    number, su = F.udf(canonical_real, "string", useArrow=True), F.udf(lambda x: canonical_real(x, True), "string", useArrow=True)
    n = F.col("l_linenumber").cast("string")
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", number(F.concat(n, F.lit(".50(3)"))).alias("a"), number(F.concat(n, F.lit(".5e2"))).alias("b"), su(F.concat(n, F.lit(".50"))).alias("c"), number(F.lit("n/a")).alias("e"))


def quote_cif11(s: SparkSession, d: str) -> DataFrame:
    token = F.udf(lambda x: None if x is None else quote_text(x, V1), "string", useArrow=True)
    return _t(s, d, "part").select("p_partkey", token(F.concat("p_name", F.lit("'s"))).alias("tok"))


def table_keys(s: SparkSession, d: str) -> DataFrame:
    """Whether whole documents could be keys of tables, which stand on one line."""
    fits = F.udf(lambda x: None if x is None else is_table_key_quotable(x), "boolean", useArrow=True)
    return _t(s, d, "documents").select("doc_id", fits("text").alias("fits"))


def uuid_values(s: SparkSession, d: str) -> DataFrame:
    made = C.stable_uuid(F.col("s_suppkey"))
    value = F.when(F.col("s_suppkey") % 2 == 0, F.upper(made)).otherwise(F.substring(made, 2, 36))
    return _t(s, d, "supplier").select("s_suppkey", C.is_uuid(value).alias("ok"), (made == C.stable_uuid(F.col("s_suppkey"))).alias("again"))


# ---- dictionaries

#: Shelves (Set) with boxes (Loop) and things (Loop) in them: a link, an alias, an uncertainty, a replaced item.
SHELF_DICTIONARY = """#\\#CIF_2.0
data_SHELF_DIC
_dictionary.title SHELF_DIC
save_SHELF
_definition.id SHELF
_definition.scope Category
_definition.class Set
_name.category_id SHELF_DIC
_name.object_id SHELF
_category_key.name '_shelf.id'
save_
save_shelf.id
_definition.id '_shelf.id'
_name.category_id shelf
_name.object_id id
_type.contents Code
save_
save_BOX
_definition.id BOX
_definition.scope Category
_definition.class Loop
_name.category_id SHELF
_name.object_id BOX
loop_
_category_key.name
'_box.shelf_id'
'_box.id'
save_
save_box.shelf_id
_definition.id '_box.shelf_id'
_name.category_id box
_name.object_id shelf_id
_type.purpose Link
_name.linked_item_id '_shelf.id'
save_
save_box.id
_definition.id '_box.id'
_name.category_id box
_name.object_id id
_type.contents Integer
save_
save_box.weight
_definition.id '_box.weight'
_name.category_id box
_name.object_id weight
_type.contents Real
loop_
_alias.definition_id
'_box.mass'
'_box_mass'
save_
save_box.weight_su
_definition.id '_box.weight_su'
_name.category_id box
_name.object_id weight_su
_type.purpose SU
_type.contents Real
_name.linked_item_id '_box.weight'
save_
save_box.old
_definition.id '_box.old'
_name.category_id box
_name.object_id old
_definition_replaced.id 1
_definition_replaced.by '_box.weight'
save_
"""

#: Tags and what they resolve to: definition, category, object, by an alias, deprecated. Fixed values of the text above.
RESOLVED = [("_BOX.Mass", "_box.weight", "box", "weight", True, False), ("_box_mass", "_box.weight", "box", "weight", True, False), ("_box.weight", "_box.weight", "box", "weight", False, False), ("_box.old", "_box.old", "box", "old", False, True), ("_shelf.id", "_shelf.id", "shelf", "id", False, False)]


def resolve_tags(s: SparkSession, d: str) -> DataFrame:
    dictionary = DictionaryLoader().load(SHELF_DICTIONARY)
    found = [(t, resolve_tag(t, dictionary)) for t in [*(r[0] for r in RESOLVED), "_box.none"]]
    rows = [(t, r.definition_id, r.category_id, r.object_id, r.was_alias, r.is_deprecated) for t, r in found if r]
    return s.createDataFrame(rows, "tag string, definition string, category string, object string, was_alias boolean, deprecated boolean")


def schema_links(s: SparkSession, d: str) -> DataFrame:
    """Links, uncertainties and the order of tables that a dictionary gives."""
    schema = generate_schema(DictionaryLoader().load(SHELF_DICTIONARY))
    rows = [("link", k.source_table, ",".join(k.source_columns), f"{k.target_table}.{','.join(k.target_columns)}") for t in schema.tables.values() for k in t.foreign_keys]
    rows += [("su", *schema.tag_to_column[tag], ".".join(to)) for tag, to in schema.su_map.items()]
    rows += [("order", t, str(i), "") for i, t in enumerate(topological(schema))]
    rows += [("below", "shelf", t, "") for t in schema.descendants("shelf")]
    return s.createDataFrame(rows, "what string, table_name string, column_name string, target string")


# ---- loading


def _part_cells(s: SparkSession, d: str, *parts: tuple[str, Col]) -> DataFrame:
    """Cells of one loop of all parts."""
    return cells_of(_t(s, d, "part"), F.lit(0), F.lit("parts"), F.lit(0), F.col("p_partkey").cast("int"), list(parts), 1)


def alias_load(s: SparkSession, d: str) -> DataFrame:
    """Tags by their aliases; uncertainties go to their own column; the shelf comes from the block's scalar."""
    schema = generate_schema(DictionaryLoader().load(SHELF_DICTIONARY))
    weight = F.concat(F.col("p_size").cast("string"), F.lit(".5(2)"))
    shelf = cells_of(s.range(1), F.lit(0), F.lit("parts"), F.lit(None).cast("int"), F.lit(0), [("_shelf.id", F.lit("top"))], 0)
    boxes = ingest(shelf.unionByName(_part_cells(s, d, ("_box.id", F.col("p_partkey")), ("_box.mass", weight))), schema).tables["box"]
    return boxes.select("shelf_id", F.col("id").cast("long").alias("id"), "weight", "weight_su")


def siblings_share_keys(s: SparkSession, d: str) -> DataFrame:
    """Two categories in one loop without their key: rows get the same made key."""
    schema = _schema(_table("name", "Loop", [_column("name", "id"), _column("name", "n", "Integer")], ["id"]), _table("brand", "Loop", [_column("brand", "id"), _column("brand", "b")], ["id"]))
    data = ingest(_part_cells(s, d, ("_name.n", F.col("p_partkey")), ("_brand.b", F.col("p_brand"))), schema)
    both = data.tables["name"].select("id", "n").join(data.tables["brand"].select("id", "b"), "id", "full_outer")
    return both.select(F.col("n").cast("long").alias("p_partkey"), F.col("b").alias("p_brand"))


def stub_parents_loaded(s: SparkSession, d: str) -> DataFrame:
    """Customers that only orders name get a row."""
    c = _t(s, d, "customer").where("c_acctbal > 0")
    have = cells_of(c, F.lit(0), F.lit("shop"), F.lit(0), F.col("c_custkey").cast("int"), [("_customer.id", F.col("c_custkey")), ("_customer.segment", F.col("c_mktsegment"))], 1)
    o = cells_of(_t(s, d, "orders"), F.lit(0), F.lit("shop"), F.lit(1), F.col("o_orderkey").cast("int"), [("_order.id", F.col("o_orderkey")), ("_order.customer_id", F.col("o_custkey"))], 3)
    return ingest(have.unionByName(o), shop_schema()).tables["customer"].select(F.col("id").cast("long").alias("c_custkey"), "segment")


def stub_parents_composite(s: SparkSession, d: str) -> DataFrame:
    """Items of two keys that only shipments name get a row."""
    link = ForeignKey("ship", ("order_id", "line"), "item", ("order_id", "line"))
    item = _table("item", "Loop", [_column("item", "order_id", "Integer"), _column("item", "line", "Integer"), _column("item", "mode")], ["order_id", "line"])
    ship = _table("ship", "Loop", [_column("ship", "id"), _column("ship", "order_id", "Integer"), _column("ship", "line", "Integer")], ["id"], (link,))
    rows = _t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int")
    pair = [F.col("l_orderkey"), F.col("l_linenumber")]
    have = cells_of(rows.where("l_linenumber % 2 = 1"), F.lit(0), F.lit("b"), F.lit(0), number, [("_item.order_id", pair[0]), ("_item.line", pair[1]), ("_item.mode", F.col("flag"))], 1)
    sent = cells_of(rows, F.lit(0), F.lit("b"), F.lit(1), number, [("_ship.id", number), ("_ship.order_id", pair[0]), ("_ship.line", pair[1])], 4)
    items = ingest(have.unionByName(sent), _schema(item, ship)).tables["item"]
    return items.select(F.col("order_id").cast("long").alias("l_orderkey"), F.col("line").cast("long").alias("l_linenumber"), "mode")


def keyless_rows(s: SparkSession, d: str) -> DataFrame:
    """A loop without a key keeps every row, numbered in order."""
    head = [Column(BLOCK, is_synthetic=True), Column(ROW, is_synthetic=True)]
    log = Table("log", "log", "Loop", [*head, _column("log", "user"), _column("log", "kind")], [BLOCK, ROW])
    e = _t(s, d, "events")
    cells = cells_of(e, F.lit(0), F.lit("log"), F.lit(0), F.col("event_id").cast("int"), [("_log.user", _text("user_id")), ("_log.kind", _text("event_type"))], 1)
    return ingest(cells, _schema(log)).tables["log"].select(F.col(ROW).cast("long").alias("n"), F.col("user").alias("user_id"), F.col("kind").alias("event_type"))


def reload_keeps_old(s: SparkSession, d: str) -> DataFrame:
    """A second load into a dataset: what is there wins, the rest comes in."""
    def cells(rows: DataFrame, name: str, segment: Col) -> DataFrame:
        return cells_of(rows, F.lit(0), F.lit(name), F.lit(0), F.col("c_custkey").cast("int"), [("_customer.id", F.col("c_custkey")), ("_customer.segment", segment)], 1)

    c = _t(s, d, "customer")
    first = ingest(cells(c.where("c_mktsegment <> 'BUILDING'"), "one", F.col("c_mktsegment")), shop_schema())
    both = ingest(cells(c, "two", F.lit("NEW")), into=first)
    return both.tables["customer"].select(F.col("id").cast("long").alias("c_custkey"), "segment")


def _segments(s: SparkSession, d: str):
    """Nations as customers of one key in a block for each segment: rows of several blocks merge."""
    rows = _t(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c"))
    cells = cells_of(rows, F.ascii("c_mktsegment"), F.col("c_mktsegment"), F.lit(0), F.col("c_nationkey").cast("int"), [("_customer.id", F.col("c_nationkey")), ("_customer.segment", F.col("c_mktsegment"))], 1)
    return ingest(cells, shop_schema())


def conflicts_loaded(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).problems.select("kind", "table_name", "column_name", "detail")


def presence_loaded(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).infra["tag_presence"].select("block_id", "table_name", "column_name", "pk_json")


def loop_groups(s: SparkSession, d: str) -> DataFrame:
    """Where each table begins in each block."""
    return _shop(s, d).infra["loop_groups"].select("block_id", "table_name", F.col("loop_id").cast("long").alias("loop_id"), F.col("event_pos").cast("long").alias("event_pos"))


def block_positions(s: SparkSession, d: str) -> DataFrame:
    return _shop(s, d).infra["block_order"].select("block_id", F.col("position").cast("long").alias("position"))


def deprecated_tags(s: SparkSession, d: str) -> DataFrame:
    """A problem for each block that uses a deprecated tag."""
    schema = shop_schema()
    schema.deprecated_ids, schema.deprecated_replacements = {"_order.priority"}, {"_order.priority": ["_order.note"]}
    return ingest(shop_cells(s, d), schema).problems.select("kind", "block_id", "detail")


def mixed_loop(s: SparkSession, d: str) -> DataFrame:
    """A loop over categories with different keys goes to the fallback whole, and each value knows its table."""
    schema = _schema(_table("a", "Loop", [_column("a", "id")], ["id"]), _table("b", "Loop", [_column("b", "code")], ["code"]))
    data = ingest(_part_cells(s, d, ("_a.id", F.col("p_partkey")), ("_b.code", F.col("p_brand"))), schema)
    return data.infra["fallback"].select("tag", "value", "ref_table")


def dataset_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks of one dataset and those of none."""
    c = _t(s, d, "customer").where("c_mktsegment IS NOT NULL")
    block, none = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit(None).cast("int")
    names = cells_of(c, F.col("c_custkey"), block, none, F.lit(0), [("_customer.id", F.col("c_custkey"))], 0)
    sets = cells_of(c.where("c_mktsegment <> 'MACHINERY'"), F.col("c_custkey"), block, none, F.lit(0), [("_audit_dataset.id", F.col("c_mktsegment"))], 1)
    return select_blocks(names.unionByName(sets), "BUILDING").select("block_id", "tag", "value")


# ---- typed copies, checks, output


def _prices(s: SparkSession, d: str):
    """Parts with prices: some with an uncertainty, some that aren't numbers."""
    plain = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    price = F.when(F.col("p_size") % 3 == 0, F.concat(plain, F.lit("(2)"))).when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise(plain)
    schema = _schema(_table("part", "Loop", [_column("part", "id", "Integer"), _column("part", "price", "Real")], ["id"]))
    return ingest(_part_cells(s, d, ("_part.id", F.col("p_partkey")), ("_part.price", price)), schema)


def cast_losses(s: SparkSession, d: str) -> DataFrame:
    """All that typed copies lose."""
    return convert_database(_prices(s, d))[0]["_losses"]


def typed_prices(s: SparkSession, d: str) -> DataFrame:
    return convert_database(_prices(s, d))[0]["part"].select(F.col("id").alias("p_partkey"), "price")


def container_checks(s: SparkSession, d: str) -> DataFrame:
    """Lists of a wrong length, and places in them of a wrong kind."""
    pair = _column("part", "pair", "Integer", type_dimension="[2]")
    pair.type_container = "List"
    size = F.col("p_size").cast("string")
    stored = F.concat(F.lit('\x00["'), size, F.lit('","'), size, F.when(F.col("p_size") % 2 == 0, F.lit('"]')).otherwise(F.concat(F.lit('","'), F.col("p_brand"), F.lit('"]'))))
    value = F.when(F.col("p_size") % 5 == 0, size).otherwise(stored)
    data = ingest(_part_cells(s, d, ("_part.id", F.col("p_partkey")), ("_part.pair", value)), _schema(_table("part", "Loop", [_column("part", "id", "Integer"), pair], ["id"])))
    return validate_database(data).groupBy("check_name", "severity", "column_name").agg(F.count(F.lit(1)).alias("n"))


def _read_again(blocks: DataFrame, head: str, tags: dict[str, str]) -> DataFrame:
    cells = cells_of_texts(blocks.select(F.col("name").alias("source"), F.concat(F.lit(head), "text").alias("content")))
    return cells.groupBy("source", "iter_idx").agg(*(F.max(F.when(F.col("tag") == tag, F.col("value"))).alias(name) for tag, name in tags.items())).drop("source", "iter_idx")


def emit_version_1(s: SparkSession, d: str) -> DataFrame:
    """Written in version 1.1 and read again."""
    schema = _schema(_table("part", "Loop", [_column("part", "id", "Integer"), _column("part", "name")], ["id"]))
    data = ingest(_part_cells(s, d, ("_part.id", F.col("p_partkey")), ("_part.name", F.concat("p_name", F.lit("'s \"x\" [1]")))), schema)
    out = _read_again(emit_blocks(data, mode=EmitMode.ONE_BLOCK, version=V1), "#\\#CIF_1.1\n", {"_part.id": "p_partkey", "_part.name": "name"})
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), "name")


def emit_uncertainties(s: SparkSession, d: str) -> DataFrame:
    """Uncertainties loaded into their own column, and written back behind their numbers."""
    su = _column("part", "price_su", "Real", is_su=True, linked_item_id="_part.price")
    schema = _schema(_table("part", "Loop", [_column("part", "id", "Integer"), _column("part", "price", "Real"), su], ["id"]))
    price = F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
    data = ingest(_part_cells(s, d, ("_part.id", F.col("p_partkey")), ("_part.price", price)), schema)
    out = _read_again(emit_blocks(data, mode=EmitMode.ONE_BLOCK, reconstruct_su=True), "#\\#CIF_2.0\n", {"_part.id": "p_partkey", "_part.price": "price"})
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), "price")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    cif_quoting_styles, cif11_quotes, cif_containers, cif_save_frames, cif_two_loops, cif_events, cif_versions, clean_texts, su_merge, canonical_reals, quote_cif11,
    table_keys, uuid_values, resolve_tags, schema_links, alias_load, siblings_share_keys, stub_parents_loaded, stub_parents_composite, keyless_rows, reload_keeps_old,
    conflicts_loaded, presence_loaded, loop_groups, block_positions, deprecated_tags, mixed_loop, dataset_blocks, cast_losses, typed_prices, container_checks,
    emit_version_1, emit_uncertainties,
)}


def _literals(rows: list[tuple], names: str) -> str:
    def text(x: object) -> str:
        return str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


_NAMES = "p_partkey, p_name AS text, '{}' AS value_type FROM part"
_CELL = "SELECT p_partkey, {}::INTEGER AS frame_idx, {} AS frame_name, {}::INTEGER AS loop_idx, {}::INTEGER AS iter_idx, '{}' AS tag, {} AS value FROM part"
_LOOP = "SELECT p_partkey, {}::INTEGER AS loop_idx, {}::INTEGER AS iter_idx, '{}' AS tag, {}::INTEGER AS col_index, {} AS value FROM part"
_KEY, _SIZE, _PRICE = "p_partkey::VARCHAR", "p_size::VARCHAR", "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)"
_LIST = "CASE WHEN regexp_matches(p_name, '\\s') THEN '''' || p_name || '''' ELSE p_name END"
_NATIONS = "SELECT c_nationkey, c_mktsegment FROM customer GROUP BY ALL"
ORACLE_SQL = {
    "cif_quoting_styles": "SELECT p_partkey, p_partkey::VARCHAR AS text, 'string' AS value_type FROM part" + "".join(" UNION ALL SELECT " + _NAMES.format(x) for x in ("single", "double", "triple_single", "triple_double", "multiline")),
    "cif11_quotes": "SELECT p_partkey, 'it''s ' || p_brand AS x, 'x[' || p_size || ']' AS y FROM part",
    "cif_containers": f"""SELECT p_partkey, '["' || p_partkey || '",["' || p_name || '","' || p_brand || '"],{{"k":"' || p_size || '"}}]' AS stored, '[' || p_partkey || ' [' || {_LIST} || ' ' || p_brand || '] {{''k'':' || p_size || '}}]' AS token, p_partkey || '|' || p_name || '|' || p_brand || '|' || p_size AS leaves FROM part""",
    "cif_save_frames": " UNION ALL ".join([
        _CELL.format("NULL", "NULL", "NULL", 0, "_a.x", _KEY), _CELL.format("NULL", "NULL", "NULL", 0, "_c.z", _SIZE), _CELL.format(0, "'f1'", "NULL", 0, "_a.x", f"'f' || {_KEY}"),
        _CELL.format(1, "'f2'", 0, 0, "_b.x", "'1'"), _CELL.format(1, "'f2'", 0, 0, "_b.y", _KEY), _CELL.format(1, "'f2'", 0, 1, "_b.x", "'3'"), _CELL.format(1, "'f2'", 0, 1, "_b.y", _SIZE),
    ]),
    "cif_two_loops": " UNION ALL ".join([
        _LOOP.format(0, 0, "_a.x", 0, _KEY), _LOOP.format(0, 0, "_a.y", 1, "'2'"), _LOOP.format(0, 1, "_a.x", 0, "'3'"), _LOOP.format(0, 1, "_a.y", 1, "'4'"),
        _LOOP.format(1, 0, "_b.x", 0, _SIZE), _LOOP.format("NULL", 0, "_c.z", "NULL", _KEY),
    ]),
    "cif_events": "SELECT e AS event, n FROM (SELECT unnest(['on_data_block', 'on_loop_start', 'on_loop_end', 'add_value']) AS e, unnest([t, t, t, 2 * n]) AS n FROM (SELECT count(DISTINCT p_partkey // 100) AS t, count(*) AS n FROM part))",
    "cif_versions": _literals(BEGINNINGS, "begins, version"),
    "clean_texts": f"SELECT p_partkey, '_a.x' AS tag, {_KEY} AS value FROM part UNION ALL SELECT p_partkey, '_b.i', {_KEY} FROM part UNION ALL SELECT p_partkey, '_b.j', p_brand FROM part",
    "su_merge": "SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR || '.25(' || l_linenumber || ')' AS v FROM lineitem",
    "canonical_reals": "SELECT l_orderkey, l_linenumber, l_linenumber || '.50' AS a, (l_linenumber * 100 + 50)::VARCHAR AS b, l_linenumber || '.5' AS c, 'n/a' AS e FROM lineitem",
    "quote_cif11": "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\s') THEN '''' || p_name || '''s''' ELSE p_name || '''s' END AS tok FROM part",
    "table_keys": "SELECT doc_id, NOT contains(text, chr(10)) AND (NOT contains(text, chr(13)) AND (NOT contains(text, '''') OR NOT contains(text, '\"')) OR NOT contains(text, '''''''') AND NOT ends_with(text, '''') OR NOT contains(text, '\"\"\"') AND NOT ends_with(text, '\"')) AS fits FROM documents",
    "uuid_values": "SELECT s_suppkey, s_suppkey % 2 = 0 AS ok, TRUE AS again FROM supplier",
    "resolve_tags": _literals(RESOLVED, "tag, definition, category, object, was_alias, deprecated"),
    "schema_links": _literals([("link", "box", "shelf_id", "shelf.id"), ("su", "box", "weight", "box.weight_su"), ("order", "shelf", "0", ""), ("order", "box", "1", ""), ("below", "shelf", "shelf", ""), ("below", "shelf", "box", "")], "what, table_name, column_name, target"),
    "alias_load": "SELECT 'top' AS shelf_id, p_partkey AS id, p_size || '.5' AS weight, '0.2' AS weight_su FROM part",
    "siblings_share_keys": "SELECT p_partkey, p_brand FROM part",
    "stub_parents_loaded": "SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "stub_parents_composite": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN max(l_returnflag) END AS mode FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "keyless_rows": "SELECT row_number() OVER (ORDER BY event_id) AS n, COALESCE(user_id::VARCHAR, '?') AS user_id, COALESCE(event_type, '?') AS event_type FROM events",
    "reload_keeps_old": "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'NEW' END AS segment FROM customer",
    "conflicts_loaded": f"SELECT 'merge_conflict' AS kind, 'customer' AS table_name, 'segment' AS column_name, 'table customer, key ' || c_nationkey || ': several values of segment; the first stays' AS detail FROM ({_NATIONS}) GROUP BY c_nationkey HAVING count(*) > 1",
    "presence_loaded": f"""SELECT c_mktsegment AS block_id, 'customer' AS table_name, 'segment' AS column_name, '["' || c_nationkey || '"]' AS pk_json FROM ({_NATIONS}) QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 1""",
    "loop_groups": "SELECT DISTINCT 'c' || o_custkey AS block_id, 'customer' AS table_name, NULL::BIGINT AS loop_id, 0::BIGINT AS event_pos FROM orders UNION ALL SELECT DISTINCT 'c' || o_custkey, 'order', 0, 1 FROM orders",
    "block_positions": "SELECT DISTINCT 'c' || o_custkey AS block_id, o_custkey AS position FROM orders",
    "deprecated_tags": "SELECT DISTINCT 'deprecated_tag' AS kind, 'c' || o_custkey AS block_id, 'block c' || o_custkey || ': tag _order.priority is deprecated; use _order.note' AS detail FROM orders",
    "mixed_loop": f"SELECT '_a.id' AS tag, {_KEY} AS value, 'a' AS ref_table FROM part UNION ALL SELECT '_b.code', p_brand, 'b' FROM part",
    "dataset_blocks": "SELECT 'c' || c_custkey AS block_id, '_customer.id' AS tag, c_custkey::VARCHAR AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'c' || c_custkey, '_audit_dataset.id', c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "cast_losses": f"SELECT DISTINCT 'lost_uncertainty' AS kind, 'part' AS table_name, 'price' AS column_name, {_PRICE} || '(2)' AS value FROM part WHERE p_size % 3 = 0 UNION ALL SELECT DISTINCT 'cast_failure', 'part', 'price', p_brand FROM part WHERE p_size % 3 = 1",
    "typed_prices": f"SELECT p_partkey::INTEGER AS p_partkey, CASE WHEN p_size % 3 <> 1 THEN CAST({_PRICE} AS DOUBLE) END AS price FROM part",
    "container_checks": "SELECT * FROM (SELECT unnest(['type_container', 'type_dimension', 'type_contents']) AS check_name, 'Error' AS severity, 'pair' AS column_name, unnest([a, b, b]) AS n FROM (SELECT count(*) FILTER (WHERE p_size % 5 = 0) AS a, count(*) FILTER (WHERE p_size % 5 <> 0 AND p_size % 2 = 1) AS b FROM part)) WHERE n > 0",
    "emit_version_1": "SELECT p_partkey, p_name || '''s \"x\" [1]' AS name FROM part",
    "emit_uncertainties": f"SELECT p_partkey, {_PRICE} || '(' || p_size || ')' AS price FROM part",
}
