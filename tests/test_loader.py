"""Loading, output, conversion, checks and comparison on small schemas."""

import io
import json

import pytest
from pyspark.sql import functions as F

from quasilattice import inspection
from quasilattice.functions.values import encode_container
from quasilattice.operators import relational as R
from quasilattice.operators.convert import convert_database, generate_defaults
from quasilattice.operators.emit import _Renderer, align_decimals, emit, emit_blocks, emit_pieces, pack_tokens
from quasilattice.operators.fidelity import check_fidelity
from quasilattice.operators.ingest import Dataset, IngestionError, ingest
from quasilattice.operators.storage import dealt
from quasilattice.operators.validate import container_problems, parse_dimension, parse_range, validate
from quasilattice.plans.output import BlockSpec, EmitMode, OutputPlan, accepted, all_of, any_of, has, namer, only
from quasilattice.plans.schema import BLOCK, ID, ROW, Column, ForeignKey, Schema, Table
from quasilattice.sources.cells import CifDataSource, build_arrow, cell_batches, cells_frame, cells_of_texts, errors_of_texts, events_of_texts, read_cells
from quasilattice.plans.text_queries import shop_schema
from quasilattice.sources.clean import clean_cells
from quasilattice.sources.model import build
from quasilattice.streaming.directory import DatasetStore, merge_batch, stream_into

V2 = "#\\#CIF_2.0\n"


def col(table, name, contents="Text", container="Single", **more):
    return Column(name, f"_{table}.{name}", contents, container, **more)


def table(name, kind, columns, keys, *links):
    head = [Column(BLOCK, is_synthetic=True), *([Column(ID, is_synthetic=True)] if not keys and kind == "Set" else []), Column(ROW, is_synthetic=True)]
    for c in columns:
        c.is_primary_key = c.name in keys
    return Table(name, name, kind, head + columns, list(keys) or ([ID] if kind == "Set" else [BLOCK, ROW]), list(links))


def schema(*tables, **more):
    return Schema(tables={t.name: t for t in tables}, column_to_tag={(t.name, c.name): c.definition_id for t in tables for c in t.columns if c.definition_id}, **more)


def crystal(**more):
    return schema(
        table("structure", "Set", [col("structure", "id")], ["id"]),
        table("cell", "Set", [col("cell", "structure_id"), col("cell", "a", "Real"), col("cell", "a_su", "Real", linked_item_id="_cell.a", is_su=True)], ["structure_id"], ForeignKey("cell", ("structure_id",), "structure", ("id",))),
        table("atom", "Loop", [col("atom", "label"), col("atom", "structure_id"), col("atom", "x", "Real"), col("atom", "x_su", "Real", linked_item_id="_atom.x", is_su=True), col("atom", "n", "Integer")], ["label"], ForeignKey("atom", ("structure_id",), "structure", ("id",))),
        table("aniso", "Loop", [col("aniso", "label"), col("aniso", "u", "Real")], ["label"], ForeignKey("aniso", ("label",), "atom", ("label",))),
        table("notes", "Loop", [col("notes", "text")], []),
        table("props", "Set", [col("props", "name"), col("props", "hkl", "Integer", "List")], []),
        alias_to_definition_id={"_atom.old_x": "_atom.x"}, deprecated_ids={"_atom.n"}, deprecated_replacements={"_atom.n": ["_atom.m"]}, **more)


TEXT = V2 + """data_a
_structure.id S1
_cell.a 10.5(3)
_props.name hello
_props.hkl [1 2 x]
_unknown.tag [1 {'k':v}]
loop_
_atom.label
_atom.old_x
_aniso.u
A1 0.1(2) 1
A2 . 2
loop_
_notes.text
n1 n2
loop_
_un.a _un.b
1 2
data_b
_cell.a 7
loop_
_atom.label
_atom.x
_atom.n
A1 0.7 5
B1 ? 1.5
loop_
_aniso.u
_notes.text
mixed one
"""


@pytest.fixture(scope="module")
def loaded(spark):
    cif, errors = build(TEXT)
    assert not errors
    return ingest(cif, crystal(), spark=spark)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_routing_propagation_and_merge(loaded):
    t = loaded.tables
    s2 = t["cell"].where("a = '7'").first()["structure_id"]
    assert rows(t["structure"], "id") == sorted([("S1",), (s2,)], key=str) and len(s2) == 36
    assert rows(t["cell"], "a", "a_su") == [("10.5", "0.3"), ("7", None)]
    atoms = {r["label"]: r for r in t["atom"].collect()}
    assert (atoms["A1"]["x"], atoms["A1"]["x_su"], atoms["A1"]["structure_id"], atoms["A1"]["n"], atoms["A1"][BLOCK]) == ("0.1", "0.2", "S1", "5", "a")
    assert (atoms["A2"]["x"], atoms["B1"]["x"], atoms["B1"]["structure_id"]) == (".", "?", s2)
    assert rows(t["aniso"], "label", "u") == [("A1", "1"), ("A2", "2")]  # the loop's row gives the key
    assert rows(t["notes"], "text", ROW) == [("n1", 1), ("n2", 2)] and t["props"].count() == 1


def test_infrastructure(loaded):
    i = loaded.infra
    fallback = rows(i["fallback"], "block_id", "tag", "value_type", "ref_table")
    assert ("a", "_unknown.tag", "list", None) in fallback and ("b", "_notes.text", "string", "notes") in fallback and len(fallback) == 5
    assert rows(i["block_order"], "block_id", "position") == [("a", 0), ("b", 1)]
    presence = rows(i["tag_presence"], "block_id", "table_name", "column_name", "pk_json")
    assert ("b", "atom", "x", '["A1"]') in presence and ("a", "atom", "x_su", '["A1"]') in presence and all("A1" in p[3] for p in presence)
    counts = {(r["table_name"], r["column_name"]): r["n"] for r in i["metatable"].collect()}
    assert counts["atom", "x"] == 3 and counts["atom", "n"] == 2
    text = "\n".join(loaded.messages)
    assert "deprecated; use _atom.m" in text and "different keys" in text and "several values of x" in text


def test_partitions_do_not_matter(spark, loaded):
    cells = cells_frame(spark, build(TEXT)[0])
    again = ingest(cells.repartition(9), crystal(), spark=spark)
    for t, df in loaded.tables.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, again.tables[t].collect()))


def test_loading_again_fills_gaps_and_keeps_values(spark, loaded):
    more = build(V2 + "data_c\n_structure.id S1\nloop_\n_atom.label\n_atom.x\n_atom.n\nA1 9 9\nA2 . 4\nC1 1 1\n")[0]
    both = ingest(more, into=loaded)
    atoms = {r["label"]: (r["x"], r["n"]) for r in both.tables["atom"].collect()}
    assert atoms == {"A1": ("0.1", "5"), "A2": (".", "4"), "B1": ("?", "1.5"), "C1": ("1", "1")}
    assert rows(both.infra["block_order"], "block_id", "position")[-1] == ("c", 2) and both.tables["notes"].count() == 2


@pytest.mark.parametrize("mode", [EmitMode.ORIGINAL, EmitMode.GROUPED, EmitMode.ONE_BLOCK])
def test_written_text_loads_the_same(spark, loaded, mode):
    text = emit(loaded, mode=mode)
    cif, errors = build(text)
    assert not errors
    again = ingest(cif, crystal(), spark=spark)
    for t in ("atom", "aniso", "cell", "structure"):
        names = [c for c in loaded.schema.tables[t].data if c in loaded.tables[t].columns]
        known = lambda df: sorted(str([None if r[n] == "?" else r[n] for n in names]) for r in df.collect())
        assert known(loaded.tables[t]) == known(again.tables[t])
    if mode is EmitMode.ORIGINAL:
        assert text.index("data_a") < text.index("data_b") and again.infra["fallback"].count() == loaded.infra["fallback"].count()


def test_all_blocks_refuses_what_it_cannot_split(spark, loaded):
    with pytest.raises(ValueError, match="unknown tags"):
        emit(loaded, mode=EmitMode.ALL_BLOCKS)
    keyed = Dataset(spark, loaded.schema, {t: df for t, df in loaded.tables.items() if t != "props"}, loaded.infra | {"fallback": loaded.infra["fallback"].limit(0)})
    assert sorted(b.name.split("_")[0] for b in build(emit(keyed, mode=EmitMode.ALL_BLOCKS))[0].blocks) == ["aniso", "atom", "cell", "cell", "notes", "structure", "structure"]


def test_typed_copies(loaded):
    tables, messages = convert_database(loaded)
    assert {r["label"]: r["n"] for r in tables["atom"].collect()} == {"A1": 5, "A2": None, "B1": 2} and dict(tables["atom"].dtypes)["x"] == "double"
    assert json.loads(tables["props"].first()["hkl"]) == [1, 2, None] and "_loop_groups" in tables
    assert messages == []
    with pytest.raises(ValueError):
        convert_database(loaded, "maybe")


def test_defaults(spark):
    s = schema(
        table("kind", "Loop", [col("kind", "id"), col("kind", "class")], ["id"]),
        table("thing", "Loop", [col("thing", "id"), col("thing", "kind_id"), col("thing", "colour", enumeration_def_index_ids=["_kind.class"], enumeration_defaults=[["metal", "grey"], ["plant", "green"]], enumeration_default="none"), col("thing", "shade", enumeration_def_index_ids=["_thing.colour"], enumeration_defaults=[["green", "dark"]])], ["id"], ForeignKey("thing", ("kind_id",), "kind", ("id",))))
    data = ingest(build(V2 + "data_x\nloop_ _kind.id _kind.class k1 metal k2 plant\nloop_ _thing.id _thing.kind_id t1 k1 t2 k2\ndata_y\nloop_ _thing.id t3\n")[0], s, spark=spark, propagate_fk=False)
    assert generate_defaults(data) == 4
    assert rows(data.tables["thing"], "id", "colour", "shade") == [("t1", "grey", None), ("t2", "green", "dark"), ("t3", "none", None)]
    assert generate_defaults(data) == 0


def test_checks(spark):
    s = schema(table("v", "Loop", [col("v", "id", "Code"), col("v", "n", "Integer", enumeration_range="0:10"), col("v", "s", "Code", enumeration_states=["Yes", "No"]), col("v", "m", "Real", "Matrix", type_dimension="[2,2]"), col("v", "w", "Word")], ["id"]), table("p", "Set", [col("p", "x")], []))
    text = V2 + "data_x\n_p.x 1\n_q.y 2\nloop_ _v.id _v.n _v.s _v.m _v.w\na 5 yes [[1 2][3 4]] ok\nb 11 maybe [[1 2][3]] 'not ok'\nc x . 7 [1]\nd ? ? [[1 2][3 z]] .\n_bad\n"
    report = validate(text, s, spark=spark)
    got = {(r["check_name"], r["column_name"], r["value"] if r["value"] and r["value"][0] != "\0" else None) for r in report.issues.collect()}
    assert not report.passed
    assert {("enumeration_range", "n", "11"), ("type_contents", "n", "x"), ("enumeration_states", "s", "maybe"), ("type_contents", "w", "not ok"), ("type_container", "m", "7"), ("type_container", "w", None), ("type_dimension", "m", None), ("type_contents", "m", None), ("unknown_tag", None, None), ("parse", None, None)} <= got
    assert validate(V2 + "data_x\n_p.x 1\n", s, spark=spark).passed


def test_check_parts():
    assert parse_dimension("[3,4]") == [3, 4] and parse_dimension("[]") == [] and parse_dimension("x") is None
    assert parse_range("0:") == (0.0, None) and parse_range("-1.5:2e1") == (-1.5, 20.0) and parse_range(None) == (None, None)
    c = col("v", "x", "Integer", "List", enumeration_range="0:5")
    assert container_problems(encode_container(["1", None, "."]), c) == [] and [p[0] for p in container_problems(encode_container(["1", None]), c, True)] == ["null_leaf"]
    assert [p[0] for p in container_problems(encode_container(["9"]), c)] == ["enumeration_range"]
    assert container_problems("\0{", c)[0][0] == "type_container"


def test_datasets_are_chosen(spark):
    text = V2 + "data_a\n_audit_dataset.id d1\n_atom.label A\ndata_b\n_audit_dataset.id d2\n_atom.label B\ndata_c\n_atom.label C\n"
    cells = cells_frame(spark, build(text)[0])
    with pytest.raises(IngestionError):
        ingest(cells, crystal())
    data = ingest(cells, crystal(), dataset_id="d1")
    assert rows(data.tables["atom"], "label") == [("A",), ("C",)] and rows(data.infra["membership"], "block_id", "dataset_id") == [("a", "d1")]


def test_without_schema_all_goes_to_the_fallback(spark):
    data = ingest(build(TEXT)[0], spark=spark)
    assert not data.tables and data.infra["fallback"].count() == sum(len(v) for b in build(TEXT)[0].blocks for v in b.values.values())


def test_comparison(spark):
    assert check_fidelity(TEXT, TEXT, crystal(), spark=spark).passed
    other = TEXT.replace("0.1(2)", "0.10(2)").replace("_un.a", "_vn.a").replace("data_b\n", "data_z\n").replace("10.5(3)", "1.05e1(3)")
    kinds = {(m["kind"], m["side"], m["table_name"]) for m in check_fidelity(TEXT, other, crystal(), spark=spark).mismatches}
    assert kinds == {("row_content", "a", "atom"), ("row_content", "b", "atom"), ("fallback_mismatch", "a", None), ("fallback_mismatch", "b", None)}
    assert {m["kind"] for m in check_fidelity(TEXT, TEXT + "_x\n", crystal(), spark=spark).mismatches} == {"parse_error"}


def render(data, text_rows, **more):
    options = {"plan": OutputPlan(), "mode": EmitMode.GROUPED, "version": "2.0", "reconstruct_su": False, "pretty": True, "line_limit": 2048} | more
    return _Renderer(data, **options).render("k", text_rows)


def test_layout():
    s = crystal()
    body = [("cell", "1", None, {"structure_id": "S", "a": "10.5", "a_su": "0.3"}), ("structure", "0", None, {"id": "S"}), ("atom", "2", 0, {"label": "A", "structure_id": "S", "x": "1.25"}), ("atom", "3", 0, {"label": "B", "structure_id": "S", "x": "-10.5"}), ("aniso", "4", 0, {"label": "B", "u": "2"}), ("aniso", "5", 0, {"label": "C", "u": "3"})]
    import copy

    _, name, text = render(s, copy.deepcopy(body), reconstruct_su=True)
    assert name == "cell_structure_id_S_structure_id_S" and "10.5(3)" in text and "_cell.structure_id" not in text and "A   1.25" in text and "B -10.5" in text
    plan = OutputPlan([BlockSpec(matches=all_of("cell", "structure"), category_order=[["atom", "aniso"], "structure"], column_order={"atom": ["x"]}, block_namer=namer("structure.id", prefix="p_"))])
    spec, name, text = render(s, copy.deepcopy(body), plan=plan)
    assert (spec, name) == (0, "p_S") and text.index("_atom.x") < text.index("_atom.label") < text.index("_structure.id") and "C" in text
    with pytest.raises(ValueError):
        render(s, copy.deepcopy(body), version="1.1", plan=OutputPlan(block_namer=lambda a: "x" * 80))


def test_unknown_columns_stay_in_their_loop(spark):
    text = V2 + "data_x\nloop_ _atom.label _new.tag _atom.x\nA n1 1\nB n2 2\n"
    data = ingest(build(text)[0], crystal(), spark=spark)
    again = build(emit(data))[0]["x"]
    assert set(again.loops[0]) >= {"_atom.label", "_new.tag", "_atom.x"} and again["_new.tag"] == ["n1", "n2"]
    one = emit(Dataset(spark, crystal(dictionary_title="T", dictionary_version="1"), data.tables, data.infra), mode=EmitMode.ONE_BLOCK)
    assert build(one)[0]["output"]["_audit_conform.dict_name"] == ["T"]


def fallback_of(text, **more):
    """The multiset of (tag, value) of all blocks of a text."""
    from collections import Counter

    cif, errors = build(text)
    assert not errors, errors
    return Counter((tag, str(v)) for b in cif.blocks for tag, values in b.values.items() for v in values)


@pytest.mark.parametrize("mode", [EmitMode.ORIGINAL, EmitMode.GROUPED, EmitMode.ONE_BLOCK])
def test_no_unknown_value_is_lost(spark, mode):
    """Equal tags in several blocks, a tag twice in one block, loops of several blocks with equal, shared and other tags, and
    unknown tags in a known loop."""
    one = V2 + "data_a\n_u.s one\nloop_ _u.a _u.b 1 2 3 4\nloop_ _w.x _w.y 1 2\n_u.once 1\nloop_ _atom.label _new.tag A n1 B n2\n"
    two = "data_b\n_u.s two\nloop_ _u.a _u.b 5 6 7 8\nloop_ _w.y _w.z 3 4\nloop_ _atom.label _new.tag C n3\ndata_c\n_u.s one\n_u.a 9\n"
    cif, _ = build(one + two)
    text = emit(ingest(cif, crystal(), spark=spark), mode=mode)
    got = fallback_of(text)
    assert got == fallback_of(one + two)
    twice = ingest(build(V2 + "data_x\n_u.s one\n_u.s two\n_u.t 1\n")[0], spark=spark)
    assert fallback_of(emit(twice, mode=mode)) == {("_u.s", "one"): 1, ("_u.s", "two"): 1, ("_u.t", "1"): 1}


def test_plans_merge_and_attach(spark):
    text = V2 + "data_a\n_structure.id S1\n_cell.a 1\ndata_b\n_structure.id S2\n_cell.a 2\ndata_c\nloop_ _notes.text p q\n"
    data = ingest(build(text)[0], crystal(), spark=spark)
    whole = emit(data, mode=EmitMode.GROUPED, plan=OutputPlan([BlockSpec(has("cell"), single_block=True, block_namer=lambda a: "all")]))
    blocks = build(whole)[0]
    assert [b.name for b in blocks.blocks] == ["all", "c"] and blocks["all"]["_cell.structure_id"] == ["S1", "S2"]
    joined = build(emit(data, mode=EmitMode.GROUPED, plan=OutputPlan([BlockSpec(has("cell")), BlockSpec(has("notes"), attach_to=any_of("structure"))])))[0]
    assert len(joined.blocks) == 2 and [b.get("_notes.text") for b in joined.blocks].count(["p", "q"]) == 1
    with pytest.warns(UserWarning, match="stands alone"):
        emit(data, mode=EmitMode.GROUPED, plan=OutputPlan([BlockSpec(has("notes"), attach_to="no_such")]))


def test_matchers_and_names():
    a, t = frozenset({"cell"}), frozenset({"cell", "atom"})
    assert only("cell")(a, t) and not only("cell", "x")(a, t) and any_of("x", "cell")(a, t) and has("atom")(a, t) and not has("atom").excluding("cell")(a, t)
    assert (all_of("x") | has("atom"))(a, t) and not (all_of("x") & has("atom"))(a, t)
    assert OutputPlan([BlockSpec("x"), BlockSpec({"cell"}), BlockSpec()]).match(a, t) == 1
    assert BlockSpec({"cell"}).accepts({"cell", "x"}, t) and not BlockSpec({"cell", "y"}).accepts({"cell", "x"}, t)  # all of them, not only them
    assert namer("x.id", "y.id")({"x.id": ["1", "2"]}) == "1_?" and namer("a", "b", sep="-", suffix="!")({"b": ["2"], "a": ["1"]}) == "1-2!"
    assert namer("z", prefix="p_", fallback="f")({}) == "p_f" and namer(prefix="p")({"a": ["1"]}) == "p"


def test_conditions_on_columns_equal_those_on_sets(spark):
    """Every condition, over all subsets of three names."""
    import itertools

    names = ["a", "b", "c"]
    subsets = [list(x) for n in range(4) for x in itertools.combinations(names, n)]
    places = [(a, t) for a in subsets for t in subsets if set(a) <= set(t)]
    df = spark.createDataFrame(places, "anchors array<string>, tables array<string>")
    given = [None, "a", {"a", "b"}, set(), only("a"), any_of("a", "b"), all_of("a", "c"), has("b"), has("a").excluding("c"), only("a") | has("c") & all_of("b"), (any_of("a") | any_of("b")).excluding("c").excluding("b"), lambda a, t: len(t) > len(a)]
    got = df.select(*(accepted(g, F.col("anchors"), F.col("tables")).alias(f"g{i}") for i, g in enumerate(given))).collect()
    for i, g in enumerate(given):
        assert [r[f"g{i}"] for r in got] == [BlockSpec(g).accepts(frozenset(a), frozenset(t)) for a, t in places]


def test_specs_matched_by_plan():
    a, t = frozenset({"cell"}), frozenset({"cell", "atom"})
    assert OutputPlan([BlockSpec(lambda a, t: "atom" not in t)]).match(a, t) is None
    with pytest.raises(ValueError):
        BlockSpec(single_block=True, attach_to="x")


def test_lines():
    assert align_decimals(["1e5", "12.25(3)", ".", "-0.5"]) == [" 1e5", "12.25(3)", ".", "-0.5"]
    assert pack_tokens(["aa", "bb", "\n;x\ny\n;", "cc"], 5) == ["aa bb", ";x", "y", ";", "cc"]


def test_cells_of_files(spark, tmp_path):
    (tmp_path / "one.cif").write_text(TEXT)
    (tmp_path / "two.cif").write_text(V2 + "data_q\n_a 1\n_a 2\n9\ndata_Q\n_b 1\nloop_ _l _m 1 2 ? ?\n")
    cells = read_cells(spark, str(tmp_path / "*.cif"))
    assert cells.select("source").distinct().count() == 2 and cells.where("tag = '_atom.label'").count() == 4
    two = clean_cells(cells.where(F.col("source").endswith("two.cif")))
    assert rows(two, "block_id", "tag", "value") == [("q", "_a", "1")]
    if CifDataSource is not None:
        spark.dataSource.register(CifDataSource)
        assert spark.read.format("cif").load(str(tmp_path)).count() == cells.count()
    texts = spark.createDataFrame([("s", "data_x\n_a [\n"), ("t", None)], "source string, content string")
    assert rows(errors_of_texts(texts), "source", "code") == [("s", "illegal-start")] and cells_of_texts(texts).count() == 1
    assert [r["event"] for r in events_of_texts(texts).orderBy("pos").collect()] == ["on_data_block", "add_tag", "on_error", "add_value"]
    batches, errors = build_arrow(TEXT)
    assert len(batches) == 7 and not errors and batches[0].schema.names[:2] == ["_block_id", "_block_idx"]


def test_streamed_files_are_merged_once(spark, tmp_path):
    source, s = tmp_path / "in", crystal()
    source.mkdir()
    (source / "a.cif").write_text(V2 + "data_a\nloop_ _atom.label _atom.x A 1 B 2\n")
    store = DatasetStore(spark, str(tmp_path / "out"), s)
    stream_into(store, str(source), str(tmp_path / "check")).awaitTermination()
    (source / "b.cif").write_text(V2 + "data_b\nloop_ _atom.label _atom.x B 9 C 3\n")
    stream_into(store, str(source), str(tmp_path / "check")).awaitTermination()
    want = [("A", "1"), ("B", "2"), ("C", "3")]
    assert rows(store.load().tables["atom"], "label", "x") == want and len(store.versions()) == 2
    texts = spark.createDataFrame([("b.cif", (source / "b.cif").read_text())], "source string, content string")
    merge_batch(store, texts, max(store.versions()))  # a batch that is run again
    assert rows(store.load().tables["atom"], "label", "x") == want and len(store.versions()) == 2


def test_relational_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "b", 2), (1, "a", 5), (2, None, 1)], "k int, v string, o int")
    assert rows(R.natural_key_merge(df, ["k"], ["v"], "o"), "k", "v", "o") == [(1, "b", 2), (2, None, 1)]
    assert rows(R.merge_conflicts(df, ["k"], ["v"]), "k") == [(1,)]
    a, b = (spark.createDataFrame(x, "x int") for x in ([(1,), (1,), (2,), (None,)], [(1,), (3,), (None,)]))
    assert rows(R.multiset_difference(a, b), "side", "x") == [("a", 1), ("a", 2), ("b", 3)]
    ids = R.dense_ids(df.withColumn("g", F.when(F.col("k") == 1, "x")).repartition(3), ["g", "o"], "r", 10)
    assert rows(ids, "o", "r") == [(1, 11), (2, 12), (3, 13), (5, 14)]
    assert rows(R.upsert_coalesce(a.selectExpr("x as k", "null as v").dropDuplicates(), b.selectExpr("x as k", "1 as v"), ["k"], ["v"]), "k", "v") == [(1, 1), (2, None), (3, 1), (None, 1)]
    assert R.natural_key_merge(df.limit(0), ["k"], ["v"], "o").count() == 0


def test_views(spark, loaded):
    out = io.StringIO()
    inspection.inspect_lexer(TEXT, file=out)
    inspection.inspect_parse(TEXT, file=out, show_tokens=True)
    inspection.inspect_model(TEXT + "_x\n", file=out)
    inspection.inspect_schema(crystal(), file=out, show_ddl=True)
    text = out.getvalue()
    assert "CREATE TABLE" in text and "loop_start" in text and "missing-value" in text and "Loops without a key from a Set" in text
    assert inspection.fmt_value("x" * 40) == "x" * 15 + " … " + "x" * 5


def counted():
    return schema(table("v", "Loop", [col("v", "id"), col("v", "n", "Integer")], ["id"]))


def test_all_problems_are_kept(spark):
    """More conflicts and lost values than are shown."""
    n = 1100
    loop = lambda k: "loop_\n_v.id\n_v.n\n" + "".join(f"A{i} n{i}.{k}\n" for i in range(n))
    text, s = V2 + "data_a\n" + loop(1) + "data_b\n" + loop(2), counted()
    issues = validate(text, s, spark=spark).issues.where("check_name = 'ingest'").select("detail").collect()
    assert len([r for r in issues if "several values of n" in r["detail"]]) == len(set(issues)) == n
    data = ingest(build(text)[0], s, spark=spark)
    assert data.problems.where("kind = 'merge_conflict' AND column_name = 'n'").count() == n
    assert any(f"{n} in all" in m for m in data.messages) and sum("several values of n" in m for m in data.messages) == 1000
    assert ingest(build(V2 + "data_c\nloop_\n_v.id\n_v.n\nB 1\n")[0], into=data).problems.count() == n
    tables, messages = convert_database(data)
    assert tables["_losses"].where("kind = 'cast_failure'").count() == n and any(f"{n} of cast_failure in all" in m for m in messages)


def test_reports_tell_the_true_number_of_differences(spark, tmp_path):
    one = lambda k: V2 + "data_a\nloop_\n_v.id\n_v.n\n" + "".join(f"A{i} {i}{k}\n" for i in range(150))
    report = check_fidelity(one(1), one(2), counted(), spark=spark, report_file=str(tmp_path / "r.txt"))
    assert report.total == report.frame.count() == 300 and len(report.mismatches) == 200
    assert (tmp_path / "r.txt").read_text().startswith("300 differences (the first 200 are listed)")


def test_small_texts_are_parsed_once_in_full_batches(spark):
    texts = [(str(i), V2 + f"data_d\n_a.x {i}\n_a.x 7\nloop_\n_b.i\n_b.j\n{i} v ? ?\ndata_D\n_a.x other") for i in range(100)] + [("none", None)]
    assert [b.num_rows for b in cell_batches(texts)] == [700]
    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(texts, "source string, content string").mapInArrow(counted, "source string, content string")
    got = sorted((int(r["source"]), r["tag"], r["value"]) for r in clean_cells(cells_of_texts(frame)).collect())
    assert got == sorted(x for i in range(100) for x in ((i, "_a.x", str(i)), (i, "_b.i", str(i)), (i, "_b.j", "v")))
    assert parsed.value == 101  # before: each step read its input twice
    assert dealt(spark.range(3).coalesce(1), "id").rdd.getNumPartitions() >= 2


@pytest.mark.parametrize("mode", [EmitMode.ONE_BLOCK, EmitMode.ALL_BLOCKS, EmitMode.ORIGINAL, EmitMode.GROUPED])
def test_large_blocks_come_in_pieces(spark, mode):
    """The same values as in whole blocks, by block and tag: each piece read alone, and all pieces of a block as one text."""
    text = V2 + "".join(f"data_c{c}\n_customer.id {c}\nloop_\n_order.id\n_order.note\n" + "".join(f"{c}{i} {'.' if i else 'x y'!r}\n" for i in range(9)) for c in range(1, 4))
    text = text.replace("'.'", ".")
    if mode is not EmitMode.ALL_BLOCKS:
        text += "data_u\n_u.a 1\n_u.a 2\nloop_\n_v.x\n_v.y\n" + "".join(f"{i} 'a b'\n" for i in range(11)) + "data_w\nloop_\n_v.x\n_v.y\n1 2\n3 ?\nloop_\n_u.a\n5\n6\n7\n"
    data = ingest(cells_of_texts(spark.createDataFrame([("s", text)], "source string, content string")), shop_schema())
    whole = emit_blocks(data, mode=mode).select(F.col("name").alias("source"), F.concat(F.lit(V2), "text").alias("content"))
    pieces = emit_pieces(data, mode=mode, size=4).cache()
    alone = pieces.select(F.col("name").alias("source"), F.concat(F.lit(V2), "head", "text").alias("content"))
    joined = pieces.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text"))
    joined = joined.select(F.col("name").alias("source"), F.concat(F.lit(V2), "text").alias("content"))
    want = rows(cells_of_texts(whole), "source", "tag", "value")
    assert rows(cells_of_texts(alone), "source", "tag", "value") == want
    assert rows(cells_of_texts(joined), "source", "block_id", "tag", "value") == rows(cells_of_texts(whole), "source", "block_id", "tag", "value")
    assert errors_of_texts(joined).count() == errors_of_texts(whole).count() == errors_of_texts(alone).count() == 0
    assert pieces.where("piece > 0").count() > 2
