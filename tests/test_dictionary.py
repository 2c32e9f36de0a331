"""Dictionaries, schemas and their pictures: without Spark."""

import pytest

from quasilattice.plans.dictionary import DictionaryLoader, directory_path_resolver, directory_resolver, load_dictionary, resolve_tag, save_dictionary
from quasilattice.plans.schema import emit_create_statements, emit_fallback_create_statements, generate_schema, loops_compatible, sibling_groups, topological
from quasilattice.plans.visualise import components, ghost_tables, visualise_schema, visualise_schema_html

HEAD = "#\\#CIF_2.0\ndata_D\n_dictionary.title T\n_dictionary.version 1.0\n"


def frame(name, **tags):
    lines = "\n".join(f"{k} {v}" for k, v in tags.items())
    return f"save_{name}\n{lines}\nsave_\n"


def category(name, kind, parent="D", *keys):
    loop = "loop_\n_category_key.name\n" + "\n".join(f"'{k}'" for k in keys) if keys else ""
    return f"save_{name}\n_definition.id {name}\n_definition.scope Category\n_definition.class {kind}\n_name.category_id {parent}\n_name.object_id {name}\n{loop}\nsave_\n"


def item(cat, obj, extra=""):
    return f"save_{cat}.{obj}\n_definition.id '_{cat}.{obj}'\n_name.category_id {cat}\n_name.object_id {obj}\n{extra}\nsave_\n"


def link(to):
    return f"_type.purpose Link\n_name.linked_item_id '{to}'"


TEXT = HEAD + category("D", "Head", "D") + category("S", "Set", "D", "_s.id") + item("S", "id", "_type.contents Code") + category("A", "Loop", "S", "_a.s_id", "_a.n") + item("A", "s_id", link("_s.id")) + item("A", "n", "_type.contents Integer") + item("A", "x", "_type.contents Real\nloop_\n_alias.definition_id\n'_a.old'\n'_a_older'") + item("A", "x_su", "_type.purpose SU\n_name.linked_item_id '_a.x'") + category("B", "Loop", "S", "_b.s_id", "_b.n") + item("B", "s_id", link("_s.id")) + item("B", "n", link("_a.n")) + item("B", "old", "_definition_replaced.id 1\n_definition_replaced.by '_b.n'") + category("K", "Set") + item("K", "v", "loop_\n_enumeration_set.state\na b") + category("N", "Loop") + item("N", "v") + category("F", "Functions")


def load(text, **more):
    return DictionaryLoader(**more).load(text, base_uri="d.dic")


def test_definitions():
    d = load(TEXT)
    assert (d.title, d.version, set(d.categories)) == ("T", "1.0", {"d", "s", "a", "b", "k", "n", "f"})
    assert d.items["_k.v"].enumeration_states == ["a", "b"] and d.deprecated_ids == {"_b.old"}
    r = resolve_tag("_A.OLD", d)
    assert (r.definition_id, r.category_id, r.object_id, r.was_alias, r.is_deprecated) == ("_a.x", "a", "x", True, False)
    assert resolve_tag("_b.old", d).is_deprecated and resolve_tag("_no", d) is None


def test_schema():
    s = generate_schema(load(TEXT))
    assert set(s.tables) == {"s", "a", "b", "k", "n"} and s.tables["k"].primary_keys == ["_id"] and s.tables["n"].primary_keys == ["_block_id", "_row_id"]
    assert [c.name for c in s.tables["a"].columns] == ["_block_id", "_row_id", "s_id", "n", "x", "x_su"]
    assert [(f.target_table, f.source_columns) for f in s.tables["a"].foreign_keys] == [("s", ("s_id",))]
    assert ("a", ("s_id", "n")) in [(f.target_table, f.source_columns) for f in s.tables["b"].foreign_keys]  # the column of that name stands in
    assert s.su_map == {"_a.x": ("a", "x_su")} and s.propagation_links["a"] == [("s_id", "_s.id", None)]
    assert s.descendants("s") == {"s", "a", "b"} and topological(s).index("s") < topological(s).index("a") < topological(s).index("b")
    assert loops_compatible(["a", "b"], s) and not loops_compatible(["a", "s"], s) and sibling_groups(s) == {frozenset({"s_id", "n"}): ["a", "b"]}
    ddl = emit_create_statements(s)
    assert len(ddl) == 5 and any("FOREIGN KEY" in x for x in ddl) and len(emit_fallback_create_statements()) == 7
    assert s.tables["a"].struct["x"].metadata["type_contents"] == "Real"


def test_create_statements_run():
    import sqlite3

    con = sqlite3.connect(":memory:")
    for x in [*emit_create_statements(generate_schema(load(TEXT))), *emit_fallback_create_statements()]:
        con.execute(x)


def test_link_cases():
    two = HEAD + category("P", "Loop", "D", "_p.a", "_p.b") + item("P", "a") + item("P", "b")
    several = two + category("C", "Loop", "D", "_c.id") + item("C", "id") + item("C", "a1", link("_p.a")) + item("C", "a2", link("_p.a")) + item("C", "b1", link("_p.b"))
    assert len(generate_schema(load(several)).tables["c"].foreign_keys) == 3
    part = two + category("C", "Loop", "D", "_c.id") + item("C", "id") + item("C", "a1", link("_p.a"))
    s = generate_schema(load(part))
    assert s.tables["c"].foreign_keys == [] and any("no foreign key" in w for w in s.warnings)
    bridged = HEAD + category("S", "Set", "D", "_s.id") + item("S", "id") + category("M", "Loop", "D", "_m.id") + item("M", "id") + item("M", "s_id", link("_s.id")) + category("P", "Loop", "D", "_p.n", "_p.s_id") + item("P", "n") + item("P", "s_id", link("_s.id")) + category("C", "Loop", "D", "_c.id") + item("C", "id") + item("C", "m_id", link("_m.id")) + item("C", "n", link("_p.n"))
    s = generate_schema(load(bridged))
    assert [(b.table, b.column, b.hops, b.value_column) for b in s.bridge_columns] == [("c", "s_id", (("m_id", "m", "id"),), "s_id")]
    assert ("p", ("n", "s_id")) in [(f.target_table, f.source_columns) for f in s.tables["c"].foreign_keys]


def test_imports():
    base = "#\\#CIF_2.0\ndata_T\nsave_units\n_definition.id units\n_type.contents Real\n_units.code m\nsave_\n"
    main = HEAD + category("D", "Head", "D") + category("S", "Set", "D", "_s.id") + item("S", "id", "_type.contents Code\n_import.get [{'file':t.dic 'save':units DUPL}]")
    get = lambda dupl: load(main.replace("DUPL", dupl), resolver={"t.dic": base}.get).items["_s.id"]
    assert (get("").type_contents, get("").units_code) == ("Code", "m")
    assert get("'dupl':Replace").type_contents == "Real"
    with pytest.raises(ValueError):
        get("'dupl':Exit")
    lacking = load(main.replace("DUPL", "").replace("t.dic", "u.dic"), resolver={}.get)
    assert any("no such file" in w for w in lacking.warnings)
    with pytest.raises(ValueError):
        load(main.replace("DUPL", "'miss':Exit").replace("t.dic", "u.dic"), resolver={}.get)


def test_full_imports_take_whole_dictionaries():
    child = HEAD.replace("D\n", "E\n", 1) + "save_E\n_definition.id E\n_definition.scope Category\n_definition.class Head\n_name.category_id E\n_import.get [{'file':d.dic 'save':D 'mode':Full}]\nsave_\n" + category("Q", "Set", "E", "_q.id") + item("Q", "id")
    told = []
    d = DictionaryLoader(lambda u: TEXT if u == "d.dic" else None, on_warning=told.append).load(child, base_uri="e.dic")
    assert {"s", "a", "q"} <= set(d.categories) and d.categories["s"].category_id == "e" and d.source_files == ["e.dic", "d.dic"]
    loop = DictionaryLoader(lambda u: child).load(child, base_uri="d.dic")
    assert any("imports itself" in w for w in loop.warnings)


def test_cache(tmp_path):
    d, path = load(TEXT), str(tmp_path / "d.json")
    save_dictionary(d, path)
    again = load_dictionary(path)
    assert again.items == d.items and again.alias_to_definition_id == d.alias_to_definition_id and generate_schema(again).tables == generate_schema(d).tables
    (tmp_path / "x.json").write_text("{}")
    for wrong in (str(tmp_path / "x.json"), str(tmp_path / "none.json")):
        with pytest.raises(ValueError):
            load_dictionary(wrong)


def test_resolvers(tmp_path):
    (tmp_path / "a.dic").write_text("x")
    assert directory_resolver(str(tmp_path))("http://h/a.dic") == "x" and directory_resolver(str(tmp_path))("b") is None
    assert directory_path_resolver(str(tmp_path))("a.dic") == str(tmp_path / "a.dic")


def test_pictures():
    s = generate_schema(load(TEXT))
    dot = visualise_schema(s, show_legend=True, show_parents=True)
    assert '"a" -> "s"' in dot and dot.count("{") == dot.count("}") and '"n" [label' in dot
    assert '"n" [label' not in visualise_schema(s, show_isolated=False) and ": Real" not in visualise_schema(s, show_types=False)
    assert components(s)[0] == {"s", "a", "b"} and ghost_tables(s) == set()
    page = visualise_schema_html(s, title="<x>")
    assert "&lt;x&gt;" in page and "<script" not in page
