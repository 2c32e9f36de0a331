"""Lexer, parser, model, quoting, values, editing and cleaning: without Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quasilattice.functions.quoting import format_container, make_text_field, quote, quote_text
from quasilattice.functions.values import canonical_real, decode_container, encode_container, encode_value, merge_su, split_su, split_su_container
from quasilattice.sources import types as T
from quasilattice.sources.clean import clean
from quasilattice.sources.lexer import Lexer, detect_version
from quasilattice.sources.model import build, fold
from quasilattice.sources.textfield import transform
from quasilattice.sources.writer import CifWriter

V2 = "#\\#CIF_2.0\n"
V1 = "#\\#CIF_1.1\n"


def codes(text):
    return [e.code for e in build(text)[1]]


def values(text, tag, version=V2):
    cif, _ = build(version + "data_x\n" + text)
    return cif["x"][tag]


@pytest.mark.parametrize(("text", "version", "n"), [("", T.V1, 0), ("data_a", T.V1, 0), (V2, T.V2, 0), ("﻿" + V1, T.V1, 0), ("#\\#CIF_3.0\n", T.V2, 1), ("\n\n" + V2, T.V2, 0)])
def test_version(text, version, n):
    found, _, _, errors = detect_version(text)
    assert (found, len(errors)) == (version, n)


def test_tokens_have_places_and_kinds():
    tokens = list(Lexer(V2 + "data_a\n_x 'q' # note\nloop_ _y\n[1 {'k':v}]\n;text\nmore\n;\n").tokens())
    assert [t.kind for t in tokens] == ["data", "tag", "value", "loop", "tag", "[", "value", "{", "value", ":", "value", "}", "]", "value"]
    assert (tokens[2].line, tokens[2].column, tokens[2].value_type) == (3, 4, T.SINGLE)
    assert tokens[-1].text == "text\nmore"


def test_quoted_structure_is_plain_text():
    assert values("_a '['\n_b ':'\n", "_a") == ["["]
    assert codes(V2 + "data_x\n_a '['\n_b '}'\n") == []


def test_first_version_has_no_containers_and_quotes_end_before_blanks():
    assert values("_a 'it's here'\n_b x]y\n", "_a", V1) == ["it's here"]
    assert "illegal-start" in codes(V1 + "data_x\n_a [1\n")


def test_containers_nest():
    assert values("_a [1 [2 3] {'k':v \"l\":[x]}]\n", "_a") == [["1", ["2", "3"], {"k": "v", "l": ["x"]}]]


@pytest.mark.parametrize(("text", "code"), [
    ("data_x\n_a\n_b 1\n", "missing-value"), ("data_x\n_a 1 2\n", "orphan-value"), ("data_x\nloop_\n_a _b\n", "empty-loop"), ("data_x\nloop_\n1\n", "loop-without-tags"),
    ("data_x\n_a [1 2\n", "unterminated-list"), ("data_x\n_a {'k':1\n", "unterminated-table"), ("data_x\n_a {'k' :1}\n", "space-before-colon"), ("data_x\n_a {'k' 1}\n", "missing-colon"),
    ("data_x\n_a {k:1}\n", "unquoted-key"), ("data_x\n_a ]\n", "unmatched-close"), ("data_x\n_a 'open\n_b 1\n", "unterminated-quote"), ("data_x\n_a\n;open\n", "unterminated-text"),
    ("_a 1\n", "outside-block"), ("data_x\nglobal_\n_a 1\n", "global"), ("data_x\nsave_f\nsave_g\nsave_\n", "nested-frame"), ("data_x\nsave_\n", "stray-save"), ("data_x\nsave_f\n_a 1\n", "frame-open"),
    ("data_x\nstop_\n", "stray-stop"), ("data_\n", "no-block-name"), ("data_x\n_a 1\ndata_X\n_b 1\n", "repeated-block"), ("data_x\n_a 1\n_A 2\n", "repeated-tag"),
])
def test_recovery_tells_what_is_wrong(text, code):
    assert code in codes(V2 + text)


def test_parsing_goes_on_after_errors():
    cif, errors = build(V2 + "data_x\n_a [1 2\n_b 3\n_c 'open\n_d 4\n")
    assert cif["x"]["_b"] == ["3"] and cif["x"]["_d"] == ["4"] and len(errors) == 2


@given(st.text(alphabet="ab_ '\"\n;[]{}:.?#\\data_loop_save_", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_is_read_without_raising(text):
    build(text)
    build(V2 + text)


def test_ragged_loops():
    text = V2 + "data_x\nloop_ _a _b\n1 2 3\n"
    assert build(text)[0]["x"]["_b"] == ["2", "?"]
    assert build(text, mode="strict")[0]["x"]["_b"] == ["2"]


def test_quoted_placeholders_differ_from_bare_ones():
    assert values("_a .\n_b '.'\n", "_b") == ['"."'] and values("_a .\n", "_a") == ["."]


def test_a_repeated_loop_tag_loses_nothing():
    cif, errors = build(V2 + "data_x\n_a 1\nloop_ _a _b\n2 3\n")
    assert cif["x"]["_a"] == ["1"] and cif["x"]["_a#2"] == ["2"] and len(errors) == 1


def test_names_fold():
    assert fold("_STRASSE") == fold("_straße") and build(V2 + "data_x\n_STRASSE 1\n")[0]["x"]["_straße"] == ["1"]


@pytest.mark.parametrize(("raw", "value"), [("plain\nlines", "plain\nlines"), ("\\\nlong \\\nline\nnext", "long line\nnext"), (">\\\n>a\n>;b", "a\n;b"), (">\\\\\n>a\\\n>b", "ab"), (">\\\n>a\nb", ">\\\n>a\nb")])
def test_text_field_protocols(raw, value):
    assert transform(raw) == value


plain = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cc"), include_characters="\n"), max_size=80)


@given(plain)
@settings(max_examples=300, deadline=None)
def test_quoted_text_reads_back(text):
    text = text.replace("\x85", "").replace(" ", "").replace(" ", "")
    if text in (".", "?"):
        return
    assert values(f"_a {quote_text(text)}\n", "_a") == [text]


@given(st.text(alphabet="abc ;\\>\n", max_size=200), st.integers(12, 40))
@settings(max_examples=300, deadline=None)
def test_text_fields_read_back_and_keep_the_limit(text, limit):
    field = make_text_field(text, limit)
    assert transform(field[2:-2]) == text
    if any(len(x) > limit for x in text.split("\n")):
        assert max(map(len, field.split("\n"))) <= limit + 2


def test_containers_are_quoted():
    stored = encode_container(["1", {"k y": "it's", "l": [".", "a b"]}])
    assert values(f"_a {quote(stored)}\n", "_a") == [decode_container(stored)]
    with pytest.raises(ValueError):
        quote(stored, T.V1)


@pytest.mark.parametrize(("raw", "number", "su"), [("3.992(4)", "3.992", "0.004"), ("0.1200e3(1)", "0.1200e3", "0.1"), ("12(3)", "12", "3"), ("-1.5(12)", "-1.5", "1.2"), ("1e3(2)", "1e3", "2000"), ("abc", "abc", None), (".5(10)", ".5", "1.0"), ("1.0(0)", "1.0", "0.0")])
def test_uncertainties(raw, number, su):
    assert split_su(raw) == (number, su)
    if su and "e" not in raw:
        assert merge_su(number, su) == raw


def test_container_uncertainties():
    number, su = split_su_container(encode_container(["1.2(3)", ["4", "5(6)"]]))
    assert decode_container(number) == ["1.2", ["4", "5"]] and decode_container(su) == ["0.3", ["0", "6"]]
    assert split_su_container(encode_container(["1"]))[1] is None


@pytest.mark.parametrize(("a", "b", "same"), [("1.200e2", "120.0", True), ("1.2", "1.20", False), ("+5(3)", "5", True), ("x", "x", True)])
def test_canonical_numbers(a, b, same):
    assert (canonical_real(a) == canonical_real(b)) is same


def test_value_kinds():
    cif, _ = build(V2 + 'data_x\n_a .\n_b "q"\n_c [1]\n_d {"k":1}\n_e x\n')
    assert [encode_value(cif["x"][t][0])[1] for t in ("_a", "_b", "_c", "_d", "_e")] == ["placeholder", "double_quoted", "list", "table", "string"]


def test_writer_edits_and_checks():
    w = CifWriter()
    b = w.add_block("one").set_tag("_a", 1).add_loop({"_l.x": [1, 2], "_l.y": ["p", "q"]})
    b.add_loop_column("_l.x", "_l.z", [3, 4]).add_loop_row("_l.x", {"_l.x": 9, "_l.y": 8, "_l.z": 7}).reorder_loop_tags("_l.x", ["_l.z", "_l.x", "_l.y"]).remove_loop_tag("_l.x", "_l.y")
    assert b.get_loop_tags("_l.x") == ["_l.z", "_l.x"] and b["_l.x"] == ["1", "2", "9"]
    b.reassign_tag("_a", [1, {"k": 2}]).delete_tag("_l.z")
    frame = w["one"].add_save_frame("f").set_tag("_q", None)
    assert frame["_q"] == ["?"] and w["one"].save_frames == ["f"]
    for wrong in (lambda: b.set_tag("_A", 1), lambda: b.set_tag("no", 1), lambda: b.add_loop({"_m": [], "_n": []}), lambda: b.add_loop_row("_l.x", {}), lambda: w.add_block("ONE"), lambda: w.add_block("a b"), lambda: w.get_block("no")):
        with pytest.raises(ValueError):
            wrong()
    w.rename_block("one", "two")
    assert w.build()["two"]["_a"] == [["1", {"k": "2"}]]
    old = CifWriter(version=T.V1)
    old.add_block("x").set_tag("_a", [1])
    with pytest.raises(ValueError, match="container"):
        old.build()


def test_clean_steps():
    cif, _ = build(V2 + "data_x\n_a 1\n_a 2\n9\nloop_ _l _m\n1 2\n? ?\ndata_X\n_b 1\n")
    out, log = clean(cif)
    assert [b.name for b in out.blocks] == ["x"] and out["x"]["_a"] == ["1"] and out["x"]["_l"] == ["1"] and "_orphan.value" not in out["x"]
    assert {w.category for w in log} == {"error_value", "block", "tag", "padding"} and len(cif.blocks) == 2
    assert clean(cif, deduplicate_tags="last")[0]["x"]["_a"] == ["2"]


def test_table_keys_with_both_quotes_read_back():
    for key in ("a'b\"c", "a'b", 'a"b', "x", "a b'", "a''b\"d"):
        cif, errors = build("#\\#CIF_2.0\ndata_d\n_a.t " + format_container({key: "1"}) + "\n")
        assert not errors and [str(k) for k in cif.blocks[0]["_a.t"][0]] == [key], key
