"""Schemas as Graphviz text and as a self-contained page."""

from __future__ import annotations

import html
from collections import defaultdict

from .schema import Schema, Table


def components(schema: Schema) -> list[set[str]]:
    """Tables connected by foreign keys or parents, the largest component first."""
    near: dict[str, set[str]] = defaultdict(set)
    for t in schema.tables.values():
        near[t.name]
        for other in [f.target_table for f in t.foreign_keys] + [schema.category_parent.get(t.name)]:
            if other and other in schema.tables and other != t.name:
                near[t.name].add(other)
                near[other].add(t.name)
    out, left = [], set(schema.tables)
    while left:
        todo, group = [min(left)], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x] - group
        left -= group
        out.append(group)
    return sorted(out, key=lambda g: (-len(g), min(g)))


def deprecated_tables(schema: Schema) -> set[str]:
    return {t.name for t in schema.tables.values() if t.data and all(c.definition_id in schema.deprecated_ids for c in t.columns if not c.is_synthetic)}


def ghost_tables(schema: Schema) -> set[str]:
    """Tables that foreign keys point to and the schema hasn't."""
    return {f.target_table for t in schema.tables.values() for f in t.foreign_keys} - set(schema.tables)


def visible_columns(table: Table, schema: Schema, mode: str = "all", show_synthetic: bool = False, show_deprecated: bool = True) -> list[str]:
    """mode: all, keys (key and link columns) or none."""
    if mode == "none":
        return []
    linked = {c for f in table.foreign_keys for c in f.source_columns}
    return [c.name for c in table.columns if (show_synthetic or not c.is_synthetic) and (show_deprecated or c.definition_id not in schema.deprecated_ids) and (mode == "all" or c.is_primary_key or c.name in linked)]


def visualise_schema(schema: Schema, *, show_columns: str = "all", show_types: bool = True, show_synthetic: bool = False, show_deprecated: bool = True, show_isolated: bool = True, show_ghosts: bool = True, show_legend: bool = False, show_parents: bool = False, show_fk_labels: bool = True, show_bridges: bool = True, tables: list[str] | None = None, rankdir: str = "LR", title: str | None = None) -> str:
    """DOT text."""
    e = lambda s: html.escape(str(s), quote=True)
    gone = set() if show_deprecated else deprecated_tables(schema)
    names = [t for t in schema.tables if (tables is None or t in tables) and t not in gone]
    if not show_isolated:
        alone = {next(iter(g)) for g in components(schema) if len(g) == 1}
        names = [t for t in names if t not in alone]
    out = ["digraph schema {", f'  graph [rankdir={rankdir}, label="{e(title or schema.dictionary_title or "")}"];', "  node [shape=plain, fontname=Helvetica];"]
    for n in sorted(names):
        t = schema.tables[n]
        rows = [f'<TR><TD BGCOLOR="{"#dce9f7" if t.category_class == "Set" else "#e5f2e0"}"><B>{e(n)}</B> ({e(t.category_class)})</TD></TR>']
        for c in visible_columns(t, schema, show_columns, show_synthetic, show_deprecated):
            column = t.column(c)
            kind = f" : {column.type_contents}" if show_types and column.type_contents else ""
            mark = "<U>" + e(c) + "</U>" if column.is_primary_key else e(c)
            rows.append(f'<TR><TD ALIGN="LEFT" PORT="{e(c)}">{mark}{e(kind)}</TD></TR>')
        out.append(f'  "{n}" [label=<<TABLE BORDER="0" CELLBORDER="1" CELLSPACING="0">{"".join(rows)}</TABLE>>];')
    if show_ghosts:
        out += [f'  "{g}" [shape=box, style=dashed, label="{e(g)}"];' for g in sorted(ghost_tables(schema))]
    for n in sorted(names):
        for f in schema.tables[n].foreign_keys:
            if f.target_table in names or show_ghosts and f.target_table not in schema.tables:
                label = ", ".join(f.source_columns) if show_fk_labels else ""
                out.append(f'  "{n}" -> "{f.target_table}" [label="{e(label)}"];')
        parent = schema.category_parent.get(n)
        if show_parents and parent in names:
            out.append(f'  "{n}" -> "{parent}" [style=dotted, arrowhead=none];')
    if show_bridges:
        out += [f'  "{b.table}" -> "{b.hops[-1][1]}" [style=dashed, label="{e(b.column)}"];' for b in schema.bridge_columns if b.table in names]
    if show_legend:
        out.append('  "legend" [shape=note, label="blue: Set\\lgreen: Loop\\lunderlined: key\\l"];')
    return "\n".join([*out, "}"]) + "\n"


def visualise_schema_html(schema: Schema, *, title: str | None = None, **options) -> str:
    """A page without outside parts: the tables as lists, and the DOT text for any Graphviz viewer."""
    name = html.escape(title or schema.dictionary_title or "Schema")
    parts = [f"<h2 id='{html.escape(t.name)}'>{html.escape(t.name)} <small>{t.category_class}</small></h2><ul>" + "".join(f"<li>{'<b>' if c.is_primary_key else ''}{html.escape(c.name)}{'</b>' if c.is_primary_key else ''} {html.escape(c.type_contents or '')}</li>" for c in t.columns if not c.is_synthetic) + "</ul>" + "".join(f"<p>{html.escape(', '.join(f.source_columns))} &rarr; <a href='#{html.escape(f.target_table)}'>{html.escape(f.target_table)}</a></p>" for f in t.foreign_keys) for t in sorted(schema.tables.values(), key=lambda t: t.name)]
    dot = html.escape(visualise_schema(schema, title=title, **options))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{name}</title></head><body><h1>{name}</h1>{''.join(parts)}<h2>DOT</h2><pre>{dot}</pre></body></html>\n"
