"""Printed views of tokens, events, models, schemas and loads."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from pathlib import Path
from typing import TextIO

from .operators.ingest import Dataset, ingest
from .plans.schema import Schema, emit_create_statements
from .sources.lexer import Lexer
from .sources.model import CifFile, Namespace, build
from .sources.parser import Parser
from .sources.types import Handler


def resolve_source(source: str | Path | TextIO) -> str:
    if hasattr(source, "read"):
        return source.read()
    if isinstance(source, Path) or "\n" not in source and Path(source).is_file():
        return Path(source).read_text(encoding="utf-8")
    return source


def fmt_value(value: object, most: int = 24) -> str:
    """A value for display: the first 15 and last 5 characters of a long one."""
    text = repr(value) if not isinstance(value, str) else value.replace("\n", "\\n")
    return text if len(text) <= most else f"{text[:15]} … {text[-5:]}"


def inspect_lexer(source: str | Path | TextIO, *, version: str | None = None, file: TextIO | None = None) -> None:
    out, lexer = file or sys.stdout, Lexer(resolve_source(source), version)
    print(f"version {lexer.version}", file=out)
    for t in lexer.tokens():
        print(f"{t.line:>5}:{t.column:<4} {t.kind:<9} {t.value_type or '-':<14} {fmt_value(t.text)}", file=out)
        for e in t.errors:
            print(f"           ! {e.code}: {e.message}", file=out)


class ParseHandler:
    """Prints events and hands them on."""

    def __init__(self, inner: Handler | None = None, *, file: TextIO | None = None, show_values: bool = True):
        self.inner, self.file, self.show_values, self.depth = inner, file or sys.stdout, show_values, 0

    def __getattr__(self, name: str):
        if not name.startswith(("on_", "add_")):
            raise AttributeError(name)

        def told(*args: object) -> None:
            if name.endswith("_end"):
                self.depth -= 1
            if self.show_values or name != "add_value":
                print("  " * max(self.depth, 0) + name.removeprefix("on_") + " " + " ".join(fmt_value(a) if isinstance(a, str) else str(a) for a in args), file=self.file)
            if name.endswith("_start"):
                self.depth += 1
            if self.inner is not None:
                getattr(self.inner, name)(*args)

        return told


def inspect_parse(source: str | Path | TextIO, *, inner: Handler | None = None, file: TextIO | None = None, show_values: bool = True, show_tokens: bool = False) -> None:
    text = resolve_source(source)
    if show_tokens:
        inspect_lexer(text, file=file)
    Parser(ParseHandler(inner, file=file, show_values=show_values)).parse(text)


def inspect_model(source: str | Path | TextIO | CifFile, *, mode: str = "pad", file: TextIO | None = None, most_rows: int = 6) -> CifFile:
    out = file or sys.stdout
    cif, errors = (source, []) if isinstance(source, CifFile) else build(resolve_source(source), mode=mode)
    print(f"version {cif.version}, {len(cif.blocks)} blocks", file=out)
    for b in cif.blocks:
        for space in (b, *b.save_frames):
            print(f"{'data' if space is b else '  save'}_{space.name}", file=out)
            _namespace(space, out, most_rows)
    for e in errors:
        print(f"! {e.line}:{e.column} {e.code}: {e.message}", file=out)
    return cif


def _namespace(space: Namespace, out: TextIO, most: int) -> None:
    for tag in space.scalars():
        print(f"    {tag} = {', '.join(fmt_value(v) for v in space.values[tag])}", file=out)
    for loop in space.loops:
        n = len(space.values[loop[0]])
        print(f"    loop of {n} rows: {' '.join(loop)}", file=out)
        shown = range(n) if n <= most else [*range(most // 2), *range(n - most // 2, n)]
        for i in shown:
            print("        " + " | ".join(fmt_value(space.values[t][i]) for t in loop), file=out)


def inspect_schema(schema: Schema, *, show_ddl: bool = False, file: TextIO | None = None) -> None:
    out = file or sys.stdout
    for t in sorted(schema.tables.values(), key=lambda t: t.name):
        print(f"{t.category_class} {t.name} ({', '.join(t.primary_keys)})", file=out)
        for c in t.columns:
            old = " deprecated" if c.definition_id in schema.deprecated_ids else ""
            print(f"    {'*' if c.is_primary_key else ' '} {c.name} {c.type_contents or ''} {c.type_container or ''}{old}", file=out)
        for f in t.foreign_keys:
            print(f"    -> {f.target_table} ({', '.join(f.source_columns)} = {', '.join(f.target_columns)})", file=out)
    loose = [t.name for t in schema.tables.values() if t.category_class == "Loop" and t.keys and not any(_leads_to_set(t.name, k, schema, set()) for k in t.keys)]
    if loose:
        print(f"Loops without a key from a Set: {', '.join(sorted(loose))}", file=out)
    for w in schema.warnings:
        print(f"! {w}", file=out)
    if show_ddl:
        print(";\n".join(emit_create_statements(schema)) + ";", file=out)


def _leads_to_set(table: str, column: str, schema: Schema, seen: set[tuple[str, str]]) -> bool:
    if (table, column) in seen or table not in schema.tables:
        return False
    seen.add((table, column))
    for f in schema.tables[table].foreign_keys:
        for a, b in zip(f.source_columns, f.target_columns, strict=True):
            if a == column and f.target_table in schema.tables and (schema.tables[f.target_table].category_class == "Set" or _leads_to_set(f.target_table, b, schema, seen)):
                return True
    return False


@dataclass(frozen=True)
class TraceEvent:
    kind: str
    message: str


def inspect_ingest(cif: CifFile, schema: Schema | None = None, *, spark=None, dataset_id: str | None = None, propagate_fk: bool = True, file: TextIO | None = None) -> tuple[Dataset, list[TraceEvent]]:
    """Load, and tell what happened: messages, and for each table its number of rows."""
    data = ingest(cif, schema, spark=spark, dataset_id=dataset_id, propagate_fk=propagate_fk)
    events = [TraceEvent("message", m) for m in data.messages]
    events += [TraceEvent("table", f"{t}: {df.count()} rows") for t, df in data.tables.items()]
    events.append(TraceEvent("fallback", f"{data.infra['fallback'].count()} values"))
    for e in events:
        print(f"{e.kind}: {e.message}", file=file or sys.stdout)
    return data, events
