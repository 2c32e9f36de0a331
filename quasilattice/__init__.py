"""A Spark-native engine for dictionary-driven scientific text data. Names are imported when they are first used, so that
Python workers load only what they run."""

from __future__ import annotations

import importlib

_WHERE = {
    "functions.quoting": "quote",
    "inspection": "ParseHandler inspect_ingest inspect_lexer inspect_model inspect_parse inspect_schema",
    "operators.convert": "convert_database generate_defaults",
    "operators.emit": "emit emit_blocks emit_files",
    "operators.fidelity": "check_fidelity",
    "operators.ingest": "Dataset IngestionError ingest",
    "operators.validate": "validate validate_database",
    "plans.dictionary": "DictionaryLoader directory_path_resolver directory_resolver load_dictionary resolve_tag save_dictionary",
    "plans.output": "BlockSpec EmitMode OutputPlan all_of any_of has namer only",
    "plans.schema": "emit_create_statements emit_fallback_create_statements generate_schema",
    "plans.visualise": "visualise_schema visualise_schema_html",
    "sources.cells": "build_arrow build_arrow_file cif_to_arrow read_cells read_errors",
    "sources.clean": "clean",
    "sources.model": "CifFile build",
    "sources.writer": "BlockWriter CifWriter SaveFrameWriter",
}
_NAMES = {name: (module, name) for module, names in _WHERE.items() for name in names.split()}
_NAMES |= {"CifBlock": ("sources.model", "Block"), "CifBuilder": ("sources.model", "Builder"), "CifSaveFrame": ("sources.model", "Frame")}
__all__ = sorted(_NAMES)


def __getattr__(name: str) -> object:
    if name not in _NAMES:
        raise AttributeError(name)
    module, own = _NAMES[name]
    return getattr(importlib.import_module(f"{__name__}.{module}"), own)


def __dir__() -> list[str]:
    return [*globals(), *__all__]
