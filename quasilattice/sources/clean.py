"""Cleaning models, and the same steps on cells.

clean() works on a model; clean_cells() applies the steps to a cells DataFrame of any number of sources, by aggregation
and filters alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import written
from .model import CifFile, Namespace, fold

ORPHAN = "_orphan.value"


@dataclass(frozen=True)
class CleanWarning:
    category: str
    block: str
    frame: str | None
    message: str


def clean(cif: CifFile, *, copy: bool = True, remove_error_values: bool = True, deduplicate_blocks: str | None = "first", deduplicate_save_frames: str | None = "first", deduplicate_tags: str | None = "first", strip_loop_padding: bool = True) -> tuple[CifFile, list[CleanWarning]]:
    """The steps in order, each with a record of what it removed. `first`/`last`: which of several stays; None: all."""
    cif, log = (cif.deepcopy() if copy else cif), []
    if remove_error_values:
        for block, space, frame in _spaces(cif):
            if ORPHAN in space.values:
                log.append(CleanWarning("error_value", block, frame, f"{len(space.values[ORPHAN])} values without a tag removed"))
                _remove(space, ORPHAN)
    if deduplicate_blocks:
        cif.blocks = _dedup(cif.blocks, deduplicate_blocks, lambda b: log.append(CleanWarning("block", b.name, None, "repeated block removed")))
    if deduplicate_save_frames:
        for block in cif.blocks:
            block.save_frames = _dedup(block.save_frames, deduplicate_save_frames, lambda f, block=block: log.append(CleanWarning("save_frame", block.name, f.name, "repeated save frame removed")))
    if deduplicate_tags:
        for block, space, frame in _spaces(cif):
            for tag in space.scalars():
                n = len(space.values[tag])
                if n > 1:
                    space.values[tag] = [space.values[tag][0 if deduplicate_tags == "first" else -1]]
                    log.append(CleanWarning("tag", block, frame, f"{tag}: {n - 1} of {n} values removed"))
    if strip_loop_padding:
        for block, space, frame in _spaces(cif):
            for loop in space.loops:
                n = padding([space.values[t] for t in loop])
                if n:
                    for t in loop:
                        del space.values[t][-n:]
                    log.append(CleanWarning("padding", block, frame, f"loop of {loop[0]}: {n} rows of padding removed"))
    return cif, log


def padding(columns: list[list]) -> int:
    """Rows at the end of which every value is `?`: at most one fewer than columns, and never all rows."""
    rows, n = len(columns[0]), 0
    while n < min(len(columns) - 1, rows - 1) and all(c[rows - 1 - n] == "?" for c in columns):
        n += 1
    return n


def _spaces(cif: CifFile):
    for block in cif.blocks:
        yield block.name, block, None
        for frame in block.save_frames:
            yield block.name, frame, frame.name


def _remove(space: Namespace, tag: str) -> None:
    space.values.pop(tag)
    space.order.remove(tag)
    space.loops = [[t for t in x if t != tag] for x in space.loops]
    space.loops = [x for x in space.loops if x]


def _dedup(items: list, keep: str, told) -> list:
    if keep not in ("first", "last"):
        raise ValueError(f"first or last, not {keep!r}")
    seen: dict[str, int] = {}
    for i, x in enumerate(items):
        if keep == "last" or fold(x.name) not in seen:
            seen[fold(x.name)] = i
    kept = set(seen.values())
    for i, x in enumerate(items):
        if i not in kept:
            told(x)
    return [x for i, x in enumerate(items) if i in kept]


def _with(cells: DataFrame, part: DataFrame, keys: list[str], sums: list) -> DataFrame:
    """cells with the aggregates of part's groups; keys may be null."""
    found = part.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(*sums)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return cells.join(found, on, "left").drop(*(f"_k_{k}" for k in keys))


def clean_cells(cells: DataFrame, *, remove_error_values: bool = True, deduplicate_blocks: str | None = "first", deduplicate_tags: str | None = "first", strip_loop_padding: bool = True) -> DataFrame:
    """The steps of clean() on CELLS. Each step reads the cells twice, so they are a written table: texts are parsed once."""
    if deduplicate_blocks or deduplicate_tags or strip_loop_padding:
        cells = written(cells, "cells")
    if remove_error_values:
        cells = cells.where(F.col("tag") != ORPHAN)
    if deduplicate_blocks:
        base = F.lower(F.regexp_replace("block_id", "#[0-9]+$", ""))
        edge = (F.min if deduplicate_blocks == "first" else F.max)("block_idx").alias("_keep")
        kept = cells.groupBy("source", base.alias("_name")).agg(edge).select(F.col("source"), F.col("_keep").alias("block_idx"))
        cells = cells.join(kept, ["source", "block_idx"], "left_semi")
    if deduplicate_tags:
        edge = (F.min if deduplicate_tags == "first" else F.max)("iter_idx").alias("_keep")
        cells = _with(cells, cells.where("loop_idx IS NULL"), ["source", "block_idx", "frame_idx", "tag"], [edge])
        cells = cells.where(F.col("loop_idx").isNotNull() | (F.col("iter_idx") == F.col("_keep"))).drop("_keep")
        cells = cells.withColumn("iter_idx", F.when(F.col("loop_idx").isNull(), 0).otherwise(F.col("iter_idx")))
    if strip_loop_padding:
        parts = [F.max(F.when(F.col("value") != "?", F.col("iter_idx"))).alias("_last"), F.max("iter_idx").alias("_end"), F.count_distinct("tag").alias("_n")]
        cells = _with(cells, cells.where("loop_idx IS NOT NULL"), ["source", "block_idx", "frame_idx", "loop_idx"], parts)
        cut = F.greatest(F.coalesce("_last", F.lit(0)), F.col("_end") - F.col("_n") + 1)
        cells = cells.where(F.col("_n").isNull() | (F.col("iter_idx") <= cut)).drop("_last", "_end", "_n")
    return cells


__all__ = ["CleanWarning", "clean", "clean_cells", "padding"]
