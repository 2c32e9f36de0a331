"""Texts as DataFrames: one row a value (cells) and one row a problem (errors).

Files are read one a task by Spark's binary reader, so any store that Spark reads will do. Each is parsed in a Python worker;
everything after the cells is relational.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import encode_value
from .model import CifFile, Namespace, build

CELLS = (
    "source string, block_idx int, block_id string, frame_idx int, frame_name string, loop_idx int, iter_idx int, "
    "tag string, tag_pos int, col_index int, value string, value_type string, event_pos int"
)
ERRORS = "source string, code string, kind string, message string, line int, col int"
#: Cells that go to Spark at once.
BATCH_CELLS = 20_000
_CELL_NAMES = [c.split()[0] for c in CELLS.split(", ")]
_CELL_TYPES = [pa.int32() if c.endswith(" int") else pa.string() for c in CELLS.split(", ")]


def block_ids(cif: CifFile) -> list[str]:
    """Block names, the later ones of a repeated name with their number: rows of two blocks never share an id."""
    seen: dict[str, int] = {}
    out = []
    for b in cif.blocks:
        key = b.name.lower()
        seen[key] = seen.get(key, 0) + 1
        out.append(b.name if seen[key] == 1 else f"{b.name}#{seen[key]}")
    return out


def cell_rows(source: str, cif: CifFile) -> Iterator[tuple]:
    for i, (block, block_id) in enumerate(zip(cif.blocks, block_ids(cif), strict=True)):
        yield from _namespace_rows((source, i, block_id), (None, None), block)
        for j, frame in enumerate(block.save_frames):
            yield from _namespace_rows((source, i, block_id), (j, frame.name), frame)


def _namespace_rows(head: tuple, frame: tuple, space: Namespace) -> Iterator[tuple]:
    place = {t: (n, c) for n, tags in enumerate(space.loops) for c, t in enumerate(tags)}
    first: dict[int, int] = {}
    for pos, tag in enumerate(space.order):
        loop, col = place.get(tag, (None, None))
        event = pos if loop is None else first.setdefault(loop, pos)
        for k, value in enumerate(space.values[tag]):
            stored, kind = encode_value(value)
            yield (*head, *frame, loop, k, tag, pos, col, stored, kind, event)


def cells_of(cif: CifFile, source: str = "") -> pa.Table:
    rows = list(cell_rows(source, cif))
    columns = list(zip(*rows, strict=True)) or [()] * len(_CELL_NAMES)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _CELL_TYPES, strict=True)], names=_CELL_NAMES)


def cell_batches(texts: Iterable[tuple[str, str | bytes | None]], mode: str = "pad") -> Iterator[pa.RecordBatch]:
    """CELLS of texts in full batches: small texts share one, a large one's cells are never all held as rows."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CELL_TYPES, strict=True)], names=_CELL_NAMES)

    for source, content in texts:
        if content is None:
            continue
        cif, _ = build(content.decode("utf-8", "replace") if isinstance(content, bytes) else content, mode=mode)
        for row in cell_rows(source, cif):
            rows.append(row)
            if len(rows) == BATCH_CELLS:
                yield batch()
                rows = []
    if rows:
        yield batch()


def cells_frame(spark: SparkSession, cif: CifFile, source: str = "") -> DataFrame:
    """Cells of a model that is on the driver."""
    rows = list(cell_rows(source, cif))
    return spark.createDataFrame(rows, CELLS)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")


def cells_of_texts(texts: DataFrame, mode: str = "pad") -> DataFrame:
    """CELLS of texts(source, content): content as text or UTF-8 bytes. Null contents have no cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cell_batches(((s, c) for b in batches for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), mode)

    return texts.select(F.col("source").cast("string"), "content").mapInArrow(run, CELLS)


def errors_of_texts(texts: DataFrame, mode: str = "pad") -> DataFrame:
    """ERRORS of texts(source, content), in order of place within a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is not None:
                    _, errors = build(content.decode("utf-8", "replace") if isinstance(content, bytes) else content, mode=mode)
                    rows += [(source, e.code, e.kind, e.message, e.line, e.column) for e in errors]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int32()] * 2, strict=True)], names=["source", "code", "kind", "message", "line", "col"])

    return texts.select(F.col("source").cast("string"), "content").mapInArrow(run, ERRORS)


def read_cells(spark: SparkSession, path: str, mode: str = "pad") -> DataFrame:
    """CELLS of all files at a path or pattern."""
    return cells_of_texts(_texts(spark, path), mode)


def read_errors(spark: SparkSession, path: str, mode: str = "pad") -> DataFrame:
    return errors_of_texts(_texts(spark, path), mode)


def events_of_texts(texts: DataFrame) -> DataFrame:
    """Parse events as rows: source, pos, event, args (JSON)."""
    import json

    from .parser import Parser

    class Recorder:
        def __init__(self) -> None:
            self.rows: list[tuple[str, str]] = []

        def __getattr__(self, name: str):
            if not name.startswith(("on_", "add_")):
                raise AttributeError(name)
            return lambda *a: self.rows.append((name, json.dumps([x if isinstance(x, (str, list)) else vars(x) for x in a])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None:
                    continue
                seen = Recorder()
                Parser(seen).parse(content.decode("utf-8", "replace") if isinstance(content, bytes) else content)
                yield pa.RecordBatch.from_pydict({"source": [source] * len(seen.rows), "pos": pa.array(range(len(seen.rows)), pa.int32()), "event": [a for a, _ in seen.rows], "args": [b for _, b in seen.rows]})

    return texts.select(F.col("source").cast("string"), "content").mapInArrow(run, "source string, pos int, event string, args string")


def tokens_of_texts(texts: DataFrame) -> DataFrame:
    """Tokens as rows: source, pos, kind, text, value_type, line, col."""
    from .lexer import Lexer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None:
                    continue
                rows = [(source, i, t.kind, t.text, t.value_type, t.line, t.column) for i, t in enumerate(Lexer(content.decode("utf-8", "replace") if isinstance(content, bytes) else content).tokens())]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["source", "pos", "kind", "text", "value_type", "line", "col"])

    return texts.select(F.col("source").cast("string"), "content").mapInArrow(run, "source string, pos int, kind string, text string, value_type string, line int, col int")


def build_arrow(source: str, *, mode: str = "pad") -> tuple[list[pa.RecordBatch], list]:
    """A batch for each scalar group and each loop, every one with its own columns."""
    cif, errors = build(source, mode=mode)
    return cif_to_arrow(cif), errors


def build_arrow_file(path: str, *, mode: str = "pad") -> tuple[list[pa.RecordBatch], list]:
    with open(path, encoding="utf-8") as f:
        return build_arrow(f.read(), mode=mode)


def cif_to_arrow(cif: CifFile) -> list[pa.RecordBatch]:
    out = []
    for i, (block, block_id) in enumerate(zip(cif.blocks, block_ids(cif), strict=True)):
        for j, space in enumerate([block, *block.save_frames]):
            for n, tags in enumerate([space.scalars(), *space.loops]):
                if not tags:
                    continue
                size = max(len(space.values[t]) for t in tags)
                cells = {t: pa.array([encode_value(v)[0] for v in space.values[t]] + [None] * (size - len(space.values[t])), pa.string()) for t in tags}
                meta = {"_block_id": [block_id] * size, "_block_idx": [i] * size, "_frame": [space.name if j else None] * size, "_loop_idx": [n - 1 if n else None] * size, "_iter_idx": list(range(size))}
                kinds = {"_block_id": pa.string(), "_block_idx": pa.int32(), "_frame": pa.string(), "_loop_idx": pa.int32(), "_iter_idx": pa.int32()}
                out.append(pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in meta.items()} | cells))
    return out


try:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class CifDataSource(DataSource):
        """spark.dataSource.register(CifDataSource); spark.read.format("cif").load(path): CELLS, a partition for each file
        of a folder or pattern on a path that all workers see. For other stores use read_cells()."""

        @classmethod
        def name(cls) -> str:
            return "cif"

        def schema(self) -> str:
            return CELLS

        def reader(self, schema):
            return _CifReader(self.options)

    class _CifReader(DataSourceReader):
        def __init__(self, options):
            self.path, self.mode = options.get("path", ""), options.get("mode", "pad")

        def partitions(self):
            import glob
            import os

            path = self.path.removeprefix("file://")
            files = sorted(glob.glob(os.path.join(path, "*.cif")) if os.path.isdir(path) else glob.glob(path))
            return [InputPartition(f) for f in files]

        def read(self, partition):
            if partition is None or partition.value is None:
                return
            with open(partition.value, encoding="utf-8", errors="replace") as f:
                cif, _ = build(f.read(), mode=self.mode)
            yield from cells_of(cif, partition.value).to_batches()
except ImportError:  # older Spark without Python data sources
    CifDataSource = None
