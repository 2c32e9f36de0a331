"""Loading a folder as files arrive.

Each micro-batch of new files is parsed and merged into the dataset that is there, whose values win; the dataset is kept
as versioned table folders with a pointer, so a batch that is run again after a failure gives the same state.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Dataset, ingest, qualified
from ..operators.storage import new_path
from ..plans.schema import INFRASTRUCTURE, Schema
from ..sources.cells import cells_of_texts


def read_stream(spark: SparkSession, path: str, glob: str = "*.cif", max_files: int = 1000) -> DataFrame:
    """(source, content) of files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path)
    return raw.select(F.col("path").alias("source"), "content")


class DatasetStore:
    """A dataset in a folder: one subfolder for each state, and a table `states` with (version, tables) of all states."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> dict[int, list[str]]:
        try:
            rows = self.spark.read.schema("version long, tables string").json(f"{self.path}/states").collect()  # one a batch
        except AnalysisException:
            return {}
        return {r["version"]: json.loads(r["tables"]) for r in rows}

    def load(self, before: int | None = None) -> Dataset | None:
        """The newest state, or the newest before a version."""
        known = self.versions()
        at = max((v for v in known if before is None or v < before), default=None)
        if at is None:
            return None
        read = lambda name: self.spark.read.parquet(f"{self.path}/v{at}/{name}")
        try:
            problems = read("_problems")
        except AnalysisException:  # a state of before problems were kept
            problems = None
        return Dataset(self.spark, self.schema, {t: read(t) for t in known[at]}, {k: read(f"_{k}") for k in INFRASTRUCTURE}, problems=problems)

    def save(self, data: Dataset, version: int) -> None:
        for name, df in data.stored().items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        if version not in self.versions():
            self.spark.createDataFrame([(version, json.dumps(sorted(data.tables)))], "version long, tables string").coalesce(1).write.mode("append").json(f"{self.path}/states")


def merge_batch(store: DatasetStore, texts: DataFrame, version: int) -> Dataset:
    """One batch on top of the newest state before it: the same however often it is run."""
    cells = qualified(cells_of_texts(texts))
    data = ingest(cells, store.schema, spark=store.spark, into=store.load(before=version))
    store.save(data, version)
    return data


def stream_into(store: DatasetStore, path: str, checkpoint: str | None = None, **options) -> StreamingQuery:
    """Start (with what is there now; run again for more) merging a folder's files into the store."""
    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            merge_batch(store, batch, number)

    stream = read_stream(store.spark, path, **options)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or new_path(store.spark, "stream")).trigger(availableNow=True).start()
