"""Shared pieces: vectorised word splitting and hashing over Arrow texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import new_path, shared_dir, written

__all__ = ["new_path", "shared_dir", "written"]

#: The words of a text are the runs of bytes outside this set.
WORD = r"[^\x20\x09-\x0D]+"
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Null becomes the empty text; one array of 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


#: Bytes of text that are worked on at once, a little under a power of two (see powers).
CHUNK = (2 << 20) - 64


def chunks(column: pa.Array, max_bytes: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in them): whole rows, about max_bytes together. A longer row comes alone."""
    column = texts_of(column)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    pa.default_memory_pool().release_unused()  # workers live on: what a batch needed goes back


def split_words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and for each row the number of words before it (one entry more than rows)."""
    ink = ~sep[buf]
    n = len(buf)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = ink[:-1], ink[1:]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, alike wherever the bytes stand."""
    _, down = powers(max(len(sums), 1))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hash(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; entry i is for the words from i on. Rows are not kept apart."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _P + word[j : j + n]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def unused(name: str, columns: list[str]) -> str:
    """name, with low lines before it until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs inside send at most n rows at once to Python: for long rows, which both sides hold whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    if int(old) > 0:
        n = min(n, int(old))
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, the first by the hash of key. Rows are counted first, so that tasks send about 2 n rows in all to
    where they are ranked, whatever the number of tasks."""
    total, h = df.select(key).count(), F.xxhash64(key)
    if total > 2 * n:
        df = df.where(h < int(-(2**63) + 2**64 * 2 * n / total))
    return df.orderBy(h, key).limit(n)
