"""Token-ID output in patched frame-of-reference blocks.

Each shard file holds whole documents in ascending doc_id order. Its ids are cut into blocks of BLOCK values; a block
stores its minimum, the rest packed at the bit width of the percentile-th value, and the values that don't fit in an
exception list. The index has the start of every block, so that one block can be read alone.

File layout (little-endian): magic "QPF1", u32 block length, u64 ids, u32 documents, u32 blocks, u32 exceptions;
per document i64 doc_id, u8 null flag, u32 ids; per block u32 minimum, u8 width, u64 start of its packed bits,
u32 start of its exceptions; per exception u16 position in the block, u32 value above the minimum; packed bits.

Files are rows of a Parquet table (shard keys, `file` binary) in the shared folder, so any store that Spark writes to will do.

Defined cases: a null or empty text gives the end id alone; a null doc_id sorts first; rows that repeat a doc_id are
written one after the other, by a hash of the text, then by text; texts are encoded whole, whatever their length; an empty
table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_rows, chunks, new_path, prefix_sums, ragged, read_table, span_hash, split_words, texts_of

MAGIC, BLOCK = b"QPF1", 128
#: Bytes of text that are encoded at once, and rows that come to a worker at once: a worker holds about 30 times the former.
ENCODED, ROWS = (1 << 20) - 64, 1000
_HEAD = struct.Struct("<4sIQIII")
#: White space other than blanks and line ends; texts that have it are encoded in one piece.
_ODD = re.compile(r"[^\S \n]")
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x0A]] = True


def bit_width(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, dtype=np.int64)
    x = x.astype(np.int64)
    while x.any():
        out += x > 0
        x = x >> 1
    return out


def pack_lanes(values: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each row's BLOCK values, packed from the lowest bit on: one row of bytes each."""
    lanes = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << w) - 1)
    out = np.zeros((BLOCK * w // 64, lanes.shape[1]), dtype=np.uint64)
    for j in range(BLOCK):
        word, shift = divmod(j * w, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8)


def unpack_lanes(raw: np.ndarray, w: int) -> np.ndarray:
    """The inverse of pack_lanes."""
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
    out = np.empty((BLOCK, words.shape[1]), dtype=np.uint64)
    mask = np.uint64((1 << w) - 1)
    for j in range(BLOCK):
        word, shift = divmod(j * w, 64)
        x = words[word] >> np.uint64(shift)
        if shift + w > 64:
            x |= words[word + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return np.ascontiguousarray(out.T).astype(np.int64)


def pack_file(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, percentile: float = 98.0) -> bytes:
    """One shard file of ids (all documents' ids one after the other)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, dtype=np.int64)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.int64)
    above = grid - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
    width = bit_width(np.partition(above, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    odd_block, odd_at = np.nonzero(above >> width[:, None])
    odd_value = above[odd_block, odd_at]
    odd_start = np.searchsorted(odd_block, np.arange(blocks))
    size = width * (BLOCK // 8)
    start = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), dtype=np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            out = pack_lanes(above[rows], int(w))
            packed[(start[rows, None] + np.arange(out.shape[1])).ravel()] = out.ravel()
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join((
        _HEAD.pack(MAGIC, BLOCK, n, len(doc_ids), blocks, len(odd_at)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), null.tobytes(), counts.astype("<u4").tobytes(),
        low.astype("<u4").tobytes(), width.astype("u1").tobytes(), start.astype("<u8").tobytes(), odd_start.astype("<u4").tobytes(),
        odd_at.astype("<u2").tobytes(), odd_value.astype("<u4").tobytes(), packed.tobytes(),
    ))


class File:
    """A shard file's parts; its ids are unpacked on demand, all or block by block."""

    def __init__(self, data: bytes):
        magic, self.block, self.n, docs, blocks, odd = _HEAD.unpack_from(data)
        if magic != MAGIC or self.block != BLOCK:
            raise ValueError("not a QPF1 file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.null, self.counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.low, self.width, self.start, self.odd_start = take("<u4", blocks), take("u1", blocks), take("<u8", blocks), take("<u4", blocks)
        self.odd_at, self.odd_value = take("<u2", odd), take("<u4", odd)
        self.packed = np.frombuffer(data, dtype=np.uint8, offset=at)

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids of the blocks first to end."""
        blocks = len(self.low)
        end = blocks if end is None else min(end, blocks)
        first = min(first, end)
        width = self.width[first:end].astype(np.int64)
        out = np.zeros((end - first, self.block), dtype=np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                raw = self.packed[self.start[first:end][rows].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
                out[rows] = unpack_lanes(raw, int(w))
        lo = int(self.odd_start[first]) if first < blocks else len(self.odd_at)
        hi = int(self.odd_start[end]) if end < blocks else len(self.odd_at)
        owner = np.searchsorted(self.odd_start[first:end], np.arange(lo, hi), "right") - 1
        out[owner, self.odd_at[lo:hi]] = self.odd_value[lo:hi]
        out += self.low[first:end].astype(np.int64)[:, None]
        return out.ravel()[: max(0, self.n - first * self.block)].astype("<u4")


def _ends(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of spans (as many as they have), as integers."""
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(8, np.uint8), buf, np.zeros(8, np.uint8))), 8)
    size = np.minimum(ends - starts, 8)
    shift = (8 * (8 - size)).astype(np.uint64)
    head = np.ascontiguousarray(wide[starts + 8]).view("<u8").ravel() << shift
    tail = np.ascontiguousarray(wide[ends]).view("<u8").ravel() >> shift
    return np.where(size > 0, head, 0), np.where(size > 0, tail, 0)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder_for(path: str, ordinary: bool = False) -> Encoder:
    """One encoder for each worker process: what it has learned serves later tasks."""
    if (path, ordinary) not in _ENCODERS:
        _ENCODERS[path, ordinary] = Encoder(path, ordinary=ordinary)
    return _ENCODERS[path, ordinary]


class Encoder:
    """The library's encoding of whole texts, with recurring segments encoded once.

    A segment is a run of blanks and line ends with the ink after it. The tokenizer's pre-tokens always end where such a
    run follows ink, so the ids of a text are those of its segments. New segments are joined and encoded together; the
    ids' own byte lengths tell where each ends. Segments are found by hash; length, first and last eight bytes must agree.

    Texts with the string of an added token are encoded in one piece, as the library does by default: the string becomes
    the token's id. ordinary: such strings are text like other text."""

    def __init__(self, path: str, keep: int = 600_000, ordinary: bool = False):
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_file(path), keep
        self.tok.encode_special_tokens = ordinary
        # Added tokens that aren't special are found whatever the setting; normalised ones may match other spellings.
        added = [t for t in self.tok.get_added_tokens_decoder().values() if not (ordinary and t.special)]
        loose = any(t.normalized and self.tok.normalizer is not None for t in added)
        self.whole = re.compile("|".join([_ODD.pattern, *(re.escape(t.content) for t in added)]) if not loose else "")
        vocab = self.tok.get_vocab()
        self.id_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.id_bytes[i] = len(token)  # byte-level: a character for each byte
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)  # sorted hashes, and for each its place below
        self.place = self.start = self.len = self.byte_len = np.zeros(0, dtype=np.int32)
        self.head = self.tail = np.zeros(0, dtype=np.uint64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _one_by_one(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode segments that aren't kept yet."""
        size = ends - starts
        apart = ~_GAP[buf[starts]] | _GAP[buf[ends - 1]]  # without a run in front, or nothing but a run: not to be joined
        order = np.argsort(apart, kind="stable")
        keys, starts, ends, size = keys[order], starts[order], ends[order], size[order]
        n = int((~apart).sum())
        got, lens = [], []
        for i in range(0, n, 4096):
            k = size[i : min(n, i + 4096)]
            ids = np.array(self._one_by_one([buf[ragged(starts[i : i + len(k)], k)].tobytes().decode()])[0], dtype=np.uint32)
            cut = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(k), "left") + 1
            got.append(ids)
            lens.append(np.diff(cut, prepend=0))
        if n < len(keys):
            rest = self._one_by_one([buf[a:b].tobytes().decode() for a, b in zip(starts[n:].tolist(), ends[n:].tolist(), strict=True)])
            got += [np.array(ids, dtype=np.uint32) for ids in rest]
            lens.append(np.array([len(ids) for ids in rest], dtype=np.int64))
        lens = np.concatenate(lens)
        self.start = np.concatenate((self.start, (len(self.pool) + np.cumsum(lens) - lens).astype(np.int32)))
        self.len = np.concatenate((self.len, lens.astype(np.int32)))
        head, tail = _ends(buf, starts, ends)
        self.head, self.tail = np.concatenate((self.head, head)), np.concatenate((self.tail, tail))
        self.byte_len = np.concatenate((self.byte_len, size.astype(np.int32)))
        self.pool = np.concatenate((self.pool, *got))
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(self.key, keys[order])
        self.place = np.insert(self.place, at, len(self.place) + order)
        self.key = np.insert(self.key, at, keys[order])

    def encode(self, texts: list[str], buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each. buf, off: the texts' bytes and offsets."""
        if len(self.key) > self.keep or len(self.pool) > 1 << 28:  # places in the pool are 32-bit numbers
            self.clear()
        odd = np.fromiter((bool(self.whole.search(t)) for t in texts), dtype=bool, count=len(texts))
        _, ends, words = split_words(buf, off, _GAP)
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1]
        first = words[:-1][np.diff(words) > 0]
        starts[first] = off[:-1][np.diff(words) > 0]
        last = np.where(np.diff(words) > 0, ends[np.maximum(words[1:] - 1, 0)] if len(ends) else 0, off[:-1])
        tail = np.flatnonzero((last < off[1:]) & ~odd)  # blanks after the last word
        inside = ~np.repeat(odd, np.diff(words))
        owner = np.repeat(np.arange(len(texts)), np.diff(words))[inside]
        starts, ends = starts[inside], ends[inside]
        if len(tail):
            at = np.searchsorted(owner, tail, "right")
            starts, ends, owner = np.insert(starts, at, last[tail]), np.insert(ends, at, off[1:][tail]), np.insert(owner, at, tail)
        key = span_hash(prefix_sums(buf), starts, ends)
        which, distinct = pd.factorize(key)
        seen = np.empty(len(distinct), dtype=np.int64)
        seen[which[::-1]] = np.arange(len(key) - 1, -1, -1)
        order = np.argsort(distinct)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        distinct, seen, which = distinct[order], seen[order], rank[which]
        at = np.searchsorted(self.key, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inner = at < len(self.key)
        new[inner] = self.key[at[inner]] != distinct[inner]
        if new.any():
            self._learn(distinct[new], buf, starts[seen[new]], ends[seen[new]])
            at = np.searchsorted(self.key, distinct)
        place = self.place[at][which]
        head, tail = _ends(buf, starts, ends)
        same = (self.byte_len[place] == ends - starts) & (self.head[place] == head) & (self.tail[place] == tail)
        if not same.all():  # two segments with one hash: their texts go the plain way
            odd[np.unique(owner[~same])] = True
            keep = ~odd[owner]
            place, owner = place[keep], owner[keep]
        lens = self.len[place].astype(np.int64)
        ids = self.pool[ragged(self.start[place].astype(np.int64), lens)]
        counts = np.bincount(owner, weights=lens, minlength=len(texts)).astype(np.int64)
        if odd.any():
            pieces, ends = np.split(ids, np.cumsum(counts)[:-1]), np.flatnonzero(odd)
            for i, got in zip(ends.tolist(), self._one_by_one([texts[i] for i in ends]), strict=True):
                pieces[i] = np.array(got, dtype=np.uint32)
                counts[i] = len(got)
            ids = np.concatenate(pieces)
        return ids, counts


FILES = "part long, seq long, first_doc long, last_doc long, n_ids long, file binary"


def shards(batches: Iterator[pa.RecordBatch], part: int, tokenizer: str, shard_ids: int = 1 << 20, end_id: int = 0, percentile: float = 98.0, ordinary: bool = True) -> Iterator[pa.RecordBatch]:
    """FILES of a part's ordered rows (doc_id, text)."""
    seq, encoder = 0, encoder_for(tokenizer, ordinary)
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    names: list[int | None] = []
    n = 0

    def close() -> pa.RecordBatch:
        nonlocal held, counts, names, n, seq
        file = pack_file(np.concatenate(held), names, np.concatenate(counts), percentile)
        out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "first_doc": pa.array([names[0]], pa.int64()), "last_doc": pa.array([names[-1]], pa.int64()), "n_ids": [n], "file": pa.array([file], pa.binary())})
        held, counts, names, n, seq = [], [], [], 0, seq + 1
        return out

    for batch in batches:
        text, doc = texts_of(batch.column(1)), batch.column(0).to_pylist()
        for lo, hi, buf, off in chunks(text, ENCODED):
            ids, k = encoder.encode(text[lo:hi].to_pylist(), buf, off)
            ends = np.cumsum(k)
            held.append(np.insert(ids, ends, end_id))  # the end id after each document
            counts.append(k + 1)
            names += doc[lo:hi]
            n += len(held[-1])
            if n >= shard_ids:
                yield close()
    if names:
        yield close()


def encode_files(docs: DataFrame, tokenizer: str, shard_ids: int = 1 << 20, end_id: int = 0, percentile: float = 98.0, ordinary: bool = True) -> DataFrame:
    """Shard files of docs(doc_id, text), in ascending doc_id order: a range shuffle of the texts, then all in one pass."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A hash of the text goes with the id, so that rows that share an id, or have none, are dealt out too.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return shards(batches, TaskContext.get().partitionId(), tokenizer, shard_ids, end_id, percentile, ordinary)

    return ordered.mapInArrow(encode, FILES)


def write_files(files: DataFrame, path: str) -> DataFrame:
    """The files as a table at path, read again."""
    with batch_rows(files.sparkSession, ROWS):
        files.write.option("compression", "zstd").parquet(path)
    return files.sparkSession.read.schema(FILES).parquet(path)


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and the stored bits a token."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = data.as_buffer()
                file = File(raw)
                counts = file.counts.astype(np.int64)
                ends = np.cumsum(counts)
                body = memoryview(file.ids().tobytes())
                crc = [zlib.crc32(body[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(counts), pa.int64()), "seq": pa.array([seq] * len(counts), pa.int64()),
                    "doc_id": pa.array(file.doc_ids, pa.int64(), mask=file.null.astype(bool)), "local": ends - counts, "n_tokens": counts,
                    "ids_crc32": pa.array(crc, pa.int64()), "bits_per_token": np.full(len(counts), 8 * len(raw) / max(1, file.n)),
                })

    docs = files.select("part", "seq", "file").mapInArrow(decode, "part long, seq long, doc_id long, local long, n_tokens long, ids_crc32 long, bits_per_token double")
    # Parts are ranges in ascending order: one row for each of them is summed up, then the files of each part by themselves.
    sizes = files.select("part", "seq", "n_ids")
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, F.col("part") == F.col("p"))
    starts = starts.select("part", "seq", (F.col("above") + F.col("inside")).alias("before"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", F.round("bits_per_token", 3).alias("bits_per_token"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, path: str | None = None, ordinary: bool = True) -> DataFrame:
    """Encode docs, write the files at path (default: the shared folder), and report what they hold. ordinary: strings of
    special tokens are ordinary text; if not, they become the tokens' ids, as by the library's default."""
    files = encode_files(docs, tokenizer or tokenizer_path(), ordinary=ordinary)
    return read_documents(write_files(files, path or new_path(spark, "pfor")))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, read_table(spark, sf_dir, "documents"), ordinary=False)
