"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case (ASCII). A test item and a document that share a seed (a run of
`least` tokens, or all tokens of a shorter item) are a candidate pair. Greedy string tiling marks, longest first, matches
of at least `least` tokens that don't overlap marked ones on either side; matches of one length are found by running
Karp-Rabin hashes over unmarked tokens and compared token by token. Tiles may stand in any order, so passages that were
reordered are caught. A pair counts if tiles cover `threshold` of the item's tokens.

The items are a stated query set against all rows: they are read in blocks of a bounded size, each broadcast to all tasks.
A row's seeds are looked up in it, so nothing is shuffled and no document meets another.

Defined cases: null and empty texts have no tokens and match nothing; repeated rows are judged one by one; equal items
with one id count once; items that repeat an id with other texts are judged one by one; an empty table on either side
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, gram_hash, prefix_sums, ragged, read_table, span_hash, split_words, texts_of
from .lang_crf import _LOWER

LEAST, THRESHOLD = 5, 0.5
#: Bytes of item texts in one broadcast block.
BLOCK_BYTES = 8 << 20
_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_MOD, _BASE = (1 << 61) - 1, 1_000_003
MATCHES = "doc_id long, item_id long, tiled long, item_tokens long, tiles int, coverage double"


@dataclass
class Items:
    ids: list[int | None]
    tokens: list[list[bytes]]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length: filter, sorted hashes, item and place of each


def _running(values: list[int | None], length: int) -> dict[int, list[int]]:
    """Karp-Rabin hashes of all runs of `length` unmarked values (None: marked), and where they start."""
    out: dict[int, list[int]] = defaultdict(list)
    top, h, n = pow(_BASE, length, _MOD), 0, 0
    for i, x in enumerate(values):
        if x is None:
            h = n = 0
            continue
        h, n = (h * _BASE + x) % _MOD, n + 1
        if n > length:
            h, n = (h - values[i - length] * top) % _MOD, length
        if n == length:
            out[h].append(i - length + 1)
    return out


def tile(item: list, text: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(item start, text start, length) of the tiles: repeatedly all longest matches of unmarked tokens, in order of place."""
    code: dict = {}
    a = [code.setdefault(t, len(code) + 1) for t in item]
    b = [code.setdefault(t, len(code) + 1) for t in text]
    least = max(1, min(least, len(a)))
    p: list[int | None] = list(a)
    q: list[int | None] = list(b)
    out: list[tuple[int, int, int]] = []
    search, longest_known = max(least, 20), 0
    while search >= least and a:
        found: list[tuple[int, int, int]] = []
        hashes = _running(q, search)
        for h, starts in _running(p, search).items():
            for i in starts:
                for j in hashes.get(h, ()):
                    if p[i : i + search] != q[j : j + search]:
                        continue
                    if i and j and p[i - 1] is not None and p[i - 1] == q[j - 1]:
                        continue  # not the start of its match
                    k = search
                    while i + k < len(p) and j + k < len(q) and p[i + k] is not None and p[i + k] == q[j + k]:
                        k += 1
                    found.append((k, i, j))
        if found and max(found)[0] > 2 * search and longest_known != max(found)[0]:
            search = longest_known = max(found)[0]  # very long matches first
            continue
        again = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(x is not None for x in p[i : i + k]) and all(x is not None for x in q[j : j + k]):
                out.append((i, j, k))
                p[i : i + k] = [None] * k
                q[j : j + k] = [None] * k
            else:
                again = True  # a part of it may be unmarked still and as long as `search`
        if again and _any_left(p, q, search):
            continue
        if search == least:
            break
        search = max(least, search // 2) if search > 2 * least else least
    return out


def _any_left(p: list[int | None], q: list[int | None], length: int) -> bool:
    a, b = _running(p, length), _running(q, length)
    return any(p[i : i + length] == q[j : j + length] for h in a.keys() & b.keys() for i in a[h] for j in b[h])


def index_items(rows: list[tuple[int | None, str]], least: int = LEAST) -> Items:
    ids, tokens = [], []
    by_length: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
    column = texts_of(pa.array([t for _, t in rows], pa.large_string()))
    for lo, hi, raw, off in chunks(column):
        buf = _LOWER[raw]
        s, e, words = split_words(buf, off, _GAP)
        word = span_hash(prefix_sums(buf), s, e)
        for i in range(hi - lo):
            a, b = int(words[i]), int(words[i + 1])
            if a == b:
                continue
            n = min(least, b - a)
            by_length[n].append((gram_hash(word[a:b], n), len(ids)))
            ids.append(rows[lo + i][0])
            tokens.append([buf[x:y].tobytes() for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True)])
    seeds = {}
    for n, parts in by_length.items():
        h = np.concatenate([x for x, _ in parts])
        owner = np.concatenate([np.full(len(x), i) for x, i in parts])
        place = np.concatenate([np.arange(len(x)) for x, _ in parts])
        order = np.argsort(h, kind="stable")
        bits = max(16, int(len(h)).bit_length() + 4)
        known = np.zeros(1 << bits, dtype=bool)
        known[(h & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        seeds[n] = (known, h[order], owner[order], place[order])
    return Items(ids, tokens, seeds)


def judge(items: Items, raw: np.ndarray, off: np.ndarray, least: int = LEAST, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, int, float]]:
    """(row, item, tiled, item tokens, tiles, coverage) of the pairs that count."""
    buf = _LOWER[raw]
    s, e, words = split_words(buf, off, _GAP)
    if not len(s):
        return []
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(words))
    word = span_hash(prefix_sums(buf), s, e)
    out = []
    for n, (known, hashes, owner, place) in items.seeds.items():
        grams = gram_hash(word, n)
        at = np.flatnonzero(known[(grams & np.uint64(len(known) - 1)).astype(np.int64)])
        at = at[row_of[at] == row_of[at + n - 1]] if len(at) else at
        lo, hi = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
        at, lo, k = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            continue
        seed = ragged(lo, k)
        word_at, item, where = np.repeat(at, k), owner[seed], place[seed]
        row = row_of[word_at]
        order = np.lexsort((word_at, item, row))
        row, item, where, word_at = row[order], item[order], where[order], word_at[order]
        cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]), [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            tokens = items.tokens[int(item[a])]
            covered = np.zeros(len(tokens) + 1, dtype=np.int64)
            for shift in range(n):
                covered[where[a:b] + shift] = 1
            if covered[:-1].sum() < threshold * len(tokens):
                continue  # tiles cover no more than seeds do
            # Every match lies in the words that its seeds cover; a gap between such stretches matches nothing.
            text: list[bytes | None] = []
            last = -2
            for w in np.unique(np.concatenate([word_at[a:b] + i for i in range(n)])).tolist():
                if w != last + 1:
                    text.append(None)
                text.append(buf[s[w] : e[w]].tobytes())
                last = w
            tiles = tile(tokens, text, least)
            tiled = sum(t[2] for t in tiles)
            if tiled >= threshold * len(tokens):
                out.append((int(row[a]), int(item[a]), tiled, len(tokens), len(tiles), tiled / len(tokens)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """MATCHES: a row for each row of docs(doc_id, text) and item of benchmark(item_id, text) that count."""
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for sent in _blocks(docs.sparkSession, benchmark, least, block_bytes):
        found = _matches(rows, sent, least, threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(spark: SparkSession, benchmark: DataFrame, least: int, block_bytes: int) -> Iterator:
    """Broadcasts of the items, block_bytes of their texts in each."""
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for block in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(index_items([(r["item_id"], r["text"]) for r in held], least))


def _matches(rows: DataFrame, sent, least: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            doc = batch.column(0).to_pylist()
            found = [(doc[lo + r], items.ids[i], *rest) for lo, _, raw, off in chunks(batch.column(1)) for r, i, *rest in judge(items, raw, off, least, threshold)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "tiled", "item_tokens", "tiles", "coverage"])

    return rows.mapInArrow(run, MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay. Rows are judged where they are read."""
    for sent in _blocks(docs.sparkSession, benchmark, least, block_bytes):
        docs = _without(docs, sent, least, threshold)
    return docs


def _without(docs: DataFrame, sent, least: int, threshold: float) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, _, raw, off in chunks(batch.column(at)):
                for r, *_ in judge(sent.value, raw, off, least, threshold):
                    keep[lo + r] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
