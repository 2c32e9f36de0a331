"""Removal of word passages that stand in an earlier document, by prefix-partitioned suffix trees.

A window is `WINDOW` consecutive words; each word covered by a window whose words also start in a document with a smaller
doc_id goes. Suffixes are dealt to groups by a prefix of theirs and each group's tree is built in memory; nodes deeper
than WINDOW words are the repeats.

- Sparse suffixes. Only suffixes at anchors are indexed: in every window the GRAM words with the smallest hash, leftmost
  on ties. Equal windows have equal anchors, so no repeat is missed; one suffix in about twenty is kept.
- Prefixes. A suffix's group is its first GRAM words (its anchor). An anchor that only one document has is dropped before
  any text moves. Where an anchor has more than GROUP suffixes, prefixes of GRAM words are too short: its suffixes are
  dealt out by document, each part's trees decide what they can, and what stays is settled by prefixes of WINDOW words
  (128-bit hashes, without texts). There are no lengths between: a window holds its anchor anywhere, so two equal windows
  have only GRAM words from the anchor on in common for sure, and WINDOW words from their start; and copies, which make
  the large groups, have long prefixes in common too.
- Trees. A suffix comes with the words of the windows that have it as their anchor. In a group the suffixes from all those
  windows' starts are sorted by ranks of 1, 2, 4, ... words and the lengths of the prefixes that neighbours share give the
  tree: a run of neighbours that share d words or more is an internal node of depth d. Nodes of depth WINDOW or more are the
  repeats (maximal_repeats lists them all); of each topmost one all but its smallest doc_id lose the window.

Before suffixes are shuffled, equal ones of a chunk meet: all but the smallest document's are decided there. Whole
documents that are copies of another are found by digest and don't enter the trees.

Defined cases: a null text has no words; rows with a null doc_id are neither earlier nor later than others: they keep all
words; repeated rows of a doc_id don't remove each other and get equal results; an empty table gives no rows; other
columns are ignored; a text of any length is read whole, a long one alone. Words are compared by 64-bit hashes, fifty at a time.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, gram_hash, mix, prefix_sums, ragged, read_table, span_hash, split_words, written

WINDOW, GRAM, GROUP = 50, 8, 4096
CHUNK = (2 << 20) - 64
_PLACE = np.uint64((1 << 28) - 1)  # words of one text at most


@dataclass
class Anchors:
    starts: np.ndarray  # bytes of words
    ends: np.ndarray
    words: np.ndarray  # words before each row
    word: np.ndarray  # hashes of words
    hash: np.ndarray  # of each anchor
    lo: np.ndarray  # first and last start of a window with this anchor (words of the chunk)
    hi: np.ndarray
    rows: np.ndarray  # anchors before each row


def anchors(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Anchors:
    s, e, words = split_words(buf, off)
    word = span_hash(prefix_sums(buf), s, e)
    none = np.zeros(0, dtype=np.int64)
    if len(s) < window:
        return Anchors(s, e, words, word, none.astype(np.uint64), none, none, np.zeros(len(off), dtype=np.int64))
    grams = gram_hash(word, gram)
    # The smallest hash and, among equals, the leftmost place: 36 bits of hash over the place.
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(words))
    place = (np.arange(len(grams), dtype=np.uint64)) & _PLACE
    x = (grams & ~_PLACE) | place
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    first = np.flatnonzero(row_of[: len(row_of) - window + 1] == row_of[window - 1 :])  # valid windows
    if not len(first):
        return Anchors(s, e, words, word, none.astype(np.uint64), none, none, np.zeros(len(off), dtype=np.int64))
    low = (x[first] & _PLACE).astype(np.int64)
    at = first + ((low - first) & int(_PLACE))
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row_of[first[1:]] != row_of[first[:-1]]))))
    last = np.concatenate((new[1:], [len(first)])) - 1
    lo, hi = first[new], first[last]
    return Anchors(s, e, words, word, grams[at[new]], lo, hi, np.searchsorted(row_of[lo], np.arange(len(off))))


def _strings(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    data = buf[ragged(starts, sizes)]
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32()))


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of flagged entries of one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]


SUFFIXES = "h long, salt int, salts int, doc_id long, fp long, starts array<int>, context string"
SPANS = "doc_id long, fp long, first int, end int, k1 long, k2 long"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """doc_id, fp, hashes: the anchors of each text of WINDOW words or more, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(2)):
                found = anchors(buf, off)
                sizes = np.diff(found.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(found.hash.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], lists], names=["doc_id", "fp", "hashes"])
                yield out.filter(pa.array(sizes > 0))

    return docs.select("doc_id", "fp", "text").mapInArrow(run, "doc_id long, fp long, hashes array<long>")


def _suffix_rows(docs: DataFrame) -> DataFrame:
    """SUFFIXES of docs(doc_id, fp, text, idx, salts): the listed anchors with the words of their windows. Equal ones of a
    chunk meet here; decided spans come as rows without a context, starts = [first, end]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_all, fp_all = (np.asarray(batch.column(i)) for i in (0, 1))
            idx, salts = batch.column(3), batch.column(4)
            list_off, idx, salts = np.asarray(idx.offsets), np.asarray(idx.values), np.asarray(salts.values)
            for lo, hi, buf, off in chunks(batch.column(2), CHUNK):
                a = anchors(buf, off)
                per = np.diff(list_off[lo : hi + 1])
                row = np.repeat(np.arange(hi - lo), per)
                pick = a.rows[row] + idx[list_off[lo] : list_off[hi]]
                n_salts = salts[list_off[lo] : list_off[hi]].astype(np.int64)
                doc, fp, w0, w1 = doc_all[lo:hi][row], fp_all[lo:hi][row], a.lo[pick], a.hi[pick] + WINDOW
                first = w0 - a.words[row]
                # Contexts are compared by two sums over the hashes of their words, and the number of words.
                p, q = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(a.word * np.uint64(k)) * _odd(len(a.word), k)))) for k in (3, 5))
                one, two = (pd.factorize(_moved(x, w0, w1, k) + (w1 - w0).astype(np.uint64))[0].astype(np.int64) for x, k in ((p, 3), (q, 5)))
                which = pd.factorize(one * (len(one) + 1) + two)[0]
                order = np.lexsort((first, fp, doc, which))
                which_o, doc_o = which[order], doc[order]
                head = np.concatenate(([True], which_o[1:] != which_o[:-1])) if len(order) else np.zeros(0, bool)
                least = doc_o[head][np.cumsum(head) - 1] if len(order) else doc_o
                late = order[doc_o > least]
                kept = order[doc_o == least]
                # One row for all places of a context in one document.
                lead = np.concatenate(([True], (which[kept][1:] != which[kept][:-1]) | (fp[kept][1:] != fp[kept][:-1]))) if len(kept) else np.zeros(0, bool)
                own = kept[lead]
                counts = np.diff(np.concatenate((np.flatnonzero(lead), [len(kept)])))
                salt = (mix(doc[own].astype(np.uint64)) % n_salts[own].astype(np.uint64)).astype(np.int32) if len(own) else own.astype(np.int32)
                span = a.starts[w0[own]] if len(own) else own
                size = a.ends[w1[own] - 1] - span if len(own) else own
                yield pa.RecordBatch.from_arrays([
                    pa.array(a.hash[pick[own]].view(np.int64)), pa.array(salt), pa.array(n_salts[own], pa.int32()), pa.array(doc[own]), pa.array(fp[own]),
                    _lists(first[kept], counts), _strings(buf, span, size).cast(pa.string()),
                ], names=["h", "salt", "salts", "doc_id", "fp", "starts", "context"])
                if len(late):
                    both = np.stack((first[late], first[late] + w1[late] - w0[late]), axis=1).ravel()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(fp[late]), pa.array(np.zeros(len(late), np.int32)), pa.array(np.ones(len(late), np.int32)), pa.array(doc[late]), pa.array(fp[late]),
                        _lists(both, np.full(len(late), 2)), pa.nulls(len(late), pa.string()),
                    ], names=["h", "salt", "salts", "doc_id", "fp", "starts", "context"])

    return docs.mapInArrow(run, SUFFIXES)


_ODD: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if k not in _ODD or len(_ODD[k][0]) < n:
        base = 0x9E3779B97F4A7C15 * k % 2**64 | 1
        size = 1 << max(12, n.bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _ODD[k] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _ODD[k][0][:n], _ODD[k][1][:n]


def _odd(n: int, k: int) -> np.ndarray:
    return _both(n, k)[0]


def _moved(sums: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return mix((sums[b] - sums[a]) * _both(len(sums), k)[1][a])


def suffix_tree(word: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes word[i : end[i]] of starts i, in order (of words' numbers), and how many words each has in common with
    the one before it (0 for the first). Ranks of 1, 2, 4, ... words are each made of two ranks of half the length."""
    n, size = len(word), end - np.arange(len(word))
    rank = [np.unique(word, return_inverse=True)[1].astype(np.int64) + 1]
    have = 1
    while have < int(size[starts].max(initial=1)):
        at = np.minimum(np.arange(n) + have, n - 1)
        rest = np.where(size > have, rank[-1][at], 0)  # 0: the suffix ends there
        rank.append(np.unique(rank[-1] * (n + 1) + rest, return_inverse=True)[1].astype(np.int64) + 1)
        have *= 2
    order = starts[np.argsort(rank[-1][starts], kind="stable")]
    shared = np.zeros(len(order), dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    both = np.zeros(len(a), dtype=np.int64)
    for k in range(len(rank) - 1, -1, -1):
        left = np.minimum(end[order[:-1]] - a, end[order[1:]] - b)
        x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
        step = np.where((left > 0) & (rank[k][x] == rank[k][y]), np.minimum(left, 1 << k), 0)
        a, b, both = a + step, b + step, both + step
    shared[1:] = both
    return order, shared


def subtrees(shared: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, the number of its topmost node of `depth` or more words (a leaf is one of its own)."""
    return np.cumsum(shared < depth) - 1


def maximal_repeats(shared: np.ndarray, depth: int) -> list[tuple[int, int, int]]:
    """(first, end, words) of all internal nodes of `depth` or more words: suffixes first .. end - 1 in order have that
    many words in common, and no more."""
    out, open_ = [], []
    for i, k in enumerate([*shared[1:].tolist(), 0], 1):
        first = i - 1
        while open_ and open_[-1][1] > k:
            first, words = open_.pop()
            if words >= depth:
                out.append((first, i, words))
        if k and (not open_ or open_[-1][1] < k):
            open_.append((first, k))
    return out


def _tree(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """SPANS decided by whole groups of SUFFIXES, and of split groups the windows that stay, by their hashes."""
    known = table.column("context").is_valid().to_numpy()
    done = table.filter(pa.array(~known))
    if len(done):
        pairs = np.asarray(done.column("starts").combine_chunks().values).reshape(-1, 2)
        blank = pa.nulls(len(done), pa.int64())
        yield pa.RecordBatch.from_arrays([done.column("doc_id").combine_chunks(), done.column("fp").combine_chunks(), pa.array(pairs[:, 0], pa.int32()), pa.array(pairs[:, 1], pa.int32()), blank, blank], names=["doc_id", "fp", "first", "end", "k1", "k2"])
    table = table.filter(pa.array(known))
    if not len(table):
        return
    salts, doc, fp = (np.asarray(table.column(c).combine_chunks()) for c in ("salts", "doc_id", "fp"))
    starts = table.column("starts").combine_chunks()
    start_off, starts = np.asarray(starts.offsets), np.asarray(starts.values)
    base = 0
    for lo, hi, buf, off in chunks(table.column("context"), 1 << 62):
        s, e, words = split_words(buf, off)
        word = span_hash(prefix_sums(buf), s, e)
        per = np.diff(words) - WINDOW + 1  # windows of each suffix
        at, owner = ragged(words[:-1], per), np.repeat(np.arange(hi - lo), per)
        order, shared = suffix_tree(word, np.repeat(words[1:], np.diff(words)), at)
        node = np.empty(len(word), dtype=np.int64)
        node[order] = subtrees(shared, WINDOW)
        node = node[at]
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[owner])
        gone = doc[owner] > least[node]
        a, b = _runs(gone, owner)
        own, shift = owner[a], at - words[:-1][owner]
        counts = np.diff(start_off)[own]
        each = ragged(start_off[own], counts)
        first = starts[each] + np.repeat(shift[a], counts)
        size = np.repeat(b - a + WINDOW, counts)
        blank = pa.nulls(len(first), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc[own], counts)), pa.array(np.repeat(fp[own], counts)), pa.array(first, pa.int32()), pa.array(first + size, pa.int32()), blank, blank], names=["doc_id", "fp", "first", "end", "k1", "k2"])
        open_ = np.flatnonzero(~gone & (salts[owner] > 1))
        if len(open_):
            k1, k2 = gram_hash(word, WINDOW)[at[open_]], gram_hash(mix(word), WINDOW)[at[open_]]
            own = owner[open_]
            counts = np.diff(start_off)[own]
            first = starts[ragged(start_off[own], counts)] + np.repeat(shift[open_], counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc[own], counts)), pa.array(np.repeat(fp[own], counts)), pa.array(first, pa.int32()), pa.array(first + WINDOW, pa.int32()), pa.array(np.repeat(k1, counts).view(np.int64)), pa.array(np.repeat(k2, counts).view(np.int64))], names=["doc_id", "fp", "first", "end", "k1", "k2"])
        base = hi
    assert base == len(table)


def _trees(suffixes: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < chunk_bytes:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h, salt = (np.asarray(table.column(c).combine_chunks()) for c in ("h", "salt"))
            ends = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))
            if len(ends):  # whole groups only
                yield from _tree(table.slice(0, int(ends[-1]) + 1))
                rest = table.slice(int(ends[-1]) + 1).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes
        if held:
            yield from _tree(pa.Table.from_batches(held).combine_chunks())

    return suffixes.mapInArrow(run, SPANS)


def fingerprinted(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))


def repeated_spans(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of base(doc_id, fp, text): (doc_id, fp, spans: array of (first, end) in words, to be removed), and (doc_id, fp) of
    documents that are copies of one with a smaller doc_id."""
    known = base.where(F.col("doc_id").isNotNull())
    ids = known.select("doc_id", "fp", F.sha2("text", 256).alias("digest"))
    firsts = written(ids.groupBy("digest").agg(F.min(F.struct("doc_id", "fp")).alias("x")).select("x.*"), "first-documents")
    copies = ids.select("doc_id", "fp").join(firsts, ["doc_id", "fp"], "left_anti").distinct()
    found = written(_anchor_rows(known).join(firsts, ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"]), "anchors")
    several = found.select("doc_id", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    several = written(several.where("a <> b").select("h", F.ceil(F.col("n") / GROUP).cast("int").alias("salts")), "shared-anchors")
    listed = found.select("doc_id", "fp", F.posexplode("hashes").alias("idx", "h")).join(several, "h").groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list(F.struct("idx", "salts"))).alias("x"))
    wanted = written(listed.select("doc_id", "fp", F.transform("x", lambda y: y["idx"]).alias("idx"), F.transform("x", lambda y: y["salts"]).alias("salts")), "wanted-anchors")
    texts = known.join(wanted, ["doc_id", "fp"]).select("doc_id", "fp", "text", "idx", "salts")
    suffixes = _suffix_rows(texts).repartition(F.col("h"), F.col("salt")).sortWithinPartitions("h", "salt")
    spans = written(_trees(suffixes), "repeated-spans")
    # Windows of split groups: by all their words.
    left = spans.where("k1 IS NOT NULL")
    least = left.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    late = left.join(least, ["k1", "k2"]).where("doc_id > least")
    all_spans = spans.where("k1 IS NULL").select("doc_id", "fp", "first", "end").unionByName(late.select("doc_id", "fp", "first", "end"))
    return all_spans.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("first", "end")).alias("spans")), copies


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs(doc_id, text), and kept_text if asked for."""
    base = fingerprinted(docs)
    spans, copies = repeated_spans(base)
    fate = spans.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("spans", F.array().cast(spans.schema["spans"].dataType)).withColumn("copy", F.lit(True)))
    rows = base.join(fate, ["doc_id", "fp"], "left").select("doc_id", "text", F.transform("spans", lambda x: x["first"]).alias("first"), F.transform("spans", lambda x: x["end"]).alias("end"), F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, first, end, copy in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words = text.as_py().split()  # bytes: blank and 09 to 0D
                kept = words
                if copy and len(words) >= WINDOW:
                    kept = []
                elif first:
                    depth = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, end, -1)
                    kept = list(itertools.compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if keep_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 5
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made[: 4 + keep_text], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"), keep_text=False)
