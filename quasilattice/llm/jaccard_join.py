"""N-gram Jaccard join by chosen paths.

A document's set is its shingles of five words (all words of a shorter text). Two documents are linked if the Jaccard
similarity of their sets is at least 0.8. Equal texts are one class, joined as one record with its number of rows.

1. A record is embedded in COORDS min-hash tokens: two records share a token at a coordinate with the probability of
   their similarity.
2. Chosen paths. In each run every record starts at the run's root. A node samples coordinates, each with probability
   1 / (threshold * COORDS), and sends its records on by their tokens there. Nodes of up to SMALL records are leaves;
   larger ones are split again, to DEPTH. A pair at the threshold keeps about one common branch at each level, so the
   number of runs for a target recall follows from the survival of that branching (runs_for).
3. Leaves are searched by brute force on byte sketches of the tokens. A leaf gives a spanning forest of its pairs that may
   be similar, never the pairs. Leaves that no path splits are groups of near copies: they are dealt out by record, and
   only records that no other one of their part stands for (LEADER) meet the other parts.
4. Components of these forests are candidate groups, each record in one of them. All pairs of a group are compared exactly
   on their whole sets, in blocks of BLOCK x BLOCK records, and links are counted where they are found.
5. Components of the links are the near-duplicate classes.

The only loss is of candidates: pairs without a common leaf (1 - target recall a run design, far less with the other paths
of their group) or with a sketch more than five deviations off. Every link counted is exact up to 64-bit shingle hashes.

Defined cases: a null or blank text has an empty set and no links but to equal texts; equal texts are linked; rows with a
null doc_id or a repeated one are rows like others; class_id is the smallest doc_id of the class (null if it has none);
an empty table gives no rows; other columns are ignored (keep_one: kept, whatever their names); texts are read whole, whatever
their length, a row of a long one alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, gram_hash, mix, prefix_sums, ragged, read_table, span_hash, split_words, unused, written
from .components import components

SHINGLE, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
COORDS, DEPTH, SMALL, PART, BLOCK = 64, 4, 4096, 4096, 512
#: Sketch similarities: what may be similar (five deviations below the threshold); what stands for another (their
#: partners are then at most 0.45 from it); and what may be similar to a partner of one it stands for.
MAYBE, LEADER, FAR = 0.55, 0.85, 0.35
#: Records with more than this share of all rows are too many rows for one key of a join.
HOT_SHARE = 1e-4
_SEEDS = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
PATHS = "path long, rec long, sketch binary"


def runs_for(recall: float = TARGET_RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a leaf with this probability: Poisson branching with mean one."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, row after row, and the number of each row's."""
    s, e, words = split_words(buf, off)
    word = span_hash(prefix_sums(buf), s, e)
    per = np.diff(words)
    count = np.where(per >= size, per - size + 1, (per > 0).astype(np.int64))
    grams = gram_hash(word, size)
    at = ragged(words[:-1], count)
    out = np.zeros(len(at), dtype=np.uint64)
    owner = np.repeat(per, count)
    out[owner >= size] = grams[at[owner >= size]]
    ends = np.cumsum(count)
    for n in range(1, size):  # shorter texts: all their words
        rows = np.flatnonzero(per == n)
        if len(rows):
            out[ends[rows] - 1] = gram_hash(word, n)[words[:-1][rows]] + np.uint64(n)
    return out, count


def signatures(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows x COORDS min-hash tokens (32 bits), and which rows have a shingle."""
    grams, count = shingles(buf, off)
    has = count > 0
    out = np.zeros((len(count), COORDS), dtype=np.uint32)
    if has.any():
        first = (np.cumsum(count) - count)[has]
        for i in range(COORDS):
            x = (grams ^ _SEEDS[i]) * (_SEEDS[-1 - i] | np.uint64(1))
            out[has, i] = (mix(np.minimum.reduceat(x, first)) >> np.uint64(32)).astype(np.uint32)
    return out, has


def _records(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(2)):
                tokens, has = signatures(buf, off)
                raw = tokens.astype("<u4").tobytes()
                held = [raw[4 * COORDS * i : 4 * COORDS * (i + 1)] if h else None for i, h in enumerate(has.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(held, pa.binary())], names=["doc_id", "rec", "tokens"])

    return docs.mapInArrow(run, "doc_id long, rec long, tokens binary")


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Fixed-width binary values as rows."""
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].reshape(n, -1).view(dtype)


def _binaries(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    off = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(rows)])


def _first_level(records: DataFrame, runs: int, threshold: float, seed: int) -> DataFrame:
    """PATHS without sketches: each record at the nodes that the roots' sampled coordinates lead to."""
    rate = np.uint64(int(2**64 / (threshold * COORDS)))
    picks = []
    for r in range(runs):
        draw = mix(np.arange(COORDS, dtype=np.uint64) + np.uint64((seed * 1000 + r + 1) * 7919))
        picks += [(r, i) for i in (np.flatnonzero(draw < rate) if (draw < rate).any() else [int(draw.argmin())])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rec = _matrix(batch.column(1), "<u4"), batch.column(0)
            for r, i in picks:
                path = mix(tokens[:, i].astype(np.uint64) | np.uint64(i + 1) << np.uint64(32) | np.uint64(r + 1) << np.uint64(48))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), rec], names=["path", "rec"])

    return records.where("tokens IS NOT NULL").select("rec", "tokens").mapInArrow(run, "path long, rec long")


def _next_level(rows: DataFrame, threshold: float) -> DataFrame:
    rate = np.uint64(int(2**64 / (threshold * COORDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, rec, sketch = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1)), _matrix(batch.column(2), "u1")
            row, i = np.nonzero(mix(path[:, None] + _SEEDS[None, :]) < rate)
            new = mix(path[row] * np.uint64(0x9E3779B97F4A7C15) + (i.astype(np.uint64) << np.uint64(8) | sketch[row, i]))
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(rec[row]), _binaries(sketch[row])], names=["path", "rec", "sketch"])

    return rows.select("path", "rec", "sketch").mapInArrow(run, PATHS)


def forest(sketch: np.ndarray, maybe: float = MAYBE, leader: float = LEADER) -> tuple[np.ndarray, np.ndarray]:
    """Of a leaf: each record's root among those it may be similar to, and which records another one stands for.
    If x stands for y (`leader`), all partners of y are similar enough to x to be found there, so y needn't be searched.
    Roots are the first of their trees: as leaves are in order of rec, trees of many leaves have few roots between them."""
    n = len(sketch)
    root, stood = np.arange(n), np.zeros(n, dtype=bool)
    for i in range(n - 1):
        if stood[i]:
            continue
        near = (sketch[i + 1 :] == sketch[i]).mean(axis=1)
        linked = np.flatnonzero(near >= maybe) + i + 1
        if len(linked):
            roots = np.unique(np.append(root[linked], root[i]))
            root[np.isin(root, roots)] = roots[0]
            stood[i + 1 :] |= near >= leader
    return root, stood


def _by_group(rows: DataFrame, keys: list[str], schema: str, work, chunk_bytes: int = 4 << 20) -> DataFrame:
    """work(table, starts) on whole groups of equal keys, each in order of rec; starts: first row of each group, and the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def cut(table: pa.Table) -> np.ndarray:
            change = np.zeros(max(0, len(table) - 1), dtype=bool)
            for k in keys:
                x = np.asarray(table.column(k).combine_chunks())
                change |= x[1:] != x[:-1]
            return np.flatnonzero(change) + 1

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < chunk_bytes:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            at = cut(table)
            if len(at):
                yield from work(table.slice(0, int(at[-1])), np.concatenate(([0], at)))
                held = table.slice(int(at[-1])).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, np.concatenate(([0], cut(table), [len(table)])))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "rec").mapInArrow(run, schema)


LEAVES = "a long, b long, path long, sketch binary"


def _leaf_edges(leaves: DataFrame, maybe: float, forward: bool) -> DataFrame:
    """(a, b, null, null): forest edges of leaves(path, salt, rec, sketch). forward: also the records that meet other parts,
    as (rec, rec, path, sketch)."""

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        rec, sketch = np.asarray(table.column("rec").combine_chunks()), _matrix(table.column("sketch").combine_chunks(), "u1")
        path = np.asarray(table.column("path").combine_chunks())
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        ok = (sketch[two] == sketch[two + 1]).mean(axis=1) >= maybe
        a, b, kept = [rec[two[ok]]], [rec[two[ok] + 1]], [] if not forward else [two, two + 1]
        if forward:
            kept += [starts[:-1][size == 1]]
        for lo, hi in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist(), strict=True):
            root, stood = forest(sketch[lo:hi], maybe)
            has = root != np.arange(hi - lo)
            a.append(rec[lo:hi][has])
            b.append(rec[lo:hi][root[has]])
            if forward:
                kept.append(lo + np.flatnonzero(~stood))
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], names=["a", "b", "path", "sketch"])
        if forward and (at := np.concatenate(kept)).size:
            yield pa.RecordBatch.from_arrays([pa.array(rec[at]), pa.array(rec[at]), pa.array(path[at]), _binaries(sketch[at])], names=["a", "b", "path", "sketch"])

    return _by_group(leaves.select("path", "salt", "rec", "sketch"), ["path", "salt"], LEAVES, work)


def _with_sizes(rows: DataFrame, name: str) -> DataFrame:
    """The rows of nodes with two records or more, with the node's size. Both sides are written tables, so that a node of
    many records is split among tasks."""
    rows = written(rows, name)
    sizes = written(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"{name}-sizes")
    return rows.join(sizes, "path")


def candidate_groups(records: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, seed: int = 1) -> DataFrame:
    """(node, root): the records of records(rec, tokens) that may have a partner, and their group."""
    low = F.expr(f"unhex(array_join(transform(sequence(0, {COORDS - 1}), i -> substring(hex(tokens), 8 * i + 1, 2)), ''))")
    sketches = written(records.where("tokens IS NOT NULL").select("rec", low.alias("sketch")), "sketches")
    rows = _with_sizes(_first_level(records, runs_for(recall), threshold, seed), "paths").join(sketches, "rec").select("path", "rec", "sketch", "size")
    rows = written(rows, "level")
    small, dense = None, None
    for depth in range(1, DEPTH + 1):
        leaf = rows.where(F.col("size") <= SMALL)
        small = leaf if small is None else small.unionByName(leaf)
        large = rows.where(F.col("size") > SMALL)
        if depth == DEPTH:
            dense = large
        elif large.isEmpty():
            break
        else:
            rows = written(_with_sizes(_next_level(large, threshold), "paths").select("path", "rec", "sketch", "size"), "level")
    edges = _leaf_edges(small.withColumn("salt", F.lit(0)), MAYBE, False).select("a", "b")
    if dense is not None and not dense.isEmpty():
        parts = dense.withColumn("salt", F.pmod(F.xxhash64("rec"), F.ceil(F.col("size") / PART)).cast("int"))
        first = written(_leaf_edges(parts, MAYBE, True), "dense-leaves")
        left = across_parts(first.where("path IS NOT NULL").select("path", F.col("a").alias("rec"), "sketch"))
        edges = edges.unionByName(first.where("path IS NULL").select("a", "b")).unionByName(_leaf_edges(left, FAR, False).select("a", "b"))
    return components(edges.distinct())


def across_parts(rows: DataFrame) -> DataFrame:
    """rows(path, rec, sketch) with a salt for each pair of parts of at most about PART records, so that all records of a
    path meet, in many tasks."""
    parts = rows.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = rows.join(parts, "path").withColumn("part", F.pmod(F.xxhash64("rec"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select("path", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("salt"), "rec", "sketch")


def joined_by_record(held: DataFrame, named: DataFrame) -> DataFrame:
    """held(doc_id, rec) with named(rec, rows, ...), a row a record of `rows` rows. Records with more than a HOT_SHARE of all rows,
    so at most 1 / HOT_SHARE of them, are broadcast; no task gets all copies of a text."""
    total = named.agg(F.sum("rows").alias("n")).first()["n"] or 0
    hot = F.col("rows") > max(1000, int(total * HOT_SHARE))
    first = held.join(F.broadcast(named.where(hot)), "rec", "left")
    rest = first.where("rows IS NULL").select(*held.columns).join(named.where(~hot), "rec")
    return first.where("rows IS NOT NULL").unionByName(rest)


LINKS = "rec long, links long, root long"


def _exact_links(sets: DataFrame, threshold: float) -> DataFrame:
    """LINKS of sets(root, rec, rows, block, blocks, grams): compared in pairs of blocks of one group."""
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rec", "rows", "grams")

    def group(grams: np.ndarray, sizes: np.ndarray, first: np.ndarray | None) -> np.ndarray:
        """Which pairs are linked. first: which records are of the first block, if the two differ."""
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        code, names = pd.factorize(grams)
        often = np.bincount(code, minlength=len(names)) > 1
        keep = often[code]
        number = np.cumsum(often) - 1
        code, owner = number[code[keep]], owner[keep]
        common = np.zeros((n, n), dtype=np.float32)
        width = max(256, (1 << 23) // max(n, 1))
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for lo in range(0, int(often.sum()), width):
            a, b = np.searchsorted(code, (lo, lo + width))
            x = np.zeros((n, width), dtype=np.float32)
            x[owner[a:b], code[a:b] - lo] = 1
            common += x @ x.T
        both = common.astype(np.int64)
        linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if first is not None:
            linked &= first[:, None] != first[None, :]
        return linked

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        rec, rows, x, y, block = (np.asarray(table.column(c).combine_chunks()) for c in ("rec", "rows", "x", "y", "block"))
        grams = table.column("grams").combine_chunks()
        off, grams = np.asarray(grams.offsets), np.asarray(grams.values)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            linked = group(grams[off[lo] : off[hi]], np.diff(off[lo : hi + 1]), None if x[lo] == y[lo] else block[lo:hi] == x[lo])
            has = linked.any(axis=1)
            if not has.any():
                continue
            root = np.arange(hi - lo)
            for i in np.flatnonzero(has).tolist():
                roots = np.unique(np.append(root[linked[i]], root[i]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
            out.append((rec[lo:hi][has], (linked.astype(np.int64) @ rows[lo:hi])[has], rec[lo:hi][root[has]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rec", "links", "root"])

    return _by_group(pairs, ["root", "x", "y"], LINKS, work, 8 << 20)


def _grams(rows: DataFrame) -> DataFrame:
    """rows with `text` replaced by `grams`, its distinct shingles."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(batch.schema.get_field_index("text"))):
                grams, count = shingles(buf, off)
                owner = np.repeat(np.arange(hi - lo), count)
                order = np.lexsort((grams, owner))
                grams, owner = grams[order], owner[order]
                new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))) if len(grams) else np.zeros(0, bool)
                sizes = np.bincount(owner[new], minlength=hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(grams[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c))[lo:hi] for c in names), lists], names=[*names, "grams"])

    return rows.select(*names, "text").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.drop("text").dtypes) + ", grams array<long>")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, rec, class_id, n_links, leads for each row of docs(doc_id, text): rec is the class of equal texts, class_id
    the near-duplicate class, n_links the number of other rows linked to the row; leads: the row's record and doc_id are
    those that stay if one row of a class stays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rec", F.xxhash64(F.sha2("text", 256)))
    held = written(_records(rows.select("doc_id", "rec", "text")), "records")
    records = written(held.groupBy("rec").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("tokens").alias("tokens")), "classes")
    groups = candidate_groups(records, threshold, recall)
    blocks = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = groups.withColumnRenamed("node", "rec").join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))
    placed = written(placed.join(records.select("rec", "doc_id", "rows"), "rec"), "placed")
    match = (rows["rec"] == placed["rec"]) & rows["doc_id"].eqNullSafe(placed["doc_id"])
    # Sort-merge at every size: whether a small right side is broadcast must not decide what moves.
    texts = rows.join(placed.hint("merge"), match).select("root", placed["rec"], "rows", "block", "blocks", "text").dropDuplicates(["rec"])
    links = written(_exact_links(_grams(texts), threshold), "links")
    linked = components(links.select(F.col("rec").alias("a"), F.col("root").alias("b")).distinct())
    number = links.groupBy("rec").agg(F.sum("links").alias("links"))
    classes = records.select("rec", "doc_id", "rows").join(linked.withColumnRenamed("node", "rec"), "rec", "left").join(number, "rec", "left").withColumn("root", F.coalesce("root", "rec"))
    classes = written(classes.select("rec", "root", "doc_id", "rows", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "record-classes")
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rec")).alias("x")).select("root", F.col("x.doc_id").alias("class_id"), F.col("x.rec").alias("lead"))
    named = written(classes.join(least, "root").select("rec", "rows", "class_id", "n_links", (F.col("rec") == F.col("lead")).alias("leads")), "named-classes")
    out = joined_by_record(held.select("doc_id", "rec"), named)
    return out.select("doc_id", "rec", "class_id", "n_links", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("leads"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each near-duplicate class: the smallest doc_id; of equal rows with that id, one."""
    lead, own = unused("lead", docs.columns), unused("rec", docs.columns)
    fate = near_duplicates(docs, **options).where("leads").select(F.col("doc_id").alias(lead), F.col("rec").alias(own)).distinct()
    rec = F.xxhash64(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    kept = docs.join(fate, docs["doc_id"].cast("long").eqNullSafe(F.col(lead)) & (rec == F.col(own)))
    return kept.dropDuplicates([own]).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
