"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its words (runs of letters and digits, lower case) and their first four to seven bytes, hashed to TERMS
places; presence counts. The score is the logistic of bias + sum of w over the terms + the sum over pairs of <v_i, v_j>,
so that two terms together, such as an insult with a group mention, can weigh more than both alone.

The model is fitted on the driver from at most `sample_docs` labelled documents, the first by hash. Its terms are those
that tell something alone (chi-square of at least `least_chi2`, the best `keep`) and those that tell something in a pair:
of the `screen` most frequent terms all pairs are scored by how far the documents with both lie from what a linear model of
the first terms says of them, in standard deviations, and the terms of pairs of `least_z` or more come in, the best `keep`.
Terms that only matter together, as when either word alone is harmless, or either excuses the other, are found by the
second. The machine is trained on both by Adam. The model has a fixed size.

Defined cases: a null text is empty and gets the bias's score; rows are scored one by one, so repeated rows get equal
scores; documents with several labels count as toxic if any says so, null labels don't count; with no labels every score
is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, hash_sample, mix, prefix_sums, read_table, span_hash, split_words, texts_of, written
from .lang_crf import _LOWER, held_out

TERMS = 1 << 20
PREFIXES = (4, 5, 6, 7)
_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


@dataclass
class Model:
    index: np.ndarray  # TERMS entries: place of the term in the weights, or -1
    bias: float
    w: np.ndarray
    v: np.ndarray  # terms x rank


def _terms(raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind of term, the term of each word; and the row of each word."""
    buf = _LOWER[raw]
    s, e, words = split_words(buf, off, _GAP)
    sums, size = prefix_sums(buf), e - s
    kinds = [mix(span_hash(sums, s, e) + np.uint64(99))]
    for n in PREFIXES:
        h = mix(span_hash(sums, s, s + np.minimum(size, n)) + np.uint64(n))
        h[size < n] = kinds[0][size < n]  # a short word is its own prefix
        kinds.append(h)
    return [(h % np.uint64(TERMS)).astype(np.int64) for h in kinds], np.repeat(np.arange(len(off) - 1), np.diff(words))


def _hits(model_index: np.ndarray, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) of the kept terms, by row."""
    kinds, row = _terms(raw, off)
    pairs = []
    n = int(model_index.max(initial=-1)) + 1
    for h in kinds:
        place = model_index[h]
        has = place >= 0
        pairs.append(row[has] * max(n, 1) + place[has])
    both = np.unique(np.concatenate(pairs))
    return both // max(n, 1), both % max(n, 1)


def scores(model: Model, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    row, place = _hits(model.index, raw, off)
    n = len(off) - 1
    z = model.bias + np.bincount(row, weights=model.w[place], minlength=n)
    for k in range(model.v.shape[1]):
        x = model.v[place, k]
        z += 0.5 * (np.bincount(row, weights=x, minlength=n) ** 2 - np.bincount(row, weights=x * x, minlength=n))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _presence(places: list[np.ndarray], n_terms: int) -> np.ndarray:
    """Rows of 0 and 1."""
    x = np.zeros((len(places), n_terms), dtype=np.float32)
    x[np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate(places) if places else []] = 1
    return x


def train(rows: list[tuple[np.ndarray, int]], n_terms: int, rank: int = 8, epochs: int = 25, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, w and v from (places, label) rows: logistic loss, Adam, mini-batches of 128."""
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in rows], dtype=np.float32)
    w, v = np.zeros(n_terms, np.float32), rng.normal(0, 0.02, (n_terms, rank)).astype(np.float32)
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    b = np.array([np.log(base / (1 - base))], np.float32)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (b, w, v)]
    t = 0
    for _ in range(epochs):
        for i in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            xb, t = _presence([rows[k][0] for k in i], n_terms), t + 1
            inner = xb @ v
            z = b + xb @ w + 0.5 * (inner**2 - xb @ (v * v)).sum(axis=1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(i)
            grads = (d.sum(keepdims=True), xb.T @ d + decay * w, xb.T @ (d[:, None] * inner) - (xb.T @ d)[:, None] * v + decay * v)
            for (p, m1, m2), g in zip(state, grads, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return float(b[0]), w, v


def interacting(rows: list[tuple[np.ndarray, int]], wide: int, alone: np.ndarray, least_z: float, at_once: int = 1024) -> np.ndarray:
    """Of terms 0 .. wide - 1, those in a pair that a linear model of the terms `alone` misjudges by least_z deviations, more
    than each of the two does, the strongest first. Sums over all rows, `at_once` at a time."""
    n_terms = max(wide, int(alone.max(initial=-1)) + 1)
    place = np.full(n_terms, -1)
    place[alone] = np.arange(len(alone))
    kept = [(x[x >= 0], y) for x, y in ((place[p], y) for p, y in rows)]
    bias, w, _ = train(kept, len(alone), rank=1, epochs=10)
    off, both, spread = np.zeros((wide, wide), np.float32), np.zeros((wide, wide), np.float32), np.ones((wide, wide), np.float32)
    for lo in range(0, len(rows), at_once):
        part = kept[lo : lo + at_once]
        p = 1 / (1 + np.exp(-np.array([bias + w[x].sum() for x, _ in part])))
        x = _presence([x[x < wide] for x, _ in rows[lo : lo + at_once]], wide)
        off += x.T @ ((np.array([y for _, y in part]) - p).astype(np.float32)[:, None] * x)
        spread += x.T @ ((p * (1 - p)).astype(np.float32)[:, None] * x)
        both += x.T @ x
    own = np.diag(off) / np.maximum(np.diag(both), 1)  # what a term's documents lie off on the whole is no pair's doing
    z = np.minimum(np.abs(off - both * own[:, None]), np.abs(off - both * own[None, :])) / np.sqrt(spread)
    best = z.max(axis=0, initial=0)
    order = np.argsort(-best, kind="stable")
    return order[best[order] >= least_z]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 16_000, keep: int = 1024, least_docs: int = 8, least_chi2: float = 15.0, screen: int = 2048, least_z: float = 6.0) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # sample_docs rows of 12 bytes: small enough to broadcast at any input size.
    sample = hash_sample(known, "doc_id", sample_docs)
    rows = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "doc_id"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((TERMS, 2), dtype=np.int64)
        totals = np.zeros(2, dtype=np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column(1), dtype=np.int64)
            for lo, hi, raw, off in chunks(batch.column(0)):
                kinds, row = _terms(raw, off)
                both = np.unique(np.concatenate([row * TERMS + h for h in kinds]))
                label = toxic[lo:hi][both // TERMS]
                for y in (0, 1):
                    seen[:, y] += np.bincount(both[label == y] % TERMS, minlength=TERMS)
                totals += np.bincount(toxic[lo:hi], minlength=2)[:2]
        at = np.flatnonzero(seen.any(axis=1))
        yield pa.RecordBatch.from_pydict({"term": np.append(at, -1), "clean": np.append(seen[at, 0], totals[0]), "toxic": np.append(seen[at, 1], totals[1])})

    counts = written(rows.mapInArrow(count, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-terms")
    whole = counts.where("term = -1").first()
    index = np.full(TERMS, -1, dtype=np.int32)
    if whole is None or not whole["clean"] + whole["toxic"]:
        return Model(index, -30.0, np.zeros(0, np.float32), np.zeros((0, 1), np.float32))
    n0, n1 = float(whole["clean"]), float(whole["toxic"])
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    chi2 = F.lit(n0 + n1) * F.pow(a * d - b * c, 2.0) / F.greatest((a + b) * (c + d) * F.lit(n1) * F.lit(n0), F.lit(1.0))
    seen = counts.where((F.col("term") >= 0) & (a + b >= least_docs)).withColumn("chi2", chi2)
    frequent = [r["term"] for r in seen.orderBy(F.desc(a + b), "term").limit(screen).collect()]
    best = [r["term"] for r in seen.where(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "term").limit(keep).collect()]
    terms = np.array(list(dict.fromkeys([*frequent, *best])), dtype=np.int64)  # the frequent ones first
    index[terms] = np.arange(len(terms))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in chunks(batch.column(0)):
                row, place = _hits(index, raw, off)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(2)[lo:hi], batch.column(1)[lo:hi], lists], names=["doc_id", "toxic", "places"])

    got = rows.mapInArrow(places, "doc_id long, toxic int, places array<int>").toArrow().combine_chunks()
    # At most sample_docs rows (more only if ids repeat); their order decides the mini-batches, so it is fixed.
    x = [np.asarray(p.values, dtype=np.int64) for p in got.column("places").combine_chunks()]
    labelled = sorted(zip(got.column("doc_id").to_pylist(), x, got.column("toxic").to_pylist(), strict=True), key=lambda r: (r[0], r[2], r[1].tobytes()))
    labelled = [(p, y) for _, p, y in labelled]
    chosen = index[np.array(best, dtype=np.int64)].astype(np.int64)
    pairs = interacting(labelled, len(frequent), chosen, least_z)[:keep]
    chosen = np.array(list(dict.fromkeys([*chosen.tolist(), *pairs.tolist()])), dtype=np.int64)
    place = np.full(len(terms), -1)
    place[chosen] = np.arange(len(chosen))
    index[terms] = place
    labelled = [(x[x >= 0], y) for x, y in ((place[p], y) for p, y in labelled)]
    return Model(index, *train(labelled, max(1, len(chosen))))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (columns of these names are replaced)."""
    docs = docs.drop("score", "predicted")
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, raw, off in chunks(batch.column(names.index("text"))):
                out[lo:hi] = scores(sent.value, raw, off)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(rate, docs.select("*").schema.add("score", "double").add("predicted", "integer"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
