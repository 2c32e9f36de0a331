"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters. A word's emission scores are sums of hashed feature weights: two prefixes, two suffixes, all
character trigrams (bytes) and the word itself (the lexicon). Transitions between languages are learned with them by
gradient ascent on the conditional likelihood of sequences spliced from passages of several documents, so that switches
occur; texts of any length teach. Forward-backward gives each word's language distribution; a text's language is the one with most expected words,
its score that share.

Long texts are cut into blocks whose transfer matrices are chained, so that a whole text is labelled exactly and many
blocks advance together.

The model is fitted on the driver from at most `sample_docs` labelled documents of at most `sample_chars` characters, the
first by hash. It has a fixed size and is sent to the executors.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows are judged one by one, so repeated rows
and ids get equal results; with no labelled rows everything is `und`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, hash_sample, mix, prefix_sums, ragged, read_table, span_hash, split_words, texts_of, unused

TABLE = 1 << 18
BLOCK = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # TABLE x labels
    transitions: np.ndarray  # labels x labels: from, to


def _trigrams(buf: np.ndarray) -> np.ndarray:
    """Feature of the three bytes from each byte on (two entries fewer than bytes)."""
    b = buf.astype(np.uint64)
    return (mix(b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) % np.uint64(TABLE)).astype(np.int64)


def _word_features(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Five features of each word: itself, prefixes and suffixes of two and three bytes (as much as it has)."""
    sums, size = prefix_sums(buf), e - s
    out = []
    for kind, a, z in ((1, s, e), (2, s, s + np.minimum(size, 2)), (3, s, s + np.minimum(size, 3)), (4, e - np.minimum(size, 2), e), (5, e - np.minimum(size, 3), e)):
        out.append((mix(span_hash(sums, a, z) + np.uint64(kind)) % np.uint64(TABLE)).astype(np.int64))
    return out


def emissions(model_weights: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    out = np.zeros((len(s), model_weights.shape[1]), dtype=np.float64)
    if not len(s):
        return out
    for f in _word_features(buf, s, e):
        out += model_weights[f]
    if len(buf) > 2:
        total = np.zeros((len(buf) - 1, model_weights.shape[1]))
        np.cumsum(model_weights[_trigrams(buf)], axis=0, out=total[1:])
        has = e - s > 2
        out[has] += total[e[has] - 2] - total[s[has]]
    return out


def marginals(scores: np.ndarray, words: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Each word's label distribution. words: for each row the number of words before it (one entry more than rows)."""
    n_labels = transitions.shape[0]
    per_row = np.diff(words)
    if not len(scores):
        return scores
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))
    psi = np.maximum(psi, 1e-30)
    step = np.exp(transitions - transitions.max())
    blocks = -(-per_row // BLOCK)
    first = np.cumsum(blocks) - blocks  # of each row
    n = int(blocks.sum())
    place = ragged(first * BLOCK, per_row)  # of each word in the grid of blocks
    grid = np.ones((n * BLOCK, n_labels))
    grid[place] = psi
    grid = grid.reshape(n, BLOCK, n_labels)
    used = np.zeros(n * BLOCK, dtype=bool)
    used[place] = True
    used = used.reshape(n, BLOCK)
    opens = np.zeros(n, dtype=bool)
    opens[first[blocks > 0]] = True

    # The transfer matrix of each block. A row's first word has no transition before it; places without words do nothing.
    carry = np.tile(np.eye(n_labels), (n, 1, 1))
    for t in range(BLOCK):
        moved = (carry.reshape(-1, n_labels) @ step).reshape(carry.shape)
        if t == 0:
            moved[opens] = carry[opens]
        moved *= grid[:, t, None, :]
        carry = moved if used[:, t].all() else np.where(used[:, t, None, None], moved, carry)
    carry /= carry.max(axis=(1, 2), keepdims=True)

    # Across the blocks of each row, all rows at once.
    alpha, beta = np.full((n, n_labels), 1.0), np.full((n, n_labels), 1.0)
    rows = np.argsort(-blocks, kind="stable")
    sizes = blocks[rows]
    for k in range(1, int(sizes[0])):
        live = first[rows[: np.searchsorted(-sizes, -k, "left")]]
        x = np.einsum("ni,nij->nj", alpha[live + k - 1], carry[live + k - 1])
        alpha[live + k] = x / x.max(axis=1, keepdims=True)
    for k in range(1, int(sizes[0])):
        live = rows[: np.searchsorted(-sizes, -k, "left")]
        at = first[live] + blocks[live] - 1 - k
        x = np.einsum("nij,nj->ni", carry[at + 1], beta[at + 1])
        beta[at] = x / x.max(axis=1, keepdims=True)

    # Within blocks.
    ahead = np.empty_like(grid)
    x = alpha
    for t in range(BLOCK):
        moved = x @ step
        if t == 0:
            moved[opens] = x[opens]
        moved *= grid[:, t]
        x = np.where(used[:, t, None], moved, x)
        x = x / x.max(axis=1, keepdims=True)
        ahead[:, t] = x
    x = beta
    for t in range(BLOCK - 1, -1, -1):
        ahead[:, t] *= x
        moved = (x * grid[:, t]) @ step.T
        x = np.where(used[:, t, None], moved, x)
        x = x / np.maximum(x.max(axis=1, keepdims=True), 1e-300)
    out = ahead.reshape(-1, n_labels)[place]
    return out / out.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], passage: int = 16, splices: int = 4, sequences: int = 5000, epochs: int = 6, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> Model:
    """Fit weights and transitions on `sequences` sequences of `splices` passages of `passage` words. Texts shorter than a
    passage and last parts of texts are passages too, filled up by going round their words; passages of a language are drawn
    in proportion to their own words, so that all its words teach equally often."""
    labels = sorted(set(langs))
    lookup = {x: i for i, x in enumerate(labels)}
    n_labels, rng = len(labels), np.random.default_rng(seed)
    column = texts_of(pa.array(texts, pa.large_string()))
    feats, spans, gold = [], [], []  # features of all words, one after the other; of each passage first and end word
    n_words = 0
    for lo, hi, raw, off in chunks(column, 1 << 19):
        buf = _LOWER[raw]
        s, e, words = split_words(buf, off, _NOT_LETTER)
        parts = _word_features(buf, s, e)
        tri = _trigrams(buf) if len(buf) > 2 else np.zeros(0, np.int64)
        inner = np.maximum(e - s - 2, 0)
        sizes = inner + len(parts)
        flat = np.empty(int(sizes.sum()), dtype=np.int32)
        at = np.cumsum(sizes) - sizes
        for j, f in enumerate(parts):
            flat[at + j] = f
        flat[ragged(at + len(parts), inner)] = tri[ragged(s, inner)]
        feats.append((flat, sizes))
        for i in range(hi - lo):
            a, b = int(words[i]), int(words[i + 1])
            for p in range(a, b, passage):
                spans.append((n_words + p, n_words + min(b, p + passage)))
                gold.append(lookup[langs[lo + i]])
        n_words += len(s)
    flat, sizes = np.concatenate([f for f, _ in feats]), np.concatenate([z for _, z in feats])
    starts = np.cumsum(sizes) - sizes
    spans, gold = np.array(spans, dtype=np.int64), np.array(gold)
    width = spans[:, 1] - spans[:, 0] if len(spans) else np.zeros(0, np.int64)
    weights, moves = np.zeros((TABLE, n_labels)), np.zeros((n_labels, n_labels))
    g_weights, g_moves = np.full((TABLE, n_labels), 1e-3), np.full((n_labels, n_labels), 1e-3)
    if not len(spans):
        return Model(labels, weights.astype(np.float32), moves)
    by_label = [np.flatnonzero(gold == y) for y in range(n_labels)]
    by_label = [(x, np.cumsum(width[x])) for x in by_label if len(x)]
    size, steps = 256, splices * passage
    for _ in range(epochs):
        for _ in range(max(1, sequences // size)):
            # Languages evenly, so that no language is favoured for being frequent.
            drawn = [by_label[i] for i in rng.integers(len(by_label), size=size * splices)]
            pick = np.array([x[np.searchsorted(ends, rng.integers(ends[-1]), "right")] for x, ends in drawn])
            y = np.repeat(gold[pick], passage).reshape(size, steps)
            word = (spans[pick, 0][:, None] + np.arange(passage) % width[pick][:, None]).ravel()
            f = flat[ragged(starts[word], sizes[word])]
            bound = np.cumsum(sizes[word]) - sizes[word]
            score = np.add.reduceat(weights[f], bound, axis=0).reshape(size, steps, n_labels)
            psi, step = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(moves)
            fwd, bwd = np.empty_like(psi), np.ones_like(psi)
            x = np.full((size, n_labels), 1.0)
            for t in range(steps):
                x = (x @ step if t else x) * psi[:, t]
                x /= x.sum(axis=1, keepdims=True)
                fwd[:, t] = x
            for t in range(steps - 2, -1, -1):
                x = (bwd[:, t + 1] * psi[:, t + 1]) @ step.T
                bwd[:, t] = x / x.sum(axis=1, keepdims=True)
            gamma = fwd * bwd
            gamma /= gamma.sum(axis=2, keepdims=True)
            pair = fwd[:, :-1, :, None] * step * (bwd[:, 1:] * psi[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            want = np.zeros((n_labels, n_labels))
            np.add.at(want, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            d_moves = (want - pair.sum(axis=(0, 1))) / size - decay * moves
            d_word = (np.eye(n_labels)[y.ravel()] - gamma.reshape(-1, n_labels)) / size
            spread = np.repeat(d_word, sizes[word], axis=0)
            d_weights = np.stack([np.bincount(f, weights=spread[:, k], minlength=TABLE) for k in range(n_labels)], axis=1) - decay * weights
            g_weights += d_weights**2
            g_moves += d_moves**2
            weights += rate * d_weights / np.sqrt(g_weights)
            moves += rate * d_moves / np.sqrt(g_moves)
    return Model(labels, weights.astype(np.float32), moves)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, sample_docs: int = 1200, sample_chars: int = 20_000) -> tuple[list[str], list[str]]:
    """At most sample_docs labelled documents that aren't held out, the first by hash: a bounded sample, on the driver."""
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= sample_chars))
    rows = sorted(hash_sample(known.select("doc_id", "text", "lang"), "doc_id", sample_docs).collect())
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: Model, outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, in columns named by outputs (columns of these names are replaced).
    For single words see marginals()."""
    spark, docs = docs.sparkSession, docs.drop(*outputs)
    sent = spark.sparkContext.broadcast(model)
    names = docs.columns
    letter = unused("has_letter", names)
    ready = docs.select(*(F.col(c) for c in names), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            text = texts_of(batch.column(names.index("text")))
            share = np.zeros((len(text), max(1, len(m.labels))))
            for lo, hi, raw, off in chunks(text, 1 << 20):
                buf = _LOWER[raw]
                s, e, words = split_words(buf, off, _NOT_LETTER)
                if len(s) and m.labels:
                    total = np.zeros((len(s) + 1, len(m.labels)))
                    np.cumsum(marginals(emissions(m.weights, buf, s, e), words, m.transitions), axis=0, out=total[1:])
                    share[lo:hi] = (total[words[1:]] - total[words[:-1]]) / np.maximum(np.diff(words), 1)[:, None]
            ok = np.asarray(batch.column(len(names)).to_numpy(zero_copy_only=False), dtype=bool) & (share.sum(axis=1) > 0)
            best = share.argmax(axis=1)
            pred = [m.labels[b] if k else "und" for b, k in zip(best.tolist(), ok.tolist(), strict=True)]
            score = np.where(ok, np.clip(share.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(pred, pa.string()), pa.array(score)], names=[*names, *outputs])

    schema = ready.drop(letter).schema.add(outputs[0], "string").add(outputs[1], "double")
    return ready.mapInArrow(label, schema)


def fit(docs: DataFrame) -> Model:
    texts, langs = training_rows(docs)
    return train(texts, langs) if texts else Model([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
