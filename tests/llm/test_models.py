"""The random field and the factorization machine: exactness against enumeration, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quasilattice.llm import lang_crf, toxicity_fm
from quasilattice.llm.common import chunks, texts_of

SYLLABLES = {"aa": "bla kro sti nen".split(), "bb": "ciu mar tol eza".split(), "cc": "üng öch sße täv".split()}


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def brute_marginals(scores, moves):
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for i, y in enumerate(path):
            out[i, y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_equal_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    for block in (2, 3, 32):
        monkeypatch.setattr(lang_crf, "BLOCK", block)
        sizes = [0, 1, 7, 0, 4, 6]
        scores, moves = rng.normal(0, 2, (sum(sizes), 3)), rng.normal(0, 1, (3, 3))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        got = lang_crf.marginals(scores, ends, moves)
        want = np.concatenate([brute_marginals(scores[a:b], moves) for a, b in itertools.pairwise(ends) if b > a])
        assert np.allclose(got, want)


def test_languages_of_held_out_documents(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        lang = rng.choice("aa bb cc".split())
        text = words(rng, lang, rng.randrange(5, 60))
        if i % 10 == 0:
            text += " " + words(rng, rng.choice("aa bb cc".split()), 3)
        rows.append((i, text, lang if i % 7 else None, lang))
    odd = [(1000, None), (1001, ""), (1002, "12 34 !!"), (1003, rows[0][1]), (1003, rows[0][1]), (1004, words(rng, "aa", 20000)), (None, "bla kro")]
    docs = spark.createDataFrame([r[:3] for r in rows] + [(d, t, None) for d, t in odd], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = lang_crf.fit(docs)
    got = lang_crf.identify(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    test = [(i, lang) for i, _, _, lang in rows if held_out(i)]
    assert np.mean([by_id[i]["lang_pred"] == lang for i, lang in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", by_id[0]["lang_pred"], "aa"]
    assert lang_crf.fit(docs.where("lang IS NULL")).labels == []
    none = lang_crf.identify(docs.select("doc_id", "text"), lang_crf.fit(docs.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert lang_crf.identify(docs.select("doc_id", "text").limit(0), model).count() == 0


def test_switches_are_labelled_word_by_word():
    rng = random.Random(2)
    texts = [words(rng, lang, 50) for lang in SYLLABLES for _ in range(40)]
    model = lang_crf.train(texts, [lang for lang in SYLLABLES for _ in range(40)], sequences=2000)
    mixed = texts_of(pa.array([words(rng, "aa", 30) + " " + words(rng, "bb", 30)]))
    _, _, raw, off = next(chunks(mixed))
    s, e, n = lang_crf.split_words(raw, off, lang_crf._NOT_LETTER)
    best = lang_crf.marginals(lang_crf.emissions(model.weights, raw, s, e), n, model.transitions).argmax(axis=1)
    assert (best == np.repeat([0, 1], 30)).mean() > 0.95


def test_short_texts_teach():
    """A language whose texts are all under a passage, and one that is written without blanks."""
    rng = random.Random(4)
    glue = lambda lang, n: words(rng, lang, n).replace(" ", "")
    make = {"aa": lambda: words(rng, "aa", 40), "bb": lambda: words(rng, "bb", rng.randrange(2, 12)), "cc": lambda: glue("cc", 20)}
    texts, langs = zip(*((f(), lang) for lang, f in make.items() for _ in range(60)), strict=True)
    model = lang_crf.train(list(texts), list(langs), sequences=1500)
    right = []
    for lang, f in make.items():
        for text in (f() for _ in range(20)):
            _, _, raw, off = next(chunks(texts_of(pa.array([text]))))
            s, e, n = lang_crf.split_words(raw, off, lang_crf._NOT_LETTER)
            got = lang_crf.marginals(lang_crf.emissions(model.weights, raw, s, e), n, model.transitions).sum(axis=0)
            right.append(model.labels[got.argmax()] == lang)
    assert np.mean(right) > 0.95


def brute_score(model, text):
    """The machine's value by its definition: all pairs."""
    _, _, raw, off = next(chunks(texts_of(pa.array([text]))))
    _, places = toxicity_fm._hits(model.index, raw, off)
    z = model.bias + model.w[places].sum() + sum(float(model.v[a] @ model.v[b]) for a, b in itertools.combinations(places, 2))
    return 1 / (1 + np.exp(-z))


def test_interactions_are_learned(spark):
    """An insult alone or a group alone is fine; both are toxic."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1600):
        w = [f"n{rng.randrange(200)}" for _ in range(rng.randrange(5, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += [rng.choice(["scumbagger", "scumbagged"])] * insult + [rng.choice(["martians", "venusians"])] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group)))
    odd = [(5000, None), (5001, ""), (5002, "martians " * 20000), (5003, rows[3][1]), (None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (9999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity_fm.fit(docs, marks)
    got = {r["doc_id"]: r for r in toxicity_fm.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    test = [(got[i]["predicted"], y) for i, y in labels if held_out(i)]
    assert np.mean([p == y for p, y in test]) > 0.97
    assert got[5000]["score"] == got[5001]["score"] and got[5003]["score"] == got[3]["score"] and got[5002]["predicted"] == 0
    for i in (0, 1, 2, 10):
        assert abs(got[i]["score"] - brute_score(model, rows[i][1])) < 1e-4
    assert toxicity_fm.score(docs.select("doc_id", "text").limit(0), model).count() == 0
    silent = toxicity_fm.fit(docs, marks.limit(0))
    assert {r["score"] < 1e-9 for r in toxicity_fm.score(docs.select("doc_id", "text"), silent).collect()} == {True}


def test_terms_that_only_tell_together_are_learned(spark):
    """Toxic is one of two words without the other: neither tells anything alone. And several labels a document."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(3000):
        w = [f"n{rng.randrange(2000)}" for _ in range(rng.randrange(5, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += [rng.choice(["scumbagger", "rotter"])] * insult + [rng.choice(["martians", "venusians"])] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels += [(i, int(insult != group)), (i, 0)]
    model = toxicity_fm.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity_fm.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert np.mean([got[i] == y for i, y in labels[::2] if held_out(i)]) > 0.95


def test_short_texts_of_two_languages(spark):
    """Labelled texts of five words only."""
    rng = random.Random(7)
    rows = [(i, words(rng, lang, 5), lang) for i, lang in enumerate(["aa", "bb"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in lang_crf.identify(docs, lang_crf.fit(docs)).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows if held_out(i)]) > 0.95
