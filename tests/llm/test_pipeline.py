"""The pipeline against a plain reading of its stages, on a small folder of tables."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quasilattice.llm import decontaminate, pfor
from tests.llm.test_dedup import brute_join
from tests.llm.test_models import words
from tests.llm.test_simple import expected_passes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(i, words(rng, "bb", 30)) for i in range(3)]
    rows = []
    for i in range(160):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        rows.append([i, words(rng, lang, rng.randrange(20, 90)), lang, "big" if i % 3 else f"s{i % 5}"])
    for i in range(160, 180):  # near copies of one text
        w = rows[4][1].split()
        w[i % len(w)] = "kro"
        rows.append([i, " ".join(w), rows[4][2], "big"])
    rows += [[180, rows[7][1], "aa", "big"], [181, None, None, None], [182, "12 34", "aa", "big"], [183, words(rng, "aa", 10) + " " + items[1][1], "aa", "s1"]]
    t = items[2][1].split()
    rows.append([184, words(rng, "aa", 30) + " " + " ".join(t[15:] + ["kro"] + t[:15]), "aa", "s2"])
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        seen.append([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    languages, unique, clean, mixed = seen
    assert {r[0] for r in rows} - {d for d, *_ in languages} == {181, 182}
    classes = brute_join([(d, t) for d, t, _ in languages])
    assert sorted(d for d, *_ in unique) == sorted({c for _, c, _ in classes})
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    dirty = {d for d, t, _ in unique for _, x in items if sum(k for *_, k in decontaminate.tile(tok(x), tok(t))) >= 0.5 * len(tok(x))}
    assert {183, 184} <= dirty and {d for d, *_ in clean} == {d for d, *_ in unique} - dirty
    assert {d for d, *_ in mixed} == {d for d, *_ in clean} and len(mixed) >= len(clean)
    shares = {}
    for _, t, s in clean:
        shares[s] = shares.get(s, 0) + len(t.split())
    for n, x in expected_passes(shares, 2.0).items():
        assert sum(len(t.split()) for _, t, s in mixed if s == n) == pytest.approx(x * shares[n], abs=90)


def test_run_writes_what_the_stages_keep(spark, folder):
    from tokenizers import Tokenizer

    path, rows, _ = folder
    text = {r[0]: r[1] for r in rows}
    tok = Tokenizer.from_file(pfor.tokenizer_path())
    start = 0
    got = corpus_pipeline.run(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    for r in got:
        ids = [*tok.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
