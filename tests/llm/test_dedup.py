"""Substring dedup, Jaccard join and decontamination: against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quasilattice.llm import components, decontaminate, jaccard_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("rec", F.lit("clash"))


def brute_dedup(rows, window=50):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if d is not None and first[tuple(w[j : j + window])] < d:
                gone |= set(range(j, j + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [text(k) for k in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(n):
        w = text(rng.choice([0, 3, 49, 50, 60, 150]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        rows.append((i, " ".join(w)))
    base = text(120)
    for i in range(n, n + 40):  # near copies
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, "\n".join(w)))
    rows += [(200, "the " * 300), (201, "the " * 299 + "end"), (202, " ".join(["a", "b"] * 100)), (203, " ".join(["b", "a"] * 100)), (3, rows[5][1]), (None, rows[60][1]), (None, "  "), (204, None), (205, "")]
    rows += [rows[70], (206, rows[70][1]), (207, rows[70][1] + " "), (208, "x" * 50000)]
    rng.shuffle(rows)
    return rows


def got_dedup(spark, rows, parts=5):
    df = substring_dedup.dedup(frame(spark, rows).repartition(parts))
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_dedup_equals_brute_force(spark):
    rows = passages(1)
    assert got_dedup(spark, rows) == brute_dedup(rows)


def test_dedup_of_split_groups(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 3)
    monkeypatch.setattr(substring_dedup, "CHUNK", 3000)
    rows = passages(2)
    assert got_dedup(spark, rows, 9) == brute_dedup(rows)


def test_dedup_of_nothing(spark):
    assert substring_dedup.dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_suffix_trees_equal_sorted_suffixes():
    rng = np.random.default_rng(0)
    for _ in range(8):
        sizes = rng.integers(1, 40, 12)
        ends = np.cumsum(sizes)
        word, end = rng.integers(0, 2, ends[-1]), np.repeat(ends, sizes)
        starts = np.flatnonzero(rng.random(ends[-1]) < 0.7)
        if not len(starts):
            continue
        order, shared = substring_dedup.suffix_tree(word.astype(np.uint64), end, starts)
        suffix = [tuple(word[i : end[i]].tolist()) for i in order]
        assert suffix == sorted(suffix) and sorted(order.tolist()) == starts.tolist()
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared.tolist() == [0] + [common(a, b) for a, b in itertools.pairwise(suffix)]
        for depth in (1, 3, 8):
            node = substring_dedup.subtrees(shared, depth)
            full = [s[:depth] if len(s) >= depth else (i, None) for i, s in enumerate(suffix)]
            assert [node[i] == node[i - 1] for i in range(1, len(node))] == [full[i] == full[i - 1] for i in range(1, len(node))]
            want = set()  # every prefix that two suffixes share and that can't go on for all of them
            for i, j in itertools.combinations(range(len(suffix)), 2):
                k = common(suffix[i], suffix[j])
                if k >= depth:
                    inside = [x for x, s in enumerate(suffix) if s[:k] == suffix[i][:k]]
                    want.add((inside[0], inside[-1] + 1, k))
            got = substring_dedup.maximal_repeats(shared, depth)
            assert len(got) == len(set(got)) and set(got) == want


def test_dedup_of_a_text_longer_than_a_chunk(spark):
    """Above 2 MB: a text alone, and its second half in another document."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[200_000:])), (3, " ".join(words[:40]))]
    assert [r[:3] for r in got_dedup(spark, rows, 2)] == [(1, 400_000, 0), (2, 200_001, 200_000), (3, 40, 0)]


# ---- Jaccard


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute_join(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    link = [[i != j and ((rows[i][1] or "") == (rows[j][1] or "") or bool(sets[i] | sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9) for j in range(n)] for i in range(n)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if link[i][j]:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, ids.get(find(i)), sum(link[i])) for i, (d, _) in enumerate(rows)), key=str)


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for group in (1, 1, 2, 3, 8, 40):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 60, 300]))]
        for _ in range(group):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 25, len(w) // 10])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "one"), (n + 4, "one"), (n + 5, "one two three four"), (n + 6, "one  two three four"), (None, rows[0][1]), (3, rows[9][1]), (n + 7, "x" * 30000)]
    return rows


def got_join(spark, rows):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()), key=str)


def test_join_equals_brute_force(spark):
    rows = near_rows(1)
    assert got_join(spark, rows) == brute_join(rows)


def test_join_of_dense_leaves_and_blocks(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("PART", 8), ("BLOCK", 7)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_rows(2)
    assert got_join(spark, rows) == brute_join(rows)


def test_one_of_each_class_stays(spark):
    rows = near_rows(3)
    want = brute_join(rows)
    kept = jaccard_join.keep_one(frame(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "spans", "rec"] and len(ids) == len({c for _, c, _ in want})
    assert jaccard_join.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_runs_grow_with_recall():
    assert jaccard_join.runs_for(0.9) < jaccard_join.runs_for(0.999) == 19


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (-5, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: -5, 101: -5, 102: -5, -5: -5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- tiling


def brute_tiles(a, b, least):
    """The definition, without hashes: longest first, then by place."""
    p, q, out = list(a), list(b), []
    while True:
        best = []
        for i in range(len(p)):
            for j in range(len(q)):
                k = 0
                while i + k < len(p) and j + k < len(q) and p[i + k] is not None and p[i + k] == q[j + k]:
                    k += 1
                if k >= least:
                    best.append((-k, i, j))
        if not best:
            return sum(out)
        k, i, j = min(best)
        out.append(-k)
        p[i : i - k] = [None] * -k
        q[j : j - k] = [None] * -k


def test_tiles_cover_what_the_definition_covers():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randrange(1, 40))]
        text = [rng.choice("abcdef") for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            cut = rng.randrange(len(item))
            text[len(text) // 2 : len(text) // 2] = item[cut : cut + rng.randrange(1, 25)]
        least = min(rng.choice([1, 3, 5]), len(item))
        tiles = decontaminate.tile(item, text, least)
        assert sum(t[2] for t in tiles) == brute_tiles(item, text, least)
        assert all(item[i : i + k] == text[j : j + k] and k >= least for i, j, k in tiles)
        for side in (0, 1):
            used = [x for t in tiles for x in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))


def tokens(text):
    return re.findall("[0-9a-z]+", (text or "").lower())


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 40])))) for i in range(12)] + [(50, None), (51, ""), (52, "the the the the the the"), (1, "other text of item one here")]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            t = tokens(rng.choice(items)[1])
            half = len(t) // 2
            piece = rng.choice([t, t[half:] + ["gap"] + t[:half], t[: max(1, int(len(t) * 0.45))], [x.upper() for x in t]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece
        docs.append((i, ", ".join(w)))
    docs += [(60, None), (61, ""), (None, items[2][1]), (0, docs[0][1]), (62, "the " * 500), (63, items[3][1] + " x" * 20000)]
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = frame(spark, docs)
    want = []
    for d, t in docs:
        for q, x in set(items):
            a = tokens(x)
            if a and (n := brute_tiles(a, tokens(t), min(5, len(a)))) >= 0.5 * len(a):
                want.append((d, q, n, len(a)))
    for size in (8 << 20, 200):
        got = [(r["doc_id"], r["item_id"], r["tiled"], r["item_tokens"]) for r in decontaminate.contaminated(df, bench, block_bytes=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    bad = {d for d, *_ in want}
    cleaned = decontaminate.clean(df, bench)
    assert cleaned.columns == df.columns and sorted((r["doc_id"] for r in cleaned.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("small", [4096, 48])
def test_recall_just_above_the_threshold(spark, monkeypatch, small):
    """1200 pairs of similarity 0.80 to 0.85 among texts that share many words; with leaves of any size and with recursion."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, planted = [], []
    while len(planted) < 1200:
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        other = list(base)
        while True:
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
            a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
            likeness = len(a & b) / len(a | b)
            if likeness <= 0.85:
                break
        if likeness >= 0.8:
            planted.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 2400
    found = np.mean([got[a] == got[b] == (a, 1) for a, b in planted])
    assert found >= 0.99


def test_parts_of_a_dense_path_meet(spark, monkeypatch):
    """Representatives of a path are dealt out in parts, and every two of them are in one of its groups."""
    monkeypatch.setattr(jaccard_join, "PART", 10)
    rows = spark.createDataFrame([(p, r, b"x") for p in (1, 2) for r in range(35 * p)], "path long, rec long, sketch binary")
    groups = {}
    for r in jaccard_join.across_parts(rows).collect():
        groups.setdefault((r["path"], r["salt"]), set()).add(r["rec"])
    for p in (1, 2):
        met = {x for (q, _), g in groups.items() if q == p for x in itertools.combinations(sorted(g), 2)}
        assert met == set(itertools.combinations(range(35 * p), 2)) and max(len(g) for (q, _), g in groups.items() if q == p) < 35 * p


def test_copies_of_one_text_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 1e-9)
    rows = [(i, "the same text again and again") for i in range(1500)] + [(i, f"other text {i}") for i in range(1500, 1600)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 1499) if i < 1500 else (i, 0) for i in range(1600)}
