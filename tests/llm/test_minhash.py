import random

import numpy as np
from karstline.llm import minhash as m
from karstline.llm.common import WordHashes


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "One", "two words", "\t Two\nwords "]
    for n in (12, 40, 150):
        for _ in range(3):
            text = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(text))
            for _ in range(25):  # chains of edits, some of them under the threshold
                text = list(text)
                for _ in range(max(1, n // 25)):
                    text[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(text))
            texts.append(texts[-3])
    rng.shuffle(texts)
    return texts


def test_matches_brute_force(spark, docs):
    rows = list(enumerate(corpus()))
    for size in (2, 5):
        want = brute(rows, size, 80)
        got = m.near_duplicates(docs(rows), shingle_words=size).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_repeated_null_ids_and_clashing_columns(spark, docs):
    text = " ".join(f"x{i}" for i in range(30))
    frame = docs([(None, text), (4, text), (4, "other text here"), (9, text), (6, "other text here")]).selectExpr("*", "1 AS id", "2 AS node", "3 AS bits")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in m.near_duplicates(frame).collect())
    assert got == [("4", 4, True), ("4", 4, True), ("6", 4, False), ("9", 4, False), ("None", None, True)]
    kept = m.stage(spark, frame, "")
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "None"]


def test_empty_table(spark, docs):
    assert m.near_duplicates(docs([])).collect() == []


def test_estimate_is_close_and_copies_are_one(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for share in (0.2, 0.5, 0.8, 1.0):
        for n in (200, 3000):
            common, rest = int(n * share), n - int(n * share)
            x, y, z = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (common, rest, rest))
            a, b = np.unique(np.concatenate([x, y])), np.unique(np.concatenate([x, z]))
            rows.append((m.packed_bits(m.minima(a)).tolist(), m.packed_bits(m.minima(b)).tolist()))
            want.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [r[0] for r in frame.select(m.estimate(frame["a"], frame["b"])).collect()]
    assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 0.15
    assert got[-1] == 1.0


def test_shingle_rule():
    h = WordHashes()
    assert len(m.shingles([b"a", b"b", b"a", b"b"], 2, h)) == 2
    assert len(m.shingles([b"a"], 2, h)) == 1 and len(m.shingles([], 2, h)) == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in m.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_many_copies_of_near_duplicate_rows(spark, docs):
    words = [f"x{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(8, a)] * 1000 + [(6, b)] * 1000 + [(7, b)] + [(9, "one of its own kind")] * 500
    got = m.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(8, 6), (6, 6), (7, 6), (9, 9)}


def test_one_id_with_many_texts(spark, docs):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(300)]
    rows = [(0, t) for t in texts] + [(1 + i, t if i % 2 else t + " more") for i, t in enumerate(texts)] + [(0, ""), (1000, "")]
    got = {(r.doc_id, r.component_id) for r in m.near_duplicates(docs(rows)).collect()}
    want = brute(rows, 5, 80)
    assert got == set(want.items())


def test_tiles_lose_no_link(spark, docs, monkeypatch):
    monkeypatch.setattr(m, "TILE_NODES", 2)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):  # texts around the threshold, many in a bucket and few linked
        text = list(base)
        for at in rng.sample(range(120), rng.choice([2, 3, 4])):
            text[at] = f"v{i}_{at}"
        rows.append((i, " ".join(text)))
    want = brute(rows, 5, 80)
    assert 1 < len(set(want.values())) < 80
    assert {r.doc_id: r.component_id for r in m.near_duplicates(docs(rows)).collect()} == want
