import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from karstline.llm import toxicity as t


def plain_top(vectors, query, k):
    q = dict(zip(*map(list, query), strict=True))
    scores = [(-sum(w * q.get(term, 0) for term, w in zip(*map(list, v), strict=True)), i) for i, v in enumerate(vectors)]
    return sorted(s for s in scores if s[0] < 0)[:k]


def test_block_max_search_is_exact():
    rng = random.Random(1)
    vectors = []
    for _ in range(700):
        raw = {int(300 * rng.random() ** 4): rng.choice([1, 2, 3]) for _ in range(rng.randrange(1, 9))}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append((np.array(sorted(raw)), np.array([round(raw[x] / norm * t.UNIT) for x in sorted(raw)], float)))
    nothing = np.empty(0, np.int64), np.empty(0)
    index = t.BlockMaxIndex(vectors, 301, block=16)
    assert 0 < len(index.dense) < 50 and index.place.size
    queries = [*vectors[:60], (np.array([300]), np.array([9.0])), nothing]
    for query, (found, p) in zip(queries, index.top(queries, 9), strict=True):
        assert list(zip((-p).tolist(), found.tolist(), strict=True)) == plain_top(vectors, query, 9)
    one = np.array([0]), np.array([5.0])
    assert [x.tolist() for x, _ in t.BlockMaxIndex([one] * 100, 1, block=16).top([one], 5)] == [[0, 1, 2, 3, 4]]
    assert [x.tolist() for x, _ in t.BlockMaxIndex([one] * 3, 1).top([one], 5)] == [[0, 1, 2]]
    assert t.BlockMaxIndex([], 0).top([nothing], 3)[0][0].size == 0


def test_scores_equal_brute_force(spark, docs):
    texts, labels, frame, table = make(docs, spark, 300)
    model = t.fit(frame, table)
    taught = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    bags = [Counter(x.lower().replace("!", " ").replace(".", " ").split()) for x in texts]
    df = Counter(w for b in bags for w in b)
    having, toxic = Counter(w for i in taught for w in bags[i]), Counter(w for i in taught if labels[i][2] for w in bags[i])
    positives = sum(labels[i][2] for i in taught)

    def weight(w):
        odds = ((toxic[w] + 0.5) / (positives + 1)) / ((having[w] - toxic[w] + 0.5) / (len(taught) - positives + 1))
        return (math.log(301 / (1 + df[w])) + 1) * (abs(math.log(odds)) + 1e-6)

    def vector(bag):
        v = {w: (1 + math.log(n)) * weight(w) for w, n in bag.items() if having[w]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(bags[i]) for i in taught}
    assert sorted(model.ids.tolist()) == taught
    for r in t.score(frame, model).collect():
        mine = vector(bags[r.doc_id])
        cosines = {i: sum(x * mine.get(w, 0) for w, x in v.items()) for i, v in vectors.items()}
        want = sorted(cosines.values(), reverse=True)[: t.NEIGHBOURS]
        assert [e.cosine for e in r.evidence] == pytest.approx(want, abs=1e-5)
        assert all(e.cosine == pytest.approx(cosines[e.doc_id], abs=1e-5) and e.label == labels[e.doc_id][2] for e in r.evidence)
        vote = sum(e.label / (1.05 - e.cosine) for e in r.evidence) / sum(1 / (1.05 - e.cosine) for e in r.evidence)
        assert r.score == pytest.approx(float(np.interp(vote, model.xs, model.ys)), abs=1e-9)


def test_equal_texts_score_alike_in_any_batch_and_copies_teach_once():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, i % 2, " ".join(rng.choice(words) for _ in range(30))) for i in range(300)]
    examples = t.Examples(rows + [(1000 + i, y, f"{x} w0") for i, y, x in rows[:50]] + [(2000, 1, "...")])
    frequencies = np.bincount(np.concatenate([v[0] for v in examples.held]))
    model = t.Model(examples, frequencies, len(examples.held))
    assert sorted(model.ids.tolist()) == list(range(300))
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(40)]
    assert model.score(texts) == [model.score([x])[0] for x in texts]


def test_isotonic_is_monotone():
    xs, ys = t.isotonic([0.1, 0.2, 0.2, 0.6, 0.7, 0.9], [0, 1, 0, 0, 1, 1])
    assert xs == sorted(xs) and list(ys) == sorted(ys) and all(0 < y < 1 for y in ys)


def make(docs, spark, n=900):
    rng = random.Random(7)
    neutral, bad = [f"word{i}" for i in range(300)], ["vile", "rotten", "snarkly", "snarkle"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(neutral) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice(["", "!", "."]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return texts, labels, docs(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_stage(spark, docs, tmp_path):
    texts, labels, frame, table = make(docs, spark)
    truth = {i: y for i, _, y in labels}
    for name, f in (("documents", frame), ("labels", table)):
        f.write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = t.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and 200 < sum(r.held_out for r in rows) < 400
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    kept = t.stage(spark, frame, str(tmp_path))
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_odd_rows(spark, docs):
    _, _, frame, table = make(docs, spark, 400)
    table = table.unionAll(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0)], table.schema))
    model = t.fit(frame, table)
    odd = docs([(None, "vile rotten"), (5, None), (5, ""), (5, "vile! " * 5000)]).selectExpr("*", "1 AS SCORE", "2 AS evidence", "3 AS label", "4 AS id", "5 AS `a.b`")
    got = {(r.doc_id, r.score) for r in t.score(odd, model).collect()}
    assert len(got) == 3 and {x for x in got if x[1] < 0.5} == {(5, model.rate)}
    kept = t.score(odd, model, keep=True)
    assert kept.columns == [*odd.columns, "score_1", "evidence_1"]
    assert {(r["SCORE"], r["evidence"]) for r in kept.collect()} == {(1, 2)}
    assert t.score(docs([]), model).collect() == []


def test_bounds_of_the_sample_pass_whole_texts_over(spark, docs):
    texts, _, frame, table = make(docs, spark, 200)
    model = t.fit(frame, table, examples=50, example_bytes=3000)
    assert 0 < len(model.ids) <= 50 and sum(len(texts[i]) for i in model.ids.tolist()) <= 3000


def test_no_labels(spark, docs):
    model = t.fit(docs(["a", "b"]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in t.score(docs(["a"]), model).collect()] == [0.5]
