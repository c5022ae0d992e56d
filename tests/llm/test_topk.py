import math
import random

import numpy as np
from karstline.llm import topk


def brute(rows, k, every):
    """By query id the answers of each of its rows, sorted."""
    ok = [(i, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for n, (q, a) in enumerate(ok):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(ok) if m != n)[:k]
            out.setdefault(q, []).extend((r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(found))
    return {q: sorted(v) for q, v in out.items() if v}


def answers(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_matches_brute_force_whatever_the_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 0.2) + (i % 3 == d) * 0.5, 2) for d in range(6)]) for i in range(500)]
    rows += [(600 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(700, [0.0] * 6), (701, None), (None, [1.0] * 6), (702, [1.0, None] * 3), (703, [float("inf")] * 6), (750, [float("nan")] * 6)]
    want = brute(rows, 5, 50)
    for v in (10_000, 64):
        assert answers(topk.exact_top_k(table(spark, rows), block_vectors=v)) == want


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    for scale in (2.0**18, 2.0**22, 2.0**40, 2.0**70):
        rows = [(i, [rng.choice([-1, 1]) * scale + rng.randrange(256) / 256 for _ in range(3)]) for i in range(120)]
        for v in (1000, 40):
            assert answers(topk.exact_top_k(table(spark, rows, "double"), block_vectors=v)) == brute(rows, 5, 50)


def test_many_dimensions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, x) for i, x in enumerate(rng.normal(0, 0.1, (600, 64)).round(3).tolist())]
    want = brute(rows, 5, 50)
    for v in (1000, 100):
        assert answers(topk.exact_top_k(table(spark, rows, "double"), block_vectors=v)) == want


def test_few_rows_and_empty_table(spark):
    assert topk.exact_top_k(table(spark, [])).collect() == []
    assert topk.exact_top_k(table(spark, [(0, [1.0])])).collect() == []
    rows = [(0, [1.0]), (1, [-1.0]), (50, [])]
    assert answers(topk.exact_top_k(table(spark, rows))) == {0: [(1, 50, 0), (2, 1, -65536)], 50: [(1, 0, 0), (2, 1, 0)]}


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [0.5, 0.25]), (3, [0.25, 0.5]), (50, [1.0]), (50, [1.0, 0.0]), (50, [1.0])]
    frame = table(spark, rows).selectExpr("*", "1 AS rank", "2 AS v", "3 AS q", "4 AS components", "5 AS `a.b`")
    for v in (100, 2):
        assert answers(topk.exact_top_k(frame, block_vectors=v)) == brute(rows, 5, 50)


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(topk, "COPIES", 7)
    rows = [(7, [1.0])] * 60 + [(100, [0.5])] * 30 + [(8, [2.0])]
    for v in (100, 2):
        assert answers(topk.exact_top_k(table(spark, rows), block_vectors=v)) == brute(rows, 5, 50)


def test_lists_are_left_early():
    rng = np.random.default_rng(0)
    vectors = (rng.random((4000, 2)) * 256).astype(np.int64)
    lists = topk.SortedLists(np.arange(4000), vectors)
    alone = lists.top(np.array([3, 1]), -1, 5)
    assert lists.depth < 1000
    assert lists.top(np.array([3, 1]), -1, 5, bound=alone[-1][0]) == alone
    assert lists.top(np.array([3, 1]), -1, 5, bound=10**6) == [] and lists.depth <= 16
