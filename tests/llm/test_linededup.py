import random

from hypothesis import given, settings
from hypothesis import strategies as st
from karstline.llm import linededup as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, edits, least):
    lines = [(i, k, s) for i, t in rows if i is not None and t is not None for k, s in enumerate(t.split("\n")) if len(s) >= least]
    gone = {(i, k) for i, k, s in lines if any((j, m) < (i, k) and (s == r or (edits and distance(s, r) <= edits)) for j, m, r in lines)}
    return {i: sorted(k for j, k in gone if j == i) for i, _ in rows}


def corpus():
    rng = random.Random(4)
    base = ["".join(rng.choice("abé ") for _ in range(n)) for n in (20, 21, 27, 40, 64, 33)]
    texts = [None, "", "\n\n", "short\nshort"]
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(s))
                s[at : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
            lines.append("".join(s))
        texts.append("\n".join(lines))
    return list(enumerate(texts))


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_distance_and_keys_lose_no_pair(a, b):
    near = distance(a, b) <= 1
    assert all(d.within(a, b, k) == (distance(a, b) <= k) for k in range(4))
    if near and a != b:
        for blocks in (d.COARSE, d.FINE):
            assert {k[0] for k in d.block_keys(a, blocks)} & {k[0] for k in d.block_keys(b, blocks)}
        mine, other = ({v for k in d.block_keys(x, d.FINE) for v, _ in d.variants(x, *k)} for x in (a, b))
        assert mine & other


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_variants_of_two_edits_certify_the_distance(a, b):
    mine, other = list(d.edited(a, 2)), list(d.edited(b, 2))
    assert any(v == w and m + x + y <= 2 for v, m, x in mine for w, _, y in other) == (distance(a, b) <= 2)


def check(found, rows, want):
    for r in found.collect():
        text = dict(rows)[r.doc_id]
        assert r.dropped == want[r.doc_id]
        left = None if text is None else "\n".join(s for k, s in enumerate(text.split("\n")) if k not in r.dropped)
        assert r.text == left and r.n_lines == (0 if text is None else text.count("\n") + 1)


def test_matches_brute_force(spark, docs):
    rows = corpus()
    for edits, least in ((0, 0), (1, 0), (1, 25)):
        check(d.dedup_lines(docs(rows), max_edits=edits, min_chars=least), rows, brute(rows, edits, least))


def test_short_lines_and_more_edits(spark, docs):
    rng = random.Random(9)
    rows = [(i, "\n".join("".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 2, 5, 9]))) for _ in range(3))) for i in range(25)]
    for edits in (0, 1, 2):
        check(d.dedup_lines(docs(rows), max_edits=edits), rows, brute(rows, edits, 0))


def test_repeated_ids_lose_nothing(spark, docs):
    a, u, v = "a" * 25, "a line that no other row has", "one more that stands alone"
    rows = [(1, a), (5, a), (5, u), (5, u), (6, f"{v}\n{a}"), (6, v), (6, v)]
    found = d.dedup_lines(docs(rows)).select("doc_id", "text").collect()
    left = sorted((r.doc_id, r.text) for r in found)
    assert len(left) == len(rows) and (1, a) in left and (5, u) in left and left.count((5, u)) == 1
    assert sorted(s for _, t in left for s in t.split("\n") if s) == sorted([a, u, v])


def test_many_copies_of_one_row(spark, docs):
    rows = [(3, "first line of a copied row\nsecond")] * 1000 + [(None, "first line of a copied row")]
    left = [r.text for r in d.dedup_lines(docs(rows)).where("doc_id IS NOT NULL").collect()]
    assert sorted(left) == [""] * 999 + [rows[0][1]]


def test_null_ids_and_clashing_columns(spark, docs):
    a, b = "a" * 25, "b" * 30
    frame = docs([(None, a), (5, a), (7, f"{b}\nkept"), (7, "x")]).selectExpr("*", "1 AS id", "2 AS line", "'own' AS Dropped", "4 AS h1", "'n' AS n_lines", "5 AS `a.b`")
    found = d.dedup_lines(frame).collect()
    assert sorted((str(r.doc_id), r.text) for r in found) == [("5", a), ("7", f"{b}\nkept"), ("7", "x"), ("None", a)]
    assert {(r["Dropped"], r["n_lines"]) for r in found} == {("own", "n")} and all(r["n_lines_1"] and r["dropped_1"] == [] for r in found)
    kept = d.stage(spark, frame, "")
    assert kept.columns == frame.columns and all(r.n_chars == len(r.text) and r["Dropped"] == "own" for r in kept.collect())


def test_many_lines_that_differ_in_one_place(spark, docs):
    rows = [(i, f"page {i:03d} of the same long report") for i in range(60)]
    want = brute(rows, 1, 0)
    assert {r.doc_id: r.dropped for r in d.dedup_lines(docs(rows)).collect()} == want


def test_empty_table(spark, docs):
    assert d.dedup_lines(docs([])).collect() == []
