import random
import re

from karstline.llm import decontaminate as d


def brute(texts, items, size=8):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = {}
    for i, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for item, it in items:
            x = words(it)
            for k in range(max(1, len(x) - size + 1)) if x and item is not None else ():
                p = x[k : k + size]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def rows(frame):
    return {r.doc_id: (r.n_words, sum(s.after_word - s.first_word for s in r.spans), r["items"]) for r in frame.collect()}


def test_matches_brute_force_in_one_block_and_in_many(spark, docs):
    rng = random.Random(5)
    word = lambda: rng.choice(["A", "b", "é", "c1"])
    texts = [None, "", "b", *[" ".join(word() for _ in range(n)) for n in (5, 30, 80, 200)], "b, A\tB! b a.b_b a b A b b a"]
    items = [(3, "b A b b a b b a b"), (12, "c1"), (12, None), (None, "a"), (4, ""), (5, "é b"), (6, "B a b b A b b a b"), (7, " ".join(["b"] * 6))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    assert rows(d.scan(docs(texts), bench)) == want
    for pairs in (1, 7):  # more blocks than passes between checkpoints, and a few
        assert rows(d.scan(docs(texts), bench, block_pairs=pairs)) == want


def test_report_stage_and_clashing_columns(spark, docs, tmp_path):
    leak = "one two three four five six seven eight nine"
    frame = docs([leak, "clean text", None, (0, leak)])
    bench = spark.createDataFrame([(1, leak), (2, leak)], "item_id long, text string")
    got = d.report(d.scan(frame.selectExpr("*", "1 AS items", "2 AS spans", "3 AS n_words"), bench)).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in got) == [(0, 9, 2, True), (0, 9, 2, True), (1, 0, 0, False), (2, 0, 0, False)]
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = frame.selectExpr("*", "'own' AS N_words", "1 AS items", "2 AS __text", "3 AS `a.b`")
    kept = d.stage(spark, odd, str(tmp_path))
    assert kept.columns == odd.columns and sorted((r.doc_id, r["N_words"], r["items"]) for r in kept.collect()) == [(1, "own", 1), (2, "own", 1)]


def test_a_long_item_and_a_window_of_many_items_are_split(spark, docs):
    long = " ".join(f"w{i}" for i in range(3000))
    items = [(i, "one and the same short text") for i in range(500)] + [(1000, long), (1000, "more of this item here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["it has one and the same short text", " ".join(long.split()[100:200]), "more of this item here", "clean"]
    assert rows(d.scan(docs(texts), bench, block_pairs=900)) == brute(texts, items)


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.report(d.scan(docs([]), bench)).count() == 0
    assert rows(d.scan(docs(["a b"]), bench)) == {0: (2, 0, [])}
