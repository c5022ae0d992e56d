"""The pipeline against a plain version of each stage, and the registry."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from karstline.llm import bpe, registry, toxicity

CODEC = bpe.codec(bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in CODEC.bytes_of.items()}, special_tokens={})
LEAK = "the quick brown fox jumps over the lazy dog again and again"


def write(spark, docs, folder):
    rng = random.Random(21)
    words = [f"word{i}" for i in range(200)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", "short"]
    for _ in range(40):
        texts.append("\n".join(line(rng.randrange(6, 14)) for _ in range(rng.randrange(1, 5))))
    for i in range(8):  # near copies: one word of a long line is another
        long = line(90).split(" ")
        texts += [" ".join([*long[:40], f"changed{i}{'abc'[k] * 5}", *long[41:]]) for k in range(3)]
    texts += [f"{line(9)}\n{LEAK}\n{line(8)}" for _ in range(4)]
    texts += [f"{line(9)}\nthis shared line stands in many documents\n{line(8)}" for _ in range(5)]
    texts += [f"{line(7)} vile rotten {line(7)}" for _ in range(40)]
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts)]
    frame = docs(texts)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, "not in any document at all, this one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return frame, texts


def line_dedup(rows):
    from test_linededup import brute

    gone = brute(rows, 1, 0)
    return [(i, None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows]


def near_dedup(rows):
    from test_minhash import brute

    root = brute(rows, 5, 80)
    return [(i, t) for i, t in rows if root[i] == i]


def decontaminate(rows, items):
    from test_decontaminate import brute

    found = brute([t for _, t in rows], items)
    return [r for k, r in enumerate(rows) if not found[k][2]]


def test_run_equals_plain_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    frame, texts = write(spark, docs, folder)
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(i, t) for i, (t, (s, _)) in enumerate(zip(texts, model.score(texts), strict=True)) if s < toxicity.THRESHOLD]
    assert 0 < len(texts) - len(rows) <= 40
    sizes = [len(rows)]
    for stage in (line_dedup, near_dedup, lambda r: decontaminate(r, [(1, LEAK), (2, "not in any document at all, this one")])):
        rows = stage(rows)
        sizes.append(len(rows))
    assert sizes[0] == sizes[1] > sizes[2] > sizes[3]
    want = {}
    for i, t in rows:
        ids = PLAIN.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == frame.columns


def test_null_and_repeated_ids_and_clashing_columns_in_every_stage(spark, docs, tmp_path):
    folder = str(tmp_path)
    frame, texts = write(spark, docs, folder)
    rng = random.Random(2)
    more = [" ".join(f"own{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4)]
    odd = docs([(None, more[0]), (7000, more[1]), (7000, more[2]), (7000, more[2]), (None, None), (7001, more[3]), (7002, None), (7003, "")])
    odd = frame.unionAll(odd).selectExpr("*", "'a' AS score", "'b' AS N_WORDS", "'c' AS items", "'d' AS evidence", "'e' AS n_lines", "'f' AS __text", "'g' AS `a.b`", "'h' AS node", "'i' AS kept", "'j' AS dropped")
    out = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.schema.names == odd.schema.names
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        rows = out.where("doc_id IS NULL OR doc_id >= 7000").collect()
        # nothing of these rows is toxic, repeated or leaked but the copy of a row, which may lose its text
        assert sorted((str(r.doc_id), r.text) for r in rows if r.text) in (
            sorted((str(i), t) for i, t in ((None, more[0]), (7000, more[1]), (7000, more[2]), (7000, more[2]), (7001, more[3]))),
            sorted((str(i), t) for i, t in ((None, more[0]), (7000, more[1]), (7000, more[2]), (7001, more[3]))),
        )
        assert len(rows) == 8
        assert {tuple(r)[5:] for r in out.collect()} == {tuple("abcdefghij")}
    last = corpus_pipeline.STAGES[-1][1](spark, out, folder)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == out.count()


def test_empty_tables(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_each_operator_has_one_query():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "byte-level BPE"]
