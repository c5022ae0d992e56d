import hashlib
import random

import public_tokenizers
import tiktoken
from karstline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CODEC = bpe.codec(bpe.rank_file(PATH), PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks={b: i for i, b in CODEC.bytes_of.items()}, special_tokens={})


def texts():
    rng = random.Random(3)
    words = ["the", "naïve", "don't", "we'll", "x1y2", "  ", "\n\n", "日本語", "🙂", "I're", "'", "<|endoftext|>", "a" * 300, "!" * 90, " " * 120, "été"]
    return [None, "", "a", "'re", *[rng.choice(["", " "]).join(rng.choice(words) for _ in range(n)) for n in (3, 40, 200, 900)], "ab" * 700, " " * 900]


def test_encodes_as_the_library_and_round_trips(spark, docs):
    cases = texts()
    for chunk, overlap in ((50, 12), (64, 60), (1000, 30)):
        found = bpe.decode(bpe.encode(docs(cases), PATH, PATTERN, chunk_chars=chunk, overlap_chars=overlap), PATH, PATTERN)
        for row in found.collect():
            text = cases[row.doc_id] or ""
            assert row.ids == PLAIN.encode_ordinary(text)
            assert bytes(row.decoded) == text.encode()


def test_repeated_rows_null_ids_and_clashing_columns(spark, docs):
    long = "word and word " * 30
    frame = docs([(None, "x"), (7, long), (7, long), (8, long)]).selectExpr("*", "1 AS ids", "2 AS k", "3 AS decoded", "'t' AS __key")
    rows = bpe.digests(frame, PATH, PATTERN, chunk_chars=100, overlap_chars=20).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 7), (False, 7), (False, 8), (True, 0)]
    want = hashlib.sha256(",".join(map(str, PLAIN.encode_ordinary(long))).encode()).hexdigest()
    assert {r.ids_sha256 for r in rows if r.doc_id} == {want}
    assert {r.decoded_sha256 for r in rows if r.doc_id} == {hashlib.sha256(long.encode()).hexdigest()}


def test_newer_characters_and_ordinary_lengths_are_cut_alike(spark, docs):
    others = "".join(map(chr, bpe.stand_ins(PATTERN)))
    for text in (f"a{c}1 {c}b" for c in others):
        assert CODEC.encode_pieces(CODEC.pre_tokenise(text)) == PLAIN.encode_ordinary(text)
    ordinary = "plain words, don't they " * 80
    cases = [f"a{others[0]}b {others[0]}1{others[-1]}", *[ordinary + f"x{c}y{c}1 " * 30 for c in others[::3000]], ordinary, "q" * 9000 + " end"]
    for options in ({}, {"chunk_chars": 50, "overlap_chars": 12}, {"deal_chunks": 1}):
        for row in bpe.encode(docs(cases), PATH, PATTERN, **options).collect():
            assert row.ids == PLAIN.encode_ordinary(cases[row.doc_id])
    chunks = bpe.chunks_of(ordinary, bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS)
    assert len(chunks) > 1 and "".join(c[0 if not at else bpe.OVERLAP_CHARS :] for at, c in chunks) == ordinary


def test_empty_table(spark, docs):
    assert bpe.digests(docs([]), PATH, PATTERN).collect() == []


def test_long_texts_are_stitched_and_encoded_in_parcels(spark, docs):
    rng = random.Random(5)
    words = ["plain", "words", "été", "日本", "12", "\n", "don't"]
    mixed = " ".join(rng.choice(words) for _ in range(60_000))
    cases = [mixed, "x" * 1_000_000 + " end", " " * 100_000 + "z", mixed[:90_000] + "q" * 5000 + mixed[:90_000]]
    for row in bpe.encode(docs(cases), PATH, PATTERN).collect():
        assert row.ids == PLAIN.encode_ordinary(cases[row.doc_id])
