"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap by
``overlap_chars``.  Chunks are pre-tokenised each from its own first character,
wherever that lies inside a pre-token.  The pattern never looks behind, so once
two neighbours both start a match at one place they go on alike: the chunks of
a text are stitched there, and only then are the pieces encoded.  The chunks of
a text that has many go to different Spark tasks, and so do parcels of its
stitched pieces; those of others stay in the task that reads the text; what is
done to them is the same.  Decoding concatenates the raw bytes of the ids.

Matches are found by Python's engine, whose Unicode tables are not those of
tiktoken's: characters that the two class otherwise are matched as a stand-in
of the class that tiktoken's engine gives them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache, cached_property
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karstline.llm.common import bounded, freed, list_array, read_table, small_batches, tidy

#: Under the length of an ordinary document.
CHUNK_CHARS = 1024
OVERLAP_CHARS = 128
#: Chunks of texts with more are dealt to other tasks: fewer would move more than they spread.
DEAL_CHUNKS = 64
#: Characters of stitched pieces that are encoded in one task, about.
PARCEL_CHARS = 1 << 16
#: A match's text can change what follows it by at most this many characters.
LOOKAHEAD = 3
VOCABULARY_LIMIT = 64 << 20


class Pieces(dict):
    """Ids by pre-token, remembered up to a bounded number of pre-tokens."""

    LIMIT = 100_000

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = ids
        return ids


@cache
def stand_ins(pattern: str) -> dict[int, int]:
    """Characters that tiktoken's engine and Python's put in other classes of the pattern: a stand-in for each.

    Both engines are asked for each class escape of the pattern; a stand-in is
    a character that both put in the classes that tiktoken's puts the other in.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    one_byte = {bytes([i]): i for i in range(256)}
    theirs, own = np.zeros((2, 0x110000), np.int64)
    for i, escape in enumerate(sorted(set(regex.findall(r"\\[pP]\{[^}]*\}|\\[pP]\w|\\[sSdDwW]", pattern)))):
        core = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks=one_byte, special_tokens={})
        for classes, found in ((theirs, bytes(core.encode_ordinary(every)).decode()), (own, "".join(regex.findall(escape, every)))):
            classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] |= 1 << i
    agreed: dict[int, int] = {}
    for c in np.flatnonzero(theirs == own).tolist():
        if c > 0x7F and not 0xD800 <= c < 0xE000 and chr(c) not in pattern:
            agreed.setdefault(int(theirs[c]), c)
    return {c: agreed[int(theirs[c])] for c in np.flatnonzero(theirs != own).tolist()}


def cut(text: str, lengths: Iterable[int]) -> list[str]:
    """A text in parts of these lengths."""
    return [text[a:b] for a, b in pairwise(accumulate(lengths, initial=0))]


class Codec:
    """A rank file and its pattern: pre-tokenise, encode pieces, decode ids."""

    def __init__(self, rank_file: bytes, pattern: str, others: dict[int, int]):
        self.pattern, self.others, self.rank_file = pattern, others, rank_file
        ranks = self.ranks()
        self.bytes_of = {i: b for b, i in ranks.items()}
        size = max(self.bytes_of, default=-1) + 1
        self.raw = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.rank_file.splitlines())}

    # what only encoding needs is made where something is encoded

    @cached_property
    def pieces(self) -> Pieces:
        core = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return Pieces(core._core_bpe.encode_single_piece)

    @cached_property
    def find(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def may_differ(self):
        # beyond the first plane any character, as a set of single ones would be searched one by one
        return re.compile(f"[{''.join(re.escape(chr(c)) for c in self.others if c < 0x10000)}\U00010000-\U0010FFFF]").search

    def pre_tokenise(self, text: str) -> list[str]:
        if text.isascii() or not self.may_differ(text):
            return self.find(text)
        return cut(text, map(len, self.find(text.translate(self.others))))

    def encode_pieces(self, pieces: Iterable[str]) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after another."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.raw[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()


_codecs: dict[bytes, Codec] = {}


def codec(rank_file: bytes, pattern: str, others: dict[int, int] | None = None) -> Codec:
    """One codec for each vocabulary and Python worker; ``others`` are the pattern's stand-ins if they are known."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern, stand_ins(pattern) if others is None else others)
    return _codecs[key]


def stitch(codec: Codec, chunks: Iterable[tuple[int, str, list[str]]]) -> Iterator[list[str]]:
    """Pre-tokens of a whole text, in order, from its chunks ``(start, text, its pre-tokens)``.

    Where no common boundary lies in an overlap (a run longer than it), the two
    chunks are joined and matched again from the last boundary that is certain.
    """
    chunks = iter(chunks)
    start, text, pieces = next(chunks)
    done = 0  # pieces of the chunk at hand that are emitted
    for next_start, next_text, next_pieces in chunks:
        end = start + len(text)
        # the chunk's boundaries in the overlap, by place; those at its very end are not certain
        own, last, at, k = {}, done, end, len(pieces)
        while True:
            if at <= end - LOOKAHEAD:
                last = max(last, k)
                if at < next_start:
                    break
                own[at] = k
            if k <= done:
                break
            k -= 1
            at -= len(pieces[k])
        at = next_start
        for k, piece in enumerate(next_pieces):
            if at in own or at > end:
                break
            at += len(piece)
        if at in own:
            yield pieces[done : own[at]]
            start, text, pieces, done = next_start, next_text, next_pieces, k
            continue
        yield pieces[done:last]
        parts = [*pieces[last:], next_text[end - next_start :]]
        size, end = sum(map(len, parts)), next_start + len(next_text)
        # a run over many chunks doubles each time, or it would be matched again with each of them
        goal = 2 * size
        while size < goal and (more := next(chunks, None)) is not None:
            parts.append(more[1][end - more[0] :])
            size, end = size + len(parts[-1]), more[0] + len(more[1])
        text = "".join(parts)
        start, pieces, done = end - size, codec.pre_tokenise(text), 0
    yield pieces[done:]


def chunks_of(text: str, chunk_chars: int, overlap_chars: int) -> list[tuple[int, str]]:
    """A text's chunks ``(start, chunk)``."""
    step = chunk_chars - overlap_chars
    return [(at, text[at : at + chunk_chars]) for at in range(0, max(1, len(text) - overlap_chars), step)]


def rank_file(path: str) -> bytes:
    """The vocabulary, read once on the driver; its size is checked as it is broadcast."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_LIMIT + 1)
    if len(data) > VOCABULARY_LIMIT:
        raise ValueError(f"{path} is larger than {VOCABULARY_LIMIT} bytes")
    return data


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, deal_chunks: int = DEAL_CHUNKS, decoded: bool = False,
) -> DataFrame:
    """Ids of every whole text: ``(id_col, ids array<int>)``, a row for each input row.

    With ``decoded`` a third column of that name has what ``decode`` makes of the ids, in
    the same Python worker.

    A null or empty text has no ids; a null or repeated id is kept as it is;
    equal texts of over ``deal_chunks`` chunks are encoded once; columns other than the two are left out,
    whatever their names.  Special tokens are ordinary text.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("overlap_chars must be over 0 and under chunk_chars")
    shared = docs.sparkSession.sparkContext.broadcast((rank_file(vocabulary), pattern, stand_ins(pattern)))
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decoded)
    rows = bounded(docs).select(F.col(id_col), F.col(text_col).alias("__text"))
    step = chunk_chars - overlap_chars
    is_long = F.coalesce(F.length("__text"), F.lit(0)) > overlap_chars + step * deal_chunks

    def encode_here(own, text):
        chunks = chunks_of(text, chunk_chars, overlap_chars)
        pieces = chain.from_iterable(stitch(own, [(at, c, own.pre_tokenise(c)) for at, c in chunks]))
        return np.array(own.encode_pieces(pieces), np.int32)

    def encode_short(batches):
        own = codec(*shared.value)
        for b in small_batches(batches):
            ids = [encode_here(own, t or "") for t in b.column(1).to_pylist()]
            columns = [b.column(0), list_array(np.concatenate(ids), [len(x) for x in ids], pa.int32())]
            if decoded:
                columns.append(pa.array(map(own.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    short = rows.where(~is_long).mapInArrow(freed(encode_short), out)

    keyed = rows.where(is_long).withColumn("__key", F.sha2("__text", 256))
    starts = F.sequence(F.lit(0), F.ceil((F.length("__text") - overlap_chars) / step).cast("int") - 1)
    chunks = (
        keyed.select("__key", "__text", F.explode(starts).alias("k"))
        .select("__key", "k", F.substring("__text", F.col("k") * step + 1, F.lit(chunk_chars)).alias("chunk"))
        # copies meet here, and the chunks of a long text go to different tasks
        .groupBy("__key", "k").agg(F.first("chunk").alias("chunk"))
    )

    def pre_tokenise(batches):
        own = codec(*shared.value)
        for b in small_batches(batches):
            lengths = [np.fromiter(map(len, own.pre_tokenise(t)), np.int32) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, list_array(np.concatenate(lengths), [len(x) for x in lengths], pa.int32())], names=["__key", "k", "chunk", "lengths"])

    def join_chunks(group: pd.DataFrame) -> pd.DataFrame:
        own = codec(*shared.value)
        group = group.sort_values("k")
        chunks = ((k * step, c, cut(c, n)) for k, c, n in zip(group["k"].tolist(), group["chunk"], group["lengths"], strict=True))
        parcels, held, size = [], [], 0
        for pieces in stitch(own, chunks):
            held += pieces
            size += sum(map(len, pieces))
            if size >= PARCEL_CHARS:
                parcels.append(held)
                held, size = [], 0
        parcels.append(held)
        return pd.DataFrame({
            "__key": group["__key"].iloc[0], "k": np.arange(len(parcels), dtype=np.int32),
            "parcel": ["".join(p) for p in parcels], "lengths": [np.fromiter(map(len, p), np.int32) for p in parcels],
        })

    def encode_parcels(batches):
        own = codec(*shared.value)
        for b in small_batches(batches):
            ids = []
            for parcel, lengths in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ids.append(np.array(own.encode_pieces(cut(parcel, lengths)), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_array(np.concatenate(ids), [len(x) for x in ids], pa.int32())], names=["__key", "k", "ids"])

    matched = chunks.mapInArrow(freed(pre_tokenise), "__key string, k int, chunk string, lengths array<int>")
    parcels = matched.groupBy("__key").applyInPandas(join_chunks, "__key string, k int, parcel string, lengths array<int>")
    # the result is one array a text, so its ids meet again; the work on them is done by then
    done = parcels.repartition("__key", "k").mapInArrow(freed(encode_parcels), "__key string, k int, ids array<int>")
    joined = done.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts")).select("__key", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    if decoded:
        joined = decode(joined, vocabulary, pattern)
    return short.unionByName(keyed.select(id_col, "__key").join(joined, "__key").select(*out.names))


def decode(encoded: DataFrame, vocabulary: str, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded binary``, the bytes of all ids one after another; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast((rank_file(vocabulary), pattern, stand_ins(pattern)))
    rest = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in rest] + [T.StructField("decoded", T.BinaryType())])
    place = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]):
        own = codec(*shared.value)
        for b in small_batches(batches):
            ids = b.column(place)
            texts = [own.decode(ids[i].values.to_numpy()) if ids[i].is_valid else None for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*rest, "decoded"])

    return bounded(encoded).select(*rest).mapInArrow(freed(run), schema)


def digests(docs: DataFrame, vocabulary: str, pattern: str, **options) -> DataFrame:
    """``encode`` then ``decode``, each result as a count or hash."""
    id_col = options.get("id_col", "doc_id")
    done = encode(docs, vocabulary, pattern, decoded=True, **options)
    return done.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), *_public())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the digests of every document that is left."""
    tidy(spark)
    return digests(docs, *_public())


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLES: dict[str, str] = {}
