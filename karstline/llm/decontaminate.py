"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item gives windows of ``window`` consecutive words (an item with
fewer words, but some, is one window).  Windows of one length share a table:
the shift of a block of two words says how far the search may jump, a block
with shift 0 leads to the bucket of windows that end with it, and direct
comparison of the words confirms an occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstline.llm.common import alnum_words, bounded, checkpoint, free_names, freed, fresh_name, named, numbered, read_table, small_batches, tidy

WINDOW_WORDS = 8
MIN_ITEMS = 2
#: Pairs of a window and an item in one block, the most that the driver and a worker hold at once (under 100 MB).
BLOCK_PAIRS = 50_000
#: Passes over the documents between checkpoints, which keep the plan short.
PASSES = 32


class WuManber:
    """Search for word windows; ``find`` gives each occurrence's start, length and items."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.tables = []
        by_length = defaultdict(list)
        for words, items in patterns.items():
            by_length[len(words)].append((words, items))
        for m, group in sorted(by_length.items()):
            block = min(2, m)
            shift: dict = {}
            bucket = defaultdict(dict)
            for words, items in group:
                for end in range(block, m + 1):
                    key = words[end - block : end]
                    shift[key] = min(shift.get(key, m - block + 1), m - end)
                bucket[words[m - block :]][words] = items
            self.tables.append((m, block, shift, dict(bucket)))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        n = len(words)
        for m, block, shift, bucket in self.tables:
            far, jump, i = m - block + 1, shift.get, m
            while i <= n:
                key = tuple(words[i - block : i])
                by = jump(key, far)
                if by:
                    i += by
                    continue
                items = bucket[key].get(tuple(words[i - m : i]))
                if items is not None:
                    yield i - m, m, items
                i += 1


def window_pairs(items: DataFrame, size: int) -> DataFrame:
    """Distinct pairs ``(item string, words binary)`` of the windows of items ``(item, text)``, words joined by a space."""

    def run(batches):
        for b in small_batches(batches):
            ids, found = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    found.append(b" ".join(words[i : i + size]))
                    if len(ids) >= BLOCK_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], names=["item", "words"])
                        ids, found = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], names=["item", "words"])

    return bounded(items).mapInArrow(freed(run), "item string, words binary").distinct()


def patterns_of(pairs: Iterable[tuple[str, bytes]]) -> dict[tuple[bytes, ...], list]:
    """Items by window, from distinct pairs; equal words are one object."""
    known: dict[bytes, bytes] = {}
    found = defaultdict(list)
    for item, words in pairs:
        found[tuple(known.setdefault(w, w) for w in bytes(words).split(b" "))].append(item)
    return {w: sorted(x) for w, x in found.items()}


def pattern_blocks(pairs: DataFrame, block_pairs: int) -> Iterator[dict[tuple[bytes, ...], list]]:
    """Blocks of patterns one after another; neither a long item nor a window of many items makes a block larger."""
    pairs = checkpoint(pairs)
    blocks = max(1, -(-pairs.count() // block_pairs))
    if blocks == 1:
        yield patterns_of(pairs.collect())
        return
    of = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).alias("block")
    dealt = pairs.select(of, "item", "words").repartition(blocks, "block").sortWithinPartitions("block")
    for _, rows in groupby(dealt.toLocalIterator(), lambda r: r["block"]):
        yield patterns_of((r["item"], r["words"]) for r in rows)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


ADDED = {"n_words": "long", "spans": "array<struct<first_word:int,after_word:int>>", "items": "array<string>"}


def scan(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", keep_text: bool = False, block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """Occurrences of benchmark windows in each document.

    Returns a row for each input row: ``id_col, n_words long, spans array<struct<
    first_word int, after_word int>>`` (merged, in words), ``items array<string>``
    (sorted ids of items with occurring windows), after all columns of ``docs`` if
    ``keep_text``; the three have other names where those columns have these
    (``free_names``).  Null or empty texts have no words; items without id or words
    have no windows; equal items each count; items that share an id are one; an
    empty benchmark hits nothing.

    The benchmark's pairs of window and item are counted first.  Up to
    ``block_pairs`` are broadcast in one block; more are dealt by their hash into as
    many blocks as it takes, each searched by a pass over the documents that adds to
    the spans and items, so no broadcast grows with the benchmark.
    """
    spark = docs.sparkSession
    items = benchmark.select(named(item_col).cast("string").alias("item"), named(item_text_col).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    kept = list(docs.columns) if keep_text else [id_col]
    added = free_names(kept, *ADDED)
    body = text_col if keep_text else fresh_name("text")
    # the text rides along while passes remain
    columns = [*map(named, kept), *([] if keep_text else [named(text_col).alias(body)])]
    out = bounded(docs).select(*columns, *[F.lit(None).cast(t).alias(n) for n, t in zip(added, ADDED.values(), strict=True)])
    names, before = out.columns, len(columns)
    text_at = names.index(body)
    out = numbered(out)
    schema = out.schema
    kinds = [pa.int64(), pa.list_(pa.struct([("first_word", pa.int32()), ("after_word", pa.int32())])), pa.list_(pa.string())]

    def one_pass(shared):
        def run(batches):
            search = WuManber(shared.value)
            for b in small_batches(batches):
                n_words, all_spans, all_items = [], [], []
                for text, spans, ids in zip(*(b.column(i).to_pylist() for i in (text_at, before + 1, before + 2)), strict=True):
                    words = alnum_words(text)
                    spans, ids = [(s["first_word"], s["after_word"]) for s in spans or ()], set(ids or ())
                    for start, length, its in search.find(words):
                        spans.append((start, start + length))
                        ids.update(its)
                    n_words.append(len(words))
                    all_spans.append([{"first_word": x, "after_word": y} for x, y in merged(spans)])
                    all_items.append(sorted(ids))
                done = [pa.array(v, t) for v, t in zip((n_words, all_spans, all_items), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:before], *done], names=schema.names)

        return run

    for n, patterns in enumerate(pattern_blocks(window_pairs(items, window), block_pairs)):
        if n and n % PASSES == 0:
            out = checkpoint(out)
        out = out.mapInArrow(freed(one_pass(spark.sparkContext.broadcast(patterns))), schema)
    out = out.toDF(*names)
    return out if keep_text else out.drop(body)


def report(scanned: DataFrame, *, id_col: str = "doc_id", min_items: int = MIN_ITEMS) -> DataFrame:
    """The counts and hash of a scan; contaminated: at least ``min_items`` items."""
    n_words, spans, items = free_names([id_col], *ADDED)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["after_word"] - s["first_word"]))
    return scanned.select(
        named(id_col), F.col(n_words).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(items) >= min_items).alias("contaminated"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with windows of any benchmark item go, all others stay whole."""
    tidy(spark)
    found = scan(docs, read_table(spark, sf_dir, "benchmark"), keep_text=True)
    items = free_names(docs.columns, *ADDED)[-1]
    return found.where(F.size(named(items)) == 0).select(*map(named, docs.columns))


ORACLE = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS size, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, (SELECT DISTINCT size FROM item_windows))),
hits AS (
  SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, phrase)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {"op9_decontaminate": ORACLE}
