"""Toxicity by votes of the nearest labelled examples.

Examples and documents are TF-IDF vectors over all words of the examples.
Document frequencies are counted over all documents.  Plain TF-IDF is deaf to
the labels, so each word's weight is also multiplied by how far its presence
moves the odds of the label (``label_weights``); no word is left out.

The nearest examples by exact cosine come from a block-max inverted index.
Words that few examples have keep posting lists, words that many have keep the
greatest weight of every block of examples besides their weights.  The lists
are summed first; a block is visited only where its best sum and the block
maxima of the other words could still reach the k-th best.  Components are
whole numbers of 2**-24, so cosines are exact and the same in any order.  Votes
are weighted by distance and calibrated by isotonic regression on the examples
themselves, each left out in turn.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karstline.llm.common import alnum_words, bounded, checkpoint, free_names, freed, fresh_name, is_held_out, named, numbered, read_table, small_batches, tidy

#: Labelled texts that are fitted at most, those with the least hash of their id, and their bytes in all.
EXAMPLES, EXAMPLE_BYTES = 6000, 12 << 20
NEIGHBOURS = 15
#: Examples in a block; words that more than a DENSE-th of the examples have keep block maxima.
BLOCK, DENSE = 64, 16
#: An example whose plain TF-IDF cosine to an earlier one is this or more teaches nothing new.
COPY = 0.9
THRESHOLD = 0.7
HELD_OUT_PARTS = 3
#: Components of vectors are multiples of 1 / UNIT; products of two and their sums stay under 2**53.
UNIT = float(1 << 24)


class BlockMaxIndex:
    """Exact top-k inner products of vectors ``(terms, weights)`` with weights of whole numbers, none under 0."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.n, self.block, self.blocks = len(vectors), block, -(-len(vectors) // block)
        self.width = self.blocks * block
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0, np.int32)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
        place = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        dense = np.flatnonzero(np.bincount(term, minlength=terms) * DENSE > self.n)
        self.row = np.full(terms, -1, np.int32)
        self.row[dense] = np.arange(len(dense))
        many = self.row[term] >= 0
        self.dense = np.zeros((len(dense), self.width))
        self.dense[self.row[term[many]], place[many]] = weight[many]
        self.most = self.dense.reshape(len(dense), self.blocks, block).max(axis=2, initial=0.0)
        term, weight, place = term[~many], weight[~many], place[~many]
        order = np.lexsort((place, term))
        self.place, self.weight = place[order].astype(np.int32), weight[order]
        self.count = np.bincount(term, minlength=terms)
        self.start = np.cumsum(self.count) - self.count

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ``(examples, products)`` of the k greatest products from ``least`` on, ties to the smaller example."""
        nothing = np.empty(0, np.int64), np.empty(0)
        if not self.n or not queries:
            return [nothing] * len(queries)
        m, k = len(queries), min(k, self.n)
        term, weight = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        query = np.repeat(np.arange(m), [len(q[0]) for q in queries])
        row = self.row[term]
        many = row >= 0
        asked = np.zeros((m, len(self.dense)))
        asked[query[many], row[many]] = weight[many]
        term, weight, query = term[~many], weight[~many], query[~many]
        count = self.count[term]
        ends = np.cumsum(count)
        at = np.repeat(self.start[term] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.bincount(np.repeat(query * self.width, count) + self.place[at], np.repeat(weight, count) * self.weight[at], m * self.width).reshape(m, self.width)
        # products are at least these sums, so the k-th of them bounds the k-th product from below
        kth = np.maximum(np.partition(sums, self.width - k, axis=1)[:, self.width - k], least)
        bound = sums.reshape(m, self.blocks, self.block).max(axis=2) + asked @ self.most
        visit = bound >= kth[:, None]
        products = np.zeros((m, self.width))
        for b in np.flatnonzero(visit.any(axis=0)).tolist():
            rows, cols = np.flatnonzero(visit[:, b]), slice(b * self.block, (b + 1) * self.block)
            products[rows, cols] = sums[rows, cols] + asked[rows] @ self.dense[:, cols]
        kth = np.maximum(np.partition(products, self.width - k, axis=1)[:, self.width - k], least)
        out = []
        for p, x in zip(products, kth.tolist(), strict=True):
            found = np.flatnonzero(p >= x)
            found = found[np.argsort(-p[found], kind="stable")[:k]]
            out.append((found, p[found]))
        return out


def isotonic(votes: list[float], labels: list[int]) -> tuple[list[float], list[float]]:
    """Pooled adjacent violators: mean vote and smoothed label rate of each pool."""
    pools: list[list[float]] = []
    for v, y in sorted(zip(votes, labels, strict=True)):
        pools.append([1.0, v, y])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0] or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    xs = [v / n for n, v, _ in pools]
    ys = [(y + 0.5) / (n + 1) for n, _, y in pools]
    return xs, list(np.maximum.accumulate(ys)) if ys else []


def label_weights(having: np.ndarray, toxic: np.ndarray, examples: int, positives: int) -> np.ndarray:
    """How far a word's presence moves the odds of the label: the absolute log of the ratio, over 0 for every word."""
    among = (toxic + 0.5) / (positives + 1)
    apart = (having - toxic + 0.5) / (examples - positives + 1)
    return np.abs(np.log(among / apart)) + 1e-6


class Examples:
    """Labelled texts as numbers and counts of their words; the texts themselves are not held."""

    def __init__(self, texts: Iterable[tuple[int, int, str]]):
        """``texts``: id, label and text; one without words is left out."""
        self.words: dict[bytes, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        number = self.words.setdefault
        for i, y, text in texts:
            counts = Counter(alnum_words(text))
            if counts:
                terms = np.fromiter((number(w, len(self.words)) for w in counts), np.int32, len(counts))
                order = np.argsort(terms)
                self.held.append((terms[order], np.fromiter(counts.values(), np.int32, len(counts))[order], i, y))


class Model:
    """Words, their weights, index, calibration, and the label rate of all examples."""

    BATCH = 64

    def __init__(self, examples: Examples, frequencies: np.ndarray, documents: int, k: int = NEIGHBOURS):
        """``frequencies``: by number of the word, how many of ``documents`` documents have it."""
        self.k, self.words = k, examples.words
        plain = np.log((1 + documents) / (1 + frequencies)) + 1
        # examples whose heaviest words agree share blocks, which keeps the block maxima low
        heaviest = [int(t[np.argmax(self.weighted(t, c, plain)[1])]) for t, c, _, _ in examples.held]
        held = [examples.held[i] for i in sorted(range(len(heaviest)), key=lambda i: (heaviest[i], i))]
        held = self.without_copies(held, plain)
        having, toxic = np.zeros(len(self.words)), np.zeros(len(self.words))
        for t, _, _, y in held:
            having[t] += 1
            toxic[t] += y
        self.ids, self.labels = np.array([v[2] for v in held], np.int64), np.array([v[3] for v in held], np.float64)
        self.weights = plain * label_weights(having, toxic, len(held), int(self.labels.sum()))
        self.rate = float((self.labels.sum() + 0.5) / (len(held) + 1))
        weighted = [self.weighted(t, c, self.weights) for t, c, _, _ in held]
        self.index = BlockMaxIndex(weighted, len(self.words))
        votes = []
        for at in range(0, len(weighted), self.BATCH):
            for own, (found, p) in enumerate(self.index.top(weighted[at : at + self.BATCH], k + 1), at):
                votes.append(self.vote(found[found != own][:k], p[found != own][:k]))
        told = [(v, y) for v, y in zip(votes, self.labels.tolist(), strict=True) if v is not None]
        self.xs, self.ys = isotonic([v for v, _ in told], [y for _, y in told])

    def without_copies(self, vectors: list, plain: np.ndarray) -> list:
        """Of examples at ``COPY`` or more to an earlier one that stays, only that one."""
        weighted = [self.weighted(t, c, plain) for t, c, _, _ in vectors]
        index, gone = BlockMaxIndex(weighted, len(self.words)), np.zeros(len(vectors), bool)
        for at in range(0, len(vectors), self.BATCH):
            for own, (found, _) in enumerate(index.top(weighted[at : at + self.BATCH], len(vectors), COPY * UNIT * UNIT), at):
                gone[own] = bool((~gone[found[found < own]]).any())
        return [v for v, out in zip(vectors, gone.tolist(), strict=True) if not out]

    def counted(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the words that examples have."""
        words = self.words
        pairs = sorted((words[w], n) for w, n in counts.items() if w in words)
        return np.array([t for t, _ in pairs], np.int32), np.array([n for _, n in pairs], np.int32)

    @staticmethod
    def weighted(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * weights[terms]
        return terms, np.rint(w * (UNIT / np.sqrt(w @ w))) if len(w) else w

    def vote(self, found: np.ndarray, products: np.ndarray) -> float | None:
        """Share of the label among the nearest, each weighted by the inverse of its distance."""
        if not len(found):
            return None
        near = 1 / (1.05 - products / (UNIT * UNIT))
        return float((near * self.labels[found]).sum() / near.sum())

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float, int]]]]:
        """Calibrated score and evidence ``(example id, cosine, label)`` of each text, from the text alone."""
        out = []
        for at in range(0, len(texts), self.BATCH):
            queries = [self.weighted(*self.counted(Counter(alnum_words(t))), self.weights) for t in texts[at : at + self.BATCH]]
            for found, p in self.index.top(queries, self.k):
                vote = self.vote(found, p)
                score = self.rate if vote is None else float(np.interp(vote, self.xs, self.ys))
                out.append((score, list(zip(self.ids[found].tolist(), (p / (UNIT * UNIT)).tolist(), self.labels[found].astype(int).tolist(), strict=True))))
        return out


def document_frequencies(docs: DataFrame, words: dict[bytes, int], text_col: str) -> tuple[np.ndarray, int]:
    """Of all documents with a text, how many have each of these words, by number, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        number = shared.value
        held, texts = np.zeros(len(number) + 1, np.int64), 0
        for b in small_batches(batches):
            for text in b.column(0).to_pylist():
                if text is not None:
                    texts += 1
                    held[[number[w] for w in set(alnum_words(text)) if w in number]] += 1
        held[-1] = texts
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["word", "n"])

    counted = bounded(docs).select(named(text_col)).mapInArrow(freed(run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    found = np.zeros(len(words) + 1)
    found[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return found[:-1], int(found[-1])


def fit(
    docs: DataFrame, labels: DataFrame, *, examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES, k: int = NEIGHBOURS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Learns from at most ``examples`` labelled texts outside the held-out third, ``example_bytes`` long in all.

    They are those with the least hash of their id; a text that no longer fits into
    ``example_bytes`` is passed over, never cut.  Of rows that share an id the greatest
    label counts and each text is an example; equal texts are one, with the least id;
    so are near copies (``COPY``).  Null ids, labels or texts and texts without words
    teach nothing.  The driver receives the examples and the frequencies of their
    words, which both parameters bound; frequencies are counted over all documents.
    """
    usable = labels.where(named(id_col).isNotNull() & named(label_col).isNotNull() & ~is_held_out(named(id_col), HELD_OUT_PARTS))
    chosen = usable.groupBy(named(id_col).cast("long").alias("id")).agg(F.max(named(label_col)).cast("int").alias("label"))
    chosen = checkpoint(chosen.orderBy(F.xxhash64("id"), "id").limit(examples))
    texts = bounded(docs).select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "id")
    one = texts.groupBy(F.sha2("text", 256).alias("key")).agg(F.min(F.struct("id", "label")).alias("one"), F.first("text").alias("text"))
    one = checkpoint(one.select("key", "one.id", "one.label", "text").orderBy(F.xxhash64("id"), "id", "key").limit(examples))
    sizes = one.select("key", F.octet_length("text").alias("size"), F.xxhash64("id").alias("place"), "id").collect()
    left, fitting = example_bytes, []
    for r in sorted(sizes, key=lambda r: (r.place, r.id, r.key)):
        if r["size"] <= left:
            left -= r["size"]
            fitting.append(r.key)
    if len(fitting) < len(sizes):
        one = one.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in fitting], "key string")), "key", "left_semi")
    table = one.select("id", "label", "text").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    taught = Examples((i.as_py(), y.as_py(), t.as_py()) for i, y, t in zip(*(table.column(c) for c in range(3)), strict=True))
    del table
    return Model(taught, *document_frequencies(docs, taught.words, text_col), k)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Scores every whole text: a row for each input row, in no order.

    Returns ``id_col, score double (0 to 1), evidence array<struct<doc_id long,
    cosine double, label int>>`` (nearest first), after all columns of ``docs`` if
    ``keep``; the two have other names where those columns have these
    (``free_names``).  A text without any word that an example has, null and empty
    ones too, gets the label rate of the examples and no evidence.  Nothing but the
    text enters a score, so equal texts have equal scores.  Ids are whole numbers;
    null and repeated ids are scored like any.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if keep or c == id_col]
    added = free_names(kept, "score", "evidence")
    kinds = T._parse_datatype_string("score double, evidence array<struct<doc_id:long,cosine:double,label:int>>").fields
    rows = numbered(bounded(docs).select(*map(named, kept), named(text_col).alias(fresh_name("text"))))
    schema = T.StructType(rows.schema.fields[:-1] + kinds)
    parts = {"doc_id": pa.int64(), "cosine": pa.float64(), "label": pa.int32()}

    def run(batches):
        own = shared.value
        for b in small_batches(batches):
            pairs = own.score(b.column(len(kept)).to_pylist())
            flat = list(zip(*(e for _, found in pairs for e in found), strict=True)) or [[]] * 3
            ends = np.cumsum([0, *(len(found) for _, found in pairs)])
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, parts.values(), strict=True)], names=list(parts)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array([s for s, _ in pairs], pa.float64()), evidence], names=schema.names)

    return rows.mapInArrow(freed(run), schema).toDF(*kept, *added)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    tidy(spark)  # the driver needs the model no longer
    return scored.select("doc_id", is_held_out(F.col("doc_id"), HELD_OUT_PARTS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of ``THRESHOLD`` or more go."""
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")), keep=True)
    tidy(spark)  # the driver needs the model no longer
    mine = free_names(docs.columns, "score", "evidence")[0]
    return scored.where(named(mine) < THRESHOLD).select(*map(named, docs.columns))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
