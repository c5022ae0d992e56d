"""Language-model scoring with a hierarchical Pitman-Yor model.

A text's words and one end mark are customers of the restaurant of their
context, the word before (``CONTEXT_BITS`` of its hash), so there are as many
restaurants as the corpus has words.  All context restaurants share one parent,
where each of their tables is a customer; its base spreads over the training
words and one symbol for all others.  Seating is sampled by Gibbs: the number of
tables of one dish in one restaurant is drawn anew, given all others, from its
exact distribution (generalised Stirling numbers count the seatings).  A word's
probability is its predictive probability averaged over samples.

Spark deals the tokens by word: a bucket holds every token of its words, hence
all their dishes and the parent's part for them.  A context's totals are spread
over buckets.  Between passes each bucket sends its part of them to the
context's owner, which sums and answers; contexts that one bucket has alone
need no messages after the first.  A pass goes on from the seating where the
last one stopped.  The samples of the last pass are kept, their own totals are
summed, and texts are scored with these, so probabilities sum to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstline.llm.common import WordHashes, bounded, checkpoint, freed, is_held_out, mix64, named, plain_words, read_table, small_batches

HELD_OUT_PARTS = 5
#: Bits of a word's hash that tell contexts apart: of 10**8 words some 20 pairs are expected to share a restaurant.
CONTEXT_BITS = 48
BURN_IN, SAMPLES, PASSES = 4, 4, 2
#: Strengths of context restaurants and of their parent.
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
#: Text bytes whose tokens meet in one bucket, about, and tokens or documents that are packed at once.
BUCKET_BYTES, PART_TOKENS, PART_DOCS = 20 << 20, 1_500_000, 60_000
#: Owners of contexts at most: each holds its share of all contexts in a task.
OWNERS = 4096
#: Documents of the sample that says which words are spread over all buckets (layout only: results stay exact), and such words at most.
LAYOUT_DOCS, HOT_WORDS = 4000, 2048
#: Customers of one dish up to which its tables are drawn from their exact distribution.
EXACT = 64
#: Customers up to which the weights are multiplied as they are, without a risk to underflow; beyond, by their logs.
PLAIN = 12
#: With more, customers sit down in turn, one by one up to this number, then in groups of a 64th of those seated.
SINGLY = 256
#: Hashed like a word, but no word holds a space.
END, START = b"end of text", b"start of text"
_SHIFT = np.uint64(64 - CONTEXT_BITS)


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Log of the generalised Stirling numbers: weights of the seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
        out[c + 1] = stay
        out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
    return out


class Seating:
    """Draws how many tables the customers of one dish take, for many dishes at once."""

    def __init__(self, discount: float, rng: np.random.Generator):
        self.discount, self.rng, self.log = discount, rng, stirling(discount)

    @staticmethod
    def by_size(customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The dishes sorted by their customers, and where each number from 2 on begins."""
        order = np.argsort(customers, kind="stable")
        return order, np.searchsorted(customers[order], np.arange(2, EXACT + 2), "left")

    def draw(
        self, customers: np.ndarray, room: np.ndarray, later: np.ndarray, whole: float, grows: int = 1,
        sorted_by: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> np.ndarray:
        """Tables of each dish.

        ``room`` is the restaurant's strength plus discount times its other tables.
        A further table's dish comes from the parent with probability ``(later + j) /
        (whole + j)`` after j tables of it here, or always the same if ``grows`` is 0.
        """
        tables = np.ones(len(customers))
        order, ends = sorted_by or self.by_size(customers)
        for c, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), 2):
            if a == b:
                continue
            at, j = order[a:b], np.arange(1, c)
            # each further table's weight over that of the first alone, which all numbers of tables share
            new = (room[at, None] + self.discount * j) * ((later[at, None] + grows * j) / (whole + grows * j))
            if c <= PLAIN:
                weight = np.empty((b - a, c))
                weight[:, 0] = 1.0
                np.cumprod(new, axis=1, out=weight[:, 1:])
                weight *= np.exp(self.log[c, 1 : c + 1] - self.log[c, c])
            else:
                weight = np.zeros((b - a, c))
                np.cumsum(np.log(new), axis=1, out=weight[:, 1:])
                weight += self.log[c, 1 : c + 1]
                weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            p = np.cumsum(weight, axis=1)
            tables[at] = 1 + (p < self.rng.random((b - a, 1)) * p[:, -1:]).sum(axis=1)
        many = order[ends[-1] :]
        if len(many):
            tables[many] = self._in_turn(customers[many], room[many], later[many], whole, grows)
        return tables

    def _in_turn(self, customers: np.ndarray, room: np.ndarray, later: np.ndarray, whole: float, grows: int) -> np.ndarray:
        order = np.argsort(-customers, kind="stable")
        c, r, q = customers[order], room[order], later[order]
        tables, seated = np.ones(len(c)), 1
        while n := int(np.searchsorted(-c, -seated, "left")):
            step = 1 if seated < SINGLY else seated // 64
            t = tables[:n]
            new = (r[:n] + self.discount * t) * (q[:n] + grows * t) / (whole + grows * t)
            p = new / (new + seated - self.discount * t)
            tables[:n] += self.rng.random(n) < p if step == 1 else self.rng.binomial(np.minimum(step, c[:n] - seated).astype(np.int64), p)
            seated += step
        out = np.empty(len(c))
        out[order] = tables
        return out


@dataclass
class Totals:
    """What is summed over all buckets; its size is set by HOT_WORDS and SAMPLES."""

    tokens: float = 0.0
    words: float = 0.0
    discount: float = 0.5
    root_discount: float = 0.5
    unknown: float = 0.5
    hot_counts: dict[int, float] = field(default_factory=dict)
    #: By sample: the root's customers and tables; of hot words, the root's customers and tables.
    root_customers: list[float] = field(default_factory=list)
    root_tables: list[float] = field(default_factory=list)
    hot: list[dict[int, tuple[float, float]]] = field(default_factory=list)

    def base(self, known: np.ndarray) -> np.ndarray:
        """The parent's base: the unknown symbol's share, the rest even over the training words."""
        return np.where(known, (1 - self.unknown) / max(1.0, self.words), self.unknown)

    def root(self, customers: np.ndarray, tables: np.ndarray, known: np.ndarray, s: int) -> np.ndarray:
        """The parent's predictive probabilities."""
        whole = ROOT_STRENGTH + self.root_customers[s]
        return (customers - self.root_discount * tables + (ROOT_STRENGTH + self.root_discount * self.root_tables[s]) * self.base(known)) / whole


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers, one byte of all of them after another, each compressed by itself."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    press = zstandard.ZstdCompressor(level=1).compress
    parts = [press(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]
    return np.array([len(values), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def unsqueeze(data: memoryview, kind: type) -> tuple[np.ndarray, memoryview]:
    """The numbers, and what lies behind them."""
    size = np.dtype(kind).itemsize
    head = np.frombuffer(data, np.uint32, size + 1)
    n, data = int(head[0]), data[4 * (size + 1) :]
    planes = np.zeros((size, n), np.uint8)
    for plane, length in zip(planes, head[1:].tolist(), strict=True):
        if length:
            plane[:] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[:length]), np.uint8)
            data = data[length:]
    return np.ascontiguousarray(planes.T).view(kind).ravel(), data


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which squeeze better."""
    return np.diff(sorted_values, prepend=np.uint64(0))


def _pack(token: np.ndarray, context: np.ndarray, docs: np.ndarray, learns: np.ndarray) -> bytes:
    """Tokens, put in order by word, then context."""
    words, word = np.unique(token, return_inverse=True)
    contexts, place = np.unique(context, return_inverse=True)
    order = np.argsort(word * len(contexts) + place)
    runs = np.bincount(word)
    parts = [_steps(words), runs.astype(np.uint32), _steps(contexts), place[order].astype(np.uint32), docs[order].astype(np.uint16), np.packbits(learns[order])]
    return b"".join(map(squeeze, parts))


def _unpack(blob: bytes):
    """Words with their runs, contexts and their places, documents, and whether they teach."""
    data, out = memoryview(blob), []
    for kind in (np.uint64, np.uint32, np.uint64, np.uint32, np.uint16, np.uint8):
        values, data = unsqueeze(data, kind)
        out.append(np.cumsum(values, dtype=np.uint64) if kind is np.uint64 else values)
    return *out[:5], np.unpackbits(out[5], count=len(out[3])).astype(bool)


class Bucket:
    """Tokens of a share of the words: dishes ``(word, context)`` with counts, and where each token stands."""

    def __init__(self, number: int, rows: list[tuple[int, bytes]]):
        self.number = number
        self.parts = [p for p, _ in rows]
        unpacked = [_unpack(blob) for _, blob in rows]
        self.words = np.unique(np.concatenate([u[0] for u in unpacked]))
        self.contexts = np.unique(np.concatenate([u[2] for u in unpacked]))
        n = len(self.contexts)
        keys, train, self.docs = [], [], []
        for words, runs, contexts, place, docs, learns in unpacked:
            keys.append(np.repeat(np.searchsorted(self.words, words) * n, runs) + np.searchsorted(self.contexts, contexts)[place])
            train.append(learns)
            self.docs.append(docs)
        self.sizes = [len(k) for k in keys]
        del unpacked
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.append(True, keys[1:] != keys[:-1])
        dishes = keys[first]
        self.place = np.empty(len(keys), np.int32)
        self.place[order] = np.cumsum(first, dtype=np.int32) - 1
        del keys, order, first
        self.word, self.context = (dishes // n).astype(np.int32), (dishes % n).astype(np.int32)
        del dishes
        self.count = np.bincount(self.place[np.concatenate(train)], minlength=len(self.word)).astype(np.float64)
        self.word_count = np.bincount(self.word, self.count, len(self.words))
        self.customers = np.bincount(self.context, self.count, n)
        self.several = np.flatnonzero(self.count > 1)

    def of_contexts(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, tables, len(self.contexts))

    def of_words(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, tables, len(self.words))

    def hot(self, values: dict) -> tuple[np.ndarray, list]:
        """Places of the words that are spread over all buckets, and what is known of each."""
        at = [(i, values[w]) for i, w in enumerate(self.words.view(np.int64).tolist()) if w in values] if values else []
        return np.array([i for i, _ in at], np.int64), [v for _, v in at]

    def known(self, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Training count of each word over all buckets, and whether it has any."""
        count = self.word_count.copy()
        at, values = self.hot(totals.hot_counts)
        count[at] = values
        return count, count > 0

    def messages(self, shared: np.ndarray, tables: list[np.ndarray], owners: int) -> Iterator[tuple[int, bytes]]:
        """For each owner the contexts ``shared`` with this bucket's customers and tables, by sample."""
        contexts = self.contexts[shared]
        owner = ((contexts >> np.uint64(16)) * np.uint64(owners)) >> np.uint64(CONTEXT_BITS - 16)
        ends = np.searchsorted(owner, np.arange(owners + 1))
        values = [self.customers[shared], *[self.of_contexts(t)[shared] for t in tables]]
        for o, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if a < b:
                yield o, squeeze(_steps(contexts[a:b])) + b"".join(squeeze(v[a:b].astype(np.uint64)) for v in values)


@dataclass
class State:
    """A bucket's seating by sample, and which of its contexts other buckets have too."""

    tables: list[np.ndarray]
    root: list[np.ndarray]
    shared: np.ndarray

    def blob(self, bucket: Bucket) -> bytes:
        parts = [squeeze(np.packbits(self.shared))]
        for t, t0 in zip(self.tables, self.root, strict=True):
            parts += [squeeze(t[bucket.several].astype(np.uint32)), squeeze(t0.astype(np.uint32))]
        return b"".join(parts)

    @staticmethod
    def read(blob: bytes, bucket: Bucket) -> State:
        bits, data = unsqueeze(memoryview(blob), np.uint8)
        tables, root = [], []
        while len(data):
            t = (bucket.count > 0).astype(np.float64)
            t[bucket.several], data = unsqueeze(data, np.uint32)
            t0, data = unsqueeze(data, np.uint32)
            tables.append(t)
            root.append(t0.astype(np.float64))
        return State(tables, root, np.unpackbits(bits, count=len(bucket.contexts)).astype(bool))


def start(bucket: Bucket) -> State:
    """One table for each dish and, in the parent, for each word."""
    t = (bucket.count > 0).astype(np.float64)
    return State([t], [np.minimum(bucket.of_words(t), 1)], np.ones(len(bucket.contexts), bool))


def answered(bucket: Bucket, state: State, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Customers of each context, and its tables in other buckets by sample, from its owners' answers in their order."""
    found: list[list[np.ndarray]] = [[] for _ in range(1 + len(state.tables))]
    for _, blob in sorted(answers):
        data = memoryview(blob)
        for values in found:
            v, data = unsqueeze(data, np.uint64)
            values.append(v.astype(np.float64))
    joined = [np.concatenate(v) if v else np.empty(0) for v in found]
    customers = bucket.customers.copy()
    customers[state.shared] = joined[0]
    elsewhere = []
    for t, whole in zip(state.tables, joined[1:], strict=True):
        other = np.zeros(len(customers))
        other[state.shared] = whole - bucket.of_contexts(t)[state.shared]
        elsewhere.append(other)
    return customers, elsewhere


def sweeps(bucket: Bucket, totals: Totals, state: State, customers: np.ndarray, elsewhere: list[np.ndarray], seed: int, burn_in: int, samples: int) -> State:
    """Goes on sampling from the last sample of ``state``; the last ``samples`` sweeps are kept."""
    rng = np.random.default_rng([seed, bucket.number])
    leaf, parent = Seating(totals.discount, rng), Seating(totals.root_discount, rng)
    s = len(state.tables) - 1
    t, t0, other = state.tables[s].copy(), state.root[s].copy(), elsewhere[s]
    _, known = bucket.known(totals)
    base = totals.base(known) * (ROOT_STRENGTH + totals.root_discount * totals.root_tables[s])
    whole = ROOT_STRENGTH + totals.root_customers[s]
    hot, values = bucket.hot(totals.hot[s])
    far = np.zeros(len(bucket.words))
    if len(hot):
        far[hot], t0[hot] = np.array(values).T
        far[hot] -= bucket.of_words(t)[hot]
    cold = np.ones(len(bucket.words), bool)
    cold[hot] = False
    turns = [bucket.several[bucket.several % 2 == half] for half in (0, 1)]
    sorted_by = [leaf.by_size(bucket.count[turn]) for turn in turns]
    kept = State([], [], state.shared & (customers != bucket.customers))
    for sweep in range(burn_in + samples):
        for turn, order in zip(turns, sorted_by, strict=True):
            w, u, own = bucket.word[turn], bucket.context[turn], t[turn]
            room = STRENGTH + totals.discount * (other + bucket.of_contexts(t))[u] - totals.discount * own
            c0 = np.maximum((far + bucket.of_words(t))[w] - own, 0)
            tables = np.minimum(t0[w], c0)
            # the first table of a word that the parent has nowhere else takes a table there
            later = base[w] + np.where(c0 > 0, c0 - totals.root_discount * tables, -totals.root_discount)
            t[turn] = leaf.draw(bucket.count[turn], room, later, whole, sorted_by=order)
            c0 = far + bucket.of_words(t)
            t0[cold] = np.minimum(c0[cold], 1)
            many = np.flatnonzero(cold & (c0 > 1))
            chance, room = totals.base(known)[many], ROOT_STRENGTH + totals.root_discount * np.maximum(totals.root_tables[s] - t0[many], 0)
            t0[many] = parent.draw(c0[many], room, chance, 1.0, 0)
        if sweep >= burn_in:
            kept.tables.append(t.copy())
            kept.root.append(t0.copy())
    return kept


def log_probabilities(bucket: Bucket, totals: Totals, state: State, customers: np.ndarray, elsewhere: list[np.ndarray]) -> np.ndarray:
    """Log10 of each dish's predictive probability, averaged over the samples of ``state``."""
    _, known = bucket.known(totals)
    sum_of = np.zeros(len(bucket.count))
    for s, (t, t0) in enumerate(zip(state.tables, state.root, strict=True)):
        c0, t0 = bucket.of_words(t), t0.copy()
        at, values = bucket.hot(totals.hot[s])
        if len(at):
            c0[at], t0[at] = np.array(values).T
        root = totals.root(c0, t0, known, s)
        backoff = (STRENGTH + totals.discount * (elsewhere[s] + bucket.of_contexts(t))) / (STRENGTH + customers)
        u = bucket.context
        sum_of += (bucket.count - totals.discount * t) / (STRENGTH + customers[u]) + backoff[u] * root[bucket.word]
    return np.log10(sum_of / len(state.tables))


def _parts(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """``(bucket, part, blob)``: packed tokens by bucket, and under bucket -1 the documents of each part."""
    end, start = (np.uint64(WordHashes()[x]) for x in (END, START))

    def run(batches):
        hashes = WordHashes()
        number = TaskContext.get().partitionId() << 24
        held: list = []

        def flush():
            nonlocal number, held
            ids, learns, words = zip(*held, strict=True)
            sizes = np.array([len(w) for w in words])
            token = np.concatenate(words)
            before = np.empty_like(token)
            before[1:] = token[:-1]
            before[np.cumsum(sizes) - sizes] = start
            context = before >> _SHIFT
            del before, words
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            bucket = ((token >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
            spread = np.isin(token, hot)
            bucket[spread] = mix64(token[spread] ^ mix64(context[spread] + np.uint64(1))) % np.uint64(buckets)
            del spread
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            token, context, doc, bucket = token[order], context[order], doc[order], bucket[order]
            del order
            learn = np.array(learns)[doc]
            rows = [(-1, number, _documents(ids, learns, sizes))]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                rows.append((int(bucket[a]), number, _pack(token[a:b], context[a:b], doc[a:b], learn[a:b])))
            number += 1
            held = []
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "part", "blob"])

        tokens = 0
        for b in small_batches(batches):
            for i, text, out in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                held.append((i, not out, np.append(hashes.array(plain_words(text)), end)))
                tokens += len(held[-1][2])
                if tokens >= PART_TOKENS or len(held) >= PART_DOCS:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return docs.mapInArrow(freed(run), "bucket int, part long, blob binary")


def _documents(ids: tuple, learns: tuple, sizes: np.ndarray) -> bytes:
    numbers = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    return b"".join([squeeze(numbers), squeeze(np.packbits([i is not None for i in ids])), squeeze(np.packbits(learns)), squeeze(sizes.astype(np.uint64))])


def _read_documents(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, data = unsqueeze(memoryview(blob), np.uint64)
    has_id, data = unsqueeze(data, np.uint8)
    learns, data = unsqueeze(data, np.uint8)
    sizes, _ = unsqueeze(data, np.uint64)
    return ids.view(np.int64), *(np.unpackbits(x, count=len(ids)).astype(bool) for x in (has_id, learns)), sizes.astype(np.int64)


def _buckets(batches):
    """Whole buckets from rows that come sorted by bucket."""
    number, rows = None, []
    for b in small_batches(batches, 64):
        for k, part, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if k != number and rows:
                yield Bucket(number, rows)
                rows = []
            number = k
            rows.append((part, blob))
    if rows:
        yield Bucket(number, rows)


#: Kinds of rows that a pass gives: to a context's owner, its answer, a bucket's state, and sums for the driver.
MESSAGE, ANSWER, STATE, HOT, REST = range(5)
_VALUES = [f"v{s}" for s in range(max(SAMPLES, 2))]
_ROWS = "owner int, bucket int, kind int, key long, blob binary, " + ", ".join(f"{v} double" for v in _VALUES)
_NAMES = ["owner", "bucket", "kind", "key", "blob", *_VALUES]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.float64()] * len(_VALUES)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows ``(owner, bucket, kind, key, blob, *values)`` with as many values as they have."""
    full = [(*r, *[0.0] * (len(_NAMES) - len(r))) for r in rows]
    cols = list(zip(*full, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=_NAMES)


def _out(bucket: Bucket, state: State, owners: int, keep: bool) -> list[tuple]:
    """What a bucket sends: its part of shared contexts, and its state if it is kept."""
    rows = [(o, bucket.number, MESSAGE, 0, blob) for o, blob in bucket.messages(state.shared, state.tables, owners)]
    return rows + [(bucket.number % owners, bucket.number, STATE, 0, state.blob(bucket))] * keep


def _answered_by_owners(rows: DataFrame, owners: int) -> DataFrame:
    """The answers to the messages, and all other rows as they are, in a checkpoint."""

    def run(batches):
        owner, held = None, []
        for b in small_batches(batches, 64):
            rows = list(zip(*(b.column(i).to_pylist() for i in range(len(_NAMES))), strict=True))
            out = []
            for r in rows:
                if r[0] != owner:
                    if held:
                        yield from _answers(owner, held)
                    owner, held = r[0], []
                if r[2] == MESSAGE:
                    held.append((r[1], r[4]))
                else:
                    out.append(r)
            if out:
                yield _batch(out)
        if held:
            yield from _answers(owner, held)

    return checkpoint(rows.repartition(owners, "owner").sortWithinPartitions("owner").mapInArrow(freed(run), _ROWS))


def _answers(owner: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    contexts, values = [], []
    for _, blob in held:
        steps, data = unsqueeze(memoryview(blob), np.uint64)
        contexts.append(np.cumsum(steps, dtype=np.uint64))
        own = []
        while len(data):
            v, data = unsqueeze(data, np.uint64)
            own.append(v.astype(np.float64))
        values.append(own)
    every, place = np.unique(np.concatenate(contexts), return_inverse=True)
    sums = [np.bincount(place, np.concatenate(v), len(every)).astype(np.uint64) for v in zip(*values, strict=True)]
    c, t = sums[0].astype(np.float64), sums[1].astype(np.float64)
    # what the contexts' customers leave to the parent is linear in the discount
    yield _batch([(owner, -1, REST, 2, b"", float((c * STRENGTH / (STRENGTH + c)).sum()), float((c * t / (STRENGTH + c)).sum()))])
    at = 0
    for (bucket, _), own in zip(held, contexts, strict=True):
        mine = place[at : at + len(own)]
        at += len(own)
        yield _batch([(owner, bucket, ANSWER, owner, b"".join(squeeze(v[mine]) for v in sums))])


def _summed(rows: DataFrame) -> dict[int, dict[int, list[float]]]:
    """Sums by kind and key: rows for hot words and a few more, whatever the corpus."""
    out: dict[int, dict[int, list[float]]] = {HOT: {}, REST: {}}
    for r in rows.where(F.col("kind").isin(HOT, REST)).groupBy("kind", "key").agg(*[F.sum(v).alias(v) for v in _VALUES]).collect():
        out[r["kind"]][r["key"]] = [r[v] for v in _VALUES]
    return out


def _count(tokens: DataFrame, hot: np.ndarray, owners: int) -> tuple[Totals, DataFrame]:
    """First pass: exact counts, and totals of the seating with one table a dish."""
    hot_keys = set(hot.view(np.int64).tolist())

    def run(batches):
        for b in _buckets(batches):
            state = start(b)
            some = b.count > 0
            spread = np.array([w in hot_keys for w in b.words.view(np.int64).tolist()])
            dishes = np.bincount(b.word[some], minlength=len(b.words))
            rows = _out(b, state, owners, False)
            own = b.number % owners
            rows += [(own, -1, HOT, int(w), b"", float(n), float(d)) for w, n, d in zip(b.words.view(np.int64)[spread].tolist(), b.word_count[spread], dishes[spread], strict=True)]
            cold = b.word_count[~spread]
            first = [(b.word_count.sum(), dishes.sum()), ((cold > 0).sum(), (cold == 1).sum()), None, ((b.count == 1).sum(), (b.count == 2).sum()), ((dishes[~spread] == 1).sum(), (dishes[~spread] == 2).sum())]
            rows += [(own, -1, REST, key, b"", *map(float, values)) for key, values in enumerate(first) if values]
            yield _batch(rows)

    answers = _answered_by_owners(tokens.mapInArrow(freed(run), _ROWS), owners)
    found = _summed(answers)
    more = [found[REST].get(i, [0.0, 0.0]) for i in range(5)]
    hot_counts = {w: v[0] for w, v in found[HOT].items()}
    words = more[1][0] + sum(v > 0 for v in hot_counts.values())
    once = more[1][1] + sum(v == 1 for v in hot_counts.values())
    ratio = lambda one, two: min(0.95, max(0.05, one / max(1.0, one + 2 * two)))
    totals = Totals(more[0][0], words, ratio(*more[3][:2]), ratio(*more[4][:2]), 0.5, hot_counts, [more[0][1]], [words], [{w: (v[1], min(v[1], 1.0)) for w, v in found[HOT].items()}])
    # Good and Turing's share of words never seen, carried back through both restaurants
    unseen = (once + 0.5) / (totals.tokens + 1)
    left = (more[2][0] + totals.discount * more[2][1]) / max(1.0, totals.tokens)
    left *= (ROOT_STRENGTH + totals.root_discount * words) / (ROOT_STRENGTH + more[0][1])
    return replace(totals, unknown=min(0.95, max(1 / (words + 1), unseen / max(left, 1e-12)))), answers


def _read_bucket(left: pa.Table, right: pa.Table) -> tuple[Bucket, State, np.ndarray, list[np.ndarray]]:
    """A bucket, its state, and its contexts' customers and tables elsewhere, from its rows and the answers to it."""
    rows = sorted(zip(*(left.column(c).to_pylist() for c in ("part", "blob")), strict=True))
    bucket = Bucket(left.column("bucket")[0].as_py(), rows)
    found = list(zip(*(right.column(c).to_pylist() for c in ("kind", "key", "blob")), strict=True))
    states = [State.read(blob, bucket) for kind, _, blob in found if kind == STATE]
    state = states[0] if states else start(bucket)
    return bucket, state, *answered(bucket, state, [(key, blob) for kind, key, blob in found if kind == ANSWER])


def _cogrouped(tokens: DataFrame, answers: DataFrame):
    to_buckets = answers.where(F.col("kind").isin(ANSWER, STATE)).select("bucket", "kind", "key", "blob")
    return tokens.groupBy("bucket").cogroup(to_buckets.groupBy("bucket"))


def _sample(tokens: DataFrame, totals: Totals, answers: DataFrame, owners: int, seed: int, burn_in: int, samples: int) -> tuple[Totals, DataFrame]:
    """One pass of sampling that goes on from the last: the totals of its samples, and what owners answer."""
    shared = tokens.sparkSession.sparkContext.broadcast(totals)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        old = shared.value
        bucket, state, customers, elsewhere = _read_bucket(left, right)
        state = sweeps(bucket, old, state, customers, elsewhere, seed, burn_in, samples)
        at, _ = bucket.hot(old.hot_counts)
        own = bucket.number % owners
        rows = _out(bucket, state, owners, True)
        tables = [bucket.of_words(t)[at] for t in state.tables]
        rows += [(own, -1, HOT, w, b"", *map(float, c)) for w, *c in zip(bucket.words.view(np.int64)[at].tolist(), *tables, strict=True)]
        cold = np.ones(len(bucket.words), bool)
        cold[at] = False
        rows.append((own, -1, REST, 0, b"", *(float(t.sum()) for t in state.tables)))
        rows.append((own, -1, REST, 1, b"", *(float(t0[cold].sum()) for t0 in state.root)))
        return pa.Table.from_batches([_batch(rows)])

    answers = _answered_by_owners(_cogrouped(tokens, answers).applyInArrow(run, _ROWS), owners)
    found = _summed(answers)
    customers, cold = (found[REST].get(i, [0.0] * samples)[:samples] for i in (0, 1))
    seating = Seating(totals.root_discount, np.random.default_rng([seed, 1 << 31]))
    words, hot, tables = sorted(found[HOT]), [], []
    for s in range(samples):
        c = np.array([found[HOT][w][s] for w in words])
        known = c > 0
        chance = totals.base(known)
        before = np.array([totals.hot[-1][w][1] for w in words])
        room = ROOT_STRENGTH + totals.root_discount * np.maximum(totals.root_tables[-1] - before, 0)
        t = np.where(known, seating.draw(np.maximum(c, 1), room, chance, 1.0, 0), 0.0)
        hot.append({w: (x, y) for w, x, y in zip(words, c.tolist(), t.tolist(), strict=True)})
        tables.append(cold[s] + t.sum())
    return replace(totals, root_customers=list(customers), root_tables=tables, hot=hot), answers


def _score(tokens: DataFrame, totals: Totals, answers: DataFrame) -> DataFrame:
    """``(part, blob)`` of sums by document, one for each bucket and part."""
    shared = tokens.sparkSession.sparkContext.broadcast(totals)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        totals = shared.value
        b, state, customers, elsewhere = _read_bucket(left, right)
        count, known = b.known(totals)
        model = log_probabilities(b, totals, state, customers, elsewhere)
        base = np.log10((count + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))[b.word]
        known = known[b.word]
        at, blobs = 0, []
        for docs, n in zip(b.docs, b.sizes, strict=True):
            place = b.place[at : at + n]
            at += n
            held, local = np.unique(docs, return_inverse=True)
            sums = [np.bincount(local, x[place], len(held)) for x in (known, base, model)]
            blobs.append(squeeze(held) + squeeze(sums[0].astype(np.uint32)) + sums[1].tobytes() + sums[2].tobytes())
        return pa.table([pa.array(b.parts, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return _cogrouped(tokens, answers).applyInArrow(run, "part long, blob binary")


def _placed(rows: DataFrame) -> DataFrame:
    """A checkpoint that remembers how its rows are dealt, so that later passes move only what is small.

    Adaptive plans forget it; the session's setting is as before when this returns.
    """
    conf = rows.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(rows)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out_parts: int = HELD_OUT_PARTS, bucket_bytes: int = BUCKET_BYTES,
    passes: int = PASSES, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 1,
) -> DataFrame:
    """Base and model log10 probabilities of every whole text, learned from all texts not held out.

    Returns a row for each input row: ``id_col long, held_out boolean, n_tokens,
    n_known, train_tokens long, base_score, score, perplexity double``.  A null or
    empty text is its end mark alone; a null id is not held out; repeated rows are
    customers each and get the same scores; an empty table gives no rows.  Words
    that no training text has share one symbol.  Other columns are left out.  Rows
    must come in an order that a lost task would see again, as a table's or a
    checkpoint's do: parts refer to documents by their place.

    ``passes`` of ``burn_in`` sweeps each go before the ``samples`` (``SAMPLES`` at
    most) that are averaged, which are one sweep apart.
    """
    if not 0 < samples <= SAMPLES or passes < 1:
        raise ValueError(f"samples are 1 to {SAMPLES}, passes 1 or more")
    ident, text = named(id_col).cast("long"), named(text_col)
    rows = bounded(docs).select(ident.alias("id"), text.alias("text"), is_held_out(named(id_col), held_out_parts).alias("out"))
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-int(size) // bucket_bytes))
    owners = min(buckets, OWNERS)
    hot = _hot_words(rows.where(F.rand(seed) < LAYOUT_DOCS / max(1, int(n))).limit(2 * LAYOUT_DOCS), buckets)
    packed = _placed(_parts(rows, buckets, hot).repartition(buckets, "bucket").sortWithinPartitions("bucket", "part"))
    tokens = packed.where("bucket >= 0")
    totals, answers = _count(tokens, hot, owners)
    for i in range(1, passes + 1):
        totals, answers = _sample(tokens, totals, answers, owners, seed + i, burn_in, samples if i == passes else 1)
    sums = _score(tokens, totals, answers)
    parts = packed.where("bucket < 0").select("part", "blob", F.lit(True).alias("first"))
    train_tokens = int(totals.tokens)

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        ids, has_id, learns, sizes = _read_documents(group.loc[group["first"], "blob"].iloc[0])
        total = np.zeros((3, len(ids)))
        for blob in group.loc[~group["first"], "blob"]:
            held, data = unsqueeze(memoryview(blob), np.uint16)
            known, data = unsqueeze(data, np.uint32)
            total[0, held] += known
            total[1:, held] += np.frombuffer(data, np.float64).reshape(2, -1)
        return pd.DataFrame({
            "id": pd.arrays.IntegerArray(ids.copy(), ~has_id), "held_out": ~learns, "n_tokens": sizes, "n_known": total[0].astype(np.int64),
            "train_tokens": train_tokens, "base_score": total[1], "score": total[2], "perplexity": 10 ** (-total[2] / sizes),
        })

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    done = parts.unionByName(sums.withColumn("first", F.lit(False))).groupBy("part").applyInPandas(gather, schema)
    return done.withColumnRenamed("id", id_col)


def _hot_words(sample: DataFrame, buckets: int) -> np.ndarray:
    """Hashes of the words that are a good part of a bucket each; at most ``HOT_WORDS``, from at most 2 * LAYOUT_DOCS texts."""

    def run(batches):
        for b in small_batches(batches):
            words, counts = np.unique(np.array([w for t in b.column(0).to_pylist() for w in [*plain_words(t), END]], object), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.tolist(), pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

    counted = sample.select("text").mapInArrow(freed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(1 / (4 * buckets), 1 / HOT_WORDS)
    top = counted.where((F.col("n") >= share * total) & F.lit(buckets > 1)).collect()
    return np.sort(np.array([WordHashes()[bytes(r.word)] for r in top], np.uint64))


def op1_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))


def hpylm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op1_hpylm that SQL can express, the base score to three digits."""
    return op1_hpylm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id,
    list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != ''), ' ') AS w,
    coalesce(xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 5 = 1, FALSE) AS held_out
  FROM documents),
t AS (SELECT row, held_out, unnest(w) AS t FROM w),
c AS (SELECT t, count(*) AS c FROM t WHERE NOT held_out GROUP BY t),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT row, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base FROM t LEFT JOIN c USING (t), n GROUP BY row)
SELECT doc_id, held_out, CAST(len(w) AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 3) AS base_score
FROM w JOIN s USING (row), n
"""

QUERIES = {"op1_hpylm": op1_hpylm, "hpylm_base": hpylm_base}
ORACLES = {"hpylm_base": ORACLE}
