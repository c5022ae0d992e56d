"""Exact top-k inner products by the threshold algorithm.

Vectors are dealt into blocks.  In each block every dimension has its list of
vectors sorted by component.  A query reads all lists in step from the end
where its weight makes the product large, scores each vector when it is first
seen, and stops when the sum of weight times the component at the lists'
present depth, the most that an unseen vector can reach, is under the k-th
score.  The k best of all blocks are ranked together.

A query is asked first in one block; its k-th score there is the bound that it
takes to all others, which stop by it and answer only what reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karstline.llm.common import bounded, checkpoint, freed, named, read_table, small_batches

TOP = 5
SCALE = 256
QUERY_EVERY = 50
#: Vectors whose lists a task holds at once.
BLOCK_VECTORS = 8192
#: Copies of an answer that one row stands for at most.
COPIES = 4096
LONG, DIGITS = 2**63, 10**38 - 1


class SortedLists:
    """Vectors of whole numbers with a list sorted by component for each dimension.

    ``times`` is how often each row stands in the table; equal rows are one here.
    Sums that may not fit a double's 53 bits are taken in 64-bit whole numbers, and
    those that may not fit these in Python's.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray | None = None, times: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.sizes = np.full(len(ids), vectors.shape[1]) if sizes is None else sizes[order]
        self.times = np.ones(len(ids), np.int64) if times is None else times[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.kinds: dict = {}

    def kind_for(self, query: np.ndarray) -> type:
        """The narrowest kind of number that holds every sum with this query."""
        most = sum(abs(int(q)) * m for q, m in zip(query.tolist(), self.most, strict=True))
        return np.float64 if most < 2**53 else np.int64 if most < LONG else object

    @property
    def most(self) -> list[int]:
        if "most" not in self.kinds:
            low, high = self.vectors.min(axis=0, initial=0).tolist(), self.vectors.max(axis=0, initial=0).tolist()
            self.kinds["most"] = [max(-a, b) for a, b in zip(low, high, strict=True)]
        return self.kinds["most"]

    def numbers(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.kinds:
            values = self.vectors.astype(kind)
            self.kinds[kind] = values, np.take_along_axis(values, self.order, axis=0)
        return self.kinds[kind]

    def top(self, query: np.ndarray, own: int, k: int, size: int | None = None, bound: int | None = None) -> list[tuple[int, int]]:
        """``(score, id)`` of the k best rows but the query's own, ties to the smaller id; none under ``bound`` need be there.

        The query's own row is one with its id and components (``size`` of them); copies of it are other rows.
        """
        n, kind = len(self.ids), self.kind_for(query)
        vectors, lists = self.numbers(kind)
        times = self.times
        same = np.flatnonzero(self.ids == own)
        same = same[(self.vectors[same] == query).all(axis=1) & (self.sizes[same] == (len(query) if size is None else size))]
        if len(same):
            times = times.copy()
            times[same] -= 1
        used = np.flatnonzero(query)
        query = query.astype(kind)
        weights = query[used]
        up = weights > 0
        seen = np.zeros(n, bool)
        scores = np.zeros(n, kind)
        best = np.empty(0, np.int64)
        depth, step = 0, max(16, k)
        while depth < n:
            upto = min(n, depth + step)
            if len(used):
                mask = np.zeros(n, bool)
                mask[self.order[n - upto : n - depth, used[up]].ravel()] = True
                mask[self.order[depth:upto, used[~up]].ravel()] = True
                new = np.flatnonzero(mask & ~seen)
            else:
                new, upto = np.arange(n), n
            seen[new] = True
            scores[new] = vectors[new] @ query
            best = np.concatenate([best, new[times[new] > 0]])
            best = best[np.lexsort((self.ids[best], -scores[best]))[:k]]
            depth, step = upto, step * 2
            # copies fill ranks of their own
            full = np.flatnonzero(np.cumsum(times[best]) >= k)
            least = scores[best[full[0]]] if len(full) else None
            if bound is not None and (least is None or least < bound):
                least = bound
            if least is not None and depth < n:
                # a ready product may be unseen, so the edge of the lists must be under the k-th score
                edge = np.where(up, lists[n - depth, used], lists[depth - 1, used]) @ weights if len(used) else 0
                if edge < least:
                    break
        self.depth = depth
        out = [(int(scores[i]), int(self.ids[i])) for i in best for _ in range(min(k, int(times[i])))]
        return [x for x in out[:k] if bound is None or x[0] >= bound]


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, components array<long>)`` without null ids, null vectors, and null or non-finite components."""
    d = F.transform(named(vector_col), lambda x: x.cast("double"))
    fit = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), d.alias("d")).where(F.col("vec_id").isNotNull() & F.col("d").isNotNull() & fit)
    return rows.select("vec_id", F.transform("d", lambda x: F.floor(x * scale)).alias("components"))


def matrix(lists: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(lists), size), np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x[:size]
    return out


def _components(column: pa.ListArray) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _search(k: int):
    """Answers of the queries of each block, from rows sorted by block with its vectors before its queries."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        block, held, lists = None, [], None
        for b in small_batches(batches):
            v, asks, number, ids, times, bounds = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6))
            parts, out = _components(b.column(4)), []
            for i in range(b.num_rows):
                if v[i] != block:
                    block, held, lists = v[i], [], None
                if not asks[i]:
                    held.append((ids[i], parts[i], times[i]))
                    continue
                if lists is None:
                    size = max((len(x) for _, x, _ in held), default=0)
                    columns = list(zip(*held, strict=True)) or [[], [], []]
                    sizes = np.array([len(x) for x in columns[1]], np.int64)
                    lists = SortedLists(np.array(columns[0], np.int64), matrix(columns[1], size), sizes, np.array(columns[2], np.int64))
                    held = []
                # what the query has beyond every vector of the block counts nothing here
                query = matrix([parts[i]], lists.vectors.shape[1])[0]
                bound = None if bounds[i] is None else int(bounds[i])
                out += [(number[i], vec, Decimal(max(-DIGITS, min(DIGITS, s)))) for s, vec in lists.top(query, ids[i], k, len(parts[i]), bound)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.decimal128(38, 0)), strict=True)], names=["number", "vec_id", "score"])

    return run


def exact_top_k(
    vectors: DataFrame, *, k: int = TOP, query_every: int = QUERY_EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """The k largest inner products of each query: ``query_id long, rank int, vec_id long, score long``.

    Each component x counts as floor(scale * x), one beyond the range of a long as
    that range's end.  Queries are the rows whose id is divisible by
    ``query_every``, candidates all rows but the query's own; ties go to the smaller
    id; fewer candidates give fewer ranks.  Rows with a null id or vector, or a null
    or non-finite component take no part; of two vectors the shorter counts as 0 in
    the dimensions that it lacks.  Rows that share an id are candidates and queries
    each, copies of a row too: n copies of a query have n answers.  Sums are exact;
    they are ranked by their value, up to 38 digits, and a score beyond the range of
    a long is given as that range's end.

    Vectors are dealt by hash into blocks of about ``block_vectors``, whose lists are
    built once for the first block of each query and once for all others; queries
    pass through a block as a stream, so a task's memory doesn't grow with the table.
    Copies of a row are counted before the shuffle, so no id fills a block.
    """
    rows = whole_numbers(vectors, id_col, vector_col, scale).groupBy("vec_id", "components").agg(F.count("*").alias("times"))
    rows = checkpoint(bounded(rows.withColumn("number", F.monotonically_increasing_id())))
    n = rows.count()
    blocks = max(1, -(-n // block_vectors))
    of = F.pmod(F.xxhash64("vec_id", "components"), F.lit(blocks)).cast("int")
    # more copies of a row than k + 1 change no answer
    held = rows.select(of.alias("v"), F.lit(False).alias("asks"), "number", "vec_id", "components", F.least("times", F.lit(k + 1)).alias("times"), F.lit(None).cast("decimal(38,0)").alias("bound"))
    queries = rows.where(F.col("vec_id") % query_every == 0)
    parts = min(4 * blocks, max(blocks, 2000))

    def answers(asked: DataFrame) -> DataFrame:
        dealt = held.unionByName(asked).repartition(parts, "v").sortWithinPartitions("v", "asks")
        return dealt.mapInArrow(freed(_search(k)), "number long, vec_id long, score decimal(38,0)")

    asked = queries.select(of.alias("v"), F.lit(True).alias("asks"), "number", "vec_id", "components", "times")
    found = answers(asked.withColumn("bound", F.lit(None).cast("decimal(38,0)")))
    if blocks > 1:
        found = checkpoint(found)
        kth = found.groupBy("number").agg(F.min("score").alias("bound"), F.count("*").alias("n")).select("number", F.when(F.col("n") == k, F.col("bound")).alias("bound"))
        others = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(blocks - 1)), F.col("v"))).alias("v")
        found = found.unionAll(answers(asked.join(kth, "number", "left").select(others, "asks", "number", "vec_id", "components", "times", "bound")))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    score = F.greatest(F.least("score", F.lit(LONG - 1).cast("decimal(38,0)")), F.lit(-LONG).cast("decimal(38,0)")).cast("long")
    named_rows = ranked.join(queries.select("number", F.col("vec_id").alias("query_id"), "times"), "number")
    # n copies of a query have n answers, made in two steps so that no array of n is
    some = F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / COPIES))).alias("part")
    named_rows = named_rows.select("query_id", "rank", "vec_id", score.alias("score"), "times", some)
    every = F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("times") - F.col("part") * COPIES).cast("int")))
    return named_rows.select("query_id", "rank", "vec_id", "score", every.alias("copy")).drop("copy")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, greatest(len(q.c), len(v.c)) + 1), lambda i: coalesce(q.c[i], 0) * coalesce(v.c[i], 0))) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.row != v.row),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op2_exact_top_k": op2_exact_top_k}
ORACLES = {"op2_exact_top_k": ORACLE}
