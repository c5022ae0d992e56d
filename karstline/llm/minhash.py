"""Near-duplicate documents by b-bit MinHash.

Each document is the set of its distinct word shingles.  ``BANDS * ROWS``
minima are taken of a set; bands of ``ROWS`` full minima give the buckets that
propose candidates, and of each minimum only the low ``BITS`` bits are kept,
packed into longs, from which bit counts estimate the similarity with the
chance of equal low bits taken out.  Links are confirmed on the full sets.

Groups of any size stay linear: equal sets collapse to one node first, a
bucket links its nodes to one leader, and only nodes that are still in
different components of one bucket are compared with each other: first by bit
counts of the signatures, then by a bitmap of the shingles, which bounds the
difference of two sets from below and so loses no link.  The pairs that both
leave, nearly all of them links, are confirmed.  Large buckets are compared in
tiles, so no task holds more of them than a tile.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstline.llm.common import WordHashes, as_long, bounded, checkpoint, freed, fresh_name, list_array, looked_up, mix64, named, plain_words, read_table, slim, small_batches, tidy

SHINGLE_WORDS = 5
PERCENT = 80
#: A pair at 0.8 misses all bands with probability (1 - 0.8**5)**32, 3 in a million.
BANDS, ROWS = 32, 5
#: Bits kept of each minimum.
BITS = 2
#: The estimate's standard deviation at 0.8 is 0.038; pairs under the threshold by over five of them go unconfirmed.
SLACK = 0.2
#: Ids or nodes that are broadcast at most (64 bytes each at most); more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Nodes of one bucket that are compared with each other in one task, about.
TILE_NODES = 4000

#: Edges, rows of buckets, and sets in one partition at most, where there are few.
EDGES, BUCKET_ROWS, SETS = 250_000, 500_000, 10_000
#: Places of the bitmap of a set.
MARKS = 4096

_LONGS = BANDS * ROWS * BITS // 64
_EVEN_BITS = 0x5555555555555555
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20_240_101)
_FACTORS = (_RNG.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)).astype(np.uint32)
_ADDED = _RNG.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32)


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``size`` are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.array(words)
    size = min(size, len(h))
    n = len(h) - size + 1
    found = mix64(h[:n] + np.uint64(size))
    for j in range(1, size):
        found = mix64(found * _STEP + h[j : j + n])
    return np.unique(found)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        y = x[None, at : at + 1024] * _FACTORS
        y += _ADDED
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(least, y.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
    for j in range(ROWS):
        key = mix64(key * _STEP + rows[:, j])
    return as_long(key)


def packed_bits(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(_LONGS, -1)
    places = np.arange(0, 64, BITS, dtype=np.uint64)
    return as_long(np.bitwise_or.reduce(low << places, axis=1))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal symbols, less the share equal by chance."""
    unequal = F.lit(0)
    for i in range(_LONGS):
        x = a[i].bitwiseXOR(b[i])
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN_BITS)))
    equal = 1 - unequal / F.lit(float(BANDS * ROWS))
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def marks_of(found: np.ndarray) -> np.ndarray:
    """Bitmap of a set: a place in one bitmap only stands for at least one shingle of one set only."""
    places = np.zeros(MARKS, np.uint8)
    places[(found >> np.uint64(17)).astype(np.int64) % MARKS] = 1
    return np.packbits(places).view(np.int64)


def may_link(a: Column, b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """False only for pairs under the threshold: links differ in at most (1 - t) / (1 + t) of the sizes' sum."""
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return unlike * (100 + percent) <= (n_a + n_b) * (100 - percent)


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """``(id, h, n_shingles, k1, k2, buckets, bits)`` of each row ``(id, h, text)``; k1 and k2 stand for the set, an empty one has no buckets."""

    def run(batches):
        hashes = WordHashes()
        for b in small_batches(batches):
            n, keys, buckets, bits = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for text in b.column(2).to_pylist():
                found = shingles(plain_words(text), size, hashes)
                n.append(len(found))
                keys.append(set_key(found))
                if len(found):
                    least = minima(found)
                    buckets.append(band_keys(least))
                    bits.append(packed_bits(least))
            k = np.array(keys, np.int64).reshape(-1, 2)
            lists = [list_array(np.concatenate(x), np.where(np.array(n, np.int64) > 0, size, 0), pa.int64()) for x, size in ((buckets, BANDS), (bits, _LONGS))]
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "n_shingles", "k1", "k2", "buckets", "bits"])

    return rows.mapInArrow(freed(run), "id long, h long, n_shingles long, k1 long, k2 long, buckets array<long>, bits array<long>")


def set_key(found: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with the least node of each component, by alternating large and small stars.

    Two shuffles by node a round; no node's neighbours are ever gathered.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, larger: bool, rows: int) -> DataFrame:
        near = both(e) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = slim(near.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), rows, EDGES)
        joined = near.join(least, "a")
        if larger:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select("a", F.col("least").alias("b")))
        return slim(slim(out.where("a != b"), rows, EDGES).distinct(), rows, EDGES)

    def state(e: DataFrame):
        # the number of edges and 128 bits of their hashes: two rounds that agree in them are one set of edges
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())

    e = checkpoint(edges.select("a", "b").where("a != b").distinct())
    before = state(e)
    e = slim(e, before[0], EDGES)
    while before[0]:
        e = checkpoint(star(star(e, True, before[0]), False, before[0]))
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``(a, b)`` whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in small_batches(batches, 128):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(freed(run), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Classes of documents joined by links of at least ``percent`` hundredths of Jaccard similarity.

    Returns a row for each input row: ``id_col, n_shingles long, component_id long
    (least id of the class), kept boolean``.  Null or empty texts have no shingles
    and are classes of their own; a null id is in no class (component_id null,
    kept); rows that share an id are one member, linked to whatever any of them is
    linked to; equal texts are always linked.  Copies of a row, however many, count
    as one before anything is compared.  Ids are whole numbers; other columns are
    left out, whatever their names.
    """
    text = named(text_col)
    rows = bounded(docs).select(named(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
    base = checkpoint(sketches(rows, shingle_words))
    part = base.where("id IS NOT NULL AND n_shingles > 0")
    total, ids = part.agg(F.count("*"), F.countDistinct("id")).first()
    # one node a set, with the place of one row that has it; the numbers are fixed by the checkpoint
    by_set = part.groupBy("k1", "k2").agg(F.min(F.struct("id", "h")).alias("rep"), F.count("*").alias("times"), F.first("buckets").alias("buckets"), F.first("bits").alias("bits"))
    nodes = checkpoint(by_set.select(F.monotonically_increasing_id().alias("node"), "rep.id", "rep.h", "k1", "k2", "times", "buckets", "bits"))
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    multi = checkpoint(placed.join(shared, "bucket"))

    edges = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    involved = multi.select("node").distinct()
    count = involved.count()
    if count:
        multi = slim(multi, multi.count(), BUCKET_ROWS)
        chosen = nodes.join(F.broadcast(involved) if count <= BROADCAST_IDS else involved, "node", "left_semi")
        places = chosen.select("node", "id", "h", "k1", "k2")
        sets = _sets(rows.join(F.broadcast(places) if count <= BROADCAST_IDS else places, ["id", "h"]), shingle_words)
        sets = checkpoint(sets.dropDuplicates(["node"]) if ids < total else sets)
        sets = slim(sets, count, SETS)
        traits = checkpoint(chosen.select("node", "buckets", "bits").join(sets.select("node", "n", "marks"), "node"))
        links = _linked(multi, slim(traits, count, SETS), sets, percent)
        edges = edges.unionAll(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    if ids < total:
        # an id with several sets joins them
        members = looked_up(part.select("id", "k1", "k2").distinct(), nodes.select("k1", "k2", "times", "node"), ["k1", "k2"], total).select("id", "node")
        least = members.groupBy("id").agg(F.min("node").alias("b"), F.count("*").alias("times")).where("times > 1")
        edges = edges.unionAll(looked_up(members, least, ["id"], total).select(F.col("node").alias("a"), "b"))

    tidy(docs.sparkSession)
    roots = nodes.select("node", "id", "k1", "k2", "times").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = checkpoint(roots)
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("times"))
    known = looked_up(roots.select("k1", "k2", "root", F.col("times").alias("rows")), least, ["root"], total).withColumnRenamed("rows", "times")
    found = looked_up(part.select("id", "n_shingles", "k1", "k2"), known.drop("root"), ["k1", "k2"], total)
    alone = base.where("id IS NULL OR n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = found.select("id", "n_shingles", "component_id").unionAll(alone)
    if ids < total:
        # an empty text of an id that others share belongs to the id's class
        classes = found.groupBy("id").agg(F.min("component_id").alias("component_id"))
        alone = alone.drop("component_id").join(classes, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        out = found.select("id", "n_shingles", "component_id").unionAll(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """``(node, n, hashes, marks)`` of the sets of rows ``(node, k1, k2, text)``."""

    def run(batches):
        hashes = WordHashes()
        for b in small_batches(batches):
            found = [shingles(plain_words(t), size, hashes) for t in b.column(3).to_pylist()]
            marks = [np.empty(0, np.int64), *map(marks_of, found)]
            right = pa.array([(k == set_key(x)).all() for *k, x in zip(b.column(1).to_numpy(), b.column(2).to_numpy(), found, strict=True)], pa.bool_())
            columns = [b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), list_array(np.concatenate(marks), [MARKS // 64] * len(found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "hashes", "marks"]).filter(right)

    return rows.select("node", "k1", "k2", "text").mapInArrow(freed(run), "node long, n long, hashes binary, marks array<long>")


def _linked(multi: DataFrame, traits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, root)`` of confirmed links among nodes that share buckets."""
    names = ("node", "bits", "marks", "n")

    def side(frame: DataFrame, s: str, *more: str) -> DataFrame:
        return frame.select(*[F.col(c).alias(f"{c}_{s}") for c in (*names, *more)])

    close = estimate(F.col("bits_a"), F.col("bits_b")) >= percent / 100 - SLACK
    close = close & may_link(F.col("marks_a"), F.col("marks_b"), F.col("n_a"), F.col("n_b"), percent)

    def links(pairs: DataFrame) -> DataFrame:
        a, b = (side(traits, s).withColumnRenamed(f"node_{s}", s) for s in "ab")
        return confirmed(pairs.join(a, "a").join(b, "b").where(close).select("a", "b"), sets, percent)

    def labelled(frame: DataFrame, column: str, to: str) -> DataFrame:
        return frame.join(roots.select(F.col("node").alias(column), F.col("root").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))

    def extended(more: DataFrame) -> DataFrame:
        more = checkpoint(more)
        return roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))

    # each node with the least leader of its buckets
    first = multi.groupBy("node").agg(F.min("leader").alias("a")).where("a != node").select("a", F.col("node").alias("b"))
    roots = components(links(first))

    # each node with those leaders of its buckets that are in other components
    pairs = multi.where("leader != node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = labelled(labelled(pairs, "a", "root_a"), "b", "root_b").where("root_a != root_b").select("a", "b")
    roots = extended(links(pairs))

    # nodes of one bucket that are still in different components: each pair once, in the first band that they share
    rest = labelled(multi.select("bucket", "node"), "node", "root")
    several = rest.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x != y").select("bucket", "size")
    tiles = F.ceil(F.col("size") / TILE_NODES).cast("int")
    rest = rest.join(several, "bucket").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    rest = checkpoint(rest.join(traits, "node").withColumn("band", F.array_position("buckets", F.col("bucket"))).drop("size"))
    # a large bucket is dealt into tiles, and each pair of tiles meets in a task of its own
    other_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other_tile")
    a = side(rest.select("*", other_tile), "a", "root", "buckets", "band", "bucket", "tile", "other_tile")
    b = side(rest.select("*", other_tile), "b", "root", "buckets", "band", "bucket", "tile", "other_tile")
    once = F.array_position(F.zip_with("buckets_a", "buckets_b", lambda x, y: x == y), True) == F.col("band_a")
    other = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    meet = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("tile_a") == F.col("other_tile_b")) & (F.col("other_tile_a") == F.col("tile_b"))
    pairs = a.join(b, meet & other & close & once).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return extended(confirmed(pairs, sets, percent))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near-duplicates the rows with the least id stay."""
    tidy(spark)
    gone = fresh_name("gone")
    ids = checkpoint(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, named("doc_id").cast("long") == F.col(gone), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT a AS doc_id, a AS other FROM edge
  UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
least AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

QUERIES = {"op8_near_duplicates": op8_near_duplicates}
ORACLES = {"op8_near_duplicates": ORACLE}
