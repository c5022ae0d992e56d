"""Line dedup by a deletion-neighbourhood join.

Lines of all documents that lie within ``max_edits`` edits of code points are
found by joining hashed variants: a line emits itself and the strings that
edits leave of it, equal variants are joined, the edit distance is verified,
and the earliest line stays.

All variants of all lines would be hundreds of times the corpus, so for one
edit they are emitted only where a partner can exist.  One edit leaves all
blocks of a line but one as they are: lines that share no "all but one block"
key have no partner.  Two such sieves (2 blocks, then 8) lose no pair; behind
them a line emits the variants of the one block in which the edit must lie.
More edits go without sieves, at a cost of the line's length to their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstline.llm.common import bounded, checkpoint, free_names, freed, fresh_name, looked_up, named, read_table, small_batches, tidy

MAX_EDITS = 1
#: Every line takes part; a caller may leave shorter ones alone.
MIN_CHARS = 0
COARSE, FINE = 2, 8
#: Rows of places or ids that are broadcast at most (64 bytes each at most); more go through a shuffle.
BROADCAST_ROWS = 100_000
#: Variants that a task holds at once, about.
VARIANT_ROWS = 100_000
#: What of a line's place is compared, in this order.
PLACE = ("id", "h", "line")


def _hash(*parts) -> int:
    data = "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def block_keys(line: str, blocks: int) -> Iterator[tuple[int, int, str]]:
    """``(key, longest, middle)`` for each block and each length the longer of a pair may have.

    Two lines within one edit share the key of the block that holds the edit;
    ``middle`` is what the line has there.
    """
    n = len(line)
    for longest in (n, n + 1):
        for i in range(blocks):
            a, after = i * longest // blocks, longest - (i + 1) * longest // blocks
            if a + after <= n and a < a + longest - a - after:
                head, tail = line[:a], line[n - after :]
                yield _hash(longest, i, blocks, head, tail), longest, line[a : n - after]


def variants(line: str, key: int, longest: int, middle: str) -> Iterator[tuple[int, bool]]:
    """Hashed deletion variants of a middle part: ``(hash, whether the line is the shorter of a pair)``.

    Of lines of one length the place of the deletion belongs to the variant, so
    that equal variants mean one substitution.
    """
    if longest > len(line):
        yield _hash("d", key, middle), True
        return
    for at in range(len(middle)):
        less = middle[:at] + middle[at + 1 :]
        yield _hash("s", key, at, less), False
        if not at or middle[at] != middle[at - 1]:
            yield _hash("d", key, less), False


def within(a: str, b: str, bound: int) -> bool:
    """Whether the edit distance of code points is at most ``bound``: the band of the table that can hold it."""
    if abs(len(a) - len(b)) > bound:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[at:], b[at:]
    row = {j: j for j in range(min(len(b), bound) + 1)}
    far = bound + 1
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - bound), min(len(b), i + bound) + 1):
            best = min(row.get(j, far), now.get(j - 1, far)) + 1
            if j:
                best = min(best, row.get(j - 1, far) + (x != b[j - 1]))
            now[j] = best
        row = now
        if min(row.values()) > bound:
            return False
    return row.get(len(b), far) <= bound


def edited(line: str, edits: int) -> Iterator[tuple[int, int, int]]:
    """``(hash, marks, deletions)`` of all that up to ``edits`` marks and deletions leave of a line.

    A mark stands for any one character.  Two lines with a variant of m marks in
    common, left by d and e deletions, are m + d + e edits apart at most, and any
    two lines so far apart have one.
    """
    seen = set()
    for n in range(min(edits, len(line)) + 1):
        for places in combinations(range(len(line)), n):
            for marks in product((True, False), repeat=n):
                parts, last = [], 0
                for at, mark in zip(places, marks, strict=True):
                    parts += [line[last:at], "\ud800" if mark else ""]
                    last = at + 1
                found = (_hash("v", "".join(parts) + line[last:]), sum(marks), n - sum(marks))
                if found not in seen:
                    seen.add(found)
                    yield found


def _fits(frame: DataFrame) -> DataFrame:
    """A frame that is broadcast if it was counted and is small."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def _columns(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in b.columns), strict=True)


def _occurrences(rows: DataFrame, min_chars: int, keyed: bool) -> DataFrame:
    """``(id, h, line, h1, h2, keys)`` of every line that is long enough."""

    def run(batches):
        for b in small_batches(batches):
            ids, hashes, numbers, digests, keys = [], [], [], [], []
            for i, h, text in _columns(b):
                for k, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars:
                        ids.append(i)
                        hashes.append(h)
                        numbers.append(k)
                        digests.append(hashlib.blake2b(line.encode(), digest_size=16).digest())
                        keys.append([x[0] for x in block_keys(line, COARSE)] if keyed else [])
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "line", "h1", "h2", "keys"])

    return rows.mapInArrow(freed(run), "id long, h long, line int, h1 long, h2 long, keys array<long>")


def _texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``(id, h, line, h1, h2, text)``: the lines at these places, read from the documents again."""
    wanted = places.groupBy("id", "h").agg(F.collect_list(F.struct("line", "h1", "h2")).alias("wanted"))
    # an array of a document's own lines; the count of lines bounds a broadcast
    wanted = F.broadcast(wanted) if places.count() <= BROADCAST_ROWS else wanted

    def run(batches):
        for b in small_batches(batches):
            out = []
            for i, h, text, want in _columns(b):
                lines = text.split("\n")
                out += [(i, h, w["line"], w["h1"], w["h2"], lines[w["line"]]) for w in want]
            yield _batch(out, id=pa.int64(), h=pa.int64(), line=pa.int32(), h1=pa.int64(), h2=pa.int64(), text=pa.string())

    found = rows.join(wanted, ["id", "h"]).select("id", "h", "text", "wanted")
    # rows that share id and text give their lines more than once
    return found.mapInArrow(freed(run), "id long, h long, line int, h1 long, h2 long, text string").dropDuplicates(["h1", "h2"])


def _sharing(keyed: DataFrame, total: int) -> DataFrame:
    """Those rows ``(h1, h2, key)`` whose key other lines have too; ``total`` is the most there can be."""
    keys = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count("*").alias("times")).where("lo != hi")
    return looked_up(keyed, checkpoint(keys.select("key", "times")), ["key"], total)


def _near(rows: DataFrame, occurrences: DataFrame, firsts: DataFrame, total: int) -> DataFrame:
    """``(id, h, line)`` of lines with an earlier line one edit away, from the ``total`` occurrences of lines."""
    keyed = occurrences.select("h1", "h2", F.explode("keys").alias("key"))
    candidates = _sharing(keyed, 2 * COARSE * total).select("h1", "h2").distinct()
    places = checkpoint(firsts.join(candidates, ["h1", "h2"], "left_semi").select("first.*", "h1", "h2"))
    lines = checkpoint(_texts(rows, places))

    def fine(batches):
        for b in small_batches(batches):
            yield _batch([(h1, h2, k[0]) for h1, h2, t in _columns(b) for k in block_keys(t, FINE)], h1=pa.int64(), h2=pa.int64(), key=pa.int64())

    keyed = lines.select("h1", "h2", "text").mapInArrow(freed(fine), "h1 long, h2 long, key long")
    # at most 16 keys a line, so collect_set is bounded by the line itself
    wanted = _sharing(keyed, 2 * FINE * lines.count()).groupBy("h1", "h2").agg(F.collect_set("key").alias("keys"))

    def neighbourhood(batches):
        for b in small_batches(batches):
            out = []
            for *place, text, keys in _columns(b):
                keys = set(keys)
                for key, longest, middle in block_keys(text, FINE):
                    if key in keys:
                        out += [(*place, v, s) for v, s in variants(text, key, longest, middle)]
            yield _batch(out, id=pa.int64(), h=pa.int64(), line=pa.int32(), variant=pa.int64(), shorter=pa.bool_())

    emitted = lines.join(wanted, ["h1", "h2"]).select(*PLACE, "text", "keys")
    emitted = checkpoint(emitted.mapInArrow(freed(neighbourhood), "id long, h long, line int, variant long, shorter boolean"))
    place = F.struct(*PLACE)
    long = emitted.where("NOT shorter").select("variant", place.alias("late"))
    earliest = long.groupBy("variant").agg(F.min("late").alias("early"), F.count("*").alias("n")).where("n > 1").drop("n")
    same_length = long.join(earliest, "variant").where("late != early").select("early", "late")
    short = emitted.where("shorter").select("variant", place.alias("other")).distinct()
    off_by_one = long.join(short, "variant").select(F.least("late", "other").alias("early"), F.greatest("late", "other").alias("late"))
    return _verified(same_length.unionAll(off_by_one).distinct(), lines, 1)


def _near_by_many(rows: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """``(id, h, line)`` of lines with an earlier line up to ``edits`` edits away, from all variants of all lines."""
    lines = checkpoint(_texts(rows, firsts.select("first.*", "h1", "h2")))

    def neighbourhood(batches):
        for b in small_batches(batches):
            out = []
            for *place, text in _columns(b):
                for found in edited(text, edits):
                    out.append((*place, *found))
                    if len(out) >= VARIANT_ROWS:
                        yield _batch(out, id=pa.int64(), h=pa.int64(), line=pa.int32(), variant=pa.int64(), marks=pa.int32(), gone=pa.int32())
                        out = []
            yield _batch(out, id=pa.int64(), h=pa.int64(), line=pa.int32(), variant=pa.int64(), marks=pa.int32(), gone=pa.int32())

    emitted = lines.select(*PLACE, "text").mapInArrow(freed(neighbourhood), "id long, h long, line int, variant long, marks int, gone int")
    emitted = checkpoint(emitted.select("variant", "marks", "gone", F.struct(*PLACE).alias("late")))
    # the earliest line of a variant for each number of deletions that leaves enough edits to the other
    firsts_of = emitted.groupBy("variant").agg(*[F.min(F.when(F.col("gone") <= d, F.col("late"))).alias(f"early{d}") for d in range(edits + 1)])
    early = F.coalesce(*[F.when(F.col("marks") + F.col("gone") == edits - d, F.col(f"early{d}")) for d in range(edits + 1)])
    pairs = emitted.join(firsts_of, "variant").select(early.alias("early"), "late").where("early < late").distinct()
    return _verified(pairs, lines, edits)


def _verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """``(id, h, line)`` of the later lines of those pairs that are within ``edits``."""

    def verify(batches):
        for b in small_batches(batches):
            yield _batch([place for *place, x, y in _columns(b) if within(x, y, edits)], id=pa.int64(), h=pa.int64(), line=pa.int32())

    of = lambda name: lines.select(F.struct(*PLACE).alias(name), F.col("text").alias(f"{name}_text"))
    told = pairs.join(of("early"), "early").join(of("late"), "late").select("late.*", "early_text", "late_text")
    return told.mapInArrow(freed(verify), "id long, h long, line int").distinct()


def dedup_lines(
    docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Drops every line that has an earlier line within ``max_edits`` edits.

    A line's place is (id, hash of the text, number of the line), so rows that
    share an id have places of their own; of rows that share id and text one is
    earlier than the others, which lose all their lines.  Lines are dropped wherever
    an earlier one stands anywhere in the table, whether or not that one stays
    itself.  Empty lines are lines like any; those under ``min_chars`` code points
    stay.  Returns all columns of ``docs`` with the text's remaining lines joined by
    ``\\n``, after them ``n_lines int`` and ``dropped array<int>`` (line numbers,
    sorted), under other names where ``docs`` has columns of these names
    (``free_names``).  A null text stays null with no lines; rows with a null id
    stay as they are and are earlier than nothing.  Ids are whole numbers.
    """
    if max_edits < 0:
        raise ValueError("max_edits is 0 or more")
    ident, text = named(id_col).cast("long"), named(text_col)
    rows = bounded(docs).select(ident.alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    occurrences = checkpoint(_occurrences(rows, min_chars, max_edits == 1))
    place = F.struct(*PLACE)
    firsts = checkpoint(occurrences.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("times")))
    total = firsts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    again = firsts.where("first != last").select("h1", "h2", "first", "times")
    dropped = looked_up(occurrences.select("h1", "h2", *PLACE), again, ["h1", "h2"], total).where(place != F.col("first")).select(*PLACE)
    firsts = firsts.select("h1", "h2", "first")
    if max_edits == 1:
        dropped = dropped.unionAll(_near(rows, occurrences, firsts, total))
    elif max_edits:
        dropped = dropped.unionAll(_near_by_many(rows, firsts, max_edits))
    dropped = checkpoint(dropped.distinct())

    i, h, gone = fresh_name("id"), fresh_name("h"), fresh_name("gone")
    by_row = dropped.groupBy(F.col("id").alias(i), F.col("h").alias(h)).agg(F.array_sort(F.collect_list("line")).alias(gone))
    keyed = docs.select("*", ident.alias(i), F.xxhash64(text).alias(h))
    several = rows.groupBy(F.col("id").alias(i), F.col("h").alias(h)).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    several = checkpoint(several)
    copies = None
    if not several.isEmpty():
        # the numbers of rows are set once and for all in the checkpoint; one row of each is the first
        number = fresh_name("number")
        several = _fits(several)
        repeated = checkpoint(keyed.join(several, [i, h], "left_semi").withColumn(number, F.monotonically_increasing_id()))
        first = repeated.groupBy(i, h).agg(F.min(number).alias(number)).select(number)
        copies = repeated.join(first, number, "left_anti").drop(number)
        keyed = keyed.join(several, [i, h], "left_anti").unionByName(repeated.join(first, number, "left_semi").drop(number))
    lines = F.split(text, "\n", -1)
    joined = keyed.join(by_row, [i, h], "left")
    if copies is not None:
        every = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda x: F.length(F.get(lines, x)) >= min_chars)
        joined = joined.unionByName(copies.withColumn(gone, every))
    left = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains(named(gone), k)), "\n")
    out = [F.when(named(gone).isNull(), named(c)).otherwise(left).alias(c) if c == text_col else named(c) for c in docs.columns]
    n_lines, drops = free_names(docs.columns, "n_lines", "dropped")
    return joined.select(*out, F.coalesce(F.size(lines), F.lit(0)).alias(n_lines), F.coalesce(named(gone), F.array().cast("array<int>")).alias(drops))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go; a document of nothing but repeated lines stays, with an empty text."""
    tidy(spark)
    done = dedup_lines(docs)
    own = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else named(c) for c in docs.columns]
    return done.select(*own)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, CAST(i - 1 AS BIGINT) AS line, parts[i] AS s
  FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
f AS (SELECT s, length(s) AS n, min((doc_id, line)) AS first FROM l GROUP BY s),
m AS (SELECT s, n, first, unnest([n, n + 1]) AS m FROM f),
k AS (SELECT s, n, first, m, 0 AS side, left(s, CAST(m // 2 AS BIGINT)) AS part FROM m
      UNION ALL SELECT s, n, first, m, 1, right(s, CAST(m - m // 2 AS BIGINT)) FROM m),
p AS (SELECT DISTINCT a.s AS late, a.first, b.s AS early, a.n AS na, b.n AS nb FROM k a JOIN k b USING (m, side, part)
      WHERE b.first < a.first AND greatest(a.n, b.n) = m),
near AS (SELECT DISTINCT first FROM p WHERE len(list_filter(range(0, greatest(na, nb)), lambda i: left(late, i) = left(early, i)
      AND substr(late, CAST(i + 1 + CASE WHEN na >= nb THEN 1 ELSE 0 END AS BIGINT)) = substr(early, CAST(i + 1 + CASE WHEN nb >= na THEN 1 ELSE 0 END AS BIGINT)))) > 0),
gone AS (
  SELECT l.doc_id, l.line FROM l JOIN f USING (s) WHERE (l.doc_id, l.line) != f.first
  UNION SELECT first[1], first[2] FROM near),
kept AS (
  SELECT doc_id, count(*) AS n, count(g.line) AS gone, string_agg(CASE WHEN g.line IS NULL THEN s END, chr(10) ORDER BY line) AS text
  FROM l LEFT JOIN gone g USING (doc_id, line) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": ORACLE}
