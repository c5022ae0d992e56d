"""Merkle fixity audit of WARC replicas, in DataFrame functions.

Records lie in files, in order, each at a byte offset.  A record's hash is a
leaf; every ``FANOUT`` nodes that follow one another in a file hash into a
parent that covers their offset range, up to one root a file, and the files'
roots hash on, ``FANOUT`` neighbouring file numbers at a time, to one root of
the archive.  Two replicas are compared by that root; below a mismatch only the
children of mismatching nodes are compared, level by level, first down to files
and then inside them, until the records that differ are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karstline.llm.common import checkpoint, read_table

FANOUT = 16
#: Ids in one file; ids are spread over files by range.
FILE_IDS = 4096
#: Records whose places are counted in one task, about, and copies of a record that are written out in one step.
PART_RECORDS, COPIES = 100_000, 4096


def warc_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_ids: int = FILE_IDS) -> DataFrame:
    """Response records ``(file long, key long, record binary)`` of pages; null fields are empty."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))
    key = F.col(id_col).cast("long")
    return pages.select(F.floor(F.coalesce(key, F.lit(-1)) / file_ids).alias("file"), key.alias("key"), record.alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """``(file, level 0, node, from_offset, to_offset, key, hash)`` of each record in its file's order.

    The order is by key (null first), then hash, so equal records are neighbours.
    They are counted before they are ordered, and files are ordered in ranges of
    about ``PART_RECORDS``: neither a record's copies nor a file, however large,
    meet in one task.
    """
    order = [F.asc_nulls_first("file"), F.asc_nulls_first("key"), "hash", "size"]
    hashed = records.select("file", "key", F.length("record").cast("long").alias("size"), F.sha2("record", 256).alias("hash"))
    groups = hashed.groupBy("file", "key", "hash", "size").agg(F.count("*").alias("n"))
    groups = checkpoint(groups)
    parts = max(1, -(-groups.count() // PART_RECORDS))
    # the number of its range is fixed by the checkpoint
    ranged = checkpoint(groups.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    bytes_of = F.col("n") * F.col("size")
    parts_of = ranged.groupBy("file", "part").agg(F.sum("n").alias("records"), F.sum(bytes_of).alias("bytes"))
    # a row for each file and range that it lies in
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts_of.select(
        F.col("file").alias("f"), F.col("part").alias("p"), F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes")
    )
    before = Window.partitionBy("file", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({"rank": F.coalesce(F.sum("n").over(before), F.lit(0)), "offset": F.coalesce(F.sum(bytes_of).over(before), F.lit(0))})
    placed = placed.join(starts, placed["file"].eqNullSafe(starts["f"]) & (placed["part"] == starts["p"])).withColumns({"rank": F.col("rank") + F.col("records"), "offset": F.col("offset") + F.col("bytes")})
    # copies are written out in two steps, so that no array is as long as their number
    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("step")
    stepped = placed.select("file", "key", "hash", "size", "n", "rank", "offset", steps)
    copies = F.explode(F.sequence(F.lit(0), F.least(F.lit(COPIES), F.col("n") - F.col("step") * COPIES).cast("int") - 1)).alias("copy")
    one = stepped.select("file", "key", "hash", "size", "rank", "offset", "step", copies).withColumn("nth", F.col("step") * COPIES + F.col("copy"))
    start = F.col("offset") + F.col("nth") * F.col("size")
    return one.select("file", F.lit(0).alias("level"), (F.col("rank") + F.col("nth")).alias("node"), start.alias("from_offset"), (start + F.col("size")).alias("to_offset"), "key", "hash")


def _parents(nodes: DataFrame, by: list[str], level: int, fanout: int) -> DataFrame:
    """Nodes one level up: the hash of the children's ranges and hashes in order (``fanout`` at most)."""
    child = F.struct("node", F.concat_ws(":", F.col("from_offset").cast("string"), F.col("to_offset").cast("string"), "hash").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["text"]), "\n")
    up = nodes.groupBy(*by, F.floor(F.col("node") / fanout).alias("node")).agg(F.min("from_offset").alias("from_offset"), F.max("to_offset").alias("to_offset"), F.sha2(joined, 256).alias("hash"))
    return up.select(*(by or [F.lit(None).cast("long").alias("file")]), F.lit(level).alias("level"), "node", "from_offset", "to_offset", F.lit(None).cast("long").alias("key"), "hash")


def file_trees(records: DataFrame, *, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all files' trees, leaves first, and each file's root."""
    levels = [checkpoint(leaves(records))]
    widest = levels[0].agg(F.max("node")).first()[0]
    most = 0 if widest is None else int(widest)
    while most:
        most //= fanout
        levels.append(checkpoint(_parents(levels[-1], ["file"], len(levels), fanout)))
    return levels, levels[-1]


def archive_levels(roots: DataFrame, first: int, last: int, *, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels ``(node, from_offset, to_offset, hash)`` above files: their roots, then groups of neighbours, up to one node.

    Files are numbered from ``first``; ``last`` sets the height.  The number of nodes
    falls with each level, and no level passes through one task before the last.
    """
    levels = [roots.select((F.col("file") - first).alias("node"), "from_offset", "to_offset", "hash")]
    most = last - first
    while most:
        most //= fanout
        levels.append(checkpoint(_parents(levels[-1], [], 0, fanout).select("node", "from_offset", "to_offset", "hash")))
    return levels


def _files(*roots: DataFrame) -> tuple[int, int] | None:
    """The least and greatest file number of all replicas, None if they have no files."""
    found = [r.agg(F.min("file"), F.max("file")).first() for r in roots]
    found = [(int(a), int(b)) for a, b in found if a is not None]
    return (min(a for a, _ in found), max(b for _, b in found)) if found else None


def archive_root(roots: DataFrame, *, fanout: int = FANOUT) -> str | None:
    """The one hash of an archive from its files' roots, in the order of the files; None if it has none."""
    span = _files(roots)
    return None if span is None else archive_levels(roots, *span, fanout=fanout)[-1].first()["hash"]


def _differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _mismatches(a: DataFrame, b: DataFrame, by: list[str], above: DataFrame | None, fanout: int, key: bool = False) -> DataFrame:
    """Nodes of one level that differ, among the children of the nodes ``(by, parent)`` that differ above."""
    names = ["from_offset", "to_offset", "hash"] + ["key"] * key
    x, y = (f.select(*by, "node", *[F.col(c).alias(f"{s}_{c}") for c in names]) for f, s in ((a, "l"), (b, "r")))
    if above is not None:
        x, y = (f.withColumn("parent", F.floor(F.col("node") / fanout)).join(above, [*by, "parent"], "left_semi").drop("parent") for f in (x, y))
    moved = _differ(F.col("l_from_offset"), F.col("r_from_offset")) | _differ(F.col("l_to_offset"), F.col("r_to_offset"))
    return x.join(y, [*by, "node"], "full").where(_differ(F.col("l_hash"), F.col("r_hash")) | moved)


def audit(left: DataFrame, right: DataFrame, *, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas ``(file, key, record)``.

    Returns ``file, node, key, from_offset, to_offset (of the left replica, the
    right's where the left has no such record), left_hash, right_hash``: one row for
    each leaf under mismatching branches whose hash differs, with a null hash where
    a replica has no such leaf.  Equal archive roots end the audit.  A lost or added
    record moves those behind it in its file, which are then reported too: fixity is
    by place.  Null keys come first in their file, equal records are kept as
    neighbours, records without a file number are in file -1, and empty replicas
    differ in every leaf of the other.  Trees of unlike height are compared from the
    lower root.  Other columns are left out.
    """
    left, right = (r.select(F.coalesce(F.col("file").cast("long"), F.lit(-1)).alias("file"), F.col("key").cast("long").alias("key"), "record") for r in (left, right))
    a, _ = file_trees(left, fanout=fanout)
    b, _ = file_trees(right, fanout=fanout)
    top = max(len(a), len(b)) - 1
    for levels in (a, b):
        while len(levels) <= top:
            levels.append(checkpoint(_parents(levels[-1], ["file"], len(levels), fanout)))
    span = _files(a[-1], b[-1])
    suspects = a[0].select("file", F.col("node").alias("parent")).limit(0)
    if span is not None:
        above, upper = None, [archive_levels(f, *span, fanout=fanout) for f in (a[-1], b[-1])]
        for x, y in zip(*(reversed(u) for u in upper), strict=True):
            above = checkpoint(_mismatches(x, y, [], above, fanout).select(F.col("node").alias("parent")))
            if above.isEmpty():
                break
        # the roots of these files differ, so their children are next
        suspects = above.select((F.col("parent") + span[0]).alias("file"))
        suspects = suspects if top == 0 else suspects.withColumn("parent", F.lit(0).cast("long"))
    for level in range(top - 1, 0, -1):
        suspects = checkpoint(_mismatches(a[level], b[level], ["file"], suspects, fanout).select("file", F.col("node").alias("parent")))
    if top == 0:
        # files of one record each: their roots are the leaves
        a[0], b[0] = (f.join(suspects.select("file"), "file", "left_semi") for f in (a[0], b[0]))
        bad = _mismatches(a[0], b[0], ["file"], None, fanout, True)
    else:
        bad = _mismatches(a[0], b[0], ["file"], suspects, fanout, True)
    return bad.select(
        "file", "node", F.coalesce("l_key", "r_key").alias("key"), F.coalesce("l_from_offset", "r_from_offset").alias("from_offset"),
        F.coalesce("l_to_offset", "r_to_offset").alias("to_offset"), F.col("l_hash").alias("left_hash"), F.col("r_hash").alias("right_hash"),
    )


#: The second replica of op6: pages whose id leaves 11 modulo 37 have the last byte of their body overwritten.
DAMAGE_EVERY, DAMAGE_AT = 37, 11


def damaged(records: DataFrame) -> DataFrame:
    """A replica with one overwritten byte in a set share of the records, of the same length."""
    n = F.length("record")
    hurt = F.concat(F.substring("record", F.lit(1), n - 5), F.lit(b"\x00"), F.lit(b"\r\n\r\n"))
    return records.withColumn("record", F.when(F.col("key") % DAMAGE_EVERY == DAMAGE_AT, hurt).otherwise(F.col("record")))


def op6_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages as WARC records against a replica with known damage."""
    records = warc_records(read_table(spark, sf_dir, "pages"))
    return audit(records, damaged(records)).withColumnRenamed("key", "page_id")


ORACLE = r"""
WITH p AS (
  SELECT page_id, CAST(floor(page_id / 4096) AS BIGINT) AS file, encode(coalesce(html, '')) AS body, coalesce(url, '') AS url FROM pages),
r AS (
  SELECT page_id, file,
    encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'Content-Length: ' || CAST(octet_length(body) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)) || body || '\x0D\x0A\x0D\x0A'::BLOB AS record
  FROM p),
o AS (
  SELECT *, row_number() OVER w - 1 AS node, CAST(sum(octet_length(record)) OVER w AS BIGINT) AS to_offset FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT file, CAST(node AS BIGINT) AS node, page_id, to_offset - octet_length(record) AS from_offset, to_offset, sha256(record) AS left_hash,
  sha256(unhex(left(hex(record), 2 * octet_length(record) - 10)) || '\x00\x0D\x0A\x0D\x0A'::BLOB) AS right_hash
FROM o WHERE page_id % 37 = 11
"""

QUERIES = {"op6_fixity_audit": op6_fixity_audit}
ORACLES = {"op6_fixity_audit": ORACLE}
