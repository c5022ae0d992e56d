"""Helpers that the operators of this subpackage share.

Words, hashing and the shared-folder checkpoint live here.  Word rules work on
UTF-8 bytes: ``bytes.lower`` folds only A-Z, ``bytes.split`` cuts only at
``\\x20`` and ``\\x09``-``\\x0D``, and ``bytes.translate`` maps every other
separator of the alphanumeric rule to a space, so no regular expression runs
over the corpus.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this part of the rows is joined by a broadcast: there are fewer such keys than HOT_PARTS.
HOT_PARTS = 1000
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_ALNUM = bytearray(range(256))
for _b in _SEPARATORS:
    _ALNUM[_b] = 0x20
for _b in range(0x41, 0x5B):
    _ALNUM[_b] = _b + 32
_ALNUM = bytes(_ALNUM)


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null has none."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return text.encode().translate(_ALNUM).split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """The same frame, in a session whose Arrow batches hold ``BATCH_BYTES`` at most.

    Spark's limit of 64 MB would be held several times over by each task, in the
    JVM's direct memory and in Python.  A limit that the session has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_LIMIT) in ("67108864b", "64MB", "64m"):
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by ``spark.checkpoint.dir``.

    The files survive the loss of executors and go when the frame does
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).  A folder of our own
    is set only in local mode with the setting unset.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="karstline-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def slim(df: DataFrame, rows: int, a_part: int, least: int = 8) -> DataFrame:
    """The same rows in as many partitions as their number asks for, not more than there are.

    A small frame that comes out of a wide shuffle would write one small file for
    each of its partitions in every later shuffle.
    """
    return df.coalesce(max(least, -(-rows // a_part)))


def is_held_out(column, parts: int):
    """Whether crc32 of the id as text leaves 1 modulo ``parts`` (a null id does not)."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(parts) == 1, F.lit(False))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_long(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return values.view(np.int64)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``, to bound what a step holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def list_array(flat: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from its flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def fresh_name(stem: str) -> str:
    return f"__{stem}_{uuid.uuid4().hex[:12]}"


def named(column: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives memory that this process no longer needs back to the machine."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage, in the JVM and in this process.

    Plans, checkpoints, broadcasts and shuffles that nothing refers to any more go
    then, not only when the heap is full.
    """
    spark.sparkContext._jvm.System.gc()
    trim()


def freed(run):
    """``run`` over Arrow batches, after which the worker gives back what it no longer needs.

    Workers live on from stage to stage and would each keep the most that they ever held.
    """

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and in ``times`` the key's number of rows.

    Keys are whole numbers.  Those of over 1 / HOT_PARTS of the ``total`` rows are
    joined by a broadcast, so no key's rows meet in one task; they are first brought
    to the driver, fewer than HOT_PARTS if there are ``total`` rows or fewer.
    """
    is_hot = F.col("times") * HOT_PARTS > total
    hot = table.where(is_hot).select(*keys).collect()
    if not hot:
        return rows.join(table.drop("times"), keys)
    text = "concat_ws(':', " + ", ".join(f"cast(`{k}` AS string)" for k in keys) + ")"
    among = F.expr(f"{text} IN (" + ", ".join("'" + ":".join(str(r[k]) for k in keys) + "'" for r in hot) + ")")
    hot_rows = rows.where(among).join(F.broadcast(table.where(is_hot).drop("times")), keys)
    return hot_rows.unionByName(rows.where(~among).join(table.where(~is_hot).drop("times"), keys))


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1 and so on: ``mapInArrow`` takes no names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def free_names(taken: Iterable[str], *stems: str) -> list[str]:
    """Names for added columns: the stems, each with the least number behind it that no column has, if one has it.

    Names are compared as Spark does, without regard to case.
    """
    used = {c.lower() for c in taken}
    out = []
    for stem in stems:
        name = next(n for n in (stem, *(f"{stem}_{i}" for i in range(1, len(used) + 2))) if n.lower() not in used)
        used.add(name.lower())
        out.append(name)
    return out
