"""Helpers that the operators of this subpackage share.

Text kernels see Arrow batches.  :func:`text_blocks` cuts each batch into
blocks of bounded text size and hands out the raw UTF-8 bytes with offsets, so
that kernels work on whole texts without a Python object for each of them.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel works on at once.  A longer text is a block of its own.
BLOCK_BYTES = 4 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The white space of the word contracts: blank and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session does not name one, a folder of its own is made and set in
    local mode; on a cluster, whose executors wouldn't see it, RuntimeError.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="veriframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@cache
def _run_folder(base: str, application: str) -> str:
    """The folder of this run, which the driver's JVM removes when it ends."""
    path = f"{base}/veriframe/{application}"
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_run_folder(shared_dir(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Remove all that this run has cut off so far.  Results that still read from it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/veriframe/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: By application, the files of :func:`cut` with the JVM's weak references to what reads them.
_CUT: dict[str, list[tuple[str, object]]] = {}


def free_unread(spark: SparkSession) -> None:
    """Remove the files of :func:`cut` that no DataFrame reads any more, as far as the JVM has collected these."""
    held = _CUT.get(spark.sparkContext.applicationId, [])
    gone = [path for path, reader in held if reader.get() is None]
    held[:] = [(path, reader) for path, reader in held if path not in gone]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The lineage ends there: a lost executor costs a read of the file, not the
    work before it.  The file stays as long as the result, or a DataFrame made
    from it, does; an RDD of it alone doesn't keep it.
    """
    spark = df.sparkSession
    free_unread(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    plan = out._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":  # all plans over this file share its index
        reader = spark._jvm.java.lang.ref.WeakReference(plan.relation().location())
        _CUT.setdefault(spark.sparkContext.applicationId, []).append((path, reader))
    return out


def join_skewed(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each, with the rows that ``left`` has of it in column ``n``.

    A key with more than a thousandth of all rows is dealt over as many tasks as
    it has thousandths: there are fewer than 1,000 such keys, which are sent with
    the number of their parts, and ``right``'s row comes once for each part.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    part = F.lit(max(1, total // 1000))
    parts = F.when(F.col(n) > part, F.ceil(F.col(n) / part)).otherwise(1)
    hot = F.broadcast(right.where(F.col(n) > part).select(key, parts.alias("_parts")))
    which = F.pmod(F.xxhash64(*(c for c in left.columns if c != key)), F.coalesce("_parts", F.lit(1)))
    dealt = left.join(hot, key, "left").withColumn("_part", which).drop("_parts")
    spread = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(n)
    return dealt.join(spread.hint("merge"), [key, "_part"]).drop("_part")


#: Bits of the filter over 64-bit values.  Its size is fixed; beyond its range it only lets more values through.
FILTER_BITS = 27


def _places(h: np.ndarray) -> np.ndarray:
    return (mix64(h.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _set_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for batch in batches:
        at = _places(batch.column("h").to_numpy(zero_copy_only=False))
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    step = 1 << 18
    for k in range(0, len(bits), step):
        if bits[k : k + step].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([bits[k : k + step].tobytes()], pa.binary())], names=["piece", "bits"])


def _or_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal pieces."""
    now, bits = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["piece", "bits"])
    for batch in batches:
        for piece, some in zip(batch.column("piece").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            if piece != now:
                if now is not None:
                    yield out()
                now, bits = piece, np.frombuffer(some, np.uint8).copy()
            else:
                bits |= np.frombuffer(some, np.uint8)
    if now is not None:
        yield out()


def bit_filter(values: DataFrame) -> np.ndarray:
    """A filter of fixed size over the 64-bit values in column ``h``."""
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    pieces = values.mapInArrow(_set_bits, "piece int, bits binary").repartition("piece").sortWithinPartitions("piece")
    for r in pieces.mapInArrow(_or_bits, "piece int, bits binary").toLocalIterator():
        bits[r.piece << 18 : (r.piece << 18) + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return bits


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each value may be in the filter; those that are, are."""
    at = _places(h)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def row_keys() -> list[Column]:
    """``_k``, ``_k2``: 96 bits by which a row is known by its ``doc_id`` and ``text``; equal rows have equal ones."""
    return [F.xxhash64("doc_id", "text").alias("_k"), F.hash("text", "doc_id").alias("_k2")]


def parted(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their keys (:func:`row_keys`): those that may be among ``keys``, and the others, which can't."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.col("_k").alias("h"))))

    @F.pandas_udf("boolean")
    def may(k: pd.Series) -> pd.Series:
        return pd.Series(in_filter(sent.value, k.to_numpy(np.int64)))

    keyed = docs.select(*(f"`{c}`" for c in docs.columns), *row_keys())
    return keyed.where(may("_k")), keyed.where(~may("_k"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are not in ``gone`` (``_k``, ``_k2``); only rows that may be among these are shuffled."""
    some, rest = parted(docs, gone)
    return some.join(gone.hint("merge"), ["_k", "_k2"], "left_anti").select(docs.columns).unionByName(rest.select(docs.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor`` (null id: null)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(divisor))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return free memory to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text each, or one row."""
    for batch in batches:
        body, offs = raw_text(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), body[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    give_back()


def words(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are no white space.

    Rows end words: a word never spans two rows.
    """
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(body)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices ``start[i] .. start[i] + length[i]`` of all i, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))
