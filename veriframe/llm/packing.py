"""Sequence packing: best-fit decreasing with certified bin counts.

Pieces are dealt at random over partitions of about ``PART`` pieces.  Each is
packed by best-fit decreasing, and dual feasible functions give a lower bound of
its bin count, which certifies a partition that meets it.  The gap to the bound
tells how many of a partition's emptiest sequences are given up, and ``OPEN`` more,
since bounds are rounded up: those of ``MERGE`` partitions come together and are
packed anew, which is kept if it needs fewer sequences.  Rounds go on with
``MERGE`` times fewer partitions until one is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, text_blocks
from .tokens import encoder

CAPACITY, PART, MERGE, OPEN = 4096, 2048, 32, 8
END_ID = 1
#: Text bytes whose parts are looked up at once.
BLOCK = 1 << 20


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound that two families of dual feasible functions give (Fekete and Schepers, 2001)."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int(n @ size) // capacity)
    # sizes above capacity - e count as whole bins, those under e as nothing
    count, weight = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    e = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - e + 1]
    middle = weight[capacity - e + 1] - weight[e]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        # u(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k, in units of 1 / (k capacity)
        whole = (k + 1) * size % capacity == 0
        u = np.where(whole, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int(n @ u) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length, by best-fit decreasing.

    ``there`` has bit r if a bin with r free tokens exists, so the tightest bin
    that fits is the lowest set bit from the length on.
    """
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = there >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                there ^= 1 << r
        else:
            r, b, made = capacity, made, made + 1
        bins[i] = b
        if r > x:
            free[r - x].append(b)
            there |= 1 << (r - x)
    return bins


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end)
        for part, _, _ in text_blocks(batches, limit=BLOCK):
            ids, counts = enc.encode(part.column("text").fill_null("").to_pylist())
            number = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            at = np.repeat(np.cumsum(counts) - counts, number) + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all pieces of at most ``capacity`` ids; a null text has the end id alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, end, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _pack(capacity: int, again: bool, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins = best_fit(lengths, capacity)
        if again:
            old = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)[1]
            if bins.max() >= old.max():
                bins = old
        bound = lower_bound(lengths, capacity)
        made = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=made)
        # a certified partition still has a last sequence that isn't full: it takes part in the exchange as well
        left = np.zeros(made, bool)
        emptiest = np.argsort(fill, kind="stable")[: made - bound + OPEN]
        left[emptiest[fill[emptiest] < capacity]] = True
        order = pc.sort_indices(table.append_column("_bin", pa.array(bins)), [("_bin", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        b, x = bins[order.to_numpy()], lengths[order.to_numpy()]
        before = np.cumsum(x) - x
        first = np.searchsorted(b, np.arange(made))
        n = len(b)
        turn, part = (table.column(c)[0].as_py() for c in ("round", "part"))
        new = {"sequence_id": (turn << 56) | (part << 24) | b, "offset": before - before[first][b], "open": left[b], "bins": np.full(n, made, np.int64), "bound": np.full(n, bound, np.int64)}
        own = table.take(order)
        return pa.table([pa.array(new[f.name], f.type) if f.name in new else own.column(f.name) for f in schema], schema=schema)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``pieces`` with ``sequence_id``, ``offset``, ``bins`` and ``bound``.

    Each sequence holds at most ``capacity`` ids without gaps.  ``bins`` and ``bound``
    are the sequences of the partition in which this one was packed last, and the
    fewest that any packing of that partition takes: where they are equal, the bound
    certifies the partition.  ``pieces`` needs ``doc_id`` (of any type that has an
    order), ``piece`` and ``length`` (1 to ``capacity``).  Equal rows are packed each by
    itself; a null doc_id is packed like any other; no pieces give an empty result.
    """
    names = pieces.columns
    extra = "part long, round int, sequence_id long, offset long, open boolean, bins long, bound long"
    schema = T.StructType([*pieces.schema.fields, *T.StructType.fromDDL(extra).fields])
    arrow = to_arrow_schema(schema)
    n = pieces.count()
    parts = max(1, -(-n // PART))
    # the row's place in the file, not its id, deals it out: equal rows spread
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))).withColumn("round", F.lit(0)).withColumn("sequence_id", F.lit(0).cast("long"))
    now = cut(dealt.groupBy("part").applyInArrow(_pack(capacity, False, arrow), schema), "packed")
    done = now.where("not open")
    turn = 0
    while parts > 1:
        turn += 1
        parts = -(-parts // MERGE)
        pool = now.where("open").withColumn("part", (F.col("part") / MERGE).cast("long")).withColumn("round", F.lit(turn)).drop("offset", "open", "bins", "bound")
        now = cut(pool.groupBy("part").applyInArrow(_pack(capacity, True, arrow), schema), "packed")
        done = done.unionByName(now.where("not open"))
        if now.isEmpty():
            break
    return done.unionByName(now.where("open")).select(*names, "sequence_id", "offset", "bins", "bound")


def pack_documents(docs: DataFrame, path: str, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    A null text counts as empty and is one piece of the end id.  Repeated rows
    are packed as often as they occur.  Texts of any length are cut, never
    shortened.  Other columns of ``docs`` are not looked at.
    """
    return pack(cut(token_pieces(docs, path, end, capacity), "pieces"), capacity)
