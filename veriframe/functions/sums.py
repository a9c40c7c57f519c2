"""Sums of arrays that tasks make side by side, in pieces of bounded size.

Pieces of one name are added up as they stream by, in two steps (the first over
``SALTS`` parts of the tasks), so that memory and the number of pieces a task meets
stay bounded however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers that travel in one row, and parts of the first step.
PIECE, SALTS = 1 << 14, 64
SCHEMA = "kind string, piece int, salt int, numbers binary"


def rows(kind: str, values: np.ndarray, salt: int = 0) -> Iterator[pa.RecordBatch]:
    """``values`` (64-bit floats or integers) in pieces; pieces of zeros are left out."""
    flat = np.ascontiguousarray(values).ravel()
    for k in range(0, len(flat), PIECE):
        piece = flat[k : k + PIECE]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([k // PIECE], pa.int32()), pa.array([salt % SALTS], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["kind", "piece", "salt", "numbers"])


def _added(dtype: str, salted: bool):
    """From rows sorted by kind, piece and salt: one row each with the sum (one for all salts if not ``salted``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([now[2]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["kind", "piece", "salt", "numbers"])

        for batch in batches:
            for kind, piece, salt, numbers in zip(*(batch.column(c).to_pylist() for c in ("kind", "piece", "salt", "numbers")), strict=True):
                own = (kind, piece, salt if salted else 0)
                if own != now:
                    if now is not None:
                        yield out()
                    now, total = own, np.frombuffer(numbers, dtype).copy()
                else:
                    total += np.frombuffer(numbers, dtype)
        if now is not None:
            yield out()

    return run


def collect(parts: DataFrame, lengths: dict[str, int], dtype: str = "<i8") -> dict[str, np.ndarray]:
    """The summed arrays by kind.  Their lengths are fixed, so what reaches the driver doesn't grow with the data."""
    for salted in (True, False):
        keys = ["kind", "piece", *(["salt"] if salted else [])]
        parts = parts.repartition(*keys).sortWithinPartitions(*keys, *([] if salted else ["salt"])).mapInArrow(_added(dtype, salted), SCHEMA)
    out = {k: np.zeros(n, dtype) for k, n in lengths.items()}
    for r in parts.toLocalIterator():
        own = np.frombuffer(r.numbers, dtype)
        out[r.kind][r.piece * PIECE : r.piece * PIECE + len(own)] = own
    return out


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
