"""Sums of count vectors of a fixed length that tasks make side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries that travel in one row.
PIECE = 1 << 14
SCHEMA = "kind string, piece int, counts binary"


def rows(kind: str, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``counts`` (64-bit) in pieces; pieces of zeros are left out."""
    for k in range(0, len(counts), PIECE):
        piece = counts[k : k + PIECE]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([k // PIECE], pa.int32()), pa.array([piece.astype("<i8").tobytes()], pa.binary())], names=["kind", "piece", "counts"])




def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["counts"].iloc[0]) // 8, np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, "<i8")
    return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "piece": [pdf["piece"].iloc[0]], "counts": [total.tobytes()]})


def collect_sums(parts: DataFrame, length: int) -> dict[str, np.ndarray]:
    """The summed vectors by kind.  Their length is fixed, so what reaches the driver doesn't grow with the data."""
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("kind", "piece").applyInPandas(_total, SCHEMA).toLocalIterator():
        vector = out.setdefault(r.kind, np.zeros(length, np.int64))
        piece = np.frombuffer(r.counts, "<i8")
        vector[r.piece * PIECE : r.piece * PIECE + len(piece)] = piece
    return out
