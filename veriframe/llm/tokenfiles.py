"""Token files: Arrow streams of fixed-size lists.

A file holds the ids of a range of documents as one run, cut into sequences of
equal length; the last is padded, and ``mask`` has a bit a place, set for ids and
not for padding.
Each record batch has ``ROWS`` sequences (the last may have fewer), so batches
have equal sizes and sequence i is in batch ``i // ROWS``: :class:`TokenFile` maps
the file and hands out views without a copy.  An index beside the file says
where each document starts, since any id may occur in a text.

Files go to the shared folder under names of their own for each attempt; what
the manifest names is complete, and a lost executor leaves at most a file that
nothing names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import new_path, text_blocks
from .tokens import encoder

LENGTH, ROWS, END_ID = 2048, 64, 0
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def index_schema(kind: pa.DataType) -> pa.Schema:
    """Of the index file; ids keep their type."""
    return pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])


class TokenFile:
    """Random access to the sequences of one file.

    Batch headers are met in order and remembered; ids and masks are views of
    the mapped file where the store is local, of the buffer read otherwise.
    """

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self._reader = pa.ipc.open_stream(source)
        self.length = self._reader.schema.field("ids").type.list_size
        self._batches: list[pa.RecordBatch] = []

    def batch(self, k: int) -> pa.RecordBatch:
        while len(self._batches) <= k:
            self._batches.append(self._reader.read_next_batch())
        return self._batches[k]

    def _row(self, name: str, i: int) -> pa.Array:
        column = self.batch(i // ROWS).column(name)
        if not 0 <= i % ROWS < len(column):
            raise IndexError(i)
        return column.values.slice(i % ROWS * self.length, self.length)

    def sequence(self, i: int) -> np.ndarray:
        return self._row("ids", i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        return self._row("mask", i)

    def runs(self) -> Iterator[np.ndarray]:
        """The ids in order, batch by batch, without padding."""
        k = 0
        while True:
            try:
                batch = self.batch(k)
            except StopIteration:
                return
            self._batches[k] = None  # what has been read in order isn't kept
            yield batch.column("ids").values.to_numpy()[: batch.column("mask").values.true_count]
            k += 1


def _write(folder: str, tokenizer: str, end: int, length: int, index_of: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, end)
        kind = pa.uint16() if enc.library.get_vocab_size() <= 1 << 16 and end < 1 << 16 else pa.uint32()
        dtype = np.dtype(kind.to_pandas_dtype())
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        schema = file_schema(length, kind)
        n_docs = n_tokens = 0

        def fixed(ids: np.ndarray) -> pa.RecordBatch:
            rows = -(-len(ids) // length)
            body, mask = np.zeros(rows * length, dtype), np.zeros(rows * length, bool)
            body[: len(ids)], mask[: len(ids)] = ids, True
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (body, mask)], schema=schema)

        with store.open_output_stream(f"{root}/{name}.arrow") as data, store.open_output_stream(f"{root}/{name}.index.arrow") as index:
            with pa.ipc.new_stream(data, schema) as out, pa.ipc.new_stream(index, index_of) as where:
                held: list[np.ndarray] = []
                waiting = 0
                for part, _, _ in text_blocks(batches):
                    ids, counts = enc.encode(part.column("text").fill_null("").to_pylist())
                    where.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id").cast(index_of.field("doc_id").type), pa.array(n_tokens + np.cumsum(counts) - counts), pa.array(counts)], schema=index_of))
                    n_docs, n_tokens = n_docs + len(counts), n_tokens + len(ids)
                    held.append(ids.astype(dtype))
                    waiting += len(ids)
                    if waiting >= ROWS * length:
                        run_ids = np.concatenate(held)
                        whole = waiting // (ROWS * length) * ROWS * length
                        for a in range(0, whole, ROWS * length):
                            out.write_batch(fixed(run_ids[a : a + ROWS * length]))
                        held, waiting = [run_ids[whole:]], waiting - whole
                if waiting:
                    out.write_batch(fixed(np.concatenate(held)))
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return run


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            store, where = fs.FileSystem.from_uri(f"{path}.index.arrow")
            with store.open_input_stream(where) as f:
                index = pa.ipc.open_stream(f).read_all()
            size = index.column("n_tokens").to_numpy()
            crcs = np.zeros(len(size), np.int64)
            k, left = 0, int(size[0])
            for ids in TokenFile(f"{path}.arrow").runs():
                ids = ids.astype("<u4")
                at = 0
                while at < len(ids):
                    to = min(len(ids), at + left)
                    crcs[k] = zlib.crc32(ids[at:to], int(crcs[k]))
                    left -= to - at
                    at = to
                    if not left and k + 1 < len(size):
                        k += 1
                        left = int(size[k])
            start = index.column("start").to_numpy() + base
            yield from pa.table({"doc_id": index.column("doc_id"), "start": start, "n_tokens": size, "ids_crc32": crcs}).combine_chunks().to_batches()


def write_token_files(docs: DataFrame, tokenizer: str, end: int = END_ID, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Write the files and return the manifest: ``shard, path, n_docs, n_tokens, base``.

    Files follow each other in ascending doc_id order (null first, equal ids in
    any order); ``base`` is the number of ids in the files before.  The
    manifest has a row a file.  An empty table writes nothing.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    index = index_schema(to_arrow_type(docs.schema["doc_id"].dataType))
    rows = sorted(ordered.mapInArrow(_write(folder, tokenizer, end, length, index), MANIFEST).collect())
    base, out = 0, []
    for r in rows:
        out.append((*r, base))
        base += r.n_tokens
    return spark.createDataFrame(out, f"{MANIFEST}, base long")


def read_token_files(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files; ``kind`` is the type of the ids."""
    many = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(many, "shard").mapInArrow(_read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, tokenizer: str, end: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Write all texts (null: empty, so the end id alone) and describe them from what is read back.  Ids of any type that has an order are kept as they are."""
    return read_token_files(write_token_files(docs, tokenizer, end, length), docs.schema["doc_id"].dataType.simpleString())
