"""Near-duplicates by SimHash with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 21, 21 and 22 bits,
each padded with zeros to the 23 bits of the binary Golay code.  A segment is
decoded to all codewords within distance 4: one, or six where the nearest is at
distance 3.  Two words of at most two differing bits always share one of them:
the codeword nearest to the word half way between is within 4 of both.

Fingerprints with at most four differing bits have, in the best two of the
three segments, at most two errors together, so the pair of segments yields a
common pair of codeword indices.  Every fingerprint is stored under the pairs of
all three combinations (28 keys for each of these on average, 85 together),
fingerprints with a common key are compared, and those that differ in at most
four bits are linked.

A key with more than ``HOT`` fingerprints is not compared pair by pair: its
fingerprints are spread to all 64-bit words within distance 2 (2,081 keys), and
two fingerprints link exactly if they have such a word in common.  A word has
at most 2,081 fingerprints around it, so these groups are bounded, and the work
for a fingerprint is bounded whatever the size of its group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, cut, join_skewed, parted, row_keys, text_blocks, words
from .components import connected_components

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Text bytes that are fingerprinted at once; places and shingles of them take about a hundred times as much memory.
BLOCK = 1 << 20
#: Fingerprints under one key from which words in between replace comparisons; a group of this size costs about as many comparisons as it costs words.
HOT = 512
SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words; for each syndrome the error patterns of weight up to 4, and how many there are (1 or 6)."""
    syndrome = np.zeros(1, np.uint16)
    for bit in range(23):
        rest = 1 << bit
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << (k - 11)
        syndrome = np.concatenate([syndrome, syndrome ^ np.uint16(rest)])
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[syndrome[e]].append(e)
    count = np.array([len(x) for x in errors], np.int64)
    return syndrome, np.array([(x * 6)[:6] for x in errors], np.int64), count


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint: the fingerprint's place, and the key."""
    syndrome, errors, count = golay()
    near, valid = [], []
    for shift, width in SEGMENTS:
        part = ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = syndrome[part]
        near.append((part[:, None] ^ errors[s]) >> 11)
        valid.append(np.arange(6) < count[s][:, None])
    at, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        key = (p << 24) | (near[i][:, :, None] << 12) | near[j][:, None, :]
        there = np.nonzero(valid[i][:, :, None] & valid[j][:, None, :])
        at.append(there[0])
        keys.append(key[there])
    return np.concatenate(at), np.concatenate(keys)


def fingerprints(body: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """SimHash of each row: words of the lower-cased bytes, joined shingles, XXH64, majority of bits."""
    n = len(offs) - 1
    low = LOWER[body]
    start, end, row = words(low, offs)
    out = np.zeros(n, np.uint64)
    if not len(start):
        return out
    # all words with one blank after each
    length = end - start
    to = np.cumsum(length + 1)
    joined = np.full(int(to[-1]), 32, np.uint8)
    begin = to - length - 1
    inside = np.ones(len(joined), bool)
    inside[to - 1] = False
    joined[inside] = low[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    data = joined.tobytes()
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(1, count - (SHINGLE - 1)), 0)
    head = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    tail = np.minimum(head + SHINGLE, np.repeat(first + count, shingles)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], SEED) for a, b in zip(begin[head].tolist(), (to[tail] - 1).tolist(), strict=True)], np.uint64)
    rows = np.flatnonzero(shingles)
    edges = np.concatenate([[0], np.cumsum(shingles[rows])])
    step = 1 << 14  # shingles whose bits are laid out at once
    ones = np.zeros((len(rows), 64), np.int64)
    for a in range(0, len(h), step):
        b = min(len(h), a + step)
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r0, r1 = int(np.searchsorted(edges, a, side="right")) - 1, int(np.searchsorted(edges, b, side="left"))
        cuts = np.maximum(edges[r0:r1], a) - a
        ones[r0:r1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    major = ones * 2 > shingles[rows][:, None]
    out[rows] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _print_docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, body, offs in text_blocks(batches, limit=BLOCK):
        own = part.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(fingerprints(body, offs).view(np.int64))], names=[*own.schema.names, "fp"])


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 5000):
            own = fps[k : k + 5000]
            at, key = golay_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(own[at])], names=["key", "fp"])


@cache
def _masks() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)


def _between(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = _masks()
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 200):
            own = fps[k : k + 200].view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ masks[None, :]).view(np.int64).ravel()), pa.array(np.repeat(own.view(np.int64), len(masks)))], names=["key", "fp"])


def _links_in(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one key, enough of them to keep what is connected connected.

    ``label`` is a row that is already joined to this one by links given out.
    """
    label = np.arange(len(key))
    a, b = [], []
    rows = np.flatnonzero(key[:-1] == key[1:]) if len(key) else np.zeros(0, np.int64)
    d = 1
    bits = fp.view(np.uint64)
    while len(rows):
        near = rows[(np.bitwise_count(bits[rows] ^ bits[rows + d]) <= radius) & (label[rows] != label[rows + d])]
        if len(near):
            a.append(fp[near])
            b.append(fp[near + d])
            low = np.minimum(label[near], label[near + d])
            np.minimum.at(label, near, low)
            np.minimum.at(label, near + d, low)
            label = label[label[label]]
        d += 1
        rows = rows[rows + d < len(key)]
        rows = rows[key[rows] == key[rows + d]]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _compare(hot_from: int, radius: int):
    def out(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key, fp, spread = none, none, None  # the rows of the last key so far; a key already known to be hot
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            done, key, fp = (key[:last], fp[:last]), key[last:], fp[last:]
            for k, f in (done, (key, fp) if len(key) > hot_from or spread is not None and len(key) and key[0] == spread else (none, none)):
                _, first, n = np.unique(k, return_index=True, return_counts=True)
                big = np.repeat((n > hot_from) | (k[first] == spread if spread is not None else False), n) if len(k) else np.zeros(0, bool)
                if big.any():
                    yield out(f[big], f[big], True)
                yield out(*_links_in(k[~big], f[~big], radius), False)
                if f is fp and len(k):
                    spread, key, fp = key[-1], none, none
        yield out(*_links_in(key, fp, radius), False)

    return run


def _adjacent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_key, last_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([last_key, batch.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([last_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
        same = np.flatnonzero(key[:-1] == key[1:])
        pairs = np.unique(np.stack([fp[same], fp[same + 1]], 1), axis=0)
        last_key, last_fp = key[-1:], fp[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``fp`` (the fingerprint as a signed 64-bit integer); null and empty texts have fingerprint 0."""
    others = [f for f in docs.schema.fields if f.name not in ("text", "fp")]
    return docs.select(*(f"`{f.name}`" for f in others), "text").mapInArrow(_print_docs, T.StructType([*others, T.StructField("fp", T.LongType())]))


def fingerprint_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct fingerprints of column ``fp`` just as all pairs of at most four differing bits do."""
    keyed = prints.select("fp").mapInArrow(_keys, "key int, fp long")
    met = cut(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare(hot, RADIUS), "a long, b long, hot boolean"), "links")
    spread = met.where("hot").select(F.col("a").alias("fp")).distinct().mapInArrow(_between, "key long, fp long")
    around = spread.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_adjacent, "a long, b long")
    return met.where("not hot").select("a", "b").unionByName(around).distinct()


def _rooted(prints: DataFrame, place: Column, hot: int) -> DataFrame:
    """``fp, n, low, root``: each distinct fingerprint with its rows, their least place and the component's smallest fingerprint."""
    classes = cut(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(place).alias("low")), "classes")
    parts = cut(connected_components(fingerprint_links(classes, hot)), "parts")
    return classes.join(parts, classes.fp == parts.node, "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most four
    differing bits reach.  Null text counts as empty; texts without words have
    fingerprint zero and link like any other.  A null doc_id is returned and
    never becomes a component's id unless all of its component are null.
    Repeated rows are returned as often as they occur.  Other columns of
    ``docs`` are not looked at; an empty table gives an empty result.
    """
    prints = cut(fingerprint_documents(docs.select("doc_id", "text")), "prints")
    joined = cut(_rooted(prints, F.col("doc_id"), hot), "rooted")
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = cut(joined.join(lowest, "root").select("fp", "n", "component_id"), "labels")
    return join_skewed(prints, labels, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest doc_id (null last), of rows with one id that whose hash comes first.

    Rows are known by id and text; of rows that repeat both, one stays.  All columns
    are kept.  Only rows that may go are shuffled.
    """
    prints = cut(fingerprint_documents(docs.select("doc_id", *row_keys(), "text")), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "_k2")
    keep = _rooted(prints, place, hot).groupBy("root").agg(F.min("low").alias("low")).select("low._k", "low._k2", F.lit(True).alias("_stays"))
    rows = prints.groupBy("_k", "_k2").agg(F.count("*").alias("_n")).join(keep, ["_k", "_k2"], "left")
    asked = cut(rows.where("_stays IS NULL OR _n > 1").select("_k", "_k2", F.coalesce("_stays", F.lit(False)).alias("_stays")), "asked")
    some, rest = parted(docs, asked)
    known = some.join(asked.hint("merge"), ["_k", "_k2"], "left")
    once = known.where("_stays").dropDuplicates(["_k", "_k2"])
    return rest.select(docs.columns).unionByName(known.where("_stays IS NULL").select(docs.columns)).unionByName(once.select(docs.columns))
