"""Benchmark decontamination by greedy string tiling.

Texts become words (runs of letters and digits, lower-cased; in scripts without
blanks each character is a word).  Windows of ``MIN_TILE`` words, or of a shorter
item's own length, are hashed by Karp and Rabin's rolling sum.  Those of the
benchmark are a table of seeds.  One scan of the documents finds the windows that
may be among them, by a filter of fixed size, and joins these with the seeds.

Where the shared windows could cover enough of an item, document and item are
tiled (Wise, 1993): the longest common run of words that are in no tile yet is
marked in both, and the next one is looked for, until none has ``MIN_TILE`` words.
Karp-Rabin runs with falling lengths: sums of any length come from prefix sums,
so memory is in proportion to the two texts however often their phrases repeat.
The share of the item's words under tiles decides: a passage whose parts come in
another order is covered all the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, in_filter, join_skewed, mix64, ragged, row_keys, text_blocks, without

MIN_TILE, COVERAGE = 5, 0.5
#: Text bytes whose words are hashed at once; that takes about 80 times as much memory.
BLOCK = 1 << 20
#: A word that no text has: what lies between the parts of a document that are compared.
GAP = 0
#: Scripts without blanks (Thai and Lao, Burmese, Khmer, kana, Han), first and last code point of each.
SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))

_R = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = np.uint64(pow(int(_R), -1, 1 << 64))


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each code point is a letter or digit, whether it is a word by itself, and its lower-case form if that is one code point."""
    inside, single, lower = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            inside[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    for low, high in SINGLE:
        single[low : high + 1] = inside[low : high + 1]
    return inside, single, lower


def tokens(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    inside, single, lower = _alphabet()
    raw = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    heads = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[offs]
    word, alone = inside[raw], single[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | alone[1:] | alone[:-1]
    last[:-1] &= ~word[1:] | alone[1:] | alone[:-1]
    a = heads[:-1][heads[:-1] < len(raw)]
    first[a] = word[a]
    z = heads[1:][heads[1:] > 0] - 1
    last[z] = word[z]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw), _R)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw), np.uint64(pow(int(_R), -1, 1 << 64)))]), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(lower[raw].astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        h = mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    h[h == GAP] = np.uint64(1)
    return h, np.searchsorted(heads, start, side="right") - 1


def windows(h: np.ndarray, row: np.ndarray, size: int = MIN_TILE) -> tuple[np.ndarray, np.ndarray]:
    """First word and rolling hash of each window of ``size`` words within a row."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1])
    with np.errstate(over="ignore"):
        value = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            value = value * _P + h[k : len(h) - size + 1 + k]
    return at, mix64(value[at])


class _Runs:
    """Rolling sums of a text, and its words that are in no tile."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _R)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BACK)]), dtype=np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words) * power[:-1], dtype=np.uint64)])
        self.taken = words == GAP
        self.refresh()

    def refresh(self) -> None:
        """``free``: how many words from each on are in no tile."""
        place = np.arange(len(self.words))
        wall = np.where(self.taken, place, len(self.words))
        self.free = np.minimum.accumulate(wall[::-1])[::-1] - place
        self.longest = int(self.free.max()) if len(place) else 0

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the free runs of ``size`` words."""
        at = np.flatnonzero(self.free >= size)
        with np.errstate(over="ignore"):
            return at, (self.sums[at + size] - self.sums[at]) * self.back[at]


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, length) from the words' hashes, the longest first.

    Ties go to the earlier place in the item, then in the document.
    """
    d, i = _Runs(doc), _Runs(item)
    tiles: list[tuple[int, int, int]] = []
    high = len(item)

    def common(size: int) -> bool:
        return bool(np.isin(i.hashes(size)[1], d.hashes(size)[1]).any())

    while True:
        high = min(high, d.longest, i.longest)
        if high < least or not common(least):
            return tiles
        size, beyond = (high, high + 1) if common(high) else (least, high)
        while beyond - size > 1:
            mid = (size + beyond) // 2
            size, beyond = (mid, beyond) if common(mid) else (size, mid)
        places, key = d.hashes(size)
        order = np.lexsort([places, key])
        places, key = places[order], key[order]
        at, wanted = i.hashes(size)
        start, stop = np.searchsorted(key, wanted), np.searchsorted(key, wanted, side="right")
        met = stop > start
        turn: dict[int, int] = {}
        for a, x, y in zip(at[met].tolist(), start[met].tolist(), stop[met].tolist(), strict=True):
            if i.taken[a : a + size].any():
                continue
            k = turn.get(x, x)
            while k < y and (d.taken[places[k] : places[k] + size].any() or not np.array_equal(doc[places[k] : places[k] + size], item[a : a + size])):
                k += 1  # what is taken once stays so
            turn[x] = k
            if k < y:
                b = int(places[k])
                d.taken[b : b + size] = i.taken[a : a + size] = True
                tiles.append((b, a, size))
        d.refresh()
        i.refresh()
        high = size - 1


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each item that has any, and the seeds, in order: its windows."""
    for part, body, offs in text_blocks(batches, limit=BLOCK):
        h, row = tokens(body, offs)
        cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
        some = np.flatnonzero(np.diff(cuts))
        n = np.diff(cuts)[some]
        seeds = []
        for k in some.tolist():
            own = h[cuts[k] : cuts[k + 1]]
            seeds.append(windows(own, np.zeros(len(own), np.int64), min(MIN_TILE, len(own)))[1].view(np.int64))
        words = [h[cuts[k] : cuts[k + 1]].tobytes() for k in some.tolist()]
        own = part.take(pa.array(some))
        yield pa.RecordBatch.from_arrays([own.column("item"), own.column("item_id"), pa.array(n, pa.int32()), pa.array(words, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], names=["item", "item_id", "n", "item_words", "seeds"])


def _near(words: np.ndarray, hit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words under the windows that start at ``hit``, with a gap between parts that aren't next to each other."""
    under = np.zeros(len(words) + 1, np.int64)
    np.add.at(under, hit, 1)
    np.add.at(under, hit + sizes, -1)
    at = np.flatnonzero(np.cumsum(under)[:-1] > 0)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(words[at], gaps, np.uint64(GAP))


def _hits(sizes: list[int], sent):
    """Of each document that has windows which may be seeds: these, and the words under them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for part, body, offs in text_blocks(batches, limit=BLOCK):
            h, row = tokens(body, offs)
            at, key, size = [], [], []
            for s in sizes:
                own, value = windows(h, row, s)
                there = in_filter(bits, value)
                at.append(own[there])
                key.append(value[there].view(np.int64))
                size.append(np.full(len(at[-1]), s))
            at, key, size = np.concatenate(at), np.concatenate(key), np.concatenate(size)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, key, size = at[order], key[order], size[order]
            which = row[at]
            some, head = np.unique(which, return_index=True)
            cuts = np.searchsorted(row, np.stack([some, some + 1]))
            seeds, words = [], []
            for x, y, a, z in zip(head.tolist(), [*head[1:].tolist(), len(at)], *cuts.tolist(), strict=True):
                seeds.append(np.unique(key[x:y]))
                words.append(_near(h[a:z], at[x:y] - a, size[x:y]).tobytes())
            own = part.drop_columns(["text"]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(seeds, pa.list_(pa.int64())), pa.array(words, pa.binary())], names=[*own.schema.names, "seeds", "words"])

    return run


def _tiled(coverage: float):
    """Tiles the pairs whose shared windows could cover enough of the item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for k, (words, item_words, places) in enumerate(zip(batch.column("words"), batch.column("item_words"), batch.column("places").to_pylist(), strict=True)):
                doc, item = (np.frombuffer(x.as_buffer(), np.uint64) for x in (words, item_words))
                least = min(MIN_TILE, len(item))
                under = np.zeros(len(item) + 1, np.int64)
                np.add.at(under, places, 1)
                np.add.at(under, np.array(places) + least, -1)
                if (np.cumsum(under)[:-1] > 0).sum() < coverage * len(item):
                    continue
                # of the document only what it has in common with this item
                row = np.zeros(max(len(doc), len(item)), np.int64)
                at, value = windows(doc, row[: len(doc)], least)
                hit = at[np.isin(value, windows(item, row[: len(item)], least)[1])]
                tiles = greedy_tiles(_near(doc, hit, np.full(len(hit), least)), item, least)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(item):
                    keep.append(k)
                    found.append((len(tiles), covered, len(item), covered / len(item)))
            own = batch.drop_columns(["words", "item_words", "places"]).take(pa.array(keep, pa.int64()))
            columns = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*own.schema.names, "n_tiles", "n_covered", "n_item", "coverage"])

    return run


def _matches(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``item_id, n_tiles, n_covered, n_item, coverage``, of all pairs at or above ``coverage``."""
    spark = docs.sparkSession
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    item_id = f"item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    result = ", ".join([*others, item_id, "n_tiles int, n_covered int, n_item int, coverage double"])
    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").where("text IS NOT NULL")
    items = cut(numbered.mapInArrow(_items, f"item long, {item_id}, n int, item_words binary, seeds array<long>"), "items")
    sizes = sorted(r.s for r in items.select(F.least("n", F.lit(MIN_TILE)).alias("s")).distinct().collect())
    if not sizes:
        return spark.createDataFrame([], result)
    seeds = items.select("item", "n", F.posexplode("seeds").alias("place", "seed"))
    sent = spark.sparkContext.broadcast(bit_filter(seeds.select(F.col("seed").alias("h")).distinct()))
    scanned = docs.withColumn("_row", F.monotonically_increasing_id())
    hits = cut(scanned.mapInArrow(_hits(sizes, sent), ", ".join([*others, "_row long, seeds array<long>, words binary"])), "hits")
    # a seed has a row with all its places; many documents may have it
    met = hits.select("_row", F.explode("seeds").alias("seed"))
    where = seeds.groupBy("seed").agg(F.collect_list(F.struct("item", "n", "place")).alias("places")).join(met.groupBy("seed").agg(F.count("*").alias("_n")), "seed")
    shared = join_skewed(met, cut(where, "seeds"), "seed", "_n").select("_row", F.explode("places").alias("p")).select("_row", "p.item", "p.n", "p.place")
    pairs = shared.groupBy("_row", "item").agg(F.max("n").alias("n"), F.collect_list("place").alias("places"))
    pairs = cut(pairs.where(F.size("places") * F.least("n", F.lit(MIN_TILE)) >= coverage * F.col("n")).drop("n"), "pairs")
    full = items.select("item", "item_id", "item_words").join(pairs.groupBy("item").agg(F.count("*").alias("_n")), "item")
    both = join_skewed(pairs.join(hits.drop("seeds"), "_row"), full, "item", "_n").drop("_row", "item")
    return both.select(*(f.name for f in docs.schema.fields if f.name != "text"), "item_id", "words", "item_words", "places").mapInArrow(_tiled(coverage), result)


def tile_matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, n_tiles, n_covered, n_item, coverage`` of pairs that share ``coverage`` of the item's words or more.

    Null texts match nothing, nor do items without a word; an item of fewer than
    five words is matched as a whole.  A row of either table that occurs several
    times gives a row each time; null ids are carried along.  An empty table on
    either side gives an empty result.  Other columns aren't looked at.
    """
    return _matches(docs.select("doc_id", "text"), benchmark, coverage)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that share no item's words to ``coverage``; all columns.

    Only rows that may be among those that go are shuffled.  Rows are known by
    id and text, so that equal ones go together.
    """
    keyed = docs.select(*row_keys(), "text")
    return without(docs, cut(_matches(keyed, benchmark, coverage).select("_k", "_k2").distinct(), "contaminated"))
