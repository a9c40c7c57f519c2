"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the
bytes before (Willems, Shtarkov and Tjalkens, 1995).  A node's estimate is
Krichevsky and Trofimov's; its weighted probability is half the estimate's and
half the product of its children's, so every depth from 0 to ``DEPTH`` is mixed by
how well it coded the training texts.  The trained tree is used as it is: a
text's score is the sum of its bytes' log10 probabilities, and of an end byte.

The tree comes from counts of byte (DEPTH + 1)-grams over all training texts, and
every counted context is a node.  It is a distributed table: of each gram that
any text has, its log-probability.  Contexts with the same latest three bytes
(65,536 grams at most) lie in one task; those of two bytes and less, 65,536 at
most, are mixed at the driver.

The most frequent grams, ``GRAMS`` at most, are sent to the tasks; the grams of a
text that aren't among these are joined with the table.

The base score is that of words by their smoothed counts.  Words are known by
64-bit hashes.  The most frequent ones, ``VOCABULARY`` at most, are sent to the
tasks; the words of a text that aren't among these are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, remainder, text_blocks, words
from .quality import word_hashes

DEPTH, GRAMS, VOCABULARY = 4, 1 << 17, 1 << 18
#: Key of the end token, which no word has.
END = 0
GRAM, WORD = 0, 1
#: Entries that a task gathers before it sums them up.
GATHER = 4_000_000
#: Grams whose contexts a task works on at once, if these end there.
LEVEL_ROWS = 100_000


def _framed(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts with ``DEPTH`` zero bytes before each and an end byte 0 after it; where each text's first byte is."""
    n = len(offs) - 1
    out = np.zeros(len(body) + n * (DEPTH + 1), np.uint8)
    shift = np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, np.diff(offs))
    out[np.arange(len(body)) + shift] = LOWER[body]
    return out, offs[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH


def _coded(offs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the bytes that are coded: each text's and its end."""
    size = np.diff(offs) + 1
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _word_keys(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word (not the end token); no hash is ``END``."""
    low = LOWER[body]
    start, end, row = words(low, offs)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes(low, start, end).view(np.int64)
    h[h == END] = 1
    return h, row


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _grams(framed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes at the places ``at`` (lowest), each with the ``DEPTH`` bytes before."""
    gram = np.zeros(len(at), np.uint64)
    for d in range(DEPTH, -1, -1):
        gram = (gram << np.uint64(8)) | framed[at - d]
    return gram.view(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n`` counts training texts, ``m`` all; words of training texts alone."""
    kinds = [(GRAM, True), (GRAM, False), (WORD, True)]
    keys: dict[tuple[int, bool], list[np.ndarray]] = {k: [] for k in kinds}
    counts: dict[tuple[int, bool], list[np.ndarray]] = {k: [] for k in kinds}
    held = dict.fromkeys(kinds, 0)
    n_rows = 0
    for batch in batches:
        train = batch.column("train")
        for trained, own in ((True, batch.filter(train)), (False, batch.filter(pc.invert(train)))):
            for part, body, offs in text_blocks([own]):
                n_rows += part.num_rows if trained else 0
                framed, first = _framed(body, offs)
                found = [((GRAM, trained), _grams(framed, _coded(offs, first)))]
                if trained:
                    found.append(((WORD, True), _word_keys(body, offs)[0]))
                for kind, values in found:
                    key, n = np.unique(values, return_counts=True)
                    keys[kind].append(key)
                    counts[kind].append(n)
                    held[kind] += len(key)
                    if held[kind] > GATHER:
                        key, n = _summed(keys[kind], counts[kind])
                        keys[kind], counts[kind], held[kind] = [key], [n], 0
    if n_rows:
        keys[WORD, True].append(np.array([END], np.int64))
        counts[WORD, True].append(np.array([n_rows]))
    for kind in kinds:
        if keys[kind]:
            key, n = _summed(keys[kind], counts[kind])
            for k in range(0, len(key), 100_000):
                some = n[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind[0], np.int8)), pa.array(key[k : k + 100_000]), pa.array(some * kind[1]), pa.array(some)], names=["kind", "key", "n", "m"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series from 8 on; smaller arguments (0.5 or more) are shifted there."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv * (1 / 1260 - inv * inv / 1680))) - shift


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def _weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability of nodes whose children's (as logs) add up to ``below``, and the estimate's share of it."""
    estimate = kt_block(zeros, ones)
    weighted = np.logaddexp(estimate, below) - np.log(2)
    return weighted, np.exp(estimate - np.log(2) - weighted)


class _Level:
    """Decisions at contexts of three and four bytes, from grams (by context of three bytes, then by number) and their counts."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        byte, bits = gram & 255, np.arange(8)
        place = (1 << bits) | (byte[:, None] >> (8 - bits))
        self.bit = byte[:, None] >> (7 - bits) & 1
        four, three = gram >> 8, gram >> 8 & 0xFFFFFF
        new = lambda x: np.cumsum(np.append(0, x[1:] != x[:-1])) if len(x) else x
        deep, at = np.unique((new(four)[:, None] * 256 + place).ravel(), return_inverse=True)
        self.at = at.reshape(-1, 8)
        weight = np.repeat(n.astype(np.float64), 8)
        ones = np.bincount(at, weights=weight * self.bit.ravel(), minlength=len(deep))
        zeros = np.bincount(at, weights=weight, minlength=len(deep)) - ones
        self.p4 = (ones + 0.5) / (zeros + ones + 1)
        # a decision at a context of four bytes: the one at its last three, and that at its last two
        over, up = np.zeros(len(deep), np.int64), np.zeros(len(deep), np.int64)
        over[at] = (new(three)[:, None] * 256 + place).ravel()
        up[at] = ((three[:, None] & 0xFFFF) * 256 + place).ravel()
        own, first, self.up = np.unique(over, return_index=True, return_inverse=True)
        self.key = up[first]
        total = lambda x: np.bincount(self.up, weights=x, minlength=len(own))
        self.zeros, self.ones = total(zeros), total(ones)
        self.weighted, self.stop = _weigh(self.zeros, self.ones, total(kt_block(zeros, ones)))

    def log10(self, keys: np.ndarray, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of each gram, from what contexts of two bytes (``keys``) have mixed and pass on."""
        k = np.searchsorted(keys, self.key)
        p1 = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        p = (mixed[k] + left[k] * self.stop * p1)[self.up] + (left[k] * (1 - self.stop))[self.up] * self.p4
        return np.where(self.bit, np.log10(p)[self.at], np.log10(1 - p)[self.at]).sum(1)


def _levels(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams, ``n`` and ``m`` of whole contexts of three bytes, from rows sorted by these and by gram."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "m")))
        size += batch.num_rows
        if size >= LEVEL_ROWS:
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            three = rows[0] >> 8 & 0xFFFFFF
            end = int(np.flatnonzero(three != three[-1])[-1]) + 1 if (three != three[-1]).any() else 0
            if end:
                yield tuple(x[:end] for x in rows)
            held = [tuple(x[end:] for x in rows)]
            size = len(rows[0]) - end
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What contexts of three bytes give to each decision at one of two bytes."""
    for gram, n, _ in _levels(batches):
        level = _Level(gram, n)
        key, at = np.unique(level.key, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(at, weights=x, minlength=len(key))) for x in (level.zeros, level.ones, level.weighted))], names=["key", "zeros", "ones", "below"])


def _mix(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is mixed at each decision of contexts of two bytes, and what these pass on."""
    levels, ups = [], []
    for d in (2, 1, 0):
        weighted, stop = _weigh(zeros, ones, below)
        levels.append((stop, (ones + 0.5) / (zeros + ones + 1)))
        if d:
            key, up = np.unique(key & ((1 << 8 * d) - 1), return_inverse=True)  # a context's oldest byte goes, its decision stays
            ups.append(up)
            zeros, ones, below = (np.bincount(up, weights=x, minlength=len(key)) for x in (zeros, ones, weighted))
    mixed, left = np.zeros(len(key)), np.ones(len(key))
    for (stop, p1), up in zip(levels[::-1], [np.arange(len(key)), *ups[::-1]], strict=True):
        mixed, left = mixed[up] + left[up] * stop * p1, left[up] * (1 - stop)
    return mixed, left


def gram_table(counts: DataFrame) -> DataFrame:
    """``key, m, log10`` of each gram of ``counts`` (``key, n, m``): the log-probability of its byte after its context, in the tree of all ``n``."""
    by = F.shiftright("key", 8).bitwiseAND(0xFFFFFF)
    dealt = counts.repartition(by).sortWithinPartitions(by, "key")
    short = cut(dealt.mapInArrow(_short, "key long, zeros double, ones double, below double"), "short")
    rows = short.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    key, *values = (rows.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
    order = np.argsort(key)
    key = key[order]
    sent = counts.sparkSession.sparkContext.broadcast((key, *_mix(key, *(x[order] for x in values))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, m in _levels(batches):
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(m), pa.array(_Level(gram, n).log10(*sent.value))], names=["key", "m", "log10"])

    return cut(dealt.mapInArrow(run, "key long, m long, log10 double"), "tree")


def _most(grams: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and log-probabilities of the most frequent grams, ``limit`` at most; counts are told apart by eighths of a power of two."""
    step = F.floor(F.log2("m") * 8).cast("int")
    left, least = limit, 1 << 30
    for b, n in sorted(((r.b, r["count"]) for r in grams.groupBy(step.alias("b")).count().collect()), reverse=True):
        if n > left:
            break
        left, least = left - n, b
    top = grams.where(step >= least).toArrow()
    key, log10 = top.column("key").to_numpy(), top.column("log10").to_numpy()
    order = np.argsort(key)
    return key[order], log10[order]


def _found(key: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted keys, and their values (else 0)."""
    if not len(key):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    there = key[place] == wanted
    return there, np.where(there, values[place], 0.0)


def _lists(row: np.ndarray, key: np.ndarray, rows: int) -> list[pa.ListArray]:
    """Of each row its keys, each once, and how often they occur."""
    order = np.lexsort([key, row])
    r, w = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(r)))
    cuts = np.searchsorted(r[head], np.arange(rows + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(w[head]), pa.array(times, pa.int64()))]


def _vocabulary(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent words: all with at least the smallest power of two that leaves ``limit`` of them."""
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()
    left, least = limit, 64
    for b, n in sorted(((r.b, r["count"]) for r in steps), reverse=True):
        if n > left:
            break
        left, least = left - n, b
    top = counts.where(F.col("n") >= F.lit(1 << least if least < 63 else (1 << 63) - 1)).toArrow()
    key, n = top.column("key").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def language_model_scores(docs: DataFrame, vocabulary: int = VOCABULARY, grams: int = GRAMS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of each row of ``docs``.

    ``bits_per_byte`` is the code length in bits over the bytes coded, the end byte among these.
    Rows whose crc32(doc_id) mod 7 is 2 are held out, as are rows with a null
    doc_id (their ``held_out`` is false).  A null text counts as empty, which has
    the end token and the end byte alone.  Without training texts all counts are
    zero.  Repeated rows are scored each by itself.
    """
    spark = docs.sparkSession
    train = F.coalesce(remainder("doc_id", 7) != 2, F.lit(False))
    seen = docs.select(train.alias("train"), "text").mapInArrow(_count, "kind byte, key long, n long, m long")
    counts = cut(seen.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    tree = gram_table(counts.where(F.col("kind") == GRAM).select("key", "n", "m"))
    gram, log10 = _most(tree, grams)
    vocab = counts.where(F.col("kind") == WORD).select("key", "n")
    tokens, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    key, n = _vocabulary(vocab, vocabulary)
    ends = vocab.where(F.col("key") == END).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    sent = spark.sparkContext.broadcast((gram, log10, key, np.log10(n + 1.0)))
    bottom = float(np.log10(tokens + distinct + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, log10, key, gain = sent.value
        for part, body, offs in text_blocks(batches):
            rows = part.num_rows
            framed, first = _framed(body, offs)
            coded = _grams(framed, _coded(offs, first))
            length = np.diff(offs) + 1
            sure, code = _found(gram, log10, coded)
            code = np.add.reduceat(code, np.cumsum(length) - length)
            rare = np.flatnonzero(~sure)
            lists = _lists(np.searchsorted(np.cumsum(length), rare, side="right"), coded[rare], rows)
            h, row = _word_keys(body, offs)
            size = np.bincount(row, minlength=rows)
            each, of = np.unique(h, return_inverse=True)
            there, gains = _found(key, gain, each)
            known = np.bincount(row, weights=there[of], minlength=rows).astype(np.int64)
            base = np.bincount(row, weights=gains[of], minlength=rows)
            rare = np.flatnonzero(~there[of])
            lists += _lists(row[rare], h[rare], rows)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(size + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(code, pa.float64()), pa.array(length), *lists], names=["row", "doc_id", "n_tokens", "known", "base", "score", "coded", "grams", "gram_times", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = cut(numbered.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, base double, score double, coded long, grams array<long>, gram_times array<long>, rare array<long>, times array<long>"), "scored")

    def met(kind: int, keys: str, times: str) -> DataFrame:
        return parts.select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("w")).select("row", F.lit(kind).alias("kind"), "w.key", "w.times")

    values = vocab.select(F.lit(WORD).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value")).unionByName(tree.select(F.lit(GRAM).alias("kind"), "key", F.col("log10").alias("value")))
    terms = met(GRAM, "grams", "gram_times").unionByName(met(WORD, "rare", "times")).join(values, ["kind", "key"])
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    gained = F.col("times") * F.col("value")
    counted = terms.groupBy("row").agg(of(WORD, F.col("times")).alias("more"), of(WORD, gained).alias("gain"), of(GRAM, gained).alias("code"))
    score = F.col("score") + F.coalesce("code", F.lit(0.0))
    return parts.join(counted, "row", "left").select(
        "doc_id",
        F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        score.alias("score"),
        (score * F.lit(-float(np.log2(10))) / F.col("coded")).alias("bits_per_byte"),
    )
