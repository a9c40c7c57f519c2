"""Quality classifier: naive Bayes features for a support-vector machine.

A text's n-grams are indicators: single words and pairs of words, and runs of
one to three word shapes (letter case, digits, marks, whether a word repeats
the one before).  They are hashed to ``SLOTS`` places.  Each place is scaled by
the log ratio of its counts in the two classes (Wang and Manning, 2012), which
all labelled training rows give, and a linear hinge-loss model is fit to the
scaled indicators by dual coordinate descent (Hsieh et al., 2008) on a bounded
sample.  A logistic curve over held-back margins of that sample makes the
margin a score from 0 to 1.

The fit runs in one task over flat arrays of the sample's places; the driver gets
vectors of ``SLOTS`` numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, cut, mix64, remainder, text_blocks, words
from .vectors import collect_sums
from .vectors import rows as vector_rows

SLOTS = 1 << 18
#: Labelled rows that the hinge-loss model is fit on, about, and places that these may have together (128 MB); the counts come from all.
SAMPLE, SAMPLE_PLACES = 20_000, 32_000_000
#: Text bytes that a kernel works on at once.
BLOCK = 2 << 20
THRESHOLD = 0.7
ALPHA, COST, EPOCHS = 1.0, 1.0, 12

_R = np.uint64(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial."""
    with np.errstate(over="ignore"):
        power = np.empty(len(body) + 1, np.uint64)
        power[0] = 1
        power[1:] = _R
        power = np.cumprod(power, dtype=np.uint64)
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        back = np.empty(len(body) + 1, np.uint64)
        back[0] = 1
        back[1:] = inverse
        back = np.cumprod(back, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[body] * power[:-1], dtype=np.uint64)])
        return mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def _classes() -> np.ndarray:
    """0 lower-case, 1 upper-case, 2 digit, 3 mark, 4 beyond ASCII, 5 blank or control."""
    out = np.full(256, 3, np.uint8)
    out[:33] = out[127] = 5
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 4
    return out


CLASSES = _classes()


def shapes(body: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A small code of each word's shape: which classes it has and roughly how many marks, and whether it repeats the word before."""
    kind = CLASSES[body]
    code = np.zeros(len(start), np.int64)
    for k, most in ((0, 1), (1, 2), (2, 1), (3, 3), (4, 1), (5, 1)):
        before = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        code = code * (most + 1) + np.minimum(before[end] - before[start], most)
    again = np.zeros(len(start), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    return code * 2 + again


def indicators(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each text's distinct n-grams."""
    start, end, row = words(body, offs)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes(LOWER[body], start, end)
    shape = mix64(shapes(body, start, end, h, row).astype(np.uint64) + np.uint64(1 << 32))
    found = [(row, h), (row, shape)]
    two = np.flatnonzero(row[1:] == row[:-1])
    three = np.flatnonzero(row[2:] == row[:-2])
    with np.errstate(over="ignore"):
        found.append((row[two], h[two] * np.uint64(3) + h[two + 1] * np.uint64(0xBF58476D1CE4E5B9)))
        pair = shape[two] * np.uint64(5) + shape[two + 1] * np.uint64(0x94D049BB133111EB)
        found.append((row[two], pair))
        found.append((row[three], shape[three] * np.uint64(7) + shape[three + 1] * np.uint64(0xBF58476D1CE4E5B9) + shape[three + 2] * np.uint64(0x94D049BB133111EB)))
        key = np.unique(np.concatenate([(r.astype(np.int64) * SLOTS) | (mix64(x) & np.uint64(SLOTS - 1)).astype(np.int64) for r, x in found]))
    return key // SLOTS, key % SLOTS


@dataclass
class Model:
    """Weight of each place (ratio and hinge weights multiplied), and the logistic curve over margins."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, row: np.ndarray, place: np.ndarray, n: int, norm: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.bincount(row, weights=norm[place] ** 2, minlength=n))
        return np.bincount(row, weights=self.weight[place], minlength=n) / np.maximum(size, 1e-9) + self.bias


def log_ratio(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """log of the share of each place among the good class's indicators over that among the bad one's."""
    p, q = good + ALPHA, bad + ALPHA
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(places: np.ndarray, ends: np.ndarray, rows: np.ndarray, y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on unit-length rows.

    Row i's places are ``places[ends[i]:ends[i + 1]]``; the model is fit to ``rows``.
    Classes count alike: each row's bound is its class's share inverted.
    """
    w, b = np.zeros(len(ratio)), 0.0
    size = np.array([np.sqrt((ratio[places[ends[i] : ends[i + 1]]] ** 2).sum()) for i in rows])
    alpha = np.zeros(len(rows))
    sign = y[rows]
    share = {s: max(1, int((sign == s).sum())) for s in (-1, 1)}
    upper = np.array([cost * len(rows) / (2 * share[int(s)]) for s in sign])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(rows)):
            i, s = rows[k], sign[k]
            p = places[ends[i] : ends[i + 1]]
            v = ratio[p] / max(1e-9, size[k])
            gradient = s * (float(w[p] @ v) + b) - 1.0
            if (alpha[k] == 0 and gradient >= 0) or (alpha[k] == upper[k] and gradient <= 0):
                continue
            most = max(most, abs(gradient))
            new = min(max(alpha[k] - gradient / 2.0, 0.0), upper[k])  # unit row and the bias's 1: curvature 2
            step = (new - alpha[k]) * s
            alpha[k] = new
            w[p] += step * v
            b += step
        if most < 0.05:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps; labels are smoothed as Platt (1999) does."""
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -35, 35)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, c = a - float(step[0]), c - float(step[1])
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-6), c


def _learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {0: np.zeros(SLOTS, np.int64), 1: np.zeros(SLOTS, np.int64)}
    none = pa.array([None], pa.int64())
    for part, body, offs in text_blocks(batches, limit=BLOCK):
        row, place = indicators(body, offs)
        y = part.column("y").to_numpy(zero_copy_only=False)
        pick = part.column("pick").to_numpy(zero_copy_only=False)
        for c in (0, 1):
            counts[c] += np.bincount(place[y[row] == c], minlength=SLOTS)
        ends = np.searchsorted(row, np.arange(len(y) + 1))
        for k in np.flatnonzero(pick):
            yield pa.RecordBatch.from_arrays([pa.array([f"row{y[k]}"]), pa.array([0], pa.int32()), part.column("order").slice(k, 1), pa.array([place[ends[k] : ends[k + 1]].astype("<i4").tobytes()], pa.binary())], names=["kind", "piece", "order", "counts"])
    for c in (0, 1):
        for out in vector_rows(f"class{c}", counts[c]):
            yield pa.RecordBatch.from_arrays([out.column("kind"), out.column("piece"), none, out.column("counts")], names=["kind", "piece", "order", "counts"])


def _fit(sent, limit: int):
    """A task that fits the model to the sample's rows, which come in a fixed order, ``limit`` places of them at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        held, sizes, y, total = [], [], [], 0
        for batch in batches:
            for kind, place in zip(batch.column("kind").to_pylist(), batch.column("counts"), strict=True):
                own = np.frombuffer(place.as_buffer(), "<i4")
                if total + len(own) > limit:
                    continue
                held.append(own.copy())
                sizes.append(len(own))
                y.append(1 if kind == "row1" else -1)
                total += len(own)
        model = fit(np.concatenate([np.zeros(0, np.int32), *held]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(y), ratio)
        numbers = np.array([model.bias, model.slope, model.shift])
        yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary()), pa.array([model.weight.tobytes()], pa.binary())], names=["numbers", "weight"])

    return run


def fit(places: np.ndarray, ends: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> Model:
    """The model from rows of places and their classes (1, -1); the share of class 1 if there is but one class (no rows: a half)."""
    if not (y > 0).any() or not (y < 0).any():
        p = min(max(float((y > 0).mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(len(ratio)), 0.0, 1.0, float(np.log(p / (1 - p))))
    back = np.random.default_rng(11).random(len(y)) < 0.25  # rows whose margins shape the curve
    if not all(((y == s) & back).any() and ((y == s) & ~back).any() for s in (-1, 1)):
        back = np.zeros(len(y), bool)
    w, b = dual_descent(places, ends, np.flatnonzero(~back), y, ratio)
    model = Model(w * ratio, b, 1.0, 0.0)
    held = np.flatnonzero(back) if back.any() else np.arange(len(y))
    margin = np.array([model.margins(np.zeros(ends[i + 1] - ends[i], np.int64), places[ends[i] : ends[i + 1]], 1, ratio)[0] for i in held])
    model.slope, model.shift = logistic(margin, y[held])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_places: int = SAMPLE_PLACES) -> tuple[Model, np.ndarray]:
    """The model and the ratios.  ``docs`` and ``labels`` (``doc_id``, ``quality``) are joined on doc_id.

    Labels that are null don't count; of several labels of a document the
    majority does (a tie: 1).  Without labels of both classes the score is the
    share of label 1 (no labels: 0.5).  The hinge-loss model is fit to about
    ``sample`` labelled rows drawn by a hash of their id; a row that would bring
    these beyond ``sample_places`` places is passed over.
    """
    spark = docs.sparkSession
    marks = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    marks = cut(marks, "labels")
    share = min(1.0, sample / max(1, marks.count()))
    order = F.xxhash64("doc_id", F.lit("sample"))
    picked = F.pmod(order, F.lit(1 << 40)) < int(share * (1 << 40))
    # labels grow with the documents, so both sides are shuffled at every size
    rows = docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id").select("text", "y", picked.alias("pick"), order.alias("order"))
    learned = cut(rows.mapInArrow(_learn, "kind string, piece int, order long, counts binary"), "quality")
    sums = collect_sums(learned.where("kind LIKE 'class%'").drop("order"), SLOTS)
    good, bad = (sums.get(k, np.zeros(SLOTS, np.int64)) for k in ("class1", "class0"))
    ratio = log_ratio(good, bad)
    chosen = learned.where("kind LIKE 'row%'").select("kind", "order", "counts").repartition(1).sortWithinPartitions("order", "kind", "counts")
    made = chosen.mapInArrow(_fit(spark.sparkContext.broadcast(ratio), sample_places), "numbers binary, weight binary").first()
    if made is None:
        return fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), ratio), ratio
    bias, slope, shift = np.frombuffer(made.numbers)
    return Model(np.frombuffer(made.weight), float(bias), float(slope), float(shift)), ratio


def score(docs: DataFrame, model: Model, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` with ``score`` and ``predicted`` (columns of these names are replaced); a text without words is scored by the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model, ratio))  # two vectors of SLOTS numbers
    docs = docs.drop("score", "predicted")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ratio = sent.value
        for part, body, offs in text_blocks(batches, limit=BLOCK):
            row, place = indicators(body, offs)
            margin = model.margins(row, place, part.num_rows, ratio)
            p = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -35, 35)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Rows whose crc32(doc_id) mod 4 is 2 are held out and never learned from; a
    null doc_id is neither held out nor learned from.  A null text counts as
    empty.  Only the text makes the score; other columns of either table are
    not looked at.
    """
    model, ratio = train(docs.where(remainder("doc_id", 4) != 2), labels.where(remainder("doc_id", 4) != 2).select("doc_id", "quality"), sample)
    return score(docs.select("doc_id", "text"), model, ratio).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
