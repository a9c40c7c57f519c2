"""Language identification with spans.

Texts are looked at as code points.  A word is a run of letters; the script
range of its first letter narrows the candidates to the languages that were
learned with that script.  Each word has a score for each language, the mean
over n-gram orders of its log-likelihood, and a Viterbi pass over the words,
with a penalty for each switch, labels spans of one language.  The text's
language is the one whose spans hold most letters.

The model is counts of hashed character n-grams for each language, over all
training texts; its size is fixed by ``SLOTS`` and the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, ragged, remainder, text_blocks
from .vectors import collect_sums
from .vectors import rows as vector_rows

SLOTS, ORDERS, SMOOTH = 1 << 16, 4, 0.5
SWITCH = 12.0
UNKNOWN = "und"
BLOCK = 8 << 20
#: Share of a language's words from which their script makes it a candidate.
SCRIPT_SHARE = 1e-3
#: First code points of script ranges; what lies between ranges belongs to the one before.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
NAMES = tuple(sorted({n for _, n in SCRIPTS}))
LENGTH = SLOTS * ORDERS + 64


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower-case form if that is one code point."""
    is_letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            is_letter[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return is_letter, lower


@cache
def _script_of() -> tuple[np.ndarray, np.ndarray]:
    return np.array([a for a, _ in SCRIPTS], np.uint32), np.array([NAMES.index(n) for _, n in SCRIPTS])


@dataclass
class Words:
    """The words of a block: place and length in code points, row, and which distinct word each is."""

    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    distinct: np.ndarray
    #: Of the distinct words: an example's place in the block's letters, length, script.
    example: np.ndarray
    size: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    #: Code points before each row.
    heads: np.ndarray


def _words(body: np.ndarray, offs: np.ndarray) -> Words:
    is_letter, lower = _letters()
    text = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    heads = lead[offs]
    low = lower[text]
    inside = is_letter[text]
    first, last = inside.copy(), inside.copy()
    if len(text):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        a = heads[:-1][heads[:-1] < len(text)]
        first[a] = inside[a]
        z = heads[1:][heads[1:] > 0] - 1
        last[z] = inside[z]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    length = end - start
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, none, none, low, heads)
    with np.errstate(over="ignore"):
        r = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(low), r)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(low), np.uint64(pow(int(r), -1, 1 << 64)))]), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(low.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        h = mix64((sums[end] - sums[start]) * back[start] + length.astype(np.uint64))
    _, example, distinct = np.unique(h, return_index=True, return_inverse=True)
    ranges, kinds = _script_of()
    script = kinds[np.searchsorted(ranges, low[start[example]], side="right") - 1]
    return Words(start, length, np.searchsorted(heads, start, side="right") - 1, distinct, start[example], length[example], script, low, heads)


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word and slot of each of its n-grams, of orders 1 to ``ORDERS``, with a blank at either end."""
    size = w.size + 2
    at = np.repeat(np.cumsum(size) - size, w.size) + 1 + ragged(np.zeros(len(size), np.int64), w.size)
    padded = np.full(int(size.sum()), 32, np.uint64)
    padded[at] = w.letters[ragged(w.example, w.size)]
    owner = np.repeat(np.arange(len(size)), size)
    words, slots = [], []
    h = np.zeros(len(padded), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDERS + 1):
            h = (h[: len(padded) - n + 1] * np.uint64(0x100000001B3)) + mix64(padded[n - 1 :] + np.uint64(n)) if n > 1 else mix64(padded + np.uint64(1))
            own = owner[: len(padded) - n + 1]
            whole = own == owner[n - 1 :]
            words.append(own[whole])
            slots.append((n - 1) * SLOTS + (mix64(h[whole]) & np.uint64(SLOTS - 1)).astype(np.int64))
    return np.concatenate(words), np.concatenate(slots)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for part, body, offs in text_blocks(batches, limit=BLOCK):
        w = _words(body, offs)
        if not len(w.start):
            continue
        word, slot = _grams(w)
        langs = part.column("lang").dictionary_encode()
        code = langs.indices.to_numpy()[w.row]
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            times = np.bincount(w.distinct[code == k], minlength=len(w.size))
            vector = counts.setdefault(lang, np.zeros(LENGTH, np.int64))
            vector[: SLOTS * ORDERS] += np.bincount(slot, weights=times[word], minlength=SLOTS * ORDERS).astype(np.int64)
            vector[SLOTS * ORDERS :] += np.bincount(w.script, weights=times, minlength=64).astype(np.int64)
    for lang, vector in counts.items():
        yield from vector_rows(lang, vector)


@dataclass
class Model:
    languages: list[str]
    #: Log-likelihood of each slot, languages across.
    loglike: np.ndarray
    #: Whether each language is a candidate for each script.
    allowed: np.ndarray


def train(docs: DataFrame) -> Model:
    """Counts over all rows of ``docs`` (``text``, ``lang``); rows with a null lang don't count."""
    parts = cut(docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "kind string, piece int, counts binary"), "ngrams")
    sums = collect_sums(parts, LENGTH)
    languages = sorted(sums)
    loglike = np.zeros((SLOTS * ORDERS, max(1, len(languages))), np.float32)
    allowed = np.zeros((64, max(1, len(languages))), bool)
    for k, lang in enumerate(languages):
        for n in range(ORDERS):
            c = sums[lang][n * SLOTS : (n + 1) * SLOTS] + SMOOTH
            loglike[n * SLOTS : (n + 1) * SLOTS, k] = np.log(c / c.sum()) / ORDERS
        seen = sums[lang][SLOTS * ORDERS :]
        allowed[:, k] = seen > SCRIPT_SHARE * max(1, seen.sum())
    allowed[~allowed.any(1)] = True  # a script that no language was learned with: all are candidates
    return Model(languages, loglike, allowed)


def viterbi(scores: np.ndarray, row: np.ndarray, n_rows: int, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word.  ``scores``: words by languages, rows in order.

    All rows go forward and back side by side, the longest first.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    count, first = count[order], first[order]
    steps = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(steps), side="left")  # rows with more than t words
    wide = scores.shape[1]
    best = np.zeros((n_rows, wide), np.float32)
    came = np.zeros(scores.shape, np.int8 if wide < 128 else np.int16)
    own = np.arange(wide, dtype=came.dtype)
    for t in range(steps):
        n = active[t]
        at = first[:n] + t
        v = best[:n]
        if t:
            top = v.argmax(1)
            bar = v[np.arange(n), top][:, None] - penalty
            switch = v < bar
            came[at] = np.where(switch, top[:, None], own)
            v = np.where(switch, bar, v)
        best[:n] = v + scores[at]
        best[:n] -= best[:n].max(1, keepdims=True)
    label = np.zeros(len(scores), came.dtype)
    state = best.argmax(1).astype(came.dtype)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        label[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return label


def _labels(w: Words, model: Model, n_rows: int) -> np.ndarray:
    word, slot = _grams(w)
    wide = len(model.languages)
    # n-grams of a word are not adjacent (orders come one after the other): sum by language
    score = np.stack([np.bincount(word, weights=model.loglike[slot, k], minlength=len(w.size)) for k in range(wide)], 1).astype(np.float32)
    score[~model.allowed[w.script]] -= 1000.0
    return viterbi(score[w.distinct], w.row, n_rows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row: the language with most letters (a tie: the first by name) and its share of them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        for part, body, offs in text_blocks(batches, limit=BLOCK):
            n = part.num_rows
            w = _words(body, offs)
            share = np.zeros(n)
            best = np.full(n, len(names) - 1)
            if len(w.start) and model.languages:
                label = _labels(w, model, n)
                letters = np.bincount(w.row * len(model.languages) + label, weights=w.length, minlength=n * len(model.languages)).reshape(n, -1)
                total = letters.sum(1)
                best = np.where(total > 0, letters.argmax(1), best)
                share = letters.max(1) / np.maximum(1, total)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, start, end, lang`` of each span (code points), from its first word to its last; rows without letters have none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array(model.languages, object)
        for part, body, offs in text_blocks(batches, limit=BLOCK):
            w = _words(body, offs)
            if not len(w.start) or not len(names):
                continue
            label = _labels(w, model, part.num_rows)
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (w.row[1:] != w.row[:-1])
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(label)) - 1
            head = w.heads[w.row[a]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(w.row[a])), pa.array(w.start[a] - head), pa.array(w.start[z] + w.length[z] - head), pa.array(names[label[a]], pa.string())], names=["doc_id", "start", "end", "lang"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, lang string")


def language_predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row of ``docs``.

    Rows whose crc32(doc_id) mod 3 is 1 are held out; rows with a null doc_id
    or lang aren't learned from.  A text that is null or has no letter, or any
    text if nothing was learned, is ``und`` with score 0.
    """
    model = train(docs.where(remainder("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
