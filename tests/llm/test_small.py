"""Kernels of the training-data operators against plain versions, without Spark."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriframe.llm import ctw, language, linededup, media, packing, quality, simhash, tiling, tokens, urlfilter
from veriframe.llm.common import raw_text, text_blocks, words

TEXTS = st.lists(st.text(max_size=40), max_size=8)


def raw(texts):
    return raw_text(pa.array(texts, pa.large_string()))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_equal_a_pattern(texts):
    import re

    body, offs = raw(texts)
    start, end, row = words(body, offs)
    got = [(r, bytes(body[a:b])) for a, b, r in zip(start, end, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]


def test_blocks_hold_every_row_and_one_long_text():
    batch = pa.record_batch({"text": ["a" * 50, None, "", "b" * 500, "c"]})
    sizes = [p.num_rows for p, _, _ in text_blocks([batch], limit=60)]
    assert sum(sizes) == 5 and b"".join(b.tobytes() for _, b, _ in text_blocks([batch], limit=60)) == b"a" * 50 + b"b" * 500 + b"c"


def payload(b: bytes) -> np.ndarray:
    out = np.zeros(max(64, -(-len(b) // 64) * 64), np.uint8)
    out[: len(b)] = np.frombuffer(b, np.uint8)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=4))
def test_jpeg_payload_round_trip(blobs):
    given_ = [payload(b) for b in blobs]
    files = media.store_payload(given_)
    images, coef = media.read_coefficients(files)
    assert all(np.array_equal(media.read_payload(i, coef), p) for i, p in zip(images, given_))
    assert [media.features(media.rgb(i, coef)) for i in images] == [media.features(t) for f in files for t in media.decode([f])]


def test_jpeg_wide_image_and_broken_files():
    big = np.random.default_rng(1).integers(0, 256, 64 * 6 * 4100, dtype=np.uint8)
    images, coef = media.read_coefficients(media.store_payload([big]))
    assert images[0].width == 32 and np.array_equal(media.read_payload(images[0], coef), big)
    for bad in (b"", b"\xff\xd8", b"\xff\xd8\xff\xc0\x00\x0b\x08\0\1\0\1\1\1\x11\0\xff\xd9", media.store_payload([payload(b"x")])[0][:200]):
        with pytest.raises((ValueError, IndexError)):
            media.decode([bad])


def test_golay_keys_meet_within_four_bits():
    syndrome, errors, count = simhash.golay()
    assert np.bincount(count)[[1, 6]].tolist() == [277, 1771]
    rng = random.Random(2)
    for d in range(5):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), d):
                b ^= 1 << k
            at, key = simhash.golay_keys(np.array([a, b], np.uint64))
            assert set(key[at == 0]) & set(key[at == 1])


def test_fingerprint_plain():
    import xxhash

    texts = ["", "One two", "A b c d e f g a b c d", "ÄÖ x\ty\nz  w", None]
    got = simhash.fingerprints(*raw(texts))
    for t, f in zip(texts, got):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sh = [" ".join(w[i : i + 4]).encode() for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        assert int(f) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_in_a_key_keep_what_is_connected():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 5, dtype=np.int64)
    fp = np.array([int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 60, (8, 2))], np.int64)
    a, b = simhash._links_in(np.zeros(len(fp), np.int64), fp, 4)
    near = lambda x, y: (int(x) ^ int(y)).bit_count() <= 4
    assert all(near(x, y) for x, y in zip(a, b))

    def groups(pairs):
        parent = {int(x): int(x) for x in fp}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in pairs:
            parent[find(int(x))] = find(int(y))
        return {frozenset(k for k in parent if find(k) == r) for r in map(find, parent)}

    assert groups(zip(a, b)) == groups((x, y) for x, y in itertools.combinations(fp, 2) if near(x, y))


def test_dual_descent_separates_and_curve_rises():
    rng = np.random.default_rng(4)
    good = [np.unique(np.append(rng.integers(0, 50, 6), 100)) for _ in range(60)]
    bad = [np.unique(np.append(rng.integers(0, 50, 6), 101)) for _ in range(20)]
    y = np.array([1] * 60 + [-1] * 20)
    count = lambda rows: np.bincount(np.concatenate(rows), minlength=128)
    ratio = quality.log_ratio(count(good), count(bad))
    ends = np.concatenate([[0], np.cumsum([len(p) for p in [*good, *bad]])])
    w, b = quality.dual_descent(np.concatenate([*good, *bad]), ends, np.arange(len(y)), y, ratio)
    m = np.array([(w * ratio)[p].sum() / np.sqrt((ratio[p] ** 2).sum()) + b for p in [*good, *bad]])
    assert (np.sign(m) == y).all()
    slope, shift = quality.logistic(m, y)
    assert slope > 0 and 0 < 1 / (1 + math.exp(-shift)) < 1


def test_indicators_are_distinct_and_ignore_neighbouring_rows():
    one = quality.indicators(*raw(["a b a b", "c"]))
    two = quality.indicators(*raw(["a b a b"]))
    assert sorted(one[1][one[0] == 0]) == sorted(two[1]) and len(set(two[1])) == len(two[1])
    assert len(quality.indicators(*raw(["", None, " \n"]))[0]) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-9, 0), min_size=3, max_size=3), min_size=1, max_size=6), st.floats(0, 6))
def test_viterbi_equals_trying_all_paths(scores, penalty):
    s = np.array(scores, np.float32)
    label = language.viterbi(s, np.zeros(len(s), np.int64), 1, penalty)
    value = lambda p: sum(float(s[t, x]) for t, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    assert value(label.tolist()) >= max(map(value, itertools.product(range(3), repeat=len(s)))) - 1e-3


def test_viterbi_rows_side_by_side():
    rng = np.random.default_rng(5)
    s = rng.normal(size=(30, 4)).astype(np.float32)
    row = np.repeat([0, 2, 3], [5, 20, 5])
    together = language.viterbi(s, row, 4, 2.0)
    alone = np.concatenate([language.viterbi(s[row == r], np.zeros((row == r).sum(), np.int64), 1, 2.0) for r in (0, 2, 3)])
    assert together.tolist() == alone.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packing_is_valid_and_bounded(lengths):
    x = np.array(lengths, np.int64)
    bound = packing.lower_bound(x, 100)
    if not lengths:
        assert bound == 0
        return
    bins = packing.best_fit(x, 100)
    fill = np.bincount(bins, weights=x)
    assert fill.max() <= 100 and (fill > 0).all() and bound <= len(fill) <= 1.5 * bound + 2


def test_bound_beats_the_sum():
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34, 34, 34, 34]), 100) == 2


def test_encoder_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["", "It's  a test\n\nof 1234 words...", "ÀÉ ünï ß'll ½²", "日本語 text", "\xa0odd\x00ctrl\x1c", "<|endoftext|>", "  lead and trail  ", "é combining", "a\r\n\tb"]
    for name, end in (("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 0)):
        lib = Tokenizer.from_file(P.path(name))
        lib.encode_special_tokens = True
        ids, n = tokens.Encoder(P.path(name), end).encode(texts)
        at = np.cumsum(n) - n
        assert [ids[a : a + k].tolist() for a, k in zip(at, n)] == [e.ids + [end] for e in lib.encode_batch(texts, add_special_tokens=False)]


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("", "/x/", "block"), ("a.b", "", "block"), ("a.b", "/q", "allow"), ("com", "/en/", "allow")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["com", "example", "a", "b", "www", ""]), max_size=3), st.sampled_from(["", "/", "/en/", "/en", "/en/7", "/en/75/x", "/x/y", "/q", "/qq/z"]))
def test_trie_equals_all_rules(labels, path):
    host = ".".join(labels)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    want = max(fits, default=None)
    assert urlfilter.decide(urlfilter.build(RULES), host, path) == ((want[2], want[3]) if want else (None, "allow"))


def plain_tiles(doc, item, least):
    """The longest common run of words that are in no tile, again and again, by trying all places."""
    in_doc, in_item, tiles = set(), set(), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in in_item and b + n not in in_doc:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (b, a, n)
        if best is None:
            return tiles
        b, a, n = best
        in_doc |= set(range(b, b + n))
        in_item |= set(range(a, a + n))
        tiles.append(best)


def test_tiles_take_the_longest_first():
    # runs 0-6 and 4-9 of the item overlap: the longer is a tile, of the other what is left is too short
    item = np.arange(1, 11, dtype=np.uint64)
    doc = np.concatenate([item[:7], np.zeros(13, np.uint64), item[4:10]])
    assert tiling.greedy_tiles(doc, item) == [(0, 0, 7)]
    once = np.full(400, 7, np.uint64)
    assert tiling.greedy_tiles(np.full(20_000, 7, np.uint64), once) == [(0, 0, 400)]


@given(st.lists(st.integers(1, 3), max_size=24), st.lists(st.integers(1, 3), max_size=14), st.integers(1, 5))
def test_tiles_equal_trying_all_places(doc, item, least):
    assert tiling.greedy_tiles(np.array(doc, np.uint64), np.array(item, np.uint64), least) == plain_tiles(doc, item, least)


def test_words_of_scripts_without_blanks():
    h, row = tiling.tokens(*raw(["東京 Tower", "京東x", "a東b"]))
    assert np.bincount(row).tolist() == [3, 3, 3] and h[0] == h[4] == h[7] and h[1] == h[3]


def test_log_gamma_and_kt():
    x = np.array([0.5, 1, 2.5, 7, 30, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    p, a, b = 1.0, 0, 0
    for bit in "0010110":
        p *= ((b if bit == "1" else a) + 0.5) / (a + b + 1)
        a, b = a + (bit == "0"), b + (bit == "1")
    assert float(ctw.kt_block(np.array([a * 1.0]), np.array([b * 1.0]))[0]) == pytest.approx(math.log(p))


def plain_lines(texts):
    out = []
    for r, t in enumerate(texts):
        out += [(r, k, line.lower().strip()) for k, line in enumerate(t.split("\n"))]
    return out


def test_lines_and_their_keys():
    texts = ["  First Line here \n\nsecond line of text\n", "", "FIRST line here\nÄÖÜ äöü ÄÖÜ", "\n", "x\n y "]
    lines = linededup.Lines(*raw(texts))
    got = [(int(r), int(k), lines.string(i)) for i, (r, k) in enumerate(zip(lines.row, lines.number))]
    assert got == plain_lines(texts)
    pick = np.flatnonzero(lines.length >= 10)
    key = dict(zip([got[i] for i in pick], lines.keys(pick).tolist()))
    assert key[0, 0, "first line here"] == key[2, 0, "first line here"] and len(set(key.values())) == 3


def test_similar_lines_share_a_band():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [" ".join(word() for _ in range(40)) for _ in range(100)]
    other = [b + " " + word() for b in base]
    lines = linededup.Lines(*raw([*base, *other]))
    key = linededup.bands(lines, np.arange(200))
    met = sum(bool(set(key[k]) & set(key[100 + k])) for k in range(100))
    assert all(linededup.jaccard(linededup.shingle_set(a), linededup.shingle_set(b)) >= 0.8 for a, b in zip(base, other)) and met == 100
    assert sum(bool(set(key[k]) & set(key[j])) for k, j in itertools.combinations(range(100), 2)) == 0


def test_digest_helpers_agree():
    assert zlib.crc32(b"abc") == 891568578 and len(hashlib.sha256(b"").hexdigest()) == 64


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\u00e9\U0001f600", max_size=60), st.text(alphabet="ab\u00e9\U0001f600", max_size=60), st.sampled_from([1, 2, 3, 8]))
def test_shingle_hashes_are_those_of_the_set(x, y, size):
    size = max(1, min(size, len(x), len(y)))
    a, b = (linededup.shingle_hashes(t, size) for t in (x, y))
    u, v = (linededup.shingle_set(t, size) if t else set() for t in (x, y))
    assert len(a) == len(u) and len(b) == len(v) and (a[1:] > a[:-1]).all()
    if u and v:
        assert linededup.similar(a, b) == (linededup.jaccard(u, v) >= linededup.SIMILARITY)


def test_lines_alike_by_chance_do_not_meet():
    rng = np.random.default_rng(3)
    parts = [*"the an er on in ou ti re nd st ha".split(), *[" "] * 4]
    base = ["ab" + "".join(rng.choice(parts, k)) + "yz" for k in rng.integers(20, 80, 3000)]
    near = [t[:-1] + "x" for t in base[:300]]
    batch = pa.record_batch({"text": ["\n".join(base[k : k + 100]) for k in range(0, 3000, 100)] + ["\n".join(near)]})
    sent = pa.Table.from_batches(linededup._band_rows(4)([batch])).sort_by("number")
    met = pa.Table.from_batches(linededup._met(sent.to_batches()))
    lines = linededup.Lines(*raw([*base, *near]))
    key = lines.keys(np.arange(3300)).tolist()
    pairs = {frozenset(p) for p in zip(met.column("h").to_pylist(), met.column("low").to_pylist())}
    assert all(frozenset((key[k], key[3000 + k])) in pairs for k in range(300))
    assert len(pairs) < 400


def test_close_lines_keep_all_links():
    """Lines x < y < z < w of one bucket, of which x and z, y and w, z and w differ in 15 bits: one group, and each line is with another."""
    h, n = np.arange(4), np.full(4, 60, np.uint8)
    sketch = np.zeros((4, 2), np.uint64)
    sketch[:, 0] = [0, (1 << 45) - 1, (1 << 15) - 1, (1 << 30) - 1]
    key, a, low = linededup.met_in(np.ones(4, np.uint32), h, n, sketch)
    assert len(set(key.tolist())) == 1 and {*a.tolist(), *low.tolist()} == {0, 1, 2, 3}
    assert not len(linededup.met_in(np.ones(2, np.uint32), h[:2], n[:2], sketch[:2])[0])
