"""Token ids of the ``tokenizers`` library at the speed of a dictionary.

Both public byte-level vocabularies split a text by a pattern before they merge,
and merge each part by itself.  :class:`Encoder` applies the same pattern with
``re`` and asks the library's model only for parts that it has not met, so that
the ids of a text are looked up and gathered.  Texts with characters beyond
U+012F or control characters, on which ``re`` and the library might disagree,
texts that hold an added token's string, and vocabularies with any other set-up go through the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np

from .common import ragged

#: Parts that a worker remembers, and ids of them, before it starts anew.
MAX_PARTS, MAX_IDS = 200_000, 4_000_000

#: The characters of texts that are split here, and their letters and digits.
SAFE = re.compile("[\t-\r -~¡-¬®-į]*")
LETTER = "A-Za-zªµºÀ-ÖØ-öø-į"
DIGIT = "0-9²³¹¼-¾"
#: The patterns of the two set-ups, over those characters.
WITH_BLANK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
NO_BLANK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+")


@cache
def byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary has for each byte: itself if printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


def _setup(spec: dict) -> tuple[re.Pattern | None, bool]:
    """The pattern that splits texts, and whether they are lower-cased; None for a set-up that isn't known."""
    normal, split = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        return None, False
    plain = lambda x: x.get("type") == "ByteLevel" and not x.get("add_prefix_space")
    if normal is None and plain(split) and split.get("use_regex", True):
        return WITH_BLANK, False
    parts = split.get("pretokenizers", [])
    wanted = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if [x.get("type") for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("pattern") == {"Regex": wanted} and parts[0].get("invert") and plain(parts[1]):
        return NO_BLANK, True
    return None, False


class _Parts(dict):
    """Places in ``first`` of the parts met so far; each part's ids are ``ids[first[place]:first[place + 1]]``."""

    def __init__(self, model, end: int) -> None:
        self.model, self.end = model, end
        self.letters = byte_letters()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.first = array("I", [self.end]), array("q", [0, 1])  # place 0: the end id

    def add(self, ids) -> int:
        self.ids.extend(ids)
        self.first.append(len(self.ids))
        return len(self.first) - 2

    def __missing__(self, part: str) -> int:
        self[part] = place = self.add([t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))])
        return place


class Encoder:
    """``encode`` gives the ids of texts, each followed by ``end``.

    With ``special_text`` the strings of added tokens are ordinary text; without
    it they get their ids, as the library does it on its own.
    """

    def __init__(self, path: str, end: int, special_text: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern, self.lower = _setup(spec)
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"] and not (special_text and t.get("special"))]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.parts = _Parts(self.library.model, end)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has (end included)."""
        parts = self.parts
        if len(parts) > MAX_PARTS or len(parts.ids) > MAX_IDS:
            parts.reset()
        places, counts = array("q"), array("q")
        for text in texts:
            before = len(places)
            if self.pattern and SAFE.fullmatch(text) and not (self.added and self.added.search(text)):
                places.extend(map(parts.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))
            elif text:
                places.append(parts.add(self.library.encode(text, add_special_tokens=False).ids))
            places.append(0)
            counts.append(len(places) - before)
        place, first = np.frombuffer(places, np.int64), np.frombuffer(parts.first, np.int64)
        length = first[place + 1] - first[place]
        ids = np.frombuffer(parts.ids, np.uint32)[ragged(first[place], length)]
        ends = np.cumsum(np.frombuffer(counts, np.int64))
        return ids, np.diff(np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], ends])]).astype(np.int64)


@cache
def encoder(path: str, end: int) -> Encoder:
    """One encoder a worker for each file and end id, with added tokens as the library has them."""
    return Encoder(path, end, special_text=False)
