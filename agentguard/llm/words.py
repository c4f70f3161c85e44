"""Pre-tokens of the word-level BPE vocabulary, for many texts at once.

The vocabulary file says: NFC, white space as one space, lower case; then contractions, letter
runs, single digits and runs of other signs are words, and white space is dropped. Strings of its
special tokens are taken out of the raw text first. Characters that Python's Unicode tables do
not know are left to the normaliser and splitter of the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

from agentguard.llm.flat import Spans, codes

#: White space of the pattern, and the letters after an apostrophe that make a contraction.
_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT_FORMS = ["s", "t", "re", "ve", "m", "ll", "d"]

SPACE, LETTER, NUMBER, OTHER, SPECIAL, UNKNOWN = 0, 1, 2, 3, 4, 255
_SPECIAL_AT = 0x110000
_SEPARATOR = np.array([0x20], dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=2)
def specials(path: str) -> list[tuple[str, int]]:
    with open(path, encoding="utf-8") as f:
        return [(x["content"], x["id"]) for x in json.load(f)["added_tokens"]]


class Splitter:
    def __init__(self, path: str):
        self.path = path
        self.special = specials(path)
        self.pattern = re.compile("(" + "|".join(re.escape(x) for x, _ in self.special) + ")") if self.special else None
        self.number = {x: k for k, (x, _) in enumerate(self.special)}
        self.kind = np.full(_SPECIAL_AT + max(1, len(self.special)), UNKNOWN, dtype=np.uint8)
        self.kind[_SPECIAL_AT:] = SPECIAL
        self.odd = np.zeros(_SPECIAL_AT, dtype=bool)
        self._learn(np.arange(0x250))

    def _learn(self, points: np.ndarray) -> None:
        for i in points.tolist():
            category = unicodedata.category(chr(i))
            if i in _SPACE:
                kind = SPACE
            elif category == "Cn":
                self.odd[i] = True
                kind = self._ask(chr(i))
            else:
                kind = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
            self.kind[i] = kind

    def _ask(self, sign: str) -> int:
        split = library(self.path).pre_tokenizer.pre_tokenize_str
        if not split(sign):
            return SPACE
        if len(split("a" + sign)) == 1:
            return LETTER
        return NUMBER if len(split(sign + sign)) == 2 else OTHER

    def kinds(self, flat: np.ndarray) -> np.ndarray:
        found = self.kind[flat]
        if (new := found == UNKNOWN).any():
            self._learn(np.unique(flat[new]))
            found = self.kind[flat]
        return found

    def normalise(self, text: str) -> np.ndarray:
        if text.isascii():
            return codes(text.lower())
        raw = codes(text)
        self.kinds(raw)
        if self.odd[raw].any():
            return codes(library(self.path).normalizer.normalize_str(text))
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return codes(text.replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[np.ndarray]:
        if self.pattern is None or not self.pattern.search(text):
            return [self.normalise(text)]
        return [
            np.array([_SPECIAL_AT + self.number[x]], dtype=np.uint32) if x in self.number else self.normalise(x)
            for x in self.pattern.split(text) if x
        ]

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat code points, starts and ends of words, and words per text."""
        parts, ends = [], np.zeros(len(texts), dtype=np.int64)
        at = 0
        for k, text in enumerate(texts):
            for piece in self.pieces(text):
                parts.append(piece)
                at += len(piece)
            parts.append(_SEPARATOR)
            at += 1
            ends[k] = at
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        starts, stops = self.words(flat)
        per_text = np.diff(np.searchsorted(starts, ends, side="left"), prepend=0)
        return flat, starts, stops, per_text

    def words(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(flat):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        kind = self.kinds(flat)
        begin = np.empty(len(flat), dtype=bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin |= (kind == NUMBER) | (kind == SPECIAL)
        lone = np.flatnonzero((flat[:-1] == 39) & begin[:-1] & (kind[1:] == LETTER))
        for form in _SHORT_FORMS:
            at = lone
            for k, letter in enumerate(form):
                at = at[at + 1 + k < len(flat)]
                at = at[flat[at + 1 + k] == ord(letter)]
            if len(at):
                begin[at + 1] = False
                rest = at + 1 + len(form)
                rest = rest[rest < len(flat)]
                begin[rest] = True
                lone = np.setdiff1d(lone, at)
        starts = np.flatnonzero(begin)
        stops = np.append(starts[1:], len(flat))
        real = kind[starts] != SPACE
        return starts[real], stops[real]


@functools.lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


class IdCache:
    """Ids of words by hash, kept between batches of a worker; emptied when it holds `most` words."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)  # ids of any vocabulary; 16 bits would cut those from 65,536 on

    def resolve(self, spans: Spans, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count) of the distinct spans; `encode(words)` gives (ids, counts) of new ones."""
        at = np.searchsorted(self.hashes, spans.unique)
        at[at == len(self.hashes)] = 0
        known = (self.hashes[at] == spans.unique) & (spans.unique != 0) if len(self.hashes) else np.zeros(len(at), dtype=bool)
        start, count = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        start[known], count[known] = self.start[at[known]], self.count[at[known]]
        ids = self.ids
        new = np.flatnonzero(~known)
        if len(new):
            got, counts = encode([spans.text(k) for k in new])
            offsets = len(ids) + np.cumsum(counts) - counts
            ids = np.concatenate([ids, got.astype(ids.dtype)])
            start[new], count[new] = offsets, counts
            self._add(spans.unique[new], offsets, counts, ids)
        return ids, start, count

    def _add(self, hashes, offsets, counts, ids) -> None:
        if len(self.hashes) + len(hashes) > self.most:
            self._clear()
            return
        keep = hashes != 0
        order = np.argsort(hashes[keep])
        hashes = hashes[keep][order]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.start = np.insert(self.start, at, offsets[keep][order])
        self.count = np.insert(self.count, at, counts[keep][order])
        self.ids = ids


def gather(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """ids[start:start+count] of each span, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(start - (ends - count), count)]
