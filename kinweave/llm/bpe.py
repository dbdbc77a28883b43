"""Byte-level BPE ids of whole Arrow columns.

The tokenizer splits a text into pieces by a pattern over letters, numbers, other characters and white space, and the
ids of a piece depend on the piece alone. So the split is done on arrays, each distinct piece goes through the
``tokenizers`` library once in a worker, and texts are put together from the pieces' ids. Texts for which the array
split is not proven equal (other scripts, contractions, the vocabulary's special token) go to the library whole.
Pieces are found by hash and then compared byte by byte; a text with a piece that only shares its hash goes to the
library whole too, so ids never depend on the hash.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kinweave.llm._text import U64, byte_sums, mix, ranges, slices

#: A worker forgets the pieces it has learned beyond this many, or beyond this many bytes of them (about 50 MB in all).
MOST_PIECES, MOST_BYTES = 1_000_000, 16_000_000
#: Pieces given to the library at once.
AT_ONCE = 8192
_FAST = 0x530  # below: Latin, Greek, Cyrillic; their character classes are the same in every Unicode version
# The characters that the tokenizer's pattern takes as white space, and the first letters after ' in it.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0]
_CONTRACTED = b"stmdrvl"
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


def _classes() -> np.ndarray:
    kinds = [{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_FAST)]
    out = np.array(kinds, np.uint8)
    out[_WHITE] = _SPACE
    return out


_CLASS = _classes()


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte positions at which pieces begin, texts that must be encoded whole) of a slice of UTF-8 texts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    wide = np.flatnonzero(lead >= 0xC0)
    codes = lead
    if len(wide):
        second = data[np.minimum(at[wide] + 1, len(data) - 1)]
        codes = lead.copy()
        codes[wide] = np.where(lead[wide] < 0xE0, ((lead[wide] & 0x1F) << 6) | (second & 0x3F), _FAST)
    begin = np.searchsorted(at, offsets)
    slow = codes >= _FAST
    nexts = np.append(codes[1:], 0)
    slow |= (codes == 0x27) & np.isin(nexts, np.frombuffer(_CONTRACTED, np.uint8))
    slow |= (codes == 0x3C) & (nexts == 0x7C)  # may begin the special token
    kinds = _CLASS[np.minimum(codes, _FAST - 1)]
    n = len(codes)
    head = np.zeros(n + 1, dtype=bool)
    head[begin] = True
    head = head[:n] if n else head[:0]
    last = np.append(head[1:], True)
    before = np.concatenate([[_SPACE], kinds[:-1]]) if n else kinds
    after = np.append(kinds[1:], _SPACE)
    white = kinds == _SPACE
    blank_before = np.concatenate([[False], codes[:-1] == 0x20]) if n else white
    starts = np.where(white, (before != _SPACE) | ((after != _SPACE) & ~last), (before != kinds) & ~blank_before)
    starts |= head
    whole = np.flatnonzero(np.add.reduceat(np.append(slow, False), np.minimum(begin[:-1], n)) * (np.diff(begin) > 0) > 0)
    return at[starts], whole


class Encoder:
    """Ids of texts; keeps the ids of the pieces it has met."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at = np.zeros(0, np.int32)
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32 if self.wide else np.uint16)
        self.bytes, self.begin, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        count, ids = [], []
        for at in range(0, len(texts), AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
            count += [len(x) for x in found]
            ids.append(np.array([i for x in found for i in x], self.ids.dtype))
        return np.array(count, np.int32), np.concatenate(ids) if ids else self.ids[:0]

    def _places(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows of first and count for distinct sorted piece hashes; spans tell where each is found."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            count, ids = self._encode([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            self.first = np.append(self.first, (len(self.ids) + np.cumsum(count) - count).astype(np.int32))
            self.count = np.append(self.count, count)
            self.ids = np.append(self.ids, ids)
            length = (end[new] - start[new]).astype(np.int32)
            self.begin = np.append(self.begin, (len(self.bytes) + np.cumsum(length) - length).astype(np.int32))
            self.length = np.append(self.length, length)
            self.bytes = np.append(self.bytes, data[ranges(start[new], length)])
            rows = (len(self.count) - len(new) + np.arange(len(new))).astype(np.int32)
            self.at = np.insert(self.at, at[new], rows)
            self.keys = np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        return self.at[at]

    def _same(self, rows: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each span holds the very bytes of its piece."""
        length = end - start
        same = length == self.length[rows]
        at = np.flatnonzero(same)
        length = length[at]
        differ = data[ranges(start[at], length)] != self.bytes[ranges(self.begin[rows[at]], length)]
        if differ.any():
            sums = np.concatenate([[0], np.cumsum(differ)])
            until = np.cumsum(length)
            same[at] = sums[until] == sums[until - length]
        return same

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is empty."""
        for _, data, offsets in slices(texts):
            begin, whole = split(data, offsets)
            end = np.append(begin[1:], len(data))
            sums = byte_sums(data, begin)
            hashes = mix(sums[end] - sums[begin]) if len(begin) else np.zeros(0, U64)
            text = np.searchsorted(offsets, begin, "right") - 1
            if len(whole):
                fast = ~np.isin(text, whole)
                begin, end, hashes, text = begin[fast], end[fast], hashes[fast], text[fast]
            if len(self.keys) > MOST_PIECES or len(self.bytes) > MOST_BYTES:
                self._forget()
            keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            rows = self._places(keys, data, begin[where], end[where])[inverse] if len(keys) else np.zeros(0, np.int64)
            if len(rows):
                apart = text[~self._same(rows, data, begin, end)]
                if len(apart):
                    whole = np.union1d(whole, apart)
            ids = self.ids[ranges(self.first[rows], self.count[rows])] if len(rows) else self.ids[:0]
            tokens = np.concatenate([[0], np.cumsum(self.count[rows])]) if len(rows) else np.zeros(1, np.int64)
            edges = tokens[np.searchsorted(text, np.arange(len(offsets)))]
            slow = {}
            for i in whole.tolist():
                slow[i] = self._encode([data[offsets[i] : offsets[i + 1]].tobytes().decode()])[1]
            for i in range(len(offsets) - 1):
                yield slow[i] if i in slow else ids[edges[i] : edges[i + 1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
