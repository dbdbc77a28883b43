"""Vectorised text arrays: words, hashes and runs over Arrow string columns.

Texts are worked on as UTF-8 bytes in slices of about a megabyte, so that memory follows the slice (or one
longer document) and not the Arrow batch. A word's hash is a 64-bit sum of random values, one for each byte and its
place in the word (tabulation), finished with a mixing step; a window's hash is a tree of mixed pairs of word hashes.
Neither is a polynomial, so no text collides by its shape alone; equal sequences always get equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
_ODD, _ODD_2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Places in a word with random values of their own; later places mix their turn into those.
_PLACES = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of words: everything but ASCII white space.
NON_SPACE = ~_SPACE
#: Bytes of words: digits, a-z (A-Z too, they are folded) and every byte of a multi-byte character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _place_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(20240611).integers(1, 2**64, (_PLACES, 256), dtype=U64)
    if fold:
        values[:, 0x41:0x5B] = values[:, 0x61:0x7B]
    return values.ravel()


_VALUES = {fold: _place_values(fold) for fold in (False, True)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_sums(data: np.ndarray, starts: np.ndarray, fold: bool = False) -> np.ndarray:
    """Running sums of the bytes' values by their place after the last of the sorted starts.

    The hash of a span that begins at a start is ``mix`` of the difference between the sums at its end and its start.
    """
    edges = np.concatenate([[0], starts, [len(data)]])
    place = np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))
    values = _VALUES[fold][(place % _PLACES) << 8 | data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        values[far] = mix(values[far] + (place[far] // _PLACES).astype(U64) * _ODD)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(values, dtype=U64, out=sums[1:])
    return sums


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets of the texts in them), about ``limit`` bytes at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of a slice: byte spans, the number in each text, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NON_SPACE, fold: bool = False) -> None:
        self.data, self.offsets, self.fold = data, offsets, fold
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = table[data]
        step = inside[1:] != inside[:-1]
        starts, ends = step & inside[1:], step & inside[:-1]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        joined = cut[inside[cut] & inside[cut + 1]]
        starts[joined] = ends[joined] = True
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        sums = byte_sums(self.data, self.start, self.fold)
        return mix(sums[self.end] - sums[self.start])


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two neighbours; the order counts."""
    out = left * _ODD
    out ^= out >> U64(32)
    out *= _ODD_2
    out += right
    return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes; windows that cross texts are the caller's to leave out.

    Windows of 1, 2, 4, ... words are paired up, and k is put together from them.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    level, size, out, done = words, 1, None, 0
    while True:
        if k & size:
            part = level[done : done + n]
            out = part if out is None else _pair(out, part)
            done += size
        if done == k:
            return mix(out + U64(k))
        level = _pair(level[:-size], level[size:])
        size *= 2


def window_starts(first: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Word indexes at which a window of k words fits into its text."""
    fits = np.maximum(count - k + 1, 0)
    return ranges(first[:-1], fits)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of start[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = start - np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.arange(total) + np.repeat(shift, count)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points in each text of a slice."""
    sums = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.diff(sums[offsets])


def by_part(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits equal ranges of the hash space begins and ends in sorted hashes."""
    edges = np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])
