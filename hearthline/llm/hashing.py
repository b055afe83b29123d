"""Words of a batch of texts, and hashes of words and of runs of words, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. A word's hash takes its UTF-8 bytes eight at a time through a
mixing bijection, so no arithmetic structure of the bytes survives; a batch costs a few passes
over arrays and no Python call for each word. Families of hashes start from different seeds and
are independent from the bytes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are hashed in slices of about this size, which bounds the arrays

_rng = np.random.default_rng(20240229)
_SEEDS = _rng.integers(1, 1 << 63, (2, 2), dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
_SEATS = _rng.integers(1, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of several texts: byte span and text number of each, in order, and for
    each text the number of its first word (with one more entry at the end). data has eight
    more bytes than the texts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.hashed(0)

    def hashed(self, family: int) -> np.ndarray:
        """The words' hashes of a family."""
        return _hash(self.data, self.starts, self.ends, family)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """Hashes of byte spans. Each pass takes up to eight more bytes of the spans that have them."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # at every byte
    at, left = starts, ends - starts
    out = mix(left.astype(np.uint64) + _SEEDS[family, 0])
    which = np.arange(len(starts))
    while len(which):
        lane = eight[at] & _BELOW[np.minimum(left, 8)]
        out[which] = mix(out[which] ^ mix(lane + _SEEDS[family, 1]))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return out


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(offset, part) of an array of strings, nulls as empty, cut so that a part has about `size`
    bytes, and one text at least."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def words(texts: pa.Array, fold: bool = False) -> Words:
    """texts: large strings without nulls. fold: A-Z count as a-z in the hashes."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2]
    size = end - base if raw is not None else 0
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(raw, np.uint8)[base:end]
    if fold:
        data = _FOLD[data]
    offsets = offsets - base
    if not size:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(n + 1, np.int64))
    inside = ~_SPACE[data[:size]]
    opens, closes = np.ones(size, bool), np.ones(size, bool)
    opens[1:] = ~inside[:-1]
    closes[:-1] = ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    opens[edges] = True
    closes[edges - 1] = True
    starts = np.flatnonzero(opens & inside)
    ends = np.flatnonzero(closes & inside) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return Words(data, starts, ends, text, np.searchsorted(starts, offsets))


def strings(texts: pa.Array, family: int = 0) -> np.ndarray:
    """The hash of each whole string of an array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return _hash(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], family)


def runs(hashes: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """The hash of each run of `size` consecutive words, by its first word, from the words' hashes
    of the same family. Runs may cross texts: the caller drops those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _SEATS[family, 0]
    for k in range(1, size):
        out = out + hashes[k : k + n] * _SEATS[family, k]
    return mix(out)
