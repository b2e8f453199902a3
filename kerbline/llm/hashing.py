"""Hashes of words and word windows of many texts at once, in numpy over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than white space (20, 09-0D); such bytes never occur inside a multi-byte character. Prefix
sums of ``value[byte] * BASE**i`` modulo 2**64 give every word's polynomial hash by one subtraction (the base is odd, so its
powers can be inverted), and prefix sums over word hashes give every window's in the same way (Rabin-Karp). Both are mixed.
Two different windows share a hash with probability 2**-64.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from kerbline.llm.common import SPACES

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """Words of a run of texts: hash, byte range in ``data``, and for text i the words first[i] to first[i + 1]."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b % 2**64, np.uint64)]) for b in (base, pow(base, -1, 2**64)))
        _POWERS[base] = have
    return have


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text stands alone."""
    ends = _offsets(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, min(stop, n)
        row = min(stop, n)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind) if len(column) else np.zeros(1, kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """Words of each text; a null text has none."""
    offsets = _offsets(column)
    if column.null_count:
        column = pa.array(column.to_pylist(), pa.large_string()).fill_null("")
        offsets = _offsets(column)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~_SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    power, inverse = _powers(BYTE_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return Words(hashes, start, end, np.searchsorted(start, offsets), data)


def windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``length`` consecutive words of one text, and the place of its first word."""
    n = len(words.hashes)
    last = np.repeat(words.first[1:], np.diff(words.first))
    place = np.flatnonzero(np.arange(n) + length <= last)
    return _spans(words.hashes, place, place + length), place


def whole(words: Words) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    return _spans(words.hashes, words.first[:-1], words.first[1:])


def _spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(WORD_BASE, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
