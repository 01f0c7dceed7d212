"""Hashed word shingles inside tasks, and bitmaps of a fixed size over keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The multipliers and shifts of a well-known 64-bit finalizer.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


#: The odd multiplier of the rolling hash of words; bytes hashed at a time.
_BASE, _PART = 0xD6E8FEB86659FD93, 1 << 18
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, _PART + 1), b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def _parts(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts, long ones cut at spaces, in groups of about ``_PART`` bytes, with the
    index of the text that each piece is from."""
    group, of, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > _PART:
                space = _SPACE.search(text, at + _PART)
                stop = space.start() if space else stop
            if group and size + stop - at > _PART:
                yield group, of
                group, of, size = [], [], 0
            group.append(text[at:stop])
            of.append(i)
            size += stop - at
            at = stop
    if group:
        yield group, of


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, with A to Z in lower case,
    and the number of words of each text. Words are hashed from prefix sums over
    the bytes, without a loop over words."""
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    for group, of in _parts(texts):
        data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
        data = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
        power, inverse = _power(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        hashes.append(mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        ends = np.cumsum([len(g) + 1 for g in group])
        np.add.at(counts, of, np.diff(np.searchsorted(start, ends), prepend=0))
    return np.concatenate(hashes), counts


def text_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8; null as empty."""
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary())]


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    at = 0
    for c in counts.tolist():
        yield np.unique(shingle_sequence(words[at : at + c], n))
        at += c


def shingle_sequence(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words, in order; with fewer words one for the
    whole sequence; none without words."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * _M1 + words[i : i + len(h)])
    return h


def test_bits(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key's bit is set. ``bitmap`` holds 64 bits a word; its
    length is a power of two."""
    at = keys & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def key_bitmap(keys: DataFrame, key: Column, log_bits: int) -> np.ndarray:
    """A bitmap of ``2**log_bits`` bits with the low bits of each key set.

    It has that size whatever the number of keys: with many keys it says yes too
    often, which costs work where it is used as a first filter and loses nothing.
    """
    at = F.pmod(key, F.lit(1 << log_bits))
    rows = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (log_bits - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def bitmap_size(n: int, least: int = 16, most: int = 27) -> int:
    """Bits, as a power of two, for ``n`` keys: about 16 a key, 16 MB at most."""
    return min(most, max(least, (16 * max(1, n) - 1).bit_length()))
