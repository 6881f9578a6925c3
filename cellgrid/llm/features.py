"""Hashed word features of Arrow string columns for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import BYTE, SPACE, mix, places, texts

#: Bytes worked on at once; a longer document is cut at white space.
BLOCK_BYTES = 1 << 20
PREFIX, SUFFIX = 5, 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER, _DIGIT, _SYMBOL = np.zeros(256, np.float32), np.zeros(256, np.float32), np.zeros(256, np.float32)
_UPPER[65:91], _DIGIT[48:58] = 1, 1
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'-.,"]] = 1
STATS = ("length", "upper", "digit", "symbol")


@dataclass
class Words:
    """The words of some rows: hashes of the lower-cased word, its first and last bytes, and byte counts."""

    word: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    stats: np.ndarray  # float32, a column for each of STATS


def _empty() -> Words:
    return Words(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty((0, len(STATS)), np.float32))


def _block(data: np.ndarray, cuts: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of ``data`` and their start bytes; no word crosses one of ``cuts``."""
    inside = ~SPACE[data]
    start = np.empty(len(data), bool)
    if not len(data):
        return _empty(), np.empty(0, np.int64)
    start[0] = inside[0]
    start[1:] = inside[1:] & ~inside[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    start[inner] |= inside[inner]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(start)
    if not len(starts):
        return _empty(), starts
    first = np.searchsorted(at, starts)
    sizes = np.diff(np.append(first, len(at)))
    raw = data[at]
    place = np.arange(len(at)) - np.repeat(first, sizes)
    back = np.repeat(sizes, sizes) - 1 - place
    byte, by_place = BYTE[_LOWER[raw]], places(int(sizes.max()))
    value = byte * by_place[place]
    add = np.add.reduceat
    word = mix(add(value, first) + sizes.astype(np.uint64))
    prefix = mix(add(np.where(place < PREFIX, value, np.uint64(0)), first))
    suffix = mix(add(np.where(back < SUFFIX, byte * by_place[np.minimum(back, SUFFIX)], np.uint64(0)), first) + np.uint64(1))
    stats = np.stack([sizes.astype(np.float32), *(add(t[raw], first) for t in (_UPPER, _DIGIT, _SYMBOL))], axis=1)
    return Words(word, prefix, suffix, stats), starts


def word_runs(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """For runs of rows: the first row, the row after the last, their words, and where the words of each row begin (and end)."""
    data, offsets = texts(column)
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = min(rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1))
        part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) <= 2 * BLOCK_BYTES:
            words, starts = _block(part, cuts)
            yield i, j, words, np.searchsorted(starts, cuts)
        else:  # one long row, in blocks
            found, at = [], 0
            while at < len(part):
                to = min(at + BLOCK_BYTES, len(part))
                while to < len(part) and not SPACE[part[to]]:
                    gap = np.flatnonzero(SPACE[part[to : to + BLOCK_BYTES]])
                    to = to + int(gap[0]) if len(gap) else min(to + BLOCK_BYTES, len(part))
                found.append(_block(part[at:to], np.array([0, to - at]))[0])
                at = to
            words = Words(*(np.concatenate([getattr(f, k) for f in found]) for k in ("word", "prefix", "suffix", "stats")))
            yield i, j, words, np.array([0, len(words.word)])
        i = j


def hash_of(word: str) -> int:
    """The hash that ``word_runs`` gives a lower-case word."""
    return int(_block(np.frombuffer(word.encode(), np.uint8), np.array([0]))[0].word[0])
