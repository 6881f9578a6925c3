"""Words of Arrow string columns as exact strings, cut without a Python object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def members(*bytes_or_ranges: int | range) -> np.ndarray:
    """A table of 256 places that is true for the given bytes."""
    out = np.zeros(256, bool)
    for b in bytes_or_ranges:
        out[b] = True
    return out


def cut_words(data: np.ndarray, cuts: np.ndarray, word: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased (A-Z) UTF-8 ``data`` and the byte each begins at.

    ``word``: which bytes belong to words (all of a multi-byte character or none);
    ``cuts``: offsets of rows, which no word crosses.
    """
    low = _LOWER[data]
    inside = word[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] |= inside[inner]
    last[inner - 1] |= inside[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(low[inside])), starts


def sorted_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words; codes follow their byte order."""
    d = words.dictionary_encode()
    order = pc.sort_indices(d.dictionary.cast(pa.large_binary())).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[d.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
    return codes, d.dictionary.take(pa.array(order))
