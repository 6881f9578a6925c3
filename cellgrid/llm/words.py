"""Vectorised word hashing over Arrow string columns.

Texts are read as the bytes Arrow holds them in; words are runs of bytes that
are not ASCII white space, hashed without creating a Python string for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Bytes hashed at once; a longer document is hashed in blocks cut at white space.
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1000, 1000 + 4096, dtype=np.uint64)) | np.uint64(1)


def places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = mix(np.arange(1000, 1000 + 2 * n, dtype=np.uint64)) | np.uint64(1)
    return _PLACE


def hash_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word of lower-cased ``data``.

    ``cuts``: offsets where a text ends and the next begins, so that no word crosses them.
    """
    inside = ~SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = len(data) > 0 and inside[0], False
    edge[1:-1] = inside[1:] & ~inside[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    edge[inner] |= inside[inner]
    starts = np.flatnonzero(edge[:-1])
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    stop = np.empty(len(data), bool)
    stop[-1] = inside[-1]
    stop[:-1] = inside[:-1] & ~inside[1:]
    stop[inner - 1] |= inside[inner - 1]
    ends = np.flatnonzero(stop) + 1
    at = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    value = BYTE[data[at]] * places(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)), starts, ends


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def batches(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, row after the last, word hashes, index of each row's first word (and the end), bytes.

    A run holds rows of about ``BLOCK_BYTES`` together, or one longer row.
    """
    data, offsets = texts(column)
    rows = len(offsets) - 1
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
        j = min(j, rows)
        part = data[offsets[i] : offsets[j]]
        part = _LOWER[part] if lower else part
        cuts = offsets[i : j + 1] - offsets[i]
        if len(part) <= 2 * BLOCK_BYTES:
            hashes, starts, _ = hash_words(part, cuts)
            yield i, j, hashes, np.searchsorted(starts, cuts), part
        else:  # one long row
            found, at = [], 0
            while at < len(part):
                to = min(at + BLOCK_BYTES, len(part))
                while to < len(part) and not SPACE[part[to]]:
                    gap = np.flatnonzero(SPACE[part[to : to + BLOCK_BYTES]])
                    to = to + int(gap[0]) if len(gap) else min(to + BLOCK_BYTES, len(part))
                found.append(hash_words(part[at:to], np.array([0, to - at]))[0])
                at = to
            hashes = np.concatenate(found)
            yield i, j, hashes, np.array([0, len(hashes)]), part
        i = j
