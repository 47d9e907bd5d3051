"""Words, shingles and hashes of Arrow text columns as flat NumPy arrays.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``); upper-case A-Z
counts as lower case. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text."""
    if len(column) == 0:
        return
    offsets = offsets_of(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high
        low = high


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of rows low..high, with eight spare bytes, and the rows' offsets. Null texts are empty."""
    if column.null_count:
        column = column.slice(low, high - low).fill_null("")
        low, high = 0, len(column)
    offsets = offsets_of(column)[low:high + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(raw) + 8, dtype=np.uint8)
    np.take(_LOWER, raw, out=out[:len(raw)])
    return out, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and the words' offsets by row (rows + 1 numbers)."""
    n = len(data) - 8
    solid = ~_SPACE[data[:n]]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True  # a word ends where its row ends
    before = np.empty(n + 1, dtype=bool)
    before[0], before[1:] = False, solid
    after = np.empty(n + 1, dtype=bool)
    after[-1], after[:-1] = False, solid
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends - starts, np.searchsorted(starts, offsets, side="left")


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, read eight bytes at a time."""
    eights = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data.data, strides=(1,))
    h = lengths.astype(np.uint64) * _GOLD
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        left = lengths[todo] - at
        todo, left = todo[left > 0], left[left > 0]
        if not len(todo):
            break
        chunk = eights[starts[todo] + at]
        short = left < 8
        if short.any():
            chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[todo] = mix((h[todo] + _GOLD) ^ chunk)
        todo, at = todo[~short], at + 8
    return h


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n words in a row (len - n + 1 of them); order counts."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        h = mix(h * _GOLD + hashes[k:k + size])
    return h


def shingles(word_hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their offsets by row.

    A row with fewer than n words (but one at least) has its whole sequence as one shingle.
    """
    counts = np.diff(rows)
    per_row = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_rows = np.concatenate([[0], np.cumsum(per_row)])
    owner = np.repeat(np.arange(len(counts)), per_row)
    first = rows[:-1][owner] + (np.arange(out_rows[-1]) - out_rows[:-1][owner])
    out = np.zeros(len(first), dtype=np.uint64)
    full = counts[owner] >= n
    windows = chain(word_hashes, n)
    out[full] = windows[first[full]]
    for k in np.flatnonzero((counts > 0) & (counts < n)):
        out[out_rows[k]] = chain(word_hashes[rows[k]:rows[k + 1]], int(counts[k]))[0]
    return out, out_rows


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the new offsets by row."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(rows)))
