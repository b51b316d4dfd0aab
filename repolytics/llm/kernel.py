"""Vectorised work on Arrow text columns inside tasks: words, hashes, byte classes.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` (A-Z lower-cased, or unchanged with
``AS_IS``) or, with ``PLAIN``, runs of letters, digits and non-ASCII bytes. Texts are handled in blocks of a few
megabytes, so that memory follows the block and not the batch; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
PLAIN = np.ones(256, dtype=bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and ``len + 1`` offsets of a text column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _block(data: np.ndarray, cuts: np.ndarray, separator: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one block; no word crosses a cut."""
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = cuts[(cuts > 0) & (cuts < len(data))]
    begins[at] |= inside[at]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:]
    ends_mask[at - 1] |= inside[at - 1]
    ends = np.flatnonzero(ends_mask) + 1
    where = np.flatnonzero(inside)
    lengths = ends - starts
    within = where - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    total = np.add.reduceat((letters[data[where]].astype(np.uint64) + np.uint64(1)) * powers[within], first)
    return starts, ends, mix(total + lengths.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, spans: bool = False, letters: np.ndarray = _LOWER):
    """Hashes of all words in order and ``len + 1`` word offsets of the texts.

    With ``spans`` also the byte starts and ends of the words. Blocks are cut at separators,
    hence a text of any length needs working memory for one block besides the result.
    """
    found, lo, size = [], 0, len(data)
    while lo < size:
        hi = min(lo + BLOCK, size)
        while hi < size and not separator[data[hi]]:
            hi += 1
        i, j = np.searchsorted(offsets, [lo, hi])
        starts, ends, hashes = _block(data[lo:hi], offsets[i:j] - lo, separator, letters)
        found.append((starts + lo, ends + lo, hashes))
        lo = hi
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    at = np.searchsorted(starts, offsets)
    return (hashes, at, starts, ends) if spans else (hashes, at)


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` following word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; with fewer words the whole is one shingle."""
    if not len(hashes):
        return hashes
    return np.unique(combine(hashes, min(width, len(hashes))))


def doc_slices(batch: pa.RecordBatch, text: str, most: int = BLOCK):
    """Yield ``(first row, data, offsets)`` for row ranges of about ``most`` bytes."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    for i, j in slices(offsets, most):
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
