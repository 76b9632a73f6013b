"""Array kernels over Arrow text batches: word and shingle hashes of whole texts, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit value per byte, so that byte strings hash as random polynomials.
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the offsets of its rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def prefix_hashes(data: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """S[i] = sum over j < i of code(byte j) * BASE ** j; ``scale``: those powers."""
    scale = powers(BASE, len(data)) if scale is None else scale
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * scale, dtype=np.uint64, out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal for equal bytes, wherever they stand."""
    inverse = powers(INVERSE, len(prefix)) if inverse is None else inverse
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes between ASCII white space or text ends) and the word count per row."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _SPACE[data]
    first = ~gap[:-1]
    first[1:] &= gap[:-2] if len(data) > 1 else gap[:0]
    edge = np.zeros(len(data) + 1, bool)  # a text's first byte starts a word even if the text before ended in one
    edge[offsets] = True
    first |= edge[:-1] & ~gap[:-1]
    last = ~gap[:-1] & (gap[1:] | edge[1:])
    starts, ends = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(bounds)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the word count per row."""
    if lower:
        data = _LOWER[data]
    starts, ends, counts = words(data, offsets)
    return range_hashes(prefix_hashes(data), starts, ends), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sorted set of hashes of its k-word shingles, concatenated, and the set sizes.

    A row of fewer than k words has its whole word sequence as the one shingle, a row without words none.
    """
    hashes, counts = word_hashes(data, offsets)
    n_rows = len(counts)
    row = np.repeat(np.arange(n_rows), counts)
    first = np.cumsum(counts) - counts
    scale = powers(BASE ^ 0x5851F42D4C957F2C, max(k, 1))
    n = max(0, len(hashes) - k + 1)
    full = np.zeros(n, np.uint64)
    for j in range(k):
        full += hashes[j:j + n] * scale[j]
    whole = row[:n] == row[k - 1:k - 1 + n] if n else np.zeros(0, bool)
    short = np.nonzero((counts > 0) & (counts < k))[0]
    extra = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = counts[short] > j
        extra[has] += hashes[first[short[has]] + j] * scale[j]
    # the length takes part, so a short text never equals a shingle
    extra += counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    rows = np.concatenate([row[:n][whole], short])
    values = mix64(np.concatenate([full[whole], extra]))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[fresh], values[fresh]
    return values, np.bincount(rows, minlength=n_rows)
