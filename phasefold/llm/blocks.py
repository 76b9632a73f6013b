"""Blocks of documents and packed exchanges between blocks and key buckets.

A block is a run of rows of one input split with about ``target`` bytes of text.
Blocks turn their keys (word or window hashes) into sorted arrays; an exchange
sends slices of those arrays to buckets of the key space, where each bucket sees
all slices of its range, and sends one answer per key back.  So a row is a slice
of many keys, shuffles stay compact, and memory is bounded by a bucket's share,
whose number grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

BLOCK_BYTES = 6 << 20


def text_blocks(batches: Iterator[pa.RecordBatch], target: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Numbered tables with about ``target`` bytes of ``text`` each; the number is unique over all tasks."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    held, size = [], 0
    for batch in batches:
        _, offsets = _sizes(batch)
        at = 0
        while at < batch.num_rows:
            # rows up to the first that fills the block
            end = int(np.searchsorted(offsets, offsets[at] + max(1, target - size), side="left"))
            end = min(max(end, at + 1), batch.num_rows)
            held.append(batch.slice(at, end - at))
            size += int(offsets[end] - offsets[at])
            at = end
            if size >= target:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def _sizes(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0)
    return lengths, np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)])


def small_batches(batches: Iterator[pa.RecordBatch], target: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``target`` bytes of ``text``; the kernels need some hundred bytes per byte."""
    for batch in batches:
        _, offsets = _sizes(batch)
        at = 0
        while at < batch.num_rows:
            end = min(max(int(np.searchsorted(offsets, offsets[at] + target, side="right")) - 1, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def key_bits(keys: int, per_bucket: int, least: int) -> int:
    """Bits of the key that number the buckets: about ``per_bucket`` keys in each, ``least`` buckets or more."""
    return max(1, int(np.ceil(np.log2(max(2, least, keys / per_bucket)))))


def slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the sorted unsigned keys by their leading bits; empty buckets are left out."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.concatenate([[0], np.nonzero(np.diff(top))[0] + 1, [len(top)]]) if len(top) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(top[a]), a, b


def packed(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    """Arrays stored as bytes, one per row."""
    return [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for x in column]


def planes(values: np.ndarray) -> bytes:
    """An array's bytes, all of one significance together: sorted keys and small numbers then compress in a shuffle."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unplaned(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    """Arrays stored by ``planes``, one per row."""
    size = np.dtype(dtype).itemsize
    return [np.frombuffer(x.as_buffer(), np.uint8).reshape(size, -1).T.copy().view(dtype).ravel() if x.is_valid else np.zeros(0, dtype) for x in column]


def shrunk(values: np.ndarray, ascending: bool = False) -> bytes:
    """An array compressed for an exchange: its length, then its bytes by significance; ``ascending`` integers as differences."""
    if ascending and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    return len(values).to_bytes(8, "little") + (_codec().compress(planes(values), asbytes=True) if len(values) else b"")


def unshrunk(column: pa.ChunkedArray | pa.Array | list, dtype, ascending: bool = False) -> list[np.ndarray]:
    """Arrays stored by ``shrunk``, one per row; a null is an empty one."""
    out, size = [], np.dtype(dtype).itemsize
    for x in column:
        data = x.as_buffer() if x.is_valid else b"\0" * 8
        n = int.from_bytes(bytes(data[:8]), "little")
        values = np.zeros(0, dtype)
        if n:
            values = unplaned([pa.scalar(_codec().decompress(data[8:], decompressed_size=n * size, asbytes=True))], dtype)[0]
        out.append(np.cumsum(values, dtype=dtype) if ascending else values)
    return out


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct unsigned 64-bit keys, the first position of each, and the place of every key among them.

    Positions replace the keys' lowest bits, so one plain sort does; if keys agree in all other bits, a slower one follows.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    spread, low = np.uint64(64 - int(keys.min() ^ keys.max()).bit_length() & 63), np.uint64(len(keys).bit_length())
    at = ((keys << spread) >> low << low) | np.arange(len(keys), dtype=np.uint64)
    at.sort()
    order = (at & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


Sender = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
