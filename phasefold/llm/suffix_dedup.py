"""Removal of repeated 100-byte strings: blockwise suffix sorting with a difference cover.

A byte goes if a 100-byte string that covers it also starts earlier (smaller
document id, or earlier in the same document).  Only suffixes that can have such
a long tie are ever sorted, one suffix bucket at a time:

1. Every suffix (window start) belongs to the bucket of its anchor, the smallest
   hash of the ``GRAM``-byte strings inside the window; equal windows have equal
   anchors at equal places.  An exchange of anchor hashes tells each block of
   documents which anchors occur again anywhere; all other suffixes are unique
   and done.
2. Neighbouring suffixes with one anchor form a segment (at most ``SPAN``
   suffixes).  Segments of repeated anchors go, with their text, to the bucket
   of the anchor; a block sends equal segments once.  Inside a bucket all but the
   earliest of equal segments go as they are, and an anchor with one distinct
   segment needs no sorting.
3. For the other segments, positions whose distance from the anchor lies in a
   difference cover modulo ``MODULUS`` are samples.  The samples' ranks among all
   ``SAMPLE``-byte strings of the bucket are computed first; suffixes are then
   sorted by the few bytes before their first sample, the sample's rank and the
   few bytes after it, so a tie of 70 bytes costs one comparison of ranks.
   Distances from the anchor are the same in equal windows, so both meet the
   same sample.
4. An anchor with more than ``HOT`` segments in the corpus (a line that stands in very
   many documents, say) would fill one bucket: its suffixes go by the 64-bit hash of
   their own window instead, one hash a block and distinct window, and so spread evenly;
   equal windows still meet.
5. The first suffix of each group of ties is the earliest one.  One bit per
   suffix goes back to the blocks, which mark bytes and cut the texts.

Memory is bounded by a block, a bucket's share of the anchors and ``HOT`` segments;
the number of buckets follows the data.  Blocks lie in a table laid out by block number, so texts are not shuffled.

Defined results: a null text is empty; matches never cross documents; null ids
come after all others; repeated rows and ids count as documents in the order of
their blocks and rows; texts below 100 bytes stay whole; if a cut splits a
character, the kept bytes are still exactly the remaining ones; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from phasefold.llm import kernels
from phasefold.llm.blocks import key_bits, packed, slices, text_blocks
from phasefold.llm.common import bucket_count, materialize, materialize_bucketed

WINDOW, GRAM = 100, 50
SPAN = WINDOW - GRAM + 1
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
SAMPLE = WINDOW - MODULUS + 1
#: Text of a block.  Rows of an exchange are blocks times buckets, both in proportion to the corpus, so blocks are as large as a worker's memory allows;
#: the kernels, which need some hundred bytes per byte, go through a block by runs of documents with about ``PIECE`` bytes.
BLOCK = 8 << 20
PIECE = 1 << 17
#: Bytes of corpus text per suffix bucket; about a third of them are sorted, at some hundred bytes each.
BUCKET = 8 << 20
#: Bits of a hash that order anchors; the others hold the place.
HASH_PART = np.uint64((1 << 64) - (1 << 31))
#: Segments of one anchor that one bucket takes, and window hashes per bucket for anchors with more (where there are few, no less than the second number).
HOT = 4096
WINDOWS, FEW_WINDOWS = 1_000_000, 65_536

BLOCKS = "block long, ids array<long>, sizes binary, text binary, n_bytes long"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("text", pa.binary()), ("n_bytes", pa.int64())])


def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to one row per block, documents in the order of their ids."""
    for block, table in text_blocks(batches, BLOCK):
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end")) if table.num_rows > 1 else table
        data, offsets = kernels.text_buffers(table.column("text"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("doc_id").combine_chunks()),
             pa.array([np.diff(offsets).astype(np.int64).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([len(data)], pa.int64())],
            schema=_BLOCK_SCHEMA)


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of whole documents with about ``PIECE`` bytes, one document at least: start, end, sizes."""
    ends = np.cumsum(sizes)
    i = start = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, start + PIECE, side="right")))
        yield start, int(ends[j - 1]), sizes[i:j]
        i, start = j, int(ends[j - 1])


@functools.cache
def _powers(base: int, bits: int) -> np.ndarray:
    return kernels.powers(base, 1 << bits)


@functools.cache
def _places(bits: int) -> np.ndarray:
    return np.arange(1 << bits, dtype=np.uint64)


def _scale(base: int, n: int) -> np.ndarray:
    """Powers for a piece, kept by the worker; a document longer than a piece gets its own."""
    return _powers(base, PIECE.bit_length())[:n] if n <= PIECE else kernels.powers(base, n)


def _prefix(data: np.ndarray) -> np.ndarray:
    return kernels.prefix_hashes(data, _scale(kernels.BASE, len(data)))


def segments(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that share an anchor: first start, number, anchor place, anchor hash."""
    found = [_segments(data[a:b], part, a) for a, b, part in pieces(sizes) if b - a >= WINDOW]
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip((empty, empty, empty, np.zeros(0, np.uint64)), *found))


def _segments(data: np.ndarray, sizes: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those of one piece, which starts at byte ``at``."""
    n = len(data) - WINDOW + 1
    prefix = _prefix(data)
    grams = prefix[GRAM:] - prefix[:-GRAM]
    grams *= _scale(kernels.INVERSE, len(grams))
    grams = kernels.mix64(grams)
    # smallest hash of each window by doubling; the low bits hold the place, so ties go to the left
    least = grams & HASH_PART
    least |= _places(PIECE.bit_length())[:len(grams)] if len(grams) <= PIECE else np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
    least = least[:n]
    # suffixes too close to their document's end are none; all others lie in runs between them
    few = np.minimum(sizes, WINDOW - 1)
    close = np.repeat(np.cumsum(sizes) - np.cumsum(few), few) + np.arange(int(few.sum()))
    inside = np.ones(n, bool)
    inside[close[close < n]] = False
    change = least[1:] != least[:-1]
    change |= inside[1:] != inside[:-1]
    cut = np.concatenate([[0], np.nonzero(change)[0] + 1, [n]])
    starts, counts = cut[:-1], np.diff(cut)
    run = inside[starts]
    starts, counts = starts[run], counts[run]
    anchor = (least[starts] & ~HASH_PART).astype(np.int64)
    # smallest hashes crowd near zero; mixed again, they spread evenly over the buckets
    return starts + at, counts, anchor + at, kernels.mix64(grams[anchor] + np.uint64(0x9E3779B97F4A7C15))


def string_hashes(data: np.ndarray, sizes: np.ndarray, *ranges: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of byte ranges [start, end) inside documents, each list in the order of its starts."""
    out = [[np.zeros(0, np.uint64)] for _ in ranges]
    for a, b, _ in pieces(sizes):
        found = [np.searchsorted(starts, (a, b)) for starts, _ in ranges]
        if any(i < j for i, j in found):
            prefix = _prefix(data[a:b])
            for hashes, (starts, ends), (i, j) in zip(out, ranges, found):
                hashes.append(kernels.range_hashes(prefix, starts[i:j] - a, ends[i:j] - a, _scale(kernels.INVERSE, b - a)))
    return [np.concatenate(x) for x in out]


def _joined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    return data[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]


def _segment_names(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Names of segments by the hashes of their texts: equal for the same text and the same anchor place inside."""
    return kernels.mix64(text + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def send_anchors(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, data in zip(batch.column("block").to_pylist(), packed(batch.column("sizes"), np.int64), packed(batch.column("text"), np.uint8)):
                keys, counts = np.unique(segments(data, sizes)[3], return_counts=True)
                rows = [(b, block, keys[i:j].tobytes(), counts[i:j].astype(np.uint32).tobytes()) for b, i, j in slices(keys, bits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "keys", "counts"])

    return send


def find_repeated(hot: int):
    """Grouped Arrow function of one bucket of anchors: a bit per key and block where another block has the key too, and one where it has more than ``hot`` segments; the block's segments of the latter."""

    def find(group: pa.Table) -> pa.Table:
        keys = packed(group.column("keys"), np.uint64)
        _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        again = n[at] > 1
        counts = np.concatenate(packed(group.column("counts"), np.uint32)).astype(np.int64)
        many = np.bincount(at, weights=counts)[at] > hot
        cut = np.cumsum([0, *map(len, keys)])
        spread = np.concatenate([[0], np.cumsum(counts * many)])[cut]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "n_hot": np.diff(spread), **{
            name: pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for name, x in (("bits", again), ("hot", many))}})

    return find


def _ordered(answers: pa.Table, name: str) -> list[bytes]:
    if not answers.num_rows:
        return []
    order = np.argsort(answers.column("bucket").to_numpy())
    column = answers.column(name)
    return [column[int(i)].as_buffer() for i in order]


def _chosen(data: np.ndarray, sizes: np.ndarray, answers: pa.Table, key_count_bits: int):
    """Repeated segments of a block, with the first of equal ones marked; the same order in every pass.

    Then, for anchors with too many segments: every start, the sorted hashes of their distinct windows, the first start of each and the hash of every start.
    """
    starts, counts, anchors, hashes = segments(data, sizes)
    keys, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    again, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for name, flags in (("bits", again), ("hot", hot)):
        for buffer, (_, i, j) in zip(_ordered(answers, name), slices(keys, key_count_bits)):
            flags[i:j] = np.unpackbits(np.frombuffer(buffer, np.uint8))[:j - i].astype(bool)
    spread = hot[at]
    single = np.repeat(starts[spread] - np.cumsum(counts[spread]) + counts[spread], counts[spread]) + np.arange(int(counts[spread].sum()))
    pick = np.nonzero((again | (n > 1))[at] & ~spread)[0]
    window, text = string_hashes(data, sizes, (single, single + WINDOW), (starts[pick], starts[pick] + counts[pick] + WINDOW - 1))
    windows = (single, *np.unique(window, return_index=True, return_inverse=True))
    by_anchor = np.argsort(hashes[pick], kind="stable")  # the earliest document first
    pick, text = pick[by_anchor], text[by_anchor]
    starts, counts, anchors, hashes = starts[pick], counts[pick], anchors[pick], hashes[pick]
    name = _segment_names(text, anchors - starts)
    _, first = np.unique(name, return_index=True)
    lead = np.zeros(len(name), bool)
    lead[first] = True
    return starts, counts, anchors, hashes, lead, windows


def send_segments(anchor_bits: int, bits: int, window_bits: int):
    """Cogroup function: a block and its anchor answers to the packed texts of its repeated segments, and to window hashes (buckets below zero) where an anchor has too many."""

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for r in range(block.num_rows):
            data, sizes = np.frombuffer(block.column("text")[r].as_buffer(), np.uint8), np.frombuffer(block.column("sizes")[r].as_buffer(), np.int64)
            ids = pc.fill_null(block.column("ids")[r].values, np.iinfo(np.int64).max).to_numpy()
            starts, counts, anchors, hashes, lead, (single, keys, earliest, _) = _chosen(data, sizes, answers, anchor_bits)
            owner = ids[np.searchsorted(np.cumsum(sizes), single[earliest], side="right")]
            for b, i, j in slices(keys, window_bits):
                rows.append((-1 - b, block.column("block")[r].as_py(), keys[i:j].tobytes(), None, None, owner[i:j].tobytes()))
            starts, counts, anchors, hashes = starts[lead], counts[lead], anchors[lead], hashes[lead]
            doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
            lengths = counts + WINDOW - 1
            for b, i, j in slices(hashes, bits):
                rows.append((b, block.column("block")[r].as_py(), _joined(data, starts[i:j], lengths[i:j]).tobytes(), counts[i:j].astype(np.uint8).tobytes(), (anchors - starts)[i:j].astype(np.uint8).tobytes(), ids[doc[i:j]].tobytes()))
        types = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("bucket", "block", "text", "counts", "places", "docs"), types))})

    return send


_NEXT_SAMPLE = np.array([min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)], np.int64)


def sort_bucket(group: pa.Table) -> pa.Table:
    """One suffix bucket: which suffixes of each segment also start earlier, a 64-bit mask per segment.

    All but the earliest of equal segments do as a whole, and suffixes of an anchor with one distinct segment do not; the others are sorted.
    """
    group = group.take(pa.array(np.argsort(group.column("block").to_numpy(), kind="stable")))
    if group.column("bucket")[0].as_py() < 0:
        return sort_windows(group)
    counts_of = packed(group.column("counts"), np.uint8)
    text, counts = np.concatenate(packed(group.column("text"), np.uint8)), np.concatenate(counts_of).astype(np.int64)
    places, docs = np.concatenate(packed(group.column("places"), np.uint8)).astype(np.int64), np.concatenate(packed(group.column("docs"), np.int64))
    lengths = counts + WINDOW - 1
    base = np.cumsum(lengths) - lengths
    whole, anchors = string_hashes(text, lengths, (base, base + lengths), (base + places, base + places + GRAM))
    # of equal segments that of the earliest document leads, then that of the first block and place, which is the order of the rows
    name = _segment_names(whole, places)
    by = np.lexsort((docs, name))
    lead = np.sort(by[np.concatenate([[True], name[by[1:]] != name[by[:-1]]])])
    mask = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
    mask[lead] = 0
    _, at, n = np.unique(anchors[lead], return_inverse=True, return_counts=True)
    mixed = lead[n[at] > 1]
    if len(mixed):
        mask[mixed] = sort_suffixes(_joined(text, base[mixed], lengths[mixed]), counts[mixed], places[mixed], docs[mixed])
    cut = np.cumsum([0, *map(len, counts_of)])
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"),
                     "masks": pa.array([mask[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def sort_suffixes(text: np.ndarray, counts: np.ndarray, places: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Masks of the segments whose texts stand one after the other: which of their suffixes also start earlier."""
    n_seg = len(counts)
    lengths = counts + WINDOW - 1
    base = np.cumsum(lengths) - lengths
    seg = np.repeat(np.arange(n_seg), counts)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base[seg] + inner
    # first cover sample at or after each suffix, by its distance from the anchor
    delta = _NEXT_SAMPLE[(inner - places[seg]) % MODULUS]
    sample = start + delta
    where, at = np.unique(sample, return_inverse=True)
    shifted = np.lib.stride_tricks.sliding_window_view(text, SAMPLE)
    _, rank = np.unique(np.ascontiguousarray(shifted[where]).view(f"V{SAMPLE}").ravel(), return_inverse=True)
    prefix = kernels.prefix_hashes(text)
    inverse = kernels.powers(kernels.INVERSE, len(prefix))
    head = kernels.range_hashes(prefix, start, sample, inverse)
    tail = kernels.range_hashes(prefix, sample + SAMPLE, start + WINDOW, inverse)
    key = kernels.mix64(head * np.uint64(0x9E3779B97F4A7C15) + kernels.mix64(tail + delta.astype(np.uint64))) + rank[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    # ties: earliest document first, then block and place, which is the order of the rows
    by = np.lexsort((docs[seg], key))
    same = np.zeros(len(by), bool)
    same[1:] = key[by[1:]] == key[by[:-1]]
    mask = np.zeros(n_seg, np.uint64)
    dup = by[same]
    np.bitwise_or.at(mask, seg[dup], np.uint64(1) << inner[dup].astype(np.uint64))
    return mask


def sort_windows(group: pa.Table) -> pa.Table:
    """One bucket of window hashes, in the order of the blocks: which of them also start earlier, a bit per hash."""
    keys, docs = packed(group.column("text"), np.uint64), np.concatenate(packed(group.column("docs"), np.int64))
    key = np.concatenate(keys)
    by = np.lexsort((docs, key))
    same = np.zeros(len(by), bool)
    same[by[1:]] = key[by[1:]] == key[by[:-1]]
    cut = np.cumsum([0, *map(len, keys)])
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"),
                     "masks": pa.array([np.packbits(same[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>"


def _cut_block(ids: pa.Array, data: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
    """The documents of a block without the windows that begin at the given places, in rising order."""
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, begins, side="right")
    # windows that overlap or touch make one span, documents apart
    apart = np.ones(len(begins) + 1, bool)
    apart[1:-1] = (begins[1:] > begins[:-1] + WINDOW) | (doc[1:] != doc[:-1])
    first, last = begins[apart[:-1]], begins[apart[1:]] + WINDOW
    doc = doc[apart[:-1]]
    n_spans = np.bincount(doc, minlength=len(sizes))
    n_removed = np.bincount(doc, weights=last - first, minlength=len(sizes)).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[first] += 1
    edge[last] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8) == 0]
    offsets = lambda n: pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    origin = (ends - sizes)[doc]
    spans = [pa.ListArray.from_buffers(pa.list_(pa.int64()), len(sizes), [None, offsets(n_spans)], children=[pa.array(x - origin)]) for x in (first, last)]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes), pa.array(n_removed), pa.array(n_spans, pa.int64()),
         pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets(sizes - n_removed), pa.py_buffer(kept)]), *spans],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "starts", "ends"])


def cut_texts(anchor_bits: int, window_bits: int):
    """Cogroup function: a block with both kinds of answers to its documents' spans and remaining bytes."""

    def cut(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        first = answers.filter(pc.is_valid(answers.column("bits")))
        second = answers.filter(pc.is_valid(answers.column("masks")))
        below = pc.less(second.column("bucket"), 0)
        second, third = second.filter(pc.invert(below)), second.filter(below)
        third = third.set_column(third.schema.get_field_index("bucket"), "bucket", pc.subtract(-1, third.column("bucket")))
        for r in range(block.num_rows):
            data, sizes = np.frombuffer(block.column("text")[r].as_buffer(), np.uint8), np.frombuffer(block.column("sizes")[r].as_buffer(), np.int64)
            starts, counts, _, _, lead, (single, keys, earliest, _) = _chosen(data, sizes, first, anchor_bits)
            later = np.zeros(len(keys), bool)
            for buffer, (_, i, j) in zip(_ordered(third, "masks"), slices(keys, window_bits)):
                later[i:j] = np.unpackbits(np.frombuffer(buffer, np.uint8))[:j - i].astype(bool)
            # all but the block's first of equal windows start earlier there
            again = np.ones(len(single), bool)
            again[earliest] = later
            masks = _ordered(second, "masks")
            mask = np.full(len(starts), np.uint64(2**64 - 1), np.uint64)  # repeats inside the block start earlier there
            if masks:
                mask[lead] = np.frombuffer(b"".join(masks), np.uint64)
            seg = np.repeat(np.arange(len(starts)), counts)
            inner = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = (mask[seg] >> inner.astype(np.uint64)) & np.uint64(1) == 1
            begins = np.zeros(len(data), bool)
            begins[starts[seg[hit]] + inner[hit]] = True
            begins[single[again]] = True
            out.append(_cut_block(block.column("ids")[r].values, data, sizes, np.nonzero(begins)[0]))
        return pa.Table.from_batches(out)

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (bytes), starts and ends of the removed spans."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    blocks = materialize_bucketed(rows.mapInArrow(make_blocks, BLOCKS), "blocks", "block", bucket_count(docs))
    total = blocks.agg(F.sum("n_bytes").alias("n")).first().n or 0
    anchor_bits, bits = key_bits(total // 26, 1_000_000, least), key_bits(total, BUCKET, least)
    anchors = blocks.select("block", "sizes", "text").mapInArrow(send_anchors(anchor_bits), "bucket long, block long, keys binary, counts binary")
    repeated = materialize(anchors.groupBy("bucket").applyInArrow(find_repeated(hot), "block long, bucket long, n_hot long, bits binary, hot binary"), "repeated")
    windows = SPAN * (repeated.agg(F.sum("n_hot").alias("n")).first().n or 0)
    window_bits = key_bits(windows, WINDOWS, min(least, windows // FEW_WINDOWS))
    first = repeated.select(F.col("block").alias("to"), "bucket", "bits", "hot")
    sent = blocks.groupBy("block").cogroup(first.groupBy("to")).applyInArrow(
        send_segments(anchor_bits, bits, window_bits), "bucket long, block long, text binary, counts binary, places binary, docs binary")
    sorted_ = materialize(sent.groupBy("bucket").applyInArrow(sort_bucket, "block long, bucket long, masks binary"), "masks")
    none = F.lit(None).cast("binary")
    answers = repeated.select(F.col("block").alias("to"), "bucket", "bits", "hot", none.alias("masks")).union(
        sorted_.select(F.col("block").alias("to"), "bucket", none.alias("bits"), none.alias("hot"), "masks"))
    return blocks.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(cut_texts(anchor_bits, window_bits), CUT)

