"""Filter interaction audit: what each filter removes on its own, after others, and on average over all orders.

Every document gets a mask of the filters it fails.  One of the filters is
"the same text as a document of smaller id", which needs all texts compared:

1. Blocks of documents go into compressed (radix) tries; a terminal holds the
   smallest id of its text, so of the copies inside a block only one text is
   sent on, whatever the size of a group of copies.
2. Texts are range-partitioned by adaptive prefixes: a prefix whose texts
   outweigh ``limit`` bytes is replaced by four times longer ones, until it fits
   or its texts are one and the same.  Memory is bounded by a prefix's texts.
3. Each range is inserted in a trie; its traversal yields, for every terminal
   reached from several blocks, the blocks whose own smallest id is not the
   table's.
4. Rows take that correction by (block, node), get their last bit, meet their
   labels, and are reduced to one count per part and mask: at most 2^filters rows
   a part, from which every order's steps follow.

Defined results: a null text is empty and equals other empty texts; rows of equal
id and text are not duplicates of each other; a null id is neither smaller nor
larger than another; a null part is the empty string; labels count if any row of
the id says 1; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phasefold.llm import kernels
from phasefold.llm.blocks import small_batches, text_blocks
from phasefold.llm.common import materialize
from phasefold.session import small_side

#: Texts of one block, and of one prefix range, in bytes.
BLOCK = 16 << 20
LIMIT = 16 << 20
DUPLICATE = "E"
SYMBOLS = "#$%&*|"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_INVERSES = np.zeros(0, np.uint64)
#: Failures of a batch of texts by filter, given their bytes and row offsets.
Filters = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) <= n:
        _INVERSES = kernels.powers(kernels.INVERSE, n + 1)
    return _INVERSES


def conditions(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The four filters on a text alone, for all texts of a batch (their bytes and row offsets); true is a failure.

    Words are told apart by a 64-bit hash.
    """
    starts, ends, n_words = kernels.words(data, offsets)
    prefix = kernels.prefix_hashes(data)
    hashes = (prefix[ends] - prefix[starts]) * _inverse_powers(len(data))[starts]
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    fresh = np.ones(len(hashes), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashes[a:b].sort()
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[bounds[:-1][n_words > 0]] = True
    n_distinct = np.diff(np.concatenate([[0], np.cumsum(fresh)])[bounds])

    def per_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.nonzero(marks)[0], offsets))

    n_chars = np.diff(offsets) - per_text((data & 0xC0) == 0x80)
    capitals = per_text((data >= 65) & (data <= 90))
    return {"A": n_words < 100, "B": 100 * n_distinct < 80 * n_words, "C": 100 * capitals > 10 * n_chars, "D": per_text(_IS_SYMBOL[data]) > 0}


class RadixTrie:
    """Compressed trie of byte strings.  A node is [edge, children by first byte, terminal or -1]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, -1]
        self.lowest: list[int | None] = []

    def insert(self, text: bytes, key: int | None) -> int:
        """The text's terminal, which keeps the smallest of its keys; a null key keeps nothing out."""
        terminal = self._reach(text)
        low = self.lowest[terminal]
        if key is not None and (low is None or key < low):
            self.lowest[terminal] = key
        return terminal

    def _reach(self, text: bytes) -> int:
        node, at, size = self.root, 0, len(text)
        while at < size:
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, -1]
            elif not text.startswith(child[0], at):
                edge, cut = child[0], _shared(child[0], text, at)
                child = node[1][text[at]] = [edge[:cut], {edge[cut]: child}, -1]
                child[1][edge[cut]][0] = edge[cut:]
            node, at = child, at + len(child[0])
        if node[2] < 0:
            node[2] = len(self.lowest)
            self.lowest.append(None)
        return node[2]

    def traverse(self) -> Iterator[tuple[bytes, int]]:
        """(text, terminal) in the order of the texts' bytes."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            text = above + node[0]
            if node[2] >= 0:
                yield text, node[2]
            stack.extend((node[1][first], text) for first in sorted(node[1], reverse=True))


def _shared(edge: bytes, text: bytes, at: int) -> int:
    """Length of the longest common prefix of ``edge`` and ``text[at:]``."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


PLACED = "doc_id long, part string, mask int, low long, block long, node int, text binary"


def _masks(table: pa.Table, filters: Filters) -> np.ndarray:
    masks = []
    for batch in small_batches(table.to_batches()):
        masks.append(np.zeros(batch.num_rows, np.int32))
        for i, failed in enumerate(filters(*kernels.text_buffers(batch.column("text"))).values()):
            masks[-1] |= failed.astype(np.int32) << i
    return np.concatenate(masks)


def _block_tries(filters: Filters, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their mask, their block's terminal and its smallest id; the text only at the first row of a terminal."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in text_blocks(batches, block_bytes):
            trie, seen, nodes, texts = RadixTrie(), -1, [], []
            for text, key in zip(table.column("text").to_pylist(), table.column("doc_id").to_pylist()):
                nodes.append(trie.insert(text, key))
                texts.append(text if nodes[-1] > seen else None)
                seen = max(seen, nodes[-1])
            columns = [table.column(c).combine_chunks() for c in ("doc_id", "part")]
            columns += [pa.array(_masks(table, filters)), pa.array([trie.lowest[n] for n in nodes], pa.int64()), pa.array([block] * len(nodes), pa.int64()),
                        pa.array(nodes, pa.int32()), pa.array(texts, pa.binary())]
            whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "low", "block", "node", "text"])
            for at in range(0, whole.num_rows, 2048):
                yield whole.slice(at, 2048)

    return place


def _range_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix; a trie a prefix.  Yields (block, node, lowest) where another block holds a smaller id."""
    prefix, trie, held = None, RadixTrie(), (array("q"), array("q"), array("q"), array("q"))
    for batch in batches:
        for key, text, block, node, low in zip(*[batch.column(c).to_pylist() for c in ("prefix", "text", "block", "node", "low")]):
            if key != prefix:
                yield from _corrections(trie, held)
                prefix, trie, held = key, RadixTrie(), (array("q"), array("q"), array("q"), array("q"))
            # blocks send the smallest id of a text, or null where it has no id at all
            for column, value in zip(held, (trie.insert(text, low), block, node, -(1 << 63) if low is None else low)):
                column.append(value)
    yield from _corrections(trie, held)


def _corrections(trie: RadixTrie, held: tuple[array, array, array, array]) -> Iterator[pa.RecordBatch]:
    if len(held[0]) == len(trie.lowest):  # no text came from two blocks
        return
    lowest = [trie.lowest[t] for _, t in sorted(trie.traverse(), key=lambda found: found[1])]
    out = [(block, node, lowest[t]) for t, block, node, low in zip(*held) if lowest[t] is not None and lowest[t] < low]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64()))], names=["block", "node", "lowest"])


def with_prefixes(texts: DataFrame, limit: int = LIMIT, first: int = 4) -> tuple[DataFrame, int]:
    """Adds ``prefix``, whose groups hold ``limit`` bytes or less unless a single text fills them; also all texts' bytes."""
    total, length, keys = None, first, []
    prefix = F.substring("text", 1, first)
    open_rows = texts
    while True:
        weights = open_rows.groupBy(F.md5(prefix).alias("key")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest"))
        weights = materialize(weights, "prefixes")
        if total is None:
            total = weights.agg(F.sum("bytes")).head()[0] or 0
        heavy = weights.filter((F.col("bytes") > limit) & (F.col("longest") > length)).select("key")
        if heavy.isEmpty():
            break
        keys.append((length, small_side(heavy)))
        open_rows = open_rows.join(keys[-1][1], F.md5(F.substring("text", 1, length)) == F.col("key"), "left_semi")
        length *= 4
        prefix = F.substring("text", 1, length)
    out, deeper, prefix = texts, F.lit(True), F.substring("text", 1, first)
    for i, (size, heavy) in enumerate(keys):
        out = out.join(heavy.select(F.col("key").alias(f"heavy{i}")), F.when(deeper, F.md5(F.substring("text", 1, size))) == F.col(f"heavy{i}"), "left")
        deeper = F.col(f"heavy{i}").isNotNull()
        prefix = F.when(deeper, F.substring("text", 1, 4 * size)).otherwise(prefix)
    return out.select(*texts.columns, prefix.alias("prefix")), total


def names_of(filters: Filters) -> str:
    """The filters' letters, the duplicate filter's last."""
    return "".join(filters(np.zeros(0, np.uint8), np.zeros(1, np.int64))) + DUPLICATE


def failed_masks(docs: DataFrame, filters: Filters = conditions, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                 block_bytes: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, part, mask.  Bit i stands for the i-th filter, the last one for a duplicate."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    placed = materialize(rows.mapInArrow(_block_tries(filters, block_bytes), PLACED), "tries")
    sent, total = with_prefixes(placed.filter("text IS NOT NULL").select("text", "block", "node", "low"), limit)
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * limit)))
    found = sent.repartitionByRange(ranges, "prefix").sortWithinPartitions("prefix").mapInArrow(_range_tries, "block long, node int, lowest long")
    known = placed.select("doc_id", "part", "mask", "low", "block", "node").join(found, ["block", "node"], "left")
    duplicate = F.coalesce(F.col("doc_id") > F.coalesce("lowest", "low"), F.lit(False))
    return known.select("doc_id", "part", (F.col("mask") + F.when(duplicate, 1 << (len(names_of(filters)) - 1)).otherwise(0)).alias("mask"))


def interactions(masks: DataFrame, letters: str, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Steps of all orders from the masks: one row per part, filter_order and step, with the counts of the module's contract.

    ``labels``: id_col, quality and toxic (1 or else).
    """
    rows = masks.select("doc_id", "part", "mask")
    if labels is not None:
        known = labels.groupBy(F.col(id_col).alias("doc_id")).agg((F.max(F.col("quality") == 1)).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        rows = rows.join(known, "doc_id", "left")
    else:
        rows = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # at most 2^filters entries a part
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.select("part", "counts", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    before = f"aggregate(sequence(1, step), 0, (m, i) -> m | IF(i < step, shiftleft(1, instr('{letters}', substr(filter_order, i, 1)) - 1), 0))"
    steps = steps.select("part", "counts", "filter_order", F.col("step").cast("int").alias("step"), F.expr(before).alias("before"),
                         F.expr(f"shiftleft(1, instr('{letters}', substr(filter_order, step, 1)) - 1)").alias("bit"))

    def total(which: str, of: str = "n") -> Column:
        return F.expr(f"aggregate(filter(counts, c -> {which}), 0L, (s, c) -> s + c.{of})")

    here = "(c.mask & bit) != 0 AND (c.mask & before) = 0"
    out = steps.select(
        "part", "filter_order", "step", "bit",
        total("(c.mask & (before | bit)) = 0").alias("kept"), total(here).alias("removed"),
        total("(c.mask & bit) != 0 AND (c.mask & before) != 0").alias("redundant"), total("c.mask = bit").alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"))
    share = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(share, ["part", "bit"]).drop("bit")


def audit(docs: DataFrame, labels: DataFrame | None = None, filters: Filters = conditions, **options) -> DataFrame:
    """All orders of the filters and the duplicate filter, part by part."""
    return interactions(materialize(failed_masks(docs, filters, **options), "masks"), names_of(filters), labels)
