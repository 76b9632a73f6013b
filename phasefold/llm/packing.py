"""Packing by cutting-stock column generation.

Documents become token ids with an end id.  A document's whole multiples of the
capacity are sequences of their own; what is left over is an item of a length
class (lengths rounded up to ``class_tokens``).  The histogram of classes, a
table of bounded size, goes to the driver, where a linear program over packing
patterns is solved by column generation: a revised simplex whose new columns
come from an unbounded-knapsack dynamic program on the dual prices.  The pattern
counts are rounded down, then up greedily while items last.  Patterns that would
leave more than ``max_waste`` of a sequence empty are not used.

Where all ids are below 65 536 they travel as two bytes each and get four in the result only.

Items are ranked inside their class without any global sort (ranks within an
input split plus offsets from a count table), so item k of a class finds its
pattern, sequence and slot from a small interval table.  Items without a slot
form one stream that is cut exactly at the capacity; the stream's end is cut at
powers of two, which need no padding.  Only the assignment rows are shuffled
with the ids; sequences differ from full only by the patterns' small waste.

Defined results: a null or empty text is its end id alone; repeated rows and
ids are separate documents; an empty table gives no pieces; other columns are
ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from phasefold.llm.common import materialize

#: Words a worker keeps encoded between batches; beyond, the store starts anew.
KEPT_WORDS = 1_000_000
_STORES: dict[tuple[str, str], dict] = {}


#: Byte-level vocabularies write a byte as this character: printable ones as themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(tokenizer) -> str:
    """Unsigned little-endian integers that hold every id of the tokenizer: two bytes if they do, else four."""
    return "<u2" if max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "<u4"


class _Words(dict):
    """ASCII-lower-case word to its ids as ``id_type``, encoded on first sight."""

    def __init__(self, path: str, kind: str):
        super().__init__()
        self.tokenizer, self.kind = _tokenizer(path), kind
        self.tokenizer.encode_special_tokens = True
        # a plain word needs no normalising and is one piece, so the merges alone give its ids; if they do for this file
        self.merge = self.tokenizer.model.tokenize
        self.plain = all(self._merged(w.encode()) == self._whole(w) for w in ("the", "thanedble", "straße", "été", "λόγος"))

    def _merged(self, word: bytes) -> list[int]:
        return [t.id for t in self.merge(word.decode("latin-1").translate(BYTE_CHARS))]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        text = word.decode()
        if self.plain and text.isalpha() and (text.isascii() or (text == text.lower() and unicodedata.is_normalized("NFC", text))):
            ids = np.asarray(self._merged(word), self.kind).tobytes()
        else:
            # marks after a letter or digit are tokens of their own, so a word is encoded once for all endings
            core = word.rstrip(b".,!?;:")
            if core and core != word and core.decode()[-1].isalnum():
                ids = self[core] + self[word[len(core):]]
            else:
                ids = np.asarray(self._whole(text), self.kind).tobytes()
        self[word] = ids
        return ids


def encoder(path: str, end_id: int | None, by_word: bool, kind: str):
    """Arrow function: (row, doc_id, text) to (row, doc_id, n_tokens, ids of type ``kind``).

    ``by_word``: the tokenizer ignores case, drops white space and joins nothing across it, nor across the end of a run of
    letters or digits; so ids of ASCII-lower-cased words can be kept and joined.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _STORES.get((path, kind))
        if store is None:
            store = _STORES[path, kind] = _Words(path, kind)
        width = np.dtype(kind).itemsize
        end = b"" if end_id is None else np.asarray([end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text in part.column("text").to_pylist():
                    if by_word:
                        out.append(b"".join(map(store.__getitem__, (text or "").encode().lower().split())) + end)
                    else:
                        out.append(np.asarray(store.tokenizer.encode(text or "", add_special_tokens=False).ids, kind).tobytes() + end)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array([len(x) // width for x in out], pa.int64()), pa.array(out, pa.binary())],
                    names=["row", "doc_id", "n_tokens", "ids"])

    return encode


def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with two-byte ``ids`` as four-byte ones."""
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        column = batch.column(at).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
        data = b"" if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].tobytes()
        ids = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(((offsets - offsets[0]) * 2).tobytes()), pa.py_buffer(np.frombuffer(data, "<u2").astype("<u4"))])
        yield batch.set_column(at, "ids", ids.cast(pa.binary()))


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of sizes within the capacity."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    useful = np.nonzero(prices > 1e-12)[0]
    useful = useful[np.argsort(sizes[useful])]
    s, p = sizes[useful], prices[useful]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if fits[c]:
            total = p[:fits[c]] + value[c - s[:fits[c]]]
            i = int(np.argmax(total))
            if total[i] > value[c] + 1e-15:
                value[c], pick[c] = total[i], useful[i]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(value[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 20, gap: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and their fractional use: the linear program by column generation.

    Stops when the best new column shows that the plan is within the share ``gap`` of the optimum (Farley's bound).  At
    most ``max_rounds`` x len(sizes) columns are priced; every basis on the way is a feasible plan.
    """
    m = len(sizes)
    patterns = np.diag(np.maximum(1, capacity // sizes)).astype(np.float64)  # columns of the basis
    inverse = np.diag(1.0 / np.diag(patterns))
    use = inverse @ demand
    for _ in range(max_rounds * m):
        prices = inverse.sum(axis=0)
        value, column = best_pattern(prices, sizes, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ column
        rows = np.nonzero(direction > 1e-9)[0]
        if not len(rows):
            break
        ratio = use[rows] / direction[rows]
        out = rows[int(np.argmin(ratio))]
        step = ratio.min()
        use -= step * direction
        use[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        patterns[:, out] = column
    return patterns.T.astype(np.int64), np.maximum(use, 0.0)


def integer_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_waste: float) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of sequences per pattern that never use more items than there are."""
    if not len(sizes):
        return []
    patterns, use = cutting_stock(sizes, demand.astype(np.float64), capacity)
    tight = patterns @ sizes >= (1 - max_waste) * capacity
    patterns, use = patterns[tight], use[tight]
    left, plan = demand.astype(np.int64).copy(), []
    largest, closest = np.argsort(-use, kind="stable"), np.argsort(np.floor(use) - use, kind="stable")
    for order, most in ((largest, np.floor(use + 1e-9)), (closest, np.ones(len(use))), (closest, np.full(len(use), np.inf))):
        for i in order:
            used = patterns[i] > 0
            n = int(min((left[used] // patterns[i][used]).min(), most[i])) if used.any() else 0
            if n > 0:
                left -= n * patterns[i]
                plan.append((patterns[i], n))
    return plan


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None, by_word: bool, id_col: str, text_col: str, kind: str = "<u4") -> DataFrame:
    """Written once: part (input split), row, doc_id, n_tokens, ids of type ``kind``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    ids = rows.mapInArrow(encoder(tokenizer, end_id, by_word, kind), "row long, doc_id long, n_tokens long, ids binary")
    return materialize(ids.select(F.shiftright("row", 33).alias("part"), "row", "doc_id", "n_tokens", "ids"), "tokens")


def assign_pieces(lengths: DataFrame, capacity: int = 2048, class_tokens: int = 16, max_waste: float = 0.01) -> DataFrame:
    """``lengths``: part, row, n_tokens.  Pieces: row, start, length, sequence_id, offset."""
    spark = lengths.sparkSession
    lengths = lengths.filter("n_tokens > 0").select(
        "part", "row", F.floor(F.col("n_tokens") / capacity).alias("whole"), (F.col("n_tokens") % capacity).alias("rest"))
    lengths = lengths.withColumn("class", F.ceil(F.col("rest") / class_tokens).cast("int"))
    # how many items of a class, whole sequences and loose tokens the splits before hold
    counts = materialize(lengths.groupBy("part", "class").agg(F.count("*").alias("n"), F.sum("rest").alias("tokens"), F.sum("whole").alias("wholes")), "lengths")
    ahead = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "class", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_before"))
    wholes = counts.groupBy("part").agg(F.sum("wholes").alias("w")).select("part", F.coalesce(F.sum("w").over(splits), F.lit(0)).alias("w_before"))
    histogram = [r for r in counts.filter("class > 0").groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect()]  # at most capacity / class_tokens rows
    n_whole = counts.agg(F.sum("wholes").alias("w")).first().w or 0
    units = capacity // class_tokens
    sizes, demand = np.array([r["class"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64)
    slots, taken, n_sequences = [], dict.fromkeys(sizes.tolist(), 0), 0
    for pattern, n in integer_plan(sizes, demand, units, max_waste):
        place = 0
        for i in np.nonzero(pattern)[0]:
            c, a = int(sizes[i]), int(pattern[i])
            slots.append((c, taken[c], taken[c] + n * a, n_sequences, a, place))
            taken[c] += n * a
            place += a
        n_sequences += n
    slot_table = F.broadcast(spark.createDataFrame(slots, "s_class int, from long, upto long, first long, copies long, place long"))
    by_class = F.broadcast(spark.createDataFrame(list(taken.items()), "t_class int, taken long"))

    inside = Window.partitionBy("part", "class").orderBy("row")
    along = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ranked = lengths.join(before, ["part", "class"]).join(wholes, "part")
    ranked = ranked.select("part", "row", "whole", "rest", "class", (F.row_number().over(inside) - 1 + F.col("n_before")).alias("rank"),
                           (F.col("w_before") + F.sum("whole").over(along) - F.col("whole")).alias("w_first"))
    ranked = materialize(ranked, "ranked")
    full = ranked.filter("whole > 0").select("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("i"), "w_first").select(
        "row", (F.col("i") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("length"), (F.col("w_first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    items = ranked.filter("rest > 0")
    hit = (F.col("class") == F.col("s_class")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto"))
    idx = F.col("rank") - F.col("from")
    slotted = items.join(slot_table, hit).select(
        "row", (F.col("whole") * capacity).alias("start"), F.col("rest").alias("length"), (n_whole + F.col("first") + F.floor(idx / F.col("copies"))).alias("sequence_id"),
        (F.col("place") + idx % F.col("copies")).alias("slot"))
    order = Window.partitionBy("sequence_id").orderBy("slot")
    slotted = slotted.select("row", "start", "length", "sequence_id", (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"))

    # items without a slot: one stream, ordered by split and row, cut at the capacity and at its end at powers of two
    loose = items.join(by_class, F.col("class") == F.col("t_class")).filter("rank >= taken")
    loose = materialize(loose.select("part", "row", "whole", "rest"), "loose")
    ahead_of = loose.groupBy("part").agg(F.sum("rest").alias("t")).select("part", F.coalesce(F.sum("t").over(splits), F.lit(0)).alias("t_before"))
    total = loose.agg(F.sum("rest").alias("t")).first().t or 0
    stream = loose.join(ahead_of, "part").select("row", (F.col("whole") * capacity).alias("base"), "rest", (F.col("t_before") + F.sum("rest").over(along) - F.col("rest")).alias("at"))
    cuts, end = [], total // capacity * capacity
    for bit in reversed(range(capacity.bit_length() - 1)):
        if (total - total // capacity * capacity) >> bit & 1:
            cuts.append((end, end + (1 << bit)))
            end += 1 << bit
    regular = total // capacity
    spans = stream.filter(F.col("at") < regular * capacity).select(
        "*", F.explode(F.sequence(F.floor(F.col("at") / capacity), F.floor((F.least(F.col("at") + F.col("rest"), F.lit(regular * capacity)) - 1) / capacity))).alias("s")).select(
        "row", "base", "rest", "at", F.col("s"), (F.col("s") * capacity).alias("lo"), ((F.col("s") + 1) * capacity).alias("hi"))
    for i, (lo, hi) in enumerate(cuts):
        spans = spans.union(stream.filter((F.col("at") < hi) & (F.col("at") + F.col("rest") > lo)).select(
            "row", "base", "rest", "at", F.lit(regular + i).cast("bigint").alias("s"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi")))
    first, last = F.greatest("at", "lo"), F.least(F.col("at") + F.col("rest"), F.col("hi"))
    streamed = spans.select("row", (F.col("base") + first - F.col("at")).alias("start"), (last - first).alias("length"),
                            (F.lit(n_whole + n_sequences) + F.col("s")).alias("sequence_id"), (first - F.col("lo")).alias("offset"))
    return full.union(slotted).union(streamed)


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 1, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 2048, class_tokens: int = 16, max_waste: float = 0.01) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    kind = id_type(_tokenizer(tokenizer)) if (end_id or 0) < 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    tokens = token_table(docs, tokenizer, end_id, by_word, id_col, text_col, kind)
    pieces = assign_pieces(tokens.select("part", "row", "n_tokens"), capacity, class_tokens, max_waste)
    per_row = pieces.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    joined = tokens.join(per_row, F.col("row") == F.col("r")).select("doc_id", "n_tokens", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", (F.col("p.start") * width + 1).cast("int"), (F.col("p.length") * width).cast("int"))
    packed = joined.select("doc_id", "p.start", "p.length", F.col("n_tokens").alias("doc_tokens"), "p.sequence_id", "p.offset", ids.alias("ids"))
    return packed if width == 4 else packed.mapInArrow(widened, packed.schema)
