"""Token counts by section: offset-mapped attribution.

A whole document is encoded once; a byte-level vocabulary loses nothing, so the
lengths of its tokens' bytes give every token's byte span.  Sections (or fields)
are byte spans of the same text.  Both lists are sorted, so the interval join is
one merge by binary search inside the task that holds the document.  A token
that crosses a boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first byte;
* ``end``: to the section that holds its last byte;
* ``longest``: to the section that holds most of its bytes, the first on ties;
* ``share``: to every section by its part of the token's bytes.

Section counts of a document always add up to its token count.

Defined results: a null or empty text has one empty section without tokens;
repeated rows are counted each; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RULES = ("start", "end", "longest", "share")
#: Words split by this pattern are encoded on their own (fixed value, belongs to the vocabulary file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, tuple] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODERS[path]


def line_starts(text: bytes, separator: bytes = b"\n") -> np.ndarray:
    """Sections are the pieces between separators; a separator belongs to the section it ends."""
    return np.array([0, *(m.end() for m in re.finditer(re.escape(separator), text))], np.int64)


def allocate(token_sizes: np.ndarray, starts: np.ndarray, n_bytes: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens that touch it cross one of its boundaries."""
    n = len(starts)
    if not len(token_sizes):
        return np.zeros(n), np.zeros(n, np.int64)
    ends = np.cumsum(token_sizes)
    begins = ends - token_sizes
    # empty sections share a start with the next one; the last of them holds the bytes
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    crossing = np.nonzero(first != last)[0]
    touched = np.zeros(n + 1, np.int64)
    np.add.at(touched, first[crossing], 1)
    np.add.at(touched, last[crossing] + 1, -1)
    crosses = np.cumsum(touched[:-1])
    if rule in ("start", "end") or not len(crossing):
        return np.bincount(first if rule != "end" else last, minlength=n).astype(float), crosses
    counts = np.bincount(first[first == last], minlength=n).astype(float)
    upper = np.append(starts[1:], n_bytes)
    for t in crossing.tolist():
        span = np.arange(first[t], last[t] + 1)
        inside = np.minimum(upper[span], ends[t]) - np.maximum(starts[span], begins[t])
        if rule == "share":
            counts[span] += inside / token_sizes[t]
        else:
            counts[span[int(np.argmax(inside))]] += 1
    return counts, crosses


COUNTED = "doc_id long, section long, start long, n_bytes long, tokens double, crossing long, doc_tokens long"


def counter(path: str, rule: str, separator: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                ids = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    raw = (text or "").encode()
                    token_sizes = sizes[encoding.encode_to_numpy(text or "", disallowed_special=())]
                    starts = line_starts(raw, separator.encode())
                    counts, crosses = allocate(token_sizes, starts, len(raw), rule)
                    n = len(starts)
                    ids += [doc] * n
                    for column, values in zip(columns, (np.arange(n), starts, np.diff(np.append(starts, len(raw))), counts, crosses, np.full(n, len(token_sizes)))):
                        column.append(values)
                joined = [np.concatenate(c) for c in columns]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(v, t) for v, t in zip(joined, types)]],
                                                 names=["doc_id", "section", "start", "n_bytes", "tokens", "crossing", "doc_tokens"])

    return count


def section_tokens(docs: DataFrame, vocabulary: str, rule: str = "longest", separator: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section (from 0), start, n_bytes, tokens, crossing, doc_tokens.

    ``vocabulary``: path of a byte-level rank file.  A text's sections lie between separators.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counter(vocabulary, rule, separator), COUNTED)


def field_tokens(rows: DataFrame, fields: list[str], vocabulary: str, rule: str = "longest", id_col: str = "doc_id") -> DataFrame:
    """Tokens of several text columns of a record, encoded together as one document with the fields on lines of their own.

    A field's own line breaks are spaces here, so that line i is field i: doc_id, field, and the columns of ``section_tokens``.
    """
    joined = F.concat_ws("\n", *[F.replace(F.coalesce(F.col(f"`{f}`"), F.lit("")), F.lit("\n"), F.lit(" ")) for f in fields])
    names = F.array(*[F.lit(f) for f in fields])
    counted = section_tokens(rows.select(F.col(id_col).alias("doc_id"), joined.alias("text")), vocabulary, rule)
    return counted.withColumn("field", F.element_at(names, (F.col("section") + 1).cast("int")))
