"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

* Features: a text's letters, lower-cased, other runs replaced by one space; its
  1- to ``ORDER``-grams of characters hashed to 2^BITS slots.  A feature is the
  slot's share of the text's n-grams times ln((1 + N) / (1 + df)) + 1, scaled to
  unit length.  Document frequencies cover all training documents.
* Training: follow-the-regularised-leader with elastic-net penalties (a weight is
  zero until its summed gradients exceed ``l1``, so the model is sparse).  It
  runs on a sample of at most about ``per_class`` documents of each language (all
  of them, if there are fewer; whole texts).  The sample is dealt to ``shards``;
  in each round every shard goes on from the common state, and the shards' summed
  gradients are averaged, so no task or driver holds more than one shard's batch.
* Calibration: a tenth of the sample is kept out of training; the temperature that
  minimises its log loss, found on a grid that is narrowed twice, divides the
  scores of every prediction.

The model is a table of at most languages x 2^BITS weights; this bound is what is
sent to tasks.  Predictions read texts only.

Defined results: null or empty text, or text without a letter, is ``und`` with
score 0; documents without language, or with a null id, are never learnt from;
without training documents everything is ``und``; repeated rows are predicted
alike; ties go to the language that comes first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phasefold.llm.blocks import small_batches
from phasefold.llm.common import materialize
from phasefold.llm.kernels import text_buffers

BITS = 15
ORDER = 3
UNDETERMINED = "und"
#: Documents whose slots are counted, or whose features are held, at once.
BATCH = 32


@dataclass(frozen=True)
class Settings:
    """``alpha``, ``beta``: step sizes; ``l1``, ``l2``: elastic net; ``per_class``: bound of the sample, in documents a language."""

    per_class: int = 10_000
    shards: int = 8
    rounds: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    report: dict = field(default_factory=dict)


def letters(text: Column) -> Column:
    """Lower-cased letters (with their marks); every other run is one space, one at either end; empty without a letter."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")
    return F.when(has_letter(text), F.concat(F.lit(" "), F.trim(bare), F.lit(" "))).otherwise("")


def has_letter(text: Column) -> Column:
    """False for a null text; looks no further than the first letter."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of a batch of UTF-8 texts, grouped by text, and each text's number of n-grams."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    slots, rows, rolled = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, ORDER + 1):
        m = max(0, len(points) - n + 1)
        rolled = (rolled[:m] + points[n - 1:n - 1 + m] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        inside = row[:m] == row[n - 1:n - 1 + m]
        slots.append((rolled[inside] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[:m][inside])
    slots, rows = np.concatenate(slots), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return slots[order], np.bincount(rows, minlength=len(sizes))


def features(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a few texts and their TF-IDF values: (slots, matrix slots x texts with columns of unit length)."""
    slots, counts = slots_of(data, offsets)
    n = len(counts)
    used = np.zeros(1 << BITS, bool)
    used[slots] = True
    found = np.nonzero(used)[0]
    place = np.cumsum(used) - 1
    matrix = np.bincount(place[slots] * n + np.repeat(np.arange(n), counts), minlength=len(found) * n).reshape(len(found), n) * idf[found][:, None]
    return found, matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=0)), 1e-300)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's texts, one packed row; the last entry counts the texts."""
    total = np.zeros((1 << BITS) + 1, np.int64)
    for batch in _few(batches):
        slots, counts = slots_of(*text_buffers(batch.column("text")))
        n = len(counts)
        held = np.zeros(n << BITS, bool)
        held[(np.repeat(np.arange(n), counts) << BITS) + slots] = True
        total[:-1] += held.reshape(n, -1).sum(axis=0)
        total[-1] += n
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["packed"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Frequencies of all slots over all rows, then the number of rows; partial sums meet in 64 groups, then in one of 64 rows."""
    packed = texts.mapInArrow(_frequencies, "packed binary").withColumn("part", F.spark_partition_id() % 64)

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"packed": [sum(np.frombuffer(b, np.int64) for b in frame["packed"]).tobytes()]})

    rows = packed.groupBy("part").applyInPandas(add, "packed binary").collect()
    return sum((np.frombuffer(r.packed, np.int64) for r in rows), np.zeros((1 << BITS) + 1, np.int64))


def ftrl_weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Closed form of the regularised leader: zero inside the l1 ball."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=0, keepdims=True))
    return e / e.sum(axis=0, keepdims=True)


def _learn(model: Model, z: np.ndarray, n: np.ndarray, s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over a shard from the common state; yields the shard's state, one packed row a language.  The last slot is the bias."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zs, ns, seen = z.copy(), n.copy(), 0
        for batch in _few(batches):
            found, x = features(*text_buffers(batch.column("text")), model.idf)
            cells = np.append(found, 1 << BITS)
            x = np.vstack([x, np.ones(x.shape[1])])
            w = ftrl_weights(zs[:, cells], ns[:, cells], s)
            p = softmax(w @ x)
            p[batch.column("label").to_numpy(), np.arange(x.shape[1])] -= 1.0
            g = p @ x.T
            step = (np.sqrt(ns[:, cells] + g * g) - np.sqrt(ns[:, cells])) / s.alpha
            zs[:, cells] += g - step * w
            ns[:, cells] += g * g
            seen += batch.num_rows
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(zs)), pa.int32()), pa.array([r.tobytes() for r in zs], pa.binary()), pa.array([r.tobytes() for r in ns], pa.binary())],
                                             names=["label", "z", "n"])

    return learn


def _mean_state(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    mean = lambda c: np.mean([np.frombuffer(b) for b in sorted(frame[c])], axis=0).tobytes()
    return pd.DataFrame({"label": [key[0]], "z": [mean("z")], "n": [mean("n")]})


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores before calibration, languages x texts."""
    found, x = features(*text_buffers(texts), model.idf)
    return model.weights[:, found] @ x + model.bias[:, None]


def _score_rows(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(_scores(model, batch.column("text")).T.tolist(), pa.list_(pa.float64()))], names=["label", "scores"])

    return score


def calibrate(held: DataFrame, rounds: int = 3, points: int = 17) -> float:
    """Temperature of least log loss of rows (label, scores), as if one more row of n + 2 were mistaken.

    Without that a fold without mistakes would ask for certainty.
    """
    n, n_classes = held.agg(F.count("*"), F.max(F.size("scores"))).head()
    if not n or n_classes < 2:
        return 1.0
    doubt = 1.0 / (n + 2)
    aim = F.expr(f"{1 - doubt!r}D * scores[label] + {doubt / (n_classes - 1)!r}D * (aggregate(scores, 0D, (s, x) -> s + x) - scores[label])")
    rows = held.withColumns({"top": F.array_max("scores"), "aim": aim})
    centre, width = 0.0, np.log(50.0)
    for _ in range(rounds):
        grid = np.exp(np.linspace(centre - width, centre + width, points))
        loss = [F.avg(F.expr(f"ln(aggregate(scores, 0D, (s, x) -> s + exp((x - top) / {t!r}D))) - (aim - top) / {t!r}D")).alias(f"t{i}") for i, t in enumerate(grid.tolist())]
        centre, width = float(np.log(grid[int(np.argmin(rows.agg(*loss).head()))])), 2 * width / (points - 1)
    return float(np.exp(centre))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings = Settings()) -> Model | None:
    """A model of the rows with a language and a letter; None if there are none."""
    s = settings
    draw = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(F.col(lang_col).cast("string").alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    frequencies = document_frequencies(rows.select(letters(F.col("text")).alias("text")))
    idf = np.log((1.0 + frequencies[-1]) / (1.0 + frequencies[:-1])) + 1.0
    # one row a language: its number and the share of its documents that is drawn
    rates = docs.sparkSession.createDataFrame([(x, i, min(1.0, s.per_class / sizes[x])) for i, x in enumerate(languages)], "lang string, label int, rate double")
    drawn = rows.join(F.broadcast(rates), "lang").filter(F.pmod("draw", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    fold = F.pmod(F.shiftright("draw", 20), F.lit(10 * s.shards))
    sample = materialize(drawn.select("label", letters(F.col("text")).alias("text"), fold.alias("fold"), "draw"), "sample")
    learnt = sample.filter(F.col("fold") >= s.shards).repartition(s.shards, F.pmod("fold", F.lit(s.shards))).sortWithinPartitions("draw", "text").select("label", "text")
    z, n = np.zeros((len(languages), (1 << BITS) + 1)), np.zeros((len(languages), (1 << BITS) + 1))
    model = Model(languages, idf, np.zeros((len(languages), 1 << BITS)), np.zeros(len(languages)))
    for _ in range(s.rounds):
        states = learnt.mapInArrow(_learn(model, z, n, s), "label int, z binary, n binary").groupBy("label").applyInPandas(_mean_state, "label int, z binary, n binary")
        for r in states.collect():
            z[r.label], n[r.label] = np.frombuffer(r.z), np.frombuffer(r.n)
    w = ftrl_weights(z, n, s)
    model.weights, model.bias = w[:, :-1], w[:, -1]
    held = materialize(sample.filter(F.col("fold") < s.shards).select("label", "text").mapInArrow(_score_rows(model), "label int, scores array<double>"), "held")
    model.temperature = calibrate(held)
    model.report = {"documents": int(frequencies[-1]), "nonzero": int(np.count_nonzero(model.weights)), "temperature": model.temperature}
    return model


def model_table(spark, model: Model) -> DataFrame:
    """The sparse weights as rows: lang, slot, weight; slot -1 is the bias."""
    which, slots = np.nonzero(model.weights)
    frame = pd.DataFrame({"lang": [model.languages[i] for i in which] + model.languages, "slot": np.append(slots, [-1] * len(model.languages)),
                          "weight": np.append(model.weights[which, slots], model.bias)})
    return spark.createDataFrame(frame, "lang string, slot long, weight double")


def _predict_rows(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            p = softmax(_scores(model, batch.column("text")) / model.temperature)
            best, top = p.argmax(axis=0), p.max(axis=0)
            known = np.diff(text_buffers(batch.column("text"))[1]) > 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.languages[i] if k else UNDETERMINED for i, k in zip(best, known)], pa.string()),
                                              pa.array(np.where(known, top, 0.0))], names=["doc_id", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text decides."""
    ids = F.col(id_col).cast("bigint").alias("doc_id")
    if model is None:
        return docs.select(ids, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.select(ids, letters(F.col(text_col)).alias("text")).mapInArrow(_predict_rows(model), "doc_id long, lang_pred string, score double")
