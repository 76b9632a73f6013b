"""Language-model scoring with weighted backoff, counted and weighted in exchanges between blocks and key buckets.

1. Blocks of documents are coded: every word becomes a number of the block's own
   sorted vocabulary of 64-bit word hashes.
2. One packed exchange adds up the training counts of every word of the corpus
   and sends each block the totals of its words.
3. Words with at least ``least`` training tokens are symbols; all others, unseen
   ones included, share one rare symbol, below which they keep their own exact
   counts.
   Exchanged arrays are compressed by byte significance, sorted keys as differences (``blocks.shrunk``).  Answers are
   laid out by block as the texts are, so each is shuffled once and later levels read it in place; a level's shuffle
   files go as soon as its answers are written, and the last answers are scored without being written.
4. n-grams of symbols are counted by the same exchange, level by level; an n-gram
   stays if it has at least ``least`` training tokens, whatever the size of the
   corpus, and only n-grams whose two shorter parts stay are sent to the next
   level.  A block gets the totals of its own n-grams, so the model is never in
   one place and grows with the text.
5. Absolute discounting makes probabilities, and backoff weights make every
   history sum to one.  Of the blocks that hold an n-gram one owns it and adds it
   to its history; a second exchange adds up the histories' followers (count,
   number and lower-order probability), of which each block gets its own
   histories back.  A frequent history costs one entry a block; number and probability travel only where there are
   followers.
6. Each block scores its tokens by array arithmetic.

``build_automaton`` and ``traverse`` are the same model in one piece, for small
corpora: the tests compare both.

The texts held out of training are those with ``crc32(id) % 7 = 2``.

Defined results: a null or empty text is its end token; a null id counts as an
empty string for the split; repeated rows are separate documents; without
training documents every score is that of one unknown symbol; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phasefold.llm import kernels
from phasefold.llm.blocks import distinct, key_bits, shrunk, slices, text_blocks, unshrunk
from phasefold.llm.common import bucket_count, materialize_bucketed

RARE, END, START, FIRST = 0, 1, 2, 3
SYMBOL_BITS = 20
BUCKET_KEYS = 2_000_000
#: A power of two, so that counts less discounts are exact.
DISCOUNT = 0.5
#: A history whose followers have more lower-order probability than this is followed by every symbol.
FULL = 1.0 - 1e-9
#: Keys of the three symbols that are no words, and the multiplier that joins a history's key with a symbol's.
RARE_KEY, END_KEY, START_KEY = kernels.mix64(np.array([0x52415245, 0x454E44, 0x5354415254], np.uint64))
JOIN = np.uint64(0xD6E8FEB86659FD93)
#: A bucket's number has its exchange above this bit: 2 k for n-grams of order k (words are order 1), 2 k + 1 for their histories.
KIND_BIT = 40

CODED = "block long, ids array<long>, held binary, words binary, codes binary, vocab binary, trained binary, n_vocab long, n_tokens long, train_words long, train_docs long"


def code_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) to one row per block."""
    for block, table in text_blocks(batches):
        hashes, counts = kernels.word_hashes(*kernels.text_buffers(table.column("text")))
        vocab, _, codes = distinct(hashes)
        held = table.column("held_out").to_numpy().astype(bool)
        used = np.bincount(codes[np.repeat(~held, counts)], minlength=len(vocab)).astype(np.int64)
        yield pa.RecordBatch.from_pylist([{
            "block": block, "ids": table.column("doc_id").to_pylist(), "held": shrunk(held.astype(np.uint8)), "words": shrunk(counts.astype(np.int64)),
            "codes": shrunk(codes.astype(np.int32)), "vocab": shrunk(vocab, True), "trained": shrunk(used), "n_vocab": len(vocab), "n_tokens": len(codes) + len(counts),
            "train_words": int(used.sum()), "train_docs": int((~held).sum())}], schema=_SCHEMA)


_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("held", "words", "codes", "vocab", "trained")],
                     *[(n, pa.int64()) for n in ("n_vocab", "n_tokens", "train_words", "train_docs")]])


def send_words(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocab, used in zip(batch.column("block").to_pylist(), unshrunk(batch.column("vocab"), np.uint64, True), unshrunk(batch.column("trained"), np.int64)):
                rows = [(b, block, shrunk(vocab[i:j], True), shrunk(used[i:j].astype(np.uint32))) for b, i, j in slices(vocab, bits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                                 names=["bucket", "block", "keys", "counts"])
    return send


TOTALS = "block long, bucket long, totals binary, rare_kinds long, rare_tokens long, kinds long"


def add_words(least: int):
    """Grouped Arrow function of one bucket: totals back to each block, and the bucket's statistics in a row with block -1."""

    def add(group: pa.Table) -> pa.Table:
        keys, counts = unshrunk(group.column("keys"), np.uint64, True), unshrunk(group.column("counts"), np.uint32)
        every, _, at = distinct(np.concatenate(keys))
        total = np.bincount(at, weights=np.concatenate(counts).astype(np.float64), minlength=len(every)).astype(np.int64)
        cut = np.cumsum([0, *map(len, keys)])
        answers = [shrunk(total[at[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
        rare = (total > 0) & (total < least)
        n, bucket = len(keys), group.column("bucket")[0].as_py()
        none = [None] * n
        return pa.table({
            "block": pa.array([*group.column("block").to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int64()),
            "totals": pa.array([*answers, None], pa.binary()), "rare_kinds": pa.array([*none, int(rare.sum())], pa.int64()),
            "rare_tokens": pa.array([*none, int(total[rare].sum())], pa.int64()), "kinds": pa.array([*none, int((total > 0).sum())], pa.int64())})

    return add


def ngram_keys(tokens: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram that ends at each token, -1 where the text is too short; the start symbol precedes each text."""
    previous = [tokens]
    for back in range(1, order):
        moved = np.empty_like(tokens)
        moved[1:] = previous[-1][:-1]
        # the token before a text is the start symbol, further back there is nothing
        moved[starts] = START if back == 1 else -1
        if back > 1:
            moved[1:][previous[-1][1:] == START] = -1
            moved[1:][previous[-1][1:] < 0] = -1
        previous.append(moved)
    key = np.zeros(len(tokens), np.int64)
    for p in reversed(previous):
        key = (key << SYMBOL_BITS) | np.maximum(p, 0)
    return np.where(previous[-1] < 0, -1, key)


def unmix64(x: np.ndarray) -> np.ndarray:
    """Inverse of ``kernels.mix64``."""
    def unshift(v, s):
        out = v
        for _ in range(64 // s + 1):
            out = v ^ (out >> np.uint64(s))
        return out

    x = unshift(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    x = unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return unshift(x, 30)


@dataclass
class Automaton:
    """States are histories; ``arcs`` maps state << SYMBOL_BITS | symbol to (log10 probability, next state)."""

    symbols: np.ndarray
    arcs: dict
    fail: list
    backoff: list
    rare_base: float
    base_denominator: float
    end_count: int
    n_tokens: int


def build_automaton(symbols: np.ndarray, counts: np.ndarray, ngrams: list[tuple[np.ndarray, np.ndarray]], n_docs: int, rare_tokens: int, rare_kinds: int, kinds: int) -> Automaton:
    """From symbol counts and the n-grams that stayed (order 2 first)."""
    unigram = np.zeros(FIRST + len(symbols), np.int64)
    unigram[RARE], unigram[END], unigram[FIRST:] = rare_tokens, n_docs, counts
    n = int(unigram.sum())
    p1 = unigram / (n + 1)
    p1[RARE] = (rare_tokens + 1) / (n + 1)  # the rare symbol also covers unseen words
    if n_docs == 0:
        p1[END] = 1.0
    probability = {(w,): float(p1[w]) for w in range(len(p1)) if w != START}
    history_count = {(w,): int(unigram[w]) for w in range(len(unigram))}
    history_count[(START,)] = n_docs
    backoff: dict[tuple, float] = {}

    def prob(history: tuple, w: int) -> float:
        scale = 1.0
        while True:
            found = probability.get((*history, w))
            if found is not None:
                return scale * found
            scale *= backoff.get(history, 1.0)
            history = history[1:]

    mask = (1 << SYMBOL_BITS) - 1
    for level, (keys, seen) in enumerate(ngrams, start=2):
        split = [(keys >> SYMBOL_BITS * i) & mask for i in reversed(range(level))]
        grams = list(zip(*[s.tolist() for s in split]))
        by_history: dict[tuple, list] = {}
        for g, c in zip(grams, seen.tolist()):
            by_history.setdefault(g[:-1], []).append((g[-1], c))
        new = {}
        for history, followers in by_history.items():
            whole = history_count[history]
            lower = sum(prob(history[1:], w) for w, _ in followers)
            # a history that every symbol follows has nobody to give the discounts to
            full = lower > 1.0 - 1e-9
            shares = [(c if full else c - DISCOUNT) for _, c in followers]
            total = sum(shares) if full else whole
            for (w, _), share in zip(followers, shares):
                new[(*history, w)] = share / total
            backoff[history] = 1.0 if full else max(1e-12, 1.0 - sum(shares) / total) / (1.0 - lower)
        probability |= new
        history_count |= dict(zip(grams, seen.tolist()))
    # states: every symbol's history, and every longer history that has arcs
    longest = len(ngrams) + 1
    states = {(w,): w for w in range(len(p1))}
    root = len(states)
    states[()] = root
    for history in backoff:
        states.setdefault(history, len(states))
    fail, weight = [0] * len(states), [0.0] * len(states)
    for history, s in states.items():
        shorter = history[1:]
        while shorter not in states:
            shorter = shorter[1:]
        fail[s], weight[s] = states[shorter], float(np.log10(backoff.get(history, 1.0)))
    arcs = {}
    for gram, p in probability.items():
        to = gram[-(longest - 1):] if longest > 1 else ()
        while to not in states:
            to = to[1:]
        arcs[states[gram[:-1]] << SYMBOL_BITS | gram[-1]] = (float(np.log10(max(p, 1e-300))), states[to])
    return Automaton(symbols, arcs, fail, weight, float(np.log10(rare_tokens + rare_kinds + 1)), float(np.log10(n + kinds + 1)), n_docs, n)


def traverse(tokens: list[int], model: Automaton) -> float:
    """Log10 probability of one text's symbols: one pass, the state goes along."""
    arcs, fail, backoff = model.arcs, model.fail, model.backoff
    state, score = START, 0.0
    for w in tokens:
        arc = arcs.get(state << SYMBOL_BITS | w)
        while arc is None:
            score += backoff[state]
            state = fail[state]
            arc = arcs.get(state << SYMBOL_BITS | w)
        score += arc[0]
        state = arc[1]
    return score


@dataclass(frozen=True)
class Corpus:
    """What every block has to know: sums over the training texts."""

    order: int
    least: int
    n_docs: int
    n_tokens: int
    rare_tokens: int
    rare_kinds: int
    kinds: int


def _lagged(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """Each token's predecessor's value; ``first`` at the start of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def walk(vocab: np.ndarray, codes: np.ndarray, words: np.ndarray, held: np.ndarray, totals: np.ndarray, known: dict[int, list[np.ndarray]], about: Corpus):
    """Probabilities of a block's tokens as far as ``known`` answers go, and what is to be asked next.

    ``known`` has for exchange 2 k twice the total of each of the block's n-grams plus 1 where the block owns it, for 2 k + 1
    what ``add_keys`` makes of all followers of each of its histories.  Returns the probabilities
    (None as long as an answer is missing) and per exchange to be made its sorted keys and their summands.
    """
    n = about.n_tokens + 1
    plain = totals >= about.least
    starts = np.cumsum(words + 1) - (words + 1)
    place = np.ones(int(words.sum()) + len(words), bool)
    place[starts + words] = False

    def per_token(of_word, end):
        out = np.full(len(place), end, of_word.dtype)
        out[place] = of_word[codes]
        return out

    symbol = per_token(np.where(plain, vocab, RARE_KEY), END_KEY)
    count = per_token(np.where(plain, totals, about.rare_tokens), about.n_docs)
    # the rare symbol also covers unseen words
    p = per_token(np.where(plain, totals, about.rare_tokens + 1) / n, about.n_docs / n if about.n_docs else 1.0)
    trained = np.repeat(held == 0, words + 1)
    at = np.arange(len(place)) - np.repeat(starts, words + 1)
    # the distinct n-grams of the order before, and which of them each token ends
    short, _, rank = distinct(np.concatenate([vocab, [RARE_KEY, END_KEY, START_KEY]]))
    ends = per_token(np.where(plain, rank[:-3], rank[-3]), rank[-2])
    stay, asks = np.ones(len(place), bool), {}
    for level in range(2, about.order + 1):
        before = _lagged(ends, starts, rank[-1])
        whole = _lagged(count, starts, about.n_docs)
        behind = _lagged(stay, starts, level == 2) & (at >= level - 2)
        sent = np.nonzero(behind & stay)[0]
        grams, first, back = distinct(kernels.mix64(short[before[sent]] * JOIN + symbol[sent]))
        if 2 * level not in known:
            asks[2 * level] = grams, [np.bincount(back, weights=trained[sent], minlength=len(grams)).astype(np.int64)]
            return None, asks
        answer = known[2 * level][0]
        count = np.zeros(len(place), np.int64)
        count[sent] = answer[back] >> 1
        stay = count >= about.least
        followed = np.nonzero(behind)[0]
        used = np.zeros(len(short), bool)
        used[before[followed]] = True
        histories, number = short[used], np.cumsum(used) - 1
        if 2 * level + 1 not in known:
            mine = sent[first[(answer & 1 == 1) & (answer >> 1 >= about.least)]]
            to = number[before[mine]]
            asks[2 * level + 1] = histories, [np.bincount(to, weights=w, minlength=len(histories)).astype(t) for w, t in ((count[mine], np.int64), (None, np.int64), (p[mine], np.float64))]
            p = None
        else:
            of = number[before[followed]]
            seen, lower = (v[of] for v in known[2 * level + 1])
            # a history that every symbol follows has nobody to give the discounts to
            full = lower > FULL
            left = np.maximum(1e-12, 1.0 - seen * DISCOUNT / np.maximum(whole[followed], 1))
            backoff = np.where(full | (seen == 0), 1.0, left / np.where(full, 1.0, 1.0 - lower))
            own = np.where(full, count[followed] / np.maximum(seen, 1), (count[followed] - DISCOUNT) / np.maximum(whole[followed], 1))
            p = p.copy()
            p[followed] = np.where(stay[followed], own, backoff * p[followed])
        short, ends = grams, np.zeros(len(place), np.int64)
        ends[sent] = back
    return p, asks


def _cells(block: pa.Table, answers: pa.Table, done: tuple[int, ...]):
    """Per row of a block: its arrays, the totals of its words and the answers of the exchanges ``done``."""
    kinds = answers.column("bucket").to_numpy() >> KIND_BIT if answers.num_rows else np.zeros(0, np.int64)
    order = np.argsort(answers.column("bucket").to_numpy()) if answers.num_rows else np.zeros(0, np.int64)

    def joined(kind: int, name: str, dtype) -> np.ndarray:
        column = answers.column(name)
        parts = unshrunk([column[int(i)] for i in order[kinds[order] == kind]], dtype)
        return np.concatenate(parts) if parts else np.zeros(0, dtype)

    def answer(kind: int) -> list[np.ndarray]:
        seen = joined(kind, "a", np.int64)
        return [seen, spread(seen > 0, joined(kind, "c", np.float64))] if kind & 1 else [seen]

    stored = (("vocab", np.uint64, True), ("codes", np.int32, False), ("words", np.int64, False), ("held", np.uint8, False))
    for row in range(block.num_rows):
        yield row, [unshrunk([block.column(n)[row]], *t)[0] for n, *t in stored], joined(2, "a", np.int64), {k: answer(k) for k in done}


def spread(where: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values`` at the places that ``where`` marks, zeros elsewhere."""
    out = np.zeros(len(where), values.dtype)
    out[where] = values
    return out


SENT = "bucket long, block long, keys binary, a binary, b binary, c binary"
ANSWERS = "block long, bucket long, a binary, c binary"


def send_keys(about: Corpus, done: tuple[int, ...], bits: dict[int, int]):
    """Cogroup function: a block and the answers so far to the keys of its next exchanges."""

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row, arrays, totals, known in _cells(block, answers, done):
            _, asks = walk(*arrays, totals, known, about)
            for kind, (keys, values) in asks.items():
                for b, i, j in slices(keys, bits[kind]):
                    some = values[0][i:j] > 0
                    parts = [shrunk(values[0][i:j]), *[shrunk(v[i:j][some]) for v in values[1:]]]
                    rows.append((kind << KIND_BIT | b, block.column("block")[row].as_py(), shrunk(keys[i:j], True), *parts, *[None] * (3 - len(parts))))
        types = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("bucket", "block", "keys", "a", "b", "c"), types))})

    return send


def add_keys(least: int):
    """Grouped Arrow function of one bucket: the sums of every key back to each block that sent it."""

    def add(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("block").to_numpy(), kind="stable")))
        keys, histories = unshrunk(group.column("keys"), np.uint64, True), group.column("bucket")[0].as_py() >> KIND_BIT & 1
        every, first, at = distinct(np.concatenate(keys))
        summed = lambda values: np.bincount(at, weights=values, minlength=len(every))
        a = np.concatenate(unshrunk(group.column("a"), np.int64))
        if histories:
            kinds, lower = (summed(spread(a > 0, np.concatenate(unshrunk(group.column(n), t)))) for n, t in (("b", np.int64), ("c", np.float64)))
            # all that a weight needs: the followers' count, less discounts in units of one unless every symbol follows
            seen = np.where(lower > FULL, summed(a), summed(a) / DISCOUNT - kinds).astype(np.int64)
            sums = {"a": seen[at], "c": lower[at]}
        else:
            found = summed(a).astype(np.int64)
            # the first block that has an n-gram owns it
            sums = {"a": (2 * np.where(found >= least, found, 0))[at] + (first[at] == np.arange(len(at)))}
        cut = np.cumsum([0, *map(len, keys)])
        none = pa.nulls(len(keys), pa.binary())
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), **{n: pa.array(
            [shrunk(sums[n][i:j] if n == "a" else sums[n][i:j][sums["a"][i:j] > 0]) for i, j in zip(cut[:-1], cut[1:])], pa.binary()) if n in sums else none for n in "ac"}})

    return add


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(about: Corpus, done: tuple[int, ...]):
    """Cogroup function: a block and all its answers to one row per document."""

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = {n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        rare_base, base = np.log10(about.rare_tokens + about.rare_kinds + 1), np.log10(about.n_tokens + about.kinds + 1)
        for row, (vocab, codes, words, held), count, known in _cells(block, answers, done):
            p, _ = walk(vocab, codes, words, held, count, known, about)
            walked = _segment_sums(np.log10(np.maximum(p, 1e-300)), words + 1)
            per_word = (np.log10(count + 1.0) - base)[codes]
            rare = np.where(count >= about.least, 0.0, np.log10(count + 1.0) - rare_base)[codes]
            known_words = _segment_sums((count > 0)[codes].astype(np.float64), words)
            out["doc_id"] += block.column("ids")[row].as_py()
            out["held_out"] += held.astype(bool).tolist()
            out["n_tokens"] += (words + 1).tolist()
            out["n_known"] += (known_words.astype(np.int64) + int(about.n_docs > 0)).tolist()
            out["train_tokens"] += [about.n_tokens] * len(words)
            out["base_score"] += (_segment_sums(per_word, words) + np.log10(about.n_docs + 1.0) - base).tolist()
            out["score"] += (walked + _segment_sums(rare, words)).tolist()
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types)})

    return score


def _segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, each added up on its own."""
    out = np.zeros(len(counts))
    some = np.nonzero(counts)[0]
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, least: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  Words and n-grams of ``least`` training tokens are in the model."""
    spark = docs.sparkSession
    key = F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), (F.crc32(key) % 7 == 2).alias("held_out"), docs[text_col].cast("string").alias("text"))
    n_buckets = bucket_count(docs)
    coded = materialize_bucketed(rows.mapInArrow(code_blocks, CODED), "coded", "block", n_buckets)
    sums = coded.agg(F.sum("train_words").alias("words"), F.sum("train_docs").alias("docs"), F.sum("n_vocab").alias("entries"), F.sum("n_tokens").alias("tokens")).first()
    n_docs, n = sums.docs or 0, (sums.words or 0) + (sums.docs or 0)
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = coded.select("block", "vocab", "trained").mapInArrow(send_words(key_bits(sums.entries or 0, BUCKET_KEYS, least_parts)), "bucket long, block long, keys binary, counts binary")
    by_block = lambda df: df.repartition(n_buckets, "block")
    totals = materialize_bucketed(by_block(sent.groupBy("bucket").applyInArrow(add_words(least), TOTALS)), "totals", "block", n_buckets)
    stats = totals.filter("block < 0").agg(F.sum("kinds").alias("kinds"), F.sum("rare_kinds").alias("rare_kinds"), F.sum("rare_tokens").alias("rare_tokens")).first()
    about = Corpus(order, least, n_docs, n, stats.rare_tokens or 0, stats.rare_kinds or 0, (stats.kinds or 0) + int(n_docs > 0))
    answers = totals.filter("block >= 0").select("block", (F.col("bucket") + F.lit(2 << KIND_BIT)).alias("bucket"), F.col("totals").alias("a"), F.lit(None).cast("binary").alias("c"))
    grams, words = key_bits(sums.tokens or 0, BUCKET_KEYS, least_parts), key_bits(sums.entries or 0, BUCKET_KEYS, least_parts)
    bits = {kind: words if kind == 5 else grams for kind in range(4, 2 * order + 2)}
    texts = coded.select("block", "ids", "held", "words", "codes", "vocab").groupBy("block")
    done: tuple[int, ...] = ()
    # n-grams of an order go together with the histories of the order before
    for level in range(2, order + 2 if order > 1 else 2):
        sent = texts.cogroup(answers.withColumnRenamed("block", "to").groupBy("to")).applyInArrow(send_keys(about, done, bits), SENT)
        fresh = by_block(sent.groupBy("bucket").applyInArrow(add_keys(least), ANSWERS))
        answers = answers.union(fresh if level > order else materialize_bucketed(fresh, f"answers{level}", "block", n_buckets))
        done += tuple(k for k in (2 * level - 1, 2 * level) if k in bits)
    return texts.cogroup(answers.withColumnRenamed("block", "to").groupBy("to")).applyInArrow(score_blocks(about, done), SCORED)
