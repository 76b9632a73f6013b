"""Conversation structure repair: the cheapest edits that make the roles alternate.

A conversation is sound if its role initials read ``(s?(ua)+)?``: nothing, or an
optional system message and pairs of user and assistant.  Rows are judged first:
blank (no visible character), duplicate (role and text seen earlier in the
conversation), truncated (the last visible character doesn't end a sentence).
Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for blank
and duplicate rows), Insert an empty user or assistant message 2; a truncated
row that stays adds 1.  Among the cheapest repairs the one whose edit initials
are least in ASCII order is taken.

The repair is a shortest path in the edit lattice, whose nodes are (rows read,
state of the grammar).  It is found by bidirectional Dijkstra: a forward heap from
the start and a reverse heap from the ends settle nodes by (cost, rows, audit);
each edge with a settled node on both sides is a crossing; the search goes on
until no crossing of equal cost can be left, and picks the least audit.  Of two
equally dear paths to one node neither audit is a prefix of the other (it would
hold one insert more), so least parts make least wholes.

Rows are put in order by a range partitioning, so a huge conversation spreads
over tasks.  Only roles' initials and faults are gathered: conversations of at
most ``SEGMENT`` rows are searched in one piece, longer ones in segments, from
every state to every state, whose answers are then chained.  The repaired
messages are streamed, conversation by conversation, and never held.

Defined results: null role or text reads as one space; a null id is an id; rows
are taken by turn (nulls first), role, text; an empty table gives empty tables;
other columns are ignored.  Texts are told apart by SHA-256.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phasefold.llm.common import SPACES, materialize

#: Rows that are searched in one piece; also the rows of one slice of the ordered table (a power of two).
SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The grammar ``(s?(ua)+)?``: states 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
STATES = range(4)
START, ENDS = 0, (0, 3)
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: The message that may be inserted, or a row reroled to, in a state.
SPEAKER = {0: "u", 1: "u", 2: "a", 3: "u"}
#: The same read backwards: states before a state, by the message between them.
KEPT_INTO = {t: {x: [s for s in STATES if STEPS[s].get(x) == t] for x in "sua"} for t in STATES}
SPOKEN_INTO = {t: [s for s in STATES if STEPS[s][SPEAKER[s]] == t] for t in STATES}
ROLES = {"u": "user", "a": "assistant"}

Node = tuple[int, int]


def edges(initials: str, faults: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    """(next node, cost, edit initial) of the edits possible in a node."""
    i, state = node
    spoken = STEPS[state][SPEAKER[state]]
    yield (i, spoken), INSERT, "I"
    if i < len(initials):
        yield (i + 1, state), DELETE, "D"
        if faults[i] not in "bd":
            extra = TRUNCATED if faults[i] == "t" else 0
            yield (i + 1, spoken), REROLE + extra, "R"
            kept = STEPS[state].get(initials[i])
            if kept is not None:
                yield (i + 1, kept), KEEP + extra, "K"


def edges_into(initials: str, faults: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    """(node before, cost, edit initial) of the edits that lead to a node."""
    i, state = node
    for before in SPOKEN_INTO[state]:
        yield (i, before), INSERT, "I"
    if i:
        yield (i - 1, state), DELETE, "D"
        if faults[i - 1] not in "bd":
            extra = TRUNCATED if faults[i - 1] == "t" else 0
            for before in SPOKEN_INTO[state]:
                yield (i - 1, before), REROLE + extra, "R"
            for before in KEPT_INTO[state].get(initials[i - 1], ()):
                yield (i - 1, before), KEEP + extra, "K"


class _Side:
    """One of the two searches: tentative labels, settled labels, heap."""

    def __init__(self, starts: list[Node], n: int, forward: bool) -> None:
        self.forward, self.n = forward, n
        self.labels: dict[Node, tuple[int, str]] = {s: (0, "") for s in starts}
        self.settled: dict[Node, tuple[int, str]] = {}
        self.heap = [(0, self.layer(s), "", s) for s in starts]
        heapq.heapify(self.heap)

    def layer(self, node: Node) -> int:
        return node[0] if self.forward else self.n - node[0]

    def top(self) -> int | None:
        """Cost of the next node to settle; rows read break ties, so a label is final when its node is settled."""
        while self.heap and (self.heap[0][3] in self.settled or self.labels[self.heap[0][3]] != (self.heap[0][0], self.heap[0][2])):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> Node:
        cost, _, audit, node = heapq.heappop(self.heap)
        self.settled[node] = (cost, audit)
        return node

    def offer(self, node: Node, cost: int, audit: str) -> None:
        if node not in self.settled and (node not in self.labels or (cost, audit) < self.labels[node]):
            self.labels[node] = (cost, audit)
            heapq.heappush(self.heap, (cost, self.layer(node), audit, node))


def cheapest(initials: str, faults: str, source: int = START, targets: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way from ``source`` before all rows to one of ``targets`` after them, if any."""
    n = len(initials)
    ahead, back = _Side([(0, source)], n, True), _Side([(n, t) for t in targets], n, False)
    best: tuple[int, str] | None = None
    while (a := ahead.top()) is not None and (b := back.top()) is not None and (best is None or a + b <= best[0]):
        side, other = (ahead, back) if a <= b else (back, ahead)
        node = side.settle()
        cost, audit = side.settled[node]
        crossings = [(cost + other.settled[node][0], audit + other.settled[node][1] if side.forward else other.settled[node][1] + audit)] if node in other.settled else []
        for near, price, edit in edges(initials, faults, node) if side.forward else edges_into(initials, faults, node):
            if near in other.settled:
                far, rest = other.settled[near]
                crossings.append((cost + price + far, audit + edit + rest if side.forward else rest + edit + audit))
            side.offer(near, cost + price, audit + edit if side.forward else edit + audit)
        best = min(crossings + ([best] if best else []), default=None)
    return best


def chain(segments: Iterator[dict[Node, tuple[int, str]]]) -> tuple[int, str]:
    """Cheapest way through consecutive segments, each given by its answers from state to state."""
    done: list[str] = []
    open_: dict[int, tuple[int, str]] = {START: (0, "")}
    for answers in segments:
        after: dict[int, tuple[int, str]] = {}
        for (a, b), (cost, audit) in answers.items():
            if a in open_:
                found = (open_[a][0] + cost, open_[a][1] + audit)
                after[b] = min(after.get(b, found), found)
        # what all ways share is settled, so only their ends are compared
        first, last = min(x for _, x in after.values()), max(x for _, x in after.values())
        shared = next((i for i, (x, y) in enumerate(zip(first, last)) if x != y), min(len(first), len(last)))
        done.append(first[:shared])
        open_ = {s: (cost, audit[shared:]) for s, (cost, audit) in after.items()}
    cost, rest = min(open_[s] for s in ENDS if s in open_)
    return cost, "".join(done) + rest


_CACHE: dict[tuple, tuple[int, str] | None] = {}


def _cached(initials: str, faults: str, source: int = START, targets: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Conversations of equal initials and faults have equal answers; the table is emptied when it is full."""
    key = (initials, faults, source, targets)
    if key not in _CACHE:
        if len(_CACHE) >= 20_000:
            _CACHE.clear()
        _CACHE[key] = cheapest(*key)
    return _CACHE[key]


def ordered_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, seq (ascending in every conversation's order), initial, blank, truncated, digest; written once."""
    named = rows.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    # the head of the text bounds what is sampled for the ranges; equal rows stay together
    ranged = named.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    seen = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    whole = F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role"), "role", "text")
    return materialize(ranged.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("seq"), F.when(first.isin("s", "u", "a"), first).otherwise("?").alias("initial"),
        (seen == "").alias("blank"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("truncated"), F.sha2(whole, 256).alias("digest")), "turns")


def signatures(ordered: DataFrame) -> DataFrame:
    """conv_id and its slices in order: array of (slice, initials, faults), at most ``SEGMENT`` rows each.

    A fault is b (blank), d (duplicate), t (truncated) or a dot.
    """
    narrow = ordered.select("conv_id", "seq", "initial", "blank", "truncated", "digest")
    twice = narrow.groupBy("digest").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    fault = F.when(F.col("blank"), "b").when(F.col("seq") > F.col("first"), "d").when(F.col("truncated"), "t").otherwise(".")
    judged = narrow.join(twice, "digest", "left").select("conv_id", "seq", "initial", fault.alias("fault"))
    slices = judged.groupBy("conv_id", F.shiftright("seq", SEGMENT.bit_length() - 1).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("seq", "initial", "fault"))).alias("r"))
    slices = slices.select("conv_id", F.struct("slice", F.array_join("r.initial", "").alias("initials"), F.array_join("r.fault", "").alias("faults")).alias("part"))
    return slices.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))


ANSWERS = "array<struct<a:int,b:int,cost:bigint,audit:string>>"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_cached("".join(i), "".join(f)) for i, f in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())],
                                         names=["conv_id", "cost", "audit"])


def _search_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        out = []
        for initials, faults in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist()):
            found = {(a, b): _cached(initials, faults, a, (b,)) for a in STATES for b in STATES}
            out.append([{"a": a, "b": b, "cost": x[0], "audit": x[1]} for (a, b), x in found.items() if x])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("slice"), pa.array(out, kind)], names=["conv_id", "slice", "answers"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [chain({(x["a"], x["b"]): (x["cost"], x["audit"]) for x in answers} for answers in parts) for parts in batch.column("answers").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())],
                                         names=["conv_id", "cost", "audit"])


def _count(text: Column, letter: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letter, ""))).cast("bigint")


def repair_plans(ordered: DataFrame) -> DataFrame:
    """One row per conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    known = materialize(signatures(ordered), "signatures")
    n = F.aggregate("parts.initials", F.lit(0), lambda s, x: s + F.length(x))
    answer = "conv_id long, cost long, audit string"
    short = known.filter(n <= SEGMENT).select("conv_id", F.col("parts.initials").alias("initials"), F.col("parts.faults").alias("faults")).mapInArrow(_search, answer)
    parts = known.filter(n > SEGMENT).select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.*").repartition("conv_id", "slice")
    answers = parts.mapInArrow(_search_segment, f"conv_id long, slice long, answers {ANSWERS}")
    long = answers.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", "answers"))).alias("s")).select("conv_id", F.col("s.answers").alias("answers")).mapInArrow(_chain, answer)
    initials, faults = F.array_join("parts.initials", ""), F.array_join("parts.faults", "")
    counts = known.select("conv_id", initials.alias("initials"), faults.alias("faults")).select(
        "conv_id", _count(F.col("faults"), "b").alias("blank"), _count(F.col("faults"), "d").alias("duplicate"), _count(F.col("faults"), "t").alias("truncated"),
        # neighbours but the legal ones; the pattern looks ahead, as pairs overlap
        (F.length("initials") - 1 - F.regexp_count("initials", F.lit("s(?=u)|u(?=a)|a(?=u)"))).cast("bigint").alias("illegal"))
    turns = ordered.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    plans = short.unionByName(long)
    joined = counts.withColumnRenamed("conv_id", "c").join(plans, F.col("c").eqNullSafe(F.col("conv_id"))).drop("conv_id")
    joined = joined.join(turns, F.col("c").eqNullSafe(F.col("conv_id"))).drop("conv_id")
    return joined.select(F.col("c").alias("conv_id"), F.coalesce("gaps", F.lit(0).cast("bigint")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


MESSAGES = "conv_id long, place long, edit string, role string, text string"


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its plan first; yields the messages that the plan leaves."""
    names = ["conv_id", "place", "edit", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out: list[list] = [[] for _ in names]
    conv, audit, at, state, place = None, "", 0, START, 0

    def put(*values) -> None:
        for column, value in zip(out, values):
            column.append(value)

    def inserts() -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            put(conv, place, "I", ROLES[SPEAKER[state]], "")
            at, state, place = at + 1, STEPS[state][SPEAKER[state]], place + 1

    for batch in batches:
        for c, seq, role, text, initial, plan in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "seq", "role", "text", "initial", "audit")]):
            if seq < 0:
                inserts()
                conv, audit, at, state, place = c, plan, 0, START, 0
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                spoken = initial if edit == "K" else SPEAKER[state]
                put(conv, place, edit, role if edit == "K" else ROLES[spoken], text)
                state, place = STEPS[state][spoken], place + 1
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            out = [[] for _ in names]
    inserts()
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def repaired_messages(ordered: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text; a conversation lies in one partition, in order."""
    rows = ordered.select("conv_id", "seq", "role", "text", "initial", F.lit(None).cast("string").alias("audit"))
    heads = plans.select("conv_id", F.lit(-1).cast("bigint").alias("seq"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "initial")], "audit")
    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_replayed, MESSAGES)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, fed line by line."""
    import hashlib

    conv, running, out = None, None, []

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([h for _, h in found], pa.string())], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for c, place, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text")]):
            if place == 0:
                if running is not None:
                    out.append((conv, running.hexdigest()))
                conv, running = c, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        if out:
            yield batch_of(out)
            out = []
    if running is not None:
        yield batch_of([(conv, running.hexdigest())])


def message_digests(messages: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of conversations that have messages; reads ``repaired_messages`` where they lie."""
    return messages.mapInArrow(_digested, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(report, messages): a row per conversation as in ``repair_plans``, and its repaired messages."""
    ordered = ordered_rows(rows, **columns)
    plans = materialize(repair_plans(ordered), "plans")
    return plans, repaired_messages(ordered, plans)
