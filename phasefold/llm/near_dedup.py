"""MinHash near-dedup with odd sketches.

1. Each text becomes the set of its k-word shingles; MinHash samples of the set
   are folded into band keys and into an odd sketch, a parity bitmap in which
   every sample flips one bit.  The population count of two sketches' XOR
   estimates a high similarity well.
2. Texts with equal sets are one class; from here on a class is one node.
3. Nodes that share a band key are a bucket.  In each of ``ROUNDS`` rounds a node
   asks one partner: of the buckets that hold several components, it takes those
   whose largest component isn't its own, and of these components' smallest nodes
   the one it shares most buckets with and hasn't asked.  A pair is compared by size, then by odd sketches
   (4.5 standard errors of slack), then by the full sets.  Links make components.
   So a round compares no more pairs than there are nodes, however large a group is.
4. What that misses: buckets that still hold several components.  Nodes
   outside the bucket's largest component meet all nodes of other components of
   that bucket, in blocks of ``BLOCK`` by ``WIDE_BLOCK`` nodes that compare sketches.  Where these are many, a first
   round emits every node's closest partner only, which joins most of a group through
   its centre.  The last round emits no pairs: its blocks name the nodes that have a pair worth confirming, in the
   first band that the pair shares, and these nodes meet again with their full sets, in blocks of bounded bytes that
   confirm every pair still apart and emit one link for two components they join.  Buckets of
   two need no blocks; their one pair is compared unless it is joined by then.

So no link between texts that share a band is lost, though members of a big
group are never expanded into pairs.  Bands are chosen so that a pair at the
threshold misses all of them with probability below ``MISS``.

Components come from alternating large-star and small-star rounds, whose edges
are rewritten in place; a hub with very many edges is only grouped with partial
aggregation and joined, which adaptive execution can split.

Defined results: a null or wordless text has an empty set and is linked with
nothing; a text of fewer than k words is one shingle; the component of texts
without any id is null; repeated rows are one class; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phasefold.llm import kernels
from phasefold.llm.blocks import small_batches
from phasefold.llm.common import materialize, numbered, without_rows
from phasefold.session import small_side

MISS = 1e-6
SKETCH_WORDS = 32
#: MinHash samples in a sketch, at least.
SAMPLES = 512
BLOCK, WIDE_BLOCK = 512, 4096
#: Rounds in which each node asks one partner.
ROUNDS = 3
#: Sets that meet a hub's set in one task.
SET_BLOCK = 256
#: Nodes on a side of a block that confirms on full sets, and bytes of their sets.
SET_NODES, SET_BYTES = 2048, 16 << 20


def banding(percent: int) -> tuple[int, int]:
    """Rows per band and bands for a similarity threshold."""
    t = percent / 100
    rows = max(1, round(-1.2 / math.log(t))) if t < 1 else 16
    return rows, (math.ceil(math.log(MISS) / math.log(1 - t**rows)) if t < 1 else 1)


def sketch_limit(percent: int, samples: int) -> int:
    """Largest XOR population count of two odd sketches that may still belong to a pair at the threshold (4.5 standard errors)."""
    bits, t = 64 * SKETCH_WORDS, percent / 100
    flips = 2 * samples * (1 - t)
    expected = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    by_samples, by_collisions = 4 * samples * t * (1 - t), 2 * flips**2 / bits
    return math.ceil(expected + 4.5 * math.sqrt(by_samples + by_collisions))


def sample_count(percent: int) -> int:
    rows, bands = banding(percent)
    return max(SAMPLES, rows * bands)


SIGNATURE = "row long, doc_id long, n_shingles long, digest long, digest2 long, bands array<long>, sketch array<long>"


def signer(k: int, percent: int):
    """Arrow function: (row, doc_id, text) to signatures."""
    rows, bands = banding(percent)
    samples = sample_count(percent)
    scale = kernels.mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    shift = kernels.mix64(scale)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, offsets = kernels.text_buffers(batch.column("text"))
            values, counts = kernels.shingle_sets(data, offsets, k)
            n = len(counts)
            some = np.nonzero(counts)[0]
            at = (np.cumsum(counts) - counts)[some]
            least = np.zeros((n, samples), np.uint64)
            digest, digest2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            if len(some):
                for j in range(samples):
                    least[some, j] = np.minimum.reduceat(values * scale[j] + shift[j], at)
                digest[some] = np.add.reduceat(kernels.mix64(values ^ np.uint64(0xA5A5A5A5)), at)
                digest2[some] = np.add.reduceat(kernels.mix64(values + np.uint64(0x1234567)), at)
            # odd sketch: sample j flips the bit its value (with j) picks
            bit = kernels.mix64(least + scale[None, :]) % np.uint64(64 * SKETCH_WORDS)
            parity = np.zeros((n, 64 * SKETCH_WORDS), np.uint8)
            np.add.at(parity, (np.arange(n)[:, None], bit.astype(np.int64)), 1)
            sketch = np.packbits(parity & 1, axis=1, bitorder="little").view(np.uint64)
            keys = np.zeros((n, bands), np.uint64)
            for b in range(bands):
                acc = np.full(n, b + 1, np.uint64)
                for j in range(rows):
                    acc = kernels.mix64(acc * np.uint64(0xD6E8FEB86659FD93) + least[:, b * rows + j])
                keys[:, b] = acc
            has = np.where(counts > 0, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]).astype(np.int32)), pa.array(keys[counts > 0].ravel().view(np.int64)))
            sketches = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * SKETCH_WORDS).astype(np.int32)), pa.array(np.ascontiguousarray(sketch).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(digest.view(np.int64)), pa.array(digest2.view(np.int64)), lists, sketches],
                names=["row", "doc_id", "n_shingles", "digest", "digest2", "bands", "sketch"])

    return sign


def set_maker(k: int):
    """Arrow function: (node, text) to (node, set), the sorted shingle hashes as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values, counts = kernels.shingle_sets(*kernels.text_buffers(batch.column("text")), k)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 8
            sets = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets.cast(pa.binary())], names=["node", "set"])

    return make


def confirmer(percent: int):
    """Cogroup function: a hub's set against a slice of its candidates' sets, exact test on whole sets."""

    def confirm(pairs: pa.Table, hubs: pa.Table) -> pa.Table:
        hub, hub_set = hubs.column("r_hub")[0].as_py(), np.frombuffer(hubs.column("set")[0].as_buffer(), np.uint64) if hubs.num_rows else None
        nodes = pairs.column("node").to_numpy()
        good = np.zeros(len(nodes), bool)
        for i, cell in enumerate(pairs.column("set")):
            other = np.frombuffer(cell.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(hub_set, other), len(hub_set) - 1)
            common = int((hub_set[at] == other).sum())
            good[i] = 100 * common >= percent * (len(hub_set) + len(other) - common)
        return pa.table({"a": pa.array(np.full(int(good.sum()), hub, np.int64)), "b": pa.array(nodes[good])})

    return confirm


def _sets(nodes: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """node, set of the given nodes."""
    nodes = small_side(nodes)
    texts = base.join(nodes, base["row"] == nodes["node"]).select("node", "text")
    return materialize(texts.mapInArrow(set_maker(k), "node long, set binary"), "sets")


def confirmed_links(pairs: DataFrame, base: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the distinct ``pairs`` (hub, node) those whose full sets reach the threshold: a, b.

    Sets are made for the nodes concerned only; a hub's set goes to each slice of about ``SET_BLOCK`` partners.
    """
    pairs = materialize(pairs, "pairs")
    sets = _sets(pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct(), base, k)
    sizes = pairs.groupBy(F.col("hub").alias("h")).agg(F.ceil(F.count("*") / SET_BLOCK).alias("slices"))
    sliced = pairs.join(sizes, F.col("hub") == F.col("h")).select("hub", "node", F.pmod(F.xxhash64("node"), "slices").alias("slice"))
    left = sliced.join(sets, "node").select("hub", "slice", "node", "set")
    right = sliced.select("hub", "slice").distinct().join(sets, F.col("hub") == F.col("node")).select(
        F.col("hub").alias("r_hub"), F.col("slice").alias("r_slice"), F.col("set").alias("set"))
    return left.groupBy("hub", "slice").cogroup(right.groupBy("r_hub", "r_slice")).applyInArrow(confirmer(percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node of the links (a, b)."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _near(left: pa.Table, right: pa.Table, percent: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions left and right, in order, and sketch distance of the pairs of different components that may be links."""
    step = 256

    def columns(t: pa.Table):
        sketch = np.asarray(t.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(t.num_rows, -1)
        return t.column("comp").to_numpy(), t.column("n_shingles").to_numpy(), sketch

    if left.num_rows and right.num_rows:
        lc, ls, lk = columns(left)
        rc, rs, rk = columns(right)
        for i in range(0, len(lc), step):
            part = slice(i, i + step)
            ok = lc[part, None] != rc[None, :]
            ok &= (100 * np.minimum(ls[part, None], rs[None, :]) >= percent * np.maximum(ls[part, None], rs[None, :]))
            a, b = np.nonzero(ok)
            apart = np.concatenate([np.bitwise_count(lk[part][a[k:k + 65536]] ^ rk[b[k:k + 65536]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
            near = apart <= limit
            yield a[near] + i, b[near], apart[near]


def _first_met(left: pa.Table, right: pa.Table, percent: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of ``_near`` the pairs whose first shared band is the block's, two nodes outside the largest component once only."""
    if left.num_rows and right.num_rows:
        bands = [np.asarray(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (left, right)]
        nodes, inside, band = [t.column("node").to_numpy() for t in (left, right)], ~right.column("outside").to_numpy(zero_copy_only=False), left.column("band")[0].as_py()
        for a, b, _ in _near(left, right, percent, limit):
            once = inside[b] | (nodes[0][a] < nodes[1][b])
            a, b = a[once], b[once]
            new = (bands[0][a] == bands[1][b]).argmax(axis=1) == band
            yield a[new], b[new]


def closest_pairs(percent: int, limit: int):
    """Cogroup function: blocks of nodes of one bucket to the best pair of each node on the left."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for a, b, apart in _near(left, right, percent, limit):
            asker, other = left.column("node").to_numpy()[a], right.column("node").to_numpy()[b]
            order = np.lexsort((other, apart, a))
            first = np.ones(len(order), bool)
            first[1:] = a[order[1:]] != a[order[:-1]]
            best = order[first]
            out.append((asker[best], other[best], apart[best]))
        a, b, d = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"asker": pa.array(a), "hub": pa.array(np.minimum(a, b)), "node": pa.array(np.maximum(a, b)), "apart": pa.array(d)})

    return compare


MET = "key long, band int, node long, comp long, outside boolean, n_shingles long"


def meeting_nodes(percent: int, limit: int):
    """Cogroup function: of blocks of nodes of one bucket those that have a pair worth confirming."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([n.removeprefix("r_") for n in right.column_names])
        has = [np.zeros(t.num_rows, bool) for t in (left, right)]
        for a, b in _first_met(left, right, percent, limit):
            has[0][a] = has[1][b] = True
        names = ["key", "band", "node", "comp", "outside", "n_shingles"]
        return pa.concat_tables([t.select(names).filter(pa.array(h)) for t, h in zip((left, right), has)])

    return meet


def block_links(percent: int, limit: int):
    """Cogroup function: blocks of nodes with their full sets to one confirmed link for two components they join."""

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            n = left.num_rows
            nodes, comps = (np.concatenate([t.column(c).to_numpy() for t in (left, right)]) for c in ("node", "comp"))
            sets = [np.frombuffer(cell.as_buffer(), np.uint64) for t in (left, right) for cell in t.column("set")]
            sizes = np.array([len(x) for x in sets])
            cut = np.concatenate([[0], np.cumsum(sizes)])
            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            codes, mark, group = codes.astype(np.int32), np.zeros(len(values), bool), np.unique(comps, return_inverse=True)[1]
            for a, b in _first_met(left, right, percent, limit):
                bounds = np.concatenate([[0], np.nonzero(np.diff(a))[0] + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
                for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    i, others = int(a[start]), b[start:end] + n
                    others = others[group[others] != group[i]]
                    if not len(others):
                        continue
                    own = codes[cut[i]:cut[i + 1]]
                    mark[own] = True
                    found = mark[np.concatenate([codes[cut[j]:cut[j + 1]] for j in others])]
                    mark[own] = False
                    common = np.add.reduceat(found, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
                    for j in others[100 * common >= percent * (sizes[i] + sizes[others] - common)].tolist():
                        if group[j] != group[i]:
                            group[group == group[j]] = group[i]
                            out.append((i, j))
        i, j = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(nodes[i] if len(i) else i, pa.int64()), "b": pa.array(nodes[j] if len(j) else j, pa.int64())})

    return link


def _sketch_distance(a: str, b: str):
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def _mixed(shared: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bucket members with their component, and the buckets of several components: size, largest component and its smallest node."""
    labelled = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    largest = F.max_by(F.struct("comp", "least"), F.struct("n", (-F.col("least")).alias("first")))
    mixed = per.groupBy("key").agg(F.sum("n").alias("size"), largest.alias("m"), F.max("n").alias("most")).filter("most < size")
    return labelled, mixed.select("key", "size", "most", F.col("m.comp").alias("major"), F.col("m.least").alias("hub"))


def _asked(shared: DataFrame, comps: DataFrame, seen: DataFrame | None) -> DataFrame:
    """One pair (hub, node) a node: the hub of another component that it shares most buckets with and hasn't asked."""
    labelled, mixed = _mixed(shared, comps)
    asks = labelled.join(mixed.select("key", "major", "hub"), "key").filter("comp <> major").groupBy("hub", "node").agg(F.count("*").alias("n"))
    if seen is not None:
        asks = asks.join(seen, ["hub", "node"], "left_anti")
    return asks.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")).select("hub", "node")


def _likely(pairs: DataFrame, about: DataFrame, percent: int, limit: int) -> DataFrame:
    """Of the pairs (hub, node) those whose sizes and sketches allow a link."""
    sized = pairs.join(about, "node").join(about.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hub")
    near = sized.filter(f"100 * least(n_shingles, hub_n) >= {percent} * greatest(n_shingles, hub_n)")
    return near.filter(_sketch_distance("sketch", "hub_sketch") <= limit).select("hub", "node")


def _upto(n):
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))


def _apart(labelled: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Given what ``_mixed`` returns: the pairs (hub, node) of buckets of two, and the members of the larger ones."""
    labelled = materialize(labelled.join(buckets, "key"), "labelled")
    two = labelled.filter("size = 2").groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("node")).select("hub", "node").distinct()
    members = labelled.filter("size > 2").select("key", "band", "node", "comp", "size", "most", (F.col("comp") != F.col("major")).alias("outside"))
    return two, members


def _with_columns_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members with the columns that ``nodes`` has for each node; a node is looked up once for all its buckets."""
    own = [c for c in members.columns if c != "node"]
    lists = members.groupBy("node").agg(F.collect_list(F.struct(*own)).alias("_at"))
    return lists.join(nodes, "node").select(*nodes.columns, F.explode("_at").alias("_m")).select(*nodes.columns, *[F.col(f"_m.{c}").alias(c) for c in own])


def _blocks(members: DataFrame, left_slices, right_slices, cols: list[str]):
    """Cogrouped blocks of one bucket: nodes outside its largest component on the left, all its nodes on the right (key as r_key)."""
    members = members.withColumns({"_ls": F.greatest(F.lit(1), F.ceil(left_slices)), "_rs": F.greatest(F.lit(1), F.ceil(right_slices))})
    left = members.filter("outside").select("key", *cols, F.pmod(F.xxhash64("node"), "_ls").alias("i"), _upto(F.col("_rs")).alias("j"))
    right = members.select(F.col("key").alias("r_key"), *[F.col(c).alias(c) for c in cols], F.pmod(F.xxhash64("node"), "_rs").alias("r_j"), _upto(F.col("_ls")).alias("r_i"))
    return left.groupBy("key", "i", "j").cogroup(right.groupBy("r_key", "r_i", "r_j"))


def _closest(members: DataFrame, full: DataFrame, percent: int, limit: int) -> DataFrame:
    """Pairs (hub, node): each outside node's closest partner of another component in its buckets."""
    blocks = _blocks(_with_columns_of(members, full), (F.col("size") - F.col("most")) / BLOCK, F.col("size") / WIDE_BLOCK, ["node", "comp", "n_shingles", "sketch"])
    pairs = blocks.applyInArrow(closest_pairs(percent, limit), "asker long, hub long, node long, apart long")
    return pairs.groupBy("asker").agg(F.min_by(F.struct("hub", "node"), F.struct("apart", "hub", "node")).alias("b")).select("b.hub", "b.node")


def _block_links(members: DataFrame, full: DataFrame, base: DataFrame, k: int, percent: int, limit: int) -> DataFrame:
    """Links (a, b) that join all that is linked inside a bucket, confirmed on full sets without a row per pair."""
    cols = ["band", "node", "comp", "outside", "n_shingles", "sketch", "bands"]
    blocks = _blocks(_with_columns_of(members, full), (F.col("size") - F.col("most")) / BLOCK, F.col("size") / WIDE_BLOCK, cols)
    met = materialize(blocks.applyInArrow(meeting_nodes(percent, limit), MET).dropDuplicates(["key", "node"]), "met")
    sets = _sets(met.select("node").distinct(), base, k)
    part = lambda n, size: F.greatest(n / SET_NODES, size * 8 / SET_BYTES)
    outside = F.when(F.col("outside"), F.col("n_shingles"))
    sizes = met.groupBy("key").agg(part(F.count(outside), F.sum(F.coalesce(outside, F.lit(0)))).alias("left"), part(F.count("*"), F.sum("n_shingles")).alias("right"))
    sized = materialize(met.join(sizes, "key"), "sized")
    whole = _with_columns_of(sized, full.drop("n_shingles").join(sets, "node"))
    return _blocks(whole, F.col("left"), F.col("right"), [*cols, "set"]).applyInArrow(block_links(percent, limit), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: row, doc_id, n_shingles, component_id, keep_row (one row of each component)."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return _grouped(materialize(base, "texts"), k, percent)


def _grouped(base: DataFrame, k: int, percent: int) -> DataFrame:
    """``base``: row, doc_id, text, with row numbers that reading again does not change."""
    limit = sketch_limit(percent, sample_count(percent))
    signed = materialize(base.mapInArrow(signer(k, percent), SIGNATURE), "signed")
    by = ["digest", "digest2", "n_shingles"]
    some = signed.filter("n_shingles > 0")
    lead = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "row")
    classes = materialize(some.groupBy(*by).agg(F.min("row").alias("node"), F.min(lead).alias("lead"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    about = classes.select("node", "n_shingles", "sketch")

    members = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(members.join(buckets, "key").select("key", "band", "node"), "buckets")
    full = classes.select("node", "n_shingles", "sketch", "bands")
    comps, links, seen = about.sparkSession.createDataFrame([], "node long, comp long"), None, None
    for step in range(ROUNDS + 2):
        found = []
        if step < ROUNDS:
            asked = materialize(_asked(shared, comps, seen), "asked")
            pairs = materialize(_likely(asked, about, percent, limit), "likely")
        else:
            labelled, mixed = _mixed(shared, comps)
            mixed = materialize(mixed, "mixed")
            meetings = mixed.agg(F.sum((F.col("size") - F.col("most")) * F.col("size"))).head()[0] or 0
            if step == ROUNDS and meetings <= 4 * classes.count():
                continue  # so few that the last round may confirm them all at once
            two, members = _apart(labelled, mixed)
            pairs = _likely(two, about, percent, limit)
            if step == ROUNDS:
                pairs = pairs.union(_closest(members, full, percent, limit)).distinct()
            else:
                found.append(materialize(_block_links(members, full, base, k, percent, limit), "links"))
            pairs = asked = materialize(pairs.join(seen, ["hub", "node"], "left_anti"), "rest")
        seen = asked if seen is None else seen.union(asked)
        if not pairs.isEmpty():
            found.append(materialize(confirmed_links(pairs, base, k, percent), "links"))
        if any(not new.isEmpty() for new in found):
            for new in found:
                links = new if links is None else links.union(new)
            comps = materialize(components(links), "components")

    labels = classes.select(*by, "node", "lead").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    leads = labels.groupBy("comp").agg(F.min("lead").alias("first"))
    answer = labels.select(*by, "comp").join(leads, "comp").select(*by, "first")
    found = some.select("row", "doc_id", *by).join(answer, by).select(
        "row", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row"))
    alone = signed.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("keep_row"))
    return found.union(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns."""
    table, row, run = numbered(docs, "rows")
    base = table.select(F.col(row).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    lost = materialize(_grouped(base, k, percent).filter("row <> keep_row").select("row"), "lost")
    return without_rows(table, row, run, lost)
