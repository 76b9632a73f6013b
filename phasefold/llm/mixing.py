"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes: words per document, per source.  Targets share ``share`` x all words by
   weight; no source gets more than ``limit`` x its size, the excess is shared
   again by weight (closed form: sources fill up in the order of limit / weight).
2. Blocks: documents are cut into blocks of ``block_words`` words.  A source
   draws all its blocks for every whole time its target covers it, then a prefix
   of its blocks in hash order; the last block is trimmed, so a source takes its
   rounded target exactly.  The draws of a source form its block quota.
3. Tree: the quotas of all sources at the root are split in halves, level by
   level, by exact multivariate-hypergeometric draws, until every leaf is an
   output shard; shards have equal numbers of blocks (within one) and are
   distributed as if all draws had been shuffled at once.
4. Each shard takes its disjoint range of every source's permuted draws and
   orders them locally by a hash.

Order inside a source comes from buckets of a hash with prefix sums over the
buckets, so a source with a third of all rows is many small sorts.  Random
numbers are hashes of ids and tree nodes: reruns and retried tasks agree.

The source table (one row per source) is taken for metadata: a node of the tree
carries one count per source in one row, and more than ``MAX_SOURCES`` raise.

Defined results: a null or wordless text has size 0 and is never drawn; a null
source is the last source; repeated rows are separate documents; an empty table
gives an empty mix; other columns are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from phasefold.llm.common import free_name, materialize, word_count, words_of
from phasefold.session import small_side

MAX_SOURCES = 100_000
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``sizes``: source, size.  Returns source, source_no, source_size, n_docs, target."""
    every = Window.orderBy(F.asc_nulls_last("source"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = per.withColumn("source_no", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("source_no") % len(weights) + 1).cast("double")
    per = per.withColumn("weight", weight).withColumn("top", F.lit(limit) * F.col("source_size"))
    fill = Window.orderBy(F.col("top") / F.col("weight"), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumn("total", F.lit(share) * F.sum("source_size").over(whole))
    level = (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # sources fill up in this order; the first that doesn't sets the rate of all after it
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    per = per.withColumn("first", F.min(F.when(F.col("top") > F.col("level") * F.col("weight"), F.col("place"))).over(whole))
    per = per.withColumn("rate", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(whole))
    target = F.when(F.col("rate").isNull(), F.col("top")).otherwise(F.least("top", F.col("rate") * F.col("weight")))
    return per.select("source", F.col("source_no").cast("int").alias("source_no"), "source_size", "n_docs", target.alias("target"))


def permuted_draws(rows: DataFrame, targets: DataFrame, block_words: int = 256, seed: int = 0) -> DataFrame:
    """``rows``: row, key (text that names the document), source_no, size.  One row per drawn block: source_no, draw_no (gapless per source), row, block, pass, words."""
    plan = targets.select(
        F.col("source_no").alias("s"), F.col("source_size"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("whole"),
        # digits of the hash that keep a bucket near BUCKET_ROWS blocks
        F.ceil(F.greatest(F.lit(0.0), F.log2((F.col("source_size") / block_words + F.col("n_docs")) / BUCKET_ROWS)) / 4).cast("int").alias("digits"),
        F.col("target"))
    plan = small_side(plan.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint")))
    blocks = rows.filter("size > 0").join(plan, F.col("source_no") == F.col("s")).select(
        "source_no", "row", "key", "size", "whole", "rest", "digits",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / block_words))).alias("block"))
    passes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("whole"), F.col("whole") + F.sign(F.col("rest")).cast("bigint") - 1)))
    drawn = blocks.filter("whole > 0 OR rest > 0").select(
        "source_no", "row", "block", "whole", "rest", "digits", passes.alias("pass"),
        F.least(F.lit(block_words).cast("bigint"), F.col("size") - F.col("block") * block_words).alias("words"),
        "key")
    order = F.md5(F.concat_ws(":", F.col("key"), F.col("block"), F.col("pass") + seed).cast("binary"))
    drawn = drawn.withColumn("order", order).withColumn("bucket", F.substring(F.col("order"), F.lit(1), F.col("digits"))).drop("key", "digits")
    drawn = materialize(drawn, "blocks")
    running = Window.partitionBy("source_no", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = drawn.groupBy("source_no", "pass", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    buckets = buckets.select("source_no", "pass", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("n_before"),
                             F.coalesce(F.sum("w").over(running), F.lit(0)).alias("w_before"))
    inside = Window.partitionBy("source_no", "pass", "bucket").orderBy("order", "row")
    placed = drawn.withColumn("n_in", F.row_number().over(inside) - 1)
    placed = placed.withColumn("w_in", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    placed = placed.join(buckets, ["source_no", "pass", "bucket"])
    start = F.col("w_before") + F.col("w_in")
    words = F.when(F.col("pass") < F.col("whole"), F.col("words")).otherwise(F.least(F.col("words"), F.col("rest") - start))
    placed = placed.select("source_no", "row", "block", "pass", "order", (F.col("n_before") + F.col("n_in")).alias("place"), words.alias("words"))
    # whole passes come first, so a source's draw number is its place plus all blocks of the passes before
    per_pass = small_side(drawn.filter("pass = 0").groupBy(F.col("source_no").alias("s")).agg(F.count("*").alias("n_blocks")))
    return placed.filter("words > 0").join(per_pass, F.col("source_no") == F.col("s")).select(
        "source_no", (F.col("place") + F.col("pass") * F.col("n_blocks")).alias("draw_no"), "row", "block", "pass", "words", "order")


def _ln_factorial(x: str) -> str:
    return (f"(CASE WHEN {x} <= 20 THEN ln(cast(factorial(cast({x} AS int)) AS double)) ELSE {x} * ln({x}) - {x} + 0.5D * ln(2 * pi() * {x})"
            f" + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}) + 1D / (1260D * pow({x}, 5)) END)")


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"


def hypergeometric_sql(population: str, marked: str, draws: str, u: str) -> str:
    """SQL of an exact hypergeometric draw: inversion that walks from the mode outwards on both sides.

    All counts are DOUBLE expressions of whole numbers; ``u`` is uniform in [0, 1).
    """
    lo, hi = "greatest(0D, g.n + g.k - g.p)", "least(g.n, g.k)"
    mode = f"greatest({lo}, least({hi}, cast(floor((g.n + 1D) * (g.k + 1D) / (g.p + 2D)) AS double)))"
    sd = "sqrt(greatest(0D, g.n * (g.k / g.p) * (1D - g.k / g.p) * (g.p - g.n) / greatest(1D, g.p - 1D)))"
    steps = f"sequence(1L, least(2L * cast(g.hi - g.lo AS bigint) + 1L, cast(ceil(24D * {sd}) AS bigint) + 80L))"
    p_mode = f"exp({_ln_choose('g.k', 'g.m')} + {_ln_choose('(g.p - g.k)', '(g.n - g.m)')} - {_ln_choose('g.p', 'g.n')})"
    up = "(a.up_p * (g.k - a.up) * (g.n - a.up) / ((a.up + 1D) * (g.p - g.k - g.n + a.up + 1D)))"
    down = "(a.down_p * a.down * (g.p - g.k - g.n + a.down) / ((g.k - a.down + 1D) * (g.n - a.down + 1D)))"
    state = "named_struct('u', {u}, 'x', {x}, 'up', {up}, 'up_p', {up_p}, 'down', {down}, 'down_p', {down_p})"
    same = dict(u="a.u", x="a.x", up="a.up", up_p="a.up_p", down="a.down", down_p="a.down_p")
    go_up = state.format(**same | dict(u=f"a.u - {up}", x=f"CASE WHEN a.u - {up} < 0D THEN a.up + 1D ELSE -1D END", up="a.up + 1D", up_p=up))
    go_down = state.format(**same | dict(u=f"a.u - {down}", x=f"CASE WHEN a.u - {down} < 0D THEN a.down - 1D ELSE -1D END", down="a.down - 1D", down_p=down))
    step = f"CASE WHEN a.x >= 0D THEN a WHEN i % 2 = 1 AND a.up < g.hi THEN {go_up} WHEN i % 2 = 0 AND a.down > g.lo THEN {go_down} ELSE a END"
    first = state.format(u="g.u - g.pm", x="CASE WHEN g.u < g.pm THEN g.m ELSE -1D END", up="g.m", up_p="g.pm", down="g.m", down_p="g.pm")
    walk = f"aggregate({steps}, {first}, (a, i) -> {step}, a -> CASE WHEN a.x >= 0D THEN a.x ELSE g.m END)"
    let1 = f"array(named_struct('p', {population}, 'k', {marked}, 'n', {draws}, 'u', {u}))"
    let2 = f"transform({let1}, g -> named_struct('p', g.p, 'k', g.k, 'n', g.n, 'u', g.u, 'lo', {lo}, 'hi', {hi}, 'm', {mode}))"
    let3 = f"transform({let2}, g -> named_struct('p', g.p, 'k', g.k, 'n', g.n, 'u', g.u, 'lo', g.lo, 'hi', g.hi, 'm', g.m, 'pm', {p_mode}))"
    return f"element_at(transform({let3}, g -> CASE WHEN g.hi <= g.lo THEN g.lo ELSE {walk} END), 1)"


def splitting_tree(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """``quotas``: source_no, quota.  Returns shard, source_no, quota for 2 ** levels shards."""
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_no", F.col("quota").cast("double").alias("q")))).alias("quotas"))
    node = node.select(F.lit(0).cast("bigint").alias("node"), "quotas")
    for level in range(levels):
        u = f"(cast(xxhash64({seed}, {level}, node, c.source_no) & 9007199254740991L AS double) / 9007199254740992D)"
        draw = hypergeometric_sql("a.p", "c.q", "a.n", u)
        # sources in turn: the next one's share of what the left half still lacks
        sizes = "aggregate(quotas, 0D, (s, c) -> s + c.q)"
        half = f"cast(floor(({sizes} + cast(node % 2 AS double)) / 2D) AS double)"
        taken = "named_struct('p', a.p - c.q, 'n', a.n - x, 'out', concat(a.out, array(named_struct('source_no', c.source_no, 'q', x))))"
        step = f"element_at(transform(array({draw}), x -> {taken}), 1)"
        empty = "cast(array() AS array<struct<source_no:int,q:double>>)"
        left = f"aggregate(quotas, named_struct('p', {sizes}, 'n', {half}, 'out', {empty}), (a, c) -> {step}, a -> a.out)"
        node = node.withColumn("left", F.expr(left))
        right = "transform(quotas, (c, i) -> named_struct('source_no', c.source_no, 'q', c.q - left[i].q))"
        node = node.select(F.explode(F.expr(f"array(named_struct('node', node * 2, 'quotas', left), named_struct('node', node * 2 + 1, 'quotas', {right}))")).alias("c")).select("c.node", "c.quotas")
        if level % 3 == 2:
            node = materialize(node.repartition("node") if level > 6 else node, "tree")
    return node.select(F.col("node").alias("shard"), F.inline("quotas")).select("shard", "source_no", F.col("q").cast("bigint").alias("quota"))


def document_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str] = ()) -> DataFrame:
    """Written once: row, doc_id, source, size and the columns in ``keep``."""
    return materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
        word_count(docs[text_col]).alias("size"), *[F.struct(*[docs[f"`{c}`"] for c in keep]).alias("doc")] * bool(keep)), "sized")


def mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block_words: int = 256,
        shard_words: int = 4_000_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix and the source targets.  ``rows`` as from ``document_rows``.

    Mix: shard, position (gapless in the shard), source_no, row, block, pass, words; words start at block x block_words.
    """
    targets = materialize(source_targets(rows.select("source", "size"), weights, share, limit), "targets")
    stats = targets.agg(F.count("*").alias("n"), F.sum("target").alias("t")).first()
    if stats.n > MAX_SOURCES:
        raise ValueError(f"{stats.n} sources; a tree node holds at most {MAX_SOURCES}")
    numbers = small_side(targets.select(F.col("source").alias("src"), "source_no"))
    named = rows.select("row", "source", "size", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"))
    numbered = named.join(numbers, F.col("source").eqNullSafe(F.col("src"))).select("row", "key", "source_no", "size")
    draws = materialize(permuted_draws(numbered, targets, block_words, seed), "draws")
    quotas = materialize(draws.groupBy("source_no").agg(F.count("*").alias("quota")), "quotas")
    levels = max(1, math.ceil(math.log2(max(2.0, (stats.t or 0.0) / shard_words))))
    tree = splitting_tree(quotas, levels, seed)
    to = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = materialize(tree.withColumn("upto", F.sum("quota").over(to)).filter("quota > 0"), "ranges")
    # ranges meet draws on cells as wide as a source's mean quota: a few ranges per cell, a few cells per range
    width = small_side(quotas.select(F.col("source_no").alias("w_source"), F.greatest(F.lit(1), F.ceil(F.col("quota") / 2 ** levels)).cast("bigint").alias("width")))
    first = F.col("upto") - F.col("quota")
    cells = ranges.join(width, F.col("source_no") == F.col("w_source")).select(
        "shard", F.col("source_no").alias("r_source"), first.alias("from"), "upto",
        F.explode(F.sequence(F.floor(first / F.col("width")), F.floor((F.col("upto") - 1) / F.col("width")))).alias("r_cell"))
    placed = draws.join(width, F.col("source_no") == F.col("w_source")).withColumn("cell", F.floor(F.col("draw_no") / F.col("width"))).join(
        cells, (F.col("source_no") == F.col("r_source")) & (F.col("cell") == F.col("r_cell")) & (F.col("draw_no") >= F.col("from")) & (F.col("draw_no") < F.col("upto")))
    local = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "order"), "order", "row")
    return placed.select("shard", (F.row_number().over(local) - 1).cast("bigint").alias("position"), "source_no", "row", "block", "pass", "words"), targets


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    rows = document_rows(docs, id_col, text_col, source_col)
    drawn, targets = mix(rows, **options)
    taken = drawn.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("taken"))
    about = small_side(targets.select(F.col("source").alias("src"), "source_size", "target"))
    return rows.join(about, F.col("source").eqNullSafe(F.col("src"))).join(taken, F.col("row") == F.col("r"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 256, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row per document and pass.

    A document drawn whole keeps its text; of one drawn in part, the drawn words are joined by single spaces.
    A column ``n_chars`` is set to the new text's length.
    """
    rows = document_rows(docs, id_col, text_col, source_col, list(docs.columns))
    drawn, _ = mix(rows.drop("doc"), block_words=block_words, **options)
    parts = drawn.groupBy(F.col("row").alias("r"), "pass").agg(F.sum("words").alias("got"), F.sort_array(F.collect_list(F.struct("block", "words"))).alias("parts"))
    joined = rows.join(parts, F.col("row") == F.col("r"))
    text, words = F.col("doc").getField(text_col), free_name(docs, "_words")
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col(words), (p["block"] * block_words + 1).cast("int"), p["words"].cast("int")))), " ")
    joined = joined.withColumn(words, F.when(F.col("got") < F.col("size"), words_of(text)))
    joined = joined.withColumn("_text", F.when(F.col("got") < F.col("size"), cut).otherwise(text))
    changed = {text_col: F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
