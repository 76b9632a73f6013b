"""Chat formatting from reply trees.

Messages form trees by parent id.  Iterative self-joins enumerate root-to-leaf
paths: each round doubles the known stretch of ancestors of every message
(pointer jumping), so a thread of n turns takes log2(n) joins, and no recursion
runs on the driver.  Branches of a tree are ranked by the sum of their messages'
scores (ties: smallest leaf id), the chosen ones are formatted, one path to one
conversation.

Template: a turn is ``### Role: `` + text + `` </turn>`` + newline.  Inside
roles and texts the backslash and the two control strings are replaced by
two-character codes, which is reversible; every backslash in the output
therefore starts a code and no text can imitate a control string.

Defined results: a null text or role is empty; a message whose parent does not
exist is a root; messages on a cycle belong to no path; an empty table gives an
empty table; repeated rows are separate turns when ``linear_thread`` makes the
tree; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phasefold.llm.common import materialize

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: Control strings and their codes inside texts; the backslash comes first when escaping, last when undoing it.
CODES = [("\\", "\\-"), ("###", "\\h"), ("</turn>", "\\t"), (":", "\\c")]


def escape(text: Column, colon: bool = False) -> Column:
    """Replace control strings; ``colon`` too where the text ends at one (roles)."""
    for plain, code in CODES if colon else CODES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def linear_thread(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Flat conversations as reply trees: every row answers the one before it (by turn; ties by role, then text)."""
    flat = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("bigint")
    return flat.withColumn("msg_id", number).select(
        "conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def root_paths(messages: DataFrame) -> DataFrame:
    """Per leaf: conv_id, leaf_id, root_id, path (message ids from the root), score; ids are unique within a conversation.

    ``messages``: conv_id, msg_id, parent_id, score.
    """
    links = messages.select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = links.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"))
    known = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent_id") == F.col("m"))
    # up: the nearest ancestor that the stretch does not hold yet
    state = links.join(ids, known, "left").select(
        "conv_id", "msg_id", F.col("m").alias("up"), F.array("msg_id").alias("path"), "score")
    parents = links.select(F.col("conv_id").alias("c"), F.col("parent_id").alias("p")).distinct()
    leaves = links.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("p")), "left_anti").select(
        F.col("conv_id").alias("c"), F.col("msg_id").alias("leaf"))
    state = materialize(state, "threads")
    total = state.count()
    done, active, reach = state.filter("up IS NULL"), state.filter("up IS NOT NULL"), 1
    while reach <= total and not active.isEmpty():
        far = done.unionByName(active).select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.col("up").alias("next"), F.col("path").alias("before"), F.col("score").alias("more"))
        joined = active.join(far, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("m")))
        state = materialize(joined.select(
            "conv_id", "msg_id", F.col("next").alias("up"), F.concat("before", "path").alias("path"), (F.col("score") + F.col("more")).alias("score")), "threads")
        done, active = done.unionByName(state.filter("up IS NULL")), state.filter("up IS NOT NULL")
        reach *= 2
    return done.join(leaves, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("leaf")), "left_semi").select(
        "conv_id", F.col("msg_id").alias("leaf_id"), F.element_at("path", 1).alias("root_id"), "path", "score")


def rank_branches(paths: DataFrame, best: int | None = 1) -> DataFrame:
    """Adds branch_rank within each tree and keeps the ``best`` ones (None: all).

    Leaves of one tree are first cut to ``best`` per slice of leaf ids, so that a tree with very many leaves meets in
    one task only with a bounded number per slice.
    """
    order = [F.desc("score"), F.asc("leaf_id")]
    if best is not None:
        slice_ = F.pmod(F.xxhash64("leaf_id"), F.lit(64))
        paths = paths.withColumn("_slice", slice_)
        paths = paths.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id", "root_id", "_slice").orderBy(*order)))
        paths = paths.filter(F.col("_r") <= best).drop("_slice", "_r")
    ranked = paths.withColumn("branch_rank", F.row_number().over(Window.partitionBy("conv_id", "root_id").orderBy(*order)).cast("bigint"))
    return ranked if best is None else ranked.filter(F.col("branch_rank") <= best)


def format_paths(messages: DataFrame, paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Per chosen path: conv_id, root_id, leaf_id, branch_rank, n_turns, formatted, loss_spans.

    A loss span (start, length in code points of ``formatted``) covers the escaped text of one turn of ``loss_role``.
    """
    steps = paths.select("conv_id", "root_id", "leaf_id", "branch_rank", F.posexplode("path").alias("at", "msg"))
    body = messages.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"),
                           F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = steps.join(body, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m"))).select(
        "conv_id", "root_id", "leaf_id", "branch_rank",
        F.struct("at", F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("text"),
                 (F.col("role") == loss_role).alias("loss")).alias("turn"))
    whole = turns.groupBy("conv_id", "root_id", "leaf_id", "branch_rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE))), "")
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["end"] + F.length(t["head"]) + F.length(t["text"]) + len(CLOSE)).alias("end"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["end"] + F.length(t["head"])).cast("bigint").alias("start"), F.length(t["text"]).cast("bigint").alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return whole.select("conv_id", "root_id", "leaf_id", "branch_rank", F.size("turns").cast("bigint").alias("n_turns"),
                        formatted.alias("formatted"), ends["spans"].alias("loss_spans"))


def format_trees(messages: DataFrame, best: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """Reply trees to formatted conversations: paths, ranking, template."""
    return format_paths(messages, rank_branches(root_paths(messages), best), loss_role)


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text)."""
    pieces = F.filter(F.split(formatted, " </turn>\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(F.split(p, MIDDLE, 2)[0], len(OPEN) + 1, 2147483647)).alias("role"), unescape(F.split(p, MIDDLE, 2)[1]).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, all taken from ``formatted`` and ``loss_spans`` alone."""
    turns = parse_turns(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    out = formatted.withColumn("_turns", turns).withColumn("_loss", loss)
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
