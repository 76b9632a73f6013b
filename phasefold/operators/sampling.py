"""File-aware sampling plans, splits and geometry checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from phasefold.functions.hashing import hash32
from phasefold.functions.linalg import with_eigenvalues
from phasefold.functions.order import hash_bucket_counts, hash_take, take_buckets

MODES = ("equal_files", "sqrt_size", "proportional")


def _weight(mode: str) -> Column:
    size = F.greatest(F.col("n_rows").cast("double"), F.lit(1.0))
    if mode == "equal_files":
        return F.lit(1.0)
    if mode == "sqrt_size":
        return F.sqrt(size)
    if mode == "proportional":
        return size
    raise ValueError(f"unknown sampling mode {mode!r}; choose from {MODES}")


def allocate_base(sizes: DataFrame, cap: int, mode: str = "proportional") -> DataFrame:
    """Capped allocation before any donor step: floor shares, then one pass of leftovers.

    ``sizes`` is the file table (file_id, n_rows), one row per source file, so
    its global windows stay small whatever the data volume is.  Leftover rows go
    one each, by descending fractional share (ties by file), to files with room.
    """
    raw = F.lit(float(cap)) * (F.col("_w") / F.sum("_w").over(Window.partitionBy()))
    plan = sizes.withColumn("_w", _weight(mode)).withColumn("_raw", raw)
    plan = plan.withColumns({"_floor": F.floor("_raw"), "_frac": F.col("_raw") - F.floor("_raw")})
    plan = plan.withColumn("_cnt", F.least(F.col("_floor"), F.col("n_rows")))
    plan = plan.withColumn("_left", F.lit(cap) - F.sum("_cnt").over(Window.partitionBy()))
    room = F.col("_cnt") < F.col("n_rows")
    queue = Window.partitionBy(room).orderBy(F.col("_frac").desc(), "file_id")
    plan = plan.withColumn("_turn", F.row_number().over(queue))
    extra = F.when(room & (F.col("_turn") <= F.col("_left")), 1).otherwise(0)
    return plan.select("file_id", "n_rows", (F.col("_cnt") + extra).cast("bigint").alias("n_take"))


def allocate(sizes: DataFrame, cap: int, mode: str = "proportional", min_per_nonzero: int = 1) -> DataFrame:
    """Full allocation: base plan plus the donor step.

    Each file left empty, in file order, takes one row from the currently
    largest share as long as that stays above ``min_per_nonzero``.  Taking one
    from the largest E times levels the shares from the top, so the step has a
    closed form: shares are cut to the level that frees at most E rows, and what
    is still missing comes from the first files standing at that level.
    """
    base = allocate_base(sizes, cap, mode)
    if min_per_nonzero <= 0 or cap <= 0:
        return base
    whole = Window.partitionBy()
    needy = (F.col("n_rows") >= min_per_nonzero) & (F.col("n_take") == 0)
    top = Window.orderBy(F.col("n_take").desc(), "file_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = base.withColumns({"_need": needy, "_e": F.count_if(needy).over(whole), "_p": F.sum("n_take").over(top), "_i": F.count(F.lit(1)).over(top)})
    plan = plan.withColumn("_level", F.greatest(F.max(F.ceil((F.col("_p") - F.col("_e")) / F.col("_i"))).over(whole), F.lit(min_per_nonzero)))
    plan = plan.withColumn("_cut", F.greatest(F.col("n_take") - F.col("_level"), F.lit(0)))
    plan = plan.withColumn("_rest", F.col("_e") - F.sum("_cut").over(whole))
    level = (F.col("n_take") >= F.col("_level")) & (F.col("_level") > min_per_nonzero)
    plan = plan.withColumns({"_at": level, "_turn": F.row_number().over(Window.partitionBy(level).orderBy("file_id"))})
    plan = plan.withColumn("_give", F.col("_cut") + F.when(F.col("_at") & (F.col("_turn") <= F.col("_rest")), 1).otherwise(0))
    plan = plan.withColumns({"_given": F.sum("_give").over(whole), "_place": F.row_number().over(Window.partitionBy("_need").orderBy("file_id"))})
    taken = F.when(F.col("_need") & (F.col("_place") <= F.col("_given")), 1).otherwise(F.col("n_take") - F.col("_give"))
    return plan.select("file_id", "n_rows", taken.cast("bigint").alias("n_take"))


def allocate_full_small(sizes: DataFrame, cap: int, mode: str = "proportional", large_files: int = 2,
                        large_names: Sequence[str] = ()) -> DataFrame:
    """Cap only the largest (or the named) files and keep every other file whole."""
    if large_names:
        flagged = sizes.withColumn("_large", F.col("file_id").cast("string").isin(*[str(n) for n in large_names]))
        if flagged.where("_large").limit(1).count() == 0:
            raise ValueError("none of the named large files exists")
    else:
        flagged = sizes.withColumn("_large", F.row_number().over(Window.orderBy(F.col("n_rows").desc(), "file_id")) <= large_files)
    large = flagged.where("_large").drop("_large")
    small = flagged.where("not _large").select("file_id", "n_rows", F.col("n_rows").cast("bigint").alias("n_take"))
    return allocate(large, cap, mode).unionByName(small)


def sample_per_file(df: DataFrame, plan: DataFrame, key: str = "particle_id", seed: int = 0) -> DataFrame:
    """Exactly ``n_take`` rows of each file, without replacement, in hash order."""
    return hash_take(df.join(plan.select("file_id", "n_take"), "file_id"), F.col("n_take"), ["file_id"], key, seed).drop("n_take")


def split_files(files: DataFrame, val_fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """File-level split in hash order with at least one validation file; a lone file serves both sides."""
    order = Window.orderBy(hash32("file_id", seed), "file_id")
    placed = files.select("file_id").withColumns({"_r": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    n_val = F.greatest(F.bround(F.col("_n") * F.lit(float(val_fraction))), F.lit(1))
    part = (
        F.when(F.col("_n") == 1, F.array(F.lit("training"), F.lit("validation")))
        .when(n_val >= F.col("_n"), F.array(F.lit("training"), F.lit("validation")))
        .when(F.col("_r") <= n_val, F.array(F.lit("validation"))).otherwise(F.array(F.lit("training")))
    )
    return placed.select("file_id", F.explode(part).alias("split"))


def split_rows(df: DataFrame, n_train: int, n_val: int, by: Sequence[str] = (), key: str = "particle_id", seed: int = 42) -> DataFrame:
    """Disjoint training and validation rows: consecutive ranges of the hash order."""
    taken = hash_take(df, n_train + n_val, by, key, seed, rank="_r")
    return taken.withColumn("split", F.when(F.col("_r") < n_train, F.lit("training")).otherwise(F.lit("validation"))).drop("_r")


def balanced_centres(df: DataFrame, n: int, key: str = "particle_id", seed: int = 0) -> DataFrame:
    """``n`` centres spread evenly over files, remainders to the first files.

    Centres are drawn with replacement: the ``t``-th draw of a file picks the
    hash-ranked row ``t mod size``.
    """
    sizes = df.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows"))
    ranked = sizes.withColumns({
        "_no": F.row_number().over(Window.orderBy("file_id")) - 1, "_files": F.count(F.lit(1)).over(Window.partitionBy())})
    quota = F.floor(F.lit(n) / F.col("_files")) + F.when(F.col("_no") < F.lit(n) % F.col("_files"), 1).otherwise(0)
    plan = ranked.select("file_id", "n_rows", quota.cast("bigint").alias("_quota"))
    drawn = hash_take(df.join(plan, "file_id"), F.col("_quota"), ["file_id"], key, seed, rank="_r")
    repeats = F.explode(F.sequence(F.col("_r"), F.col("_quota") - 1, F.col("n_rows")))
    return drawn.withColumn("draw", repeats).drop("_r", "_quota", "n_rows")


def geometry_report(df: DataFrame, by: Sequence[str] = (), sample_cap: int | None = None, key: str = "particle_id", seed: int = 404) -> DataFrame:
    """Axis ratio sqrt(largest / smallest eigenvalue) of the sample covariance of positions; NaN up to three rows."""
    sampled = df if sample_cap is None else hash_take(df, sample_cap, by, key, seed)
    pairs = {"xx": ("x", "x"), "yy": ("y", "y"), "zz": ("z", "z"), "xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}
    cov = sampled.groupBy(*by).agg(F.count(F.lit(1)).alias("sampled"), *[F.covar_samp(a, b).alias(f"_{n}") for n, (a, b) in pairs.items()])
    out = with_eigenvalues(cov, [f"_{n}" for n in pairs], floor=1e-12).drop(*[f"_{n}" for n in pairs])
    few = F.col("sampled") <= 3
    nan = F.lit(float("nan"))
    out = out.withColumn("axis_ratio", F.when(few, nan).otherwise(F.sqrt(F.col("l_max") / F.col("l_min"))))
    return out.withColumns({c: F.when(few, nan).otherwise(F.col(c)) for c in ("l_min", "l_mid", "l_max")})


def geometry_gate(df: DataFrame, stream_min: float = 1.15, background_max: float = 1.30, sample_cap: int | None = None) -> DataFrame:
    """One row: class axis ratios and whether relative stream rotation is allowed."""
    report = geometry_report(df, by=["is_stream"], sample_cap=sample_cap)
    ratios = report.agg(F.max(F.when(F.col("is_stream") == 1, F.col("axis_ratio"))).alias("stream_axis_ratio"),
                        F.max(F.when(F.col("is_stream") != 1, F.col("axis_ratio"))).alias("background_axis_ratio"))
    ok = (F.col("stream_axis_ratio") >= stream_min) & ~F.isnan("stream_axis_ratio") & (F.col("background_axis_ratio") <= background_max)
    return ratios.withColumn("relative_rotation", ok)


def stream_share(mode: str, max_raw: int, target: float = 0.10) -> Callable[[Column, Column], Column]:
    """How many stream rows a cap of ``max_raw`` rows should hold, from both class sizes."""
    if mode == "balanced":
        return lambda n_stream, n_background: F.lit(max_raw // 2)
    if mode == "target_prior":
        return lambda n_stream, n_background: F.lit(round(max_raw * min(max(target, 0.0), 1.0)))
    if mode == "proportional":
        return lambda n_stream, n_background: F.bround(F.lit(max_raw) * (n_stream.cast("double") / (n_stream + n_background)))
    raise ValueError(f"unknown raw subsample mode {mode!r}")


def chunk_quota(n_stream: Column, n_background: Column, max_raw: int, mode: str = "balanced", target: float = 0.10) -> tuple[Column, Column]:
    """Rows of each class a capped chunk keeps.  Without a positive cap, or under it, all stay.

    A full cap holds s stream and cap - s background rows.  The classes' sizes, and one row for each class
    that has any, leave an interval for s; the share asked for is moved into it, so what one class can't fill goes to
    the other.
    """
    if max_raw <= 0:
        return n_stream.cast("bigint"), n_background.cast("bigint")
    wish = stream_share(mode, max_raw, target)(n_stream, n_background).cast("bigint")
    one = lambda n: F.least(n.cast("bigint"), F.lit(1))
    most = F.least(n_stream.cast("bigint"), F.lit(max_raw) - one(n_background))
    fewest = F.greatest(F.lit(max_raw) - n_background.cast("bigint"), F.least(one(n_stream), most))
    stream = F.greatest(fewest, F.least(most, wish))
    whole = n_stream + n_background <= max_raw
    return F.when(whole, n_stream).otherwise(stream).cast("bigint"), F.when(whole, n_background).otherwise(F.lit(max_raw) - stream).cast("bigint")


def chunk_cap(members: DataFrame, chunk: Sequence[str], max_raw: int = 160_000, mode: str = "balanced", target: float = 0.10,
              key: str = "particle_id", seed: int = 0) -> DataFrame:
    """Class-aware cap of the rows of each chunk, drawn in hash order.

    A ``_hash`` column computed before the chunks were formed is used when present.
    """
    chunk = list(chunk)
    by = [*chunk, "is_stream"]
    counts, shift = hash_bucket_counts(members, by, key, seed)
    whole = Window.partitionBy(*chunk)  # bucket table: a few hundred rows per chunk
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))).over(whole), F.lit(0))
    counts = counts.withColumns({"_ns": total(F.col("is_stream") == 1), "_nb": total(F.col("is_stream") != 1)})
    keep_s, keep_b = chunk_quota(F.col("_ns"), F.col("_nb"), max_raw, mode, target)
    counts = counts.withColumn("_take", F.when(F.col("is_stream") == 1, keep_s).otherwise(keep_b)).drop("_ns", "_nb")
    return take_buckets(members, counts, shift, by, key, seed, rank=None)
