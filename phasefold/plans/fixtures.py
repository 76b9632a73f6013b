"""Particle views over the driver tables, stated once for Spark and for the SQL check.

Every expression is plain SQL that both engines evaluate bit for bit alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PARTICLE_ID = "(l_orderkey * 8 + l_linenumber) * 20000000 + CAST(round(l_extendedprice * 100) AS BIGINT)"
PROB = "CAST((l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"

P_VOL = {
    "particle_id": PARTICLE_ID,
    "file_id": "l_suppkey",
    "split": "CASE WHEN l_linestatus = 'F' THEN 'training' ELSE 'validation' END",
    "is_stream": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "x": "(l_extendedprice - CAST(53000 AS DOUBLE)) / CAST(300 AS DOUBLE)",
    "y": "CAST((l_partkey * 7) % 400 - 200 AS DOUBLE)",
    "z": "CAST((l_suppkey * 37) % 400 - 200 AS DOUBLE)",
    "vx": "(l_quantity - CAST(25 AS DOUBLE)) * CAST(8 AS DOUBLE)",
    "vy": "(l_discount - CAST(0.05 AS DOUBLE)) * CAST(4000 AS DOUBLE)",
    "vz": "(l_tax - CAST(0.04 AS DOUBLE)) * CAST(4000 AS DOUBLE)",
    "mass": "CAST(1 AS DOUBLE)",
}

# The volume with a score and a score variance per row.
P_PRED = {**P_VOL, "prob": PROB, "variance": f"({PROB}) * (CAST(1 AS DOUBLE) - ({PROB})) / CAST(4 AS DOUBLE)"}

SCORED = {"y_true": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "prob": PROB}

CENTRES = {
    "centre_id": "s_suppkey",
    "cx": "CAST((s_suppkey * 13) % 300 - 150 AS DOUBLE)",
    "cy": "CAST((s_suppkey * 29) % 360 - 180 AS DOUBLE)",
    "cz": "CAST((s_suppkey * 53) % 360 - 180 AS DOUBLE)",
}


def _patch(element: str) -> dict[str, str]:
    pick = lambda i: f"CAST({element.format(i=i)} AS DOUBLE)"
    cols = {"particle_id": "vec_id", "file_id": "label", "is_stream": "CASE WHEN label < 2 THEN 1 ELSE 0 END"}
    cols |= {c: f"CAST(100 AS DOUBLE) * {pick(i + 1)}" for i, c in enumerate(("x", "y", "z"))}
    cols |= {c: f"CAST(1000 AS DOUBLE) * {pick(i + 4)}" for i, c in enumerate(("vx", "vy", "vz"))}
    return cols


def _select(cols: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {table}"


VIEWS = {
    "p_vol": _select(P_VOL, "lineitem"),
    "p_pred": _select(P_PRED, "lineitem"),
    "scored": _select(SCORED, "lineitem"),
    "p_patch": _select(_patch("embedding[{i}]"), "embeddings"),
    "centres": _select(CENTRES, "supplier"),
}


def phase_sql(source: str, floor_radius: bool = False) -> str:
    """Level-14 columns over a view of base columns."""
    guard = "greatest(r, 1e-8)" if floor_radius else "CASE WHEN r = 0 THEN 1e-8 ELSE r END"
    return (
        f"SELECT *, sqrt(greatest(speed * speed - vr * vr, 0)) AS vt, sqrt(lx * lx + ly * ly + lz * lz) AS lmag FROM ("
        f"SELECT *, (x * vx + y * vy + z * vz) / ({guard}) AS vr, sqrt(vx * vx + vy * vy + vz * vz) AS speed, "
        f"y * vz - z * vy AS lx, z * vx - x * vz AS ly, x * vy - y * vx AS lz FROM ("
        f"SELECT *, sqrt(x * x + y * y + z * z) AS r FROM {source}))"
    )


def with_views(body: str, *names: str, **extra: str) -> str:
    """``WITH`` the named fixture views and extra views, then ``body``."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def quantile_sql(source: str, col: str, q: float, name: str = "cut") -> str:
    """One-row interpolated quantile, by rank."""
    pos = f"(n - 1) * CAST({q!r} AS DOUBLE)"
    frac = f"(max({pos}) - floor(max({pos})))"
    low, high = (f"max(CASE WHEN rn = {rank} THEN v END)" for rank in (f"floor({pos})", f"least(floor({pos}) + 1, n - 1)"))
    return (f"SELECT CASE WHEN {frac} = 0 OR {low} = {high} THEN {low} ELSE (1 - {frac}) * {low} + {frac} * {high} END AS {name} FROM "
            f"(SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS rn, count(*) OVER () AS n FROM {source})")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _view(spark: SparkSession, sf_dir: str, table: str, cols: dict[str, str]) -> DataFrame:
    rows = read(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    if table == "lineitem" and rows.rdd.getNumPartitions() < cores:
        # A single small file is one row group and would keep one core busy; a real table has splits enough.
        rows = rows.repartition(cores, "l_orderkey", "l_partkey")
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])


def p_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", P_VOL)


def p_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", P_PRED)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", SCORED)


def p_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "embeddings", _patch("element_at(embedding, {i})"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", CENTRES)


def rd(col: Column | str, digits: int = 6) -> Column:
    """Round to a grid whose steps lie off every short decimal, so engines never split on a tie."""
    value = F.col(col) if isinstance(col, str) else col
    return F.floor(value.cast("double") * F.lit(10.0 ** digits) + F.lit(0.4637)) / F.lit(10.0 ** digits)


def rd_sql(expr: str, digits: int = 6) -> str:
    return f"(floor(CAST({expr} AS DOUBLE) * {10.0 ** digits:.1f} + 0.4637) / CAST({10 ** digits} AS DOUBLE))"


def rounded(df: DataFrame, digits: dict[str, int] | int, cols: list[str] | None = None) -> DataFrame:
    chosen = digits if isinstance(digits, dict) else {c: digits for c in cols or []}
    return df.withColumns({c: rd(c, d) for c, d in chosen.items()})


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where plain SQL can state it over whole tables, its check."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
