import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasefold.functions import order


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=6000), np.zeros(3000), rng.exponential(size=40)])
    return pd.DataFrame({"g": np.where(np.arange(len(v)) < 8000, 0, 1), "v": v, "particle_id": np.arange(len(v))})


@pytest.mark.parametrize("held", [0, 10**6])
def test_exact_quantiles_both_ways(spark, values, held):
    qs = [0.001, 0.25, 0.5, 0.93, 1.0]
    got = order.exact_quantiles(spark.createDataFrame(values), "v", qs, ["g"], held_rows=held).toPandas().set_index("g")
    for g, part in values.groupby("g"):
        np.testing.assert_allclose(got.loc[g, [f"q{i}" for i in range(5)]].astype(float), np.quantile(part.v, qs), rtol=1e-12)


def test_quantiles_ignore_missing_values(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [1.0, 2.0, np.nan, 4.0]}))
    assert order.exact_quantiles(df, "v", [0.5]).first()["q0"] == 2.0


def test_radix_quantiles_on_large_group(spark):
    df = spark.range(900_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 5.0D ELSE double(id % 7919) END").alias("v"))
    got = order.exact_quantiles(df, "v", [0.1, 0.9, 0.995], held_rows=0).first()
    want = np.quantile(df.toPandas().v, [0.1, 0.9, 0.995])
    assert [got["q0"], got["q1"], got["q2"]] == pytest.approx(list(want), rel=1e-12)


def test_prefix_sums_match_cumsum(spark, values):
    df = spark.createDataFrame(values).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = order.prefix_sums(df, "v", {"c": "n"}, part_rows=400).orderBy("v").toPandas()
    assert (got.c == got.n.cumsum()).all()
    down = order.prefix_sums(df, "v", {"c": "n"}, descending=True, part_rows=400).orderBy(F.desc("v")).toPandas()
    assert (down.c == down.n.cumsum()).all()


def test_hash_take_is_exact_and_stable(spark, values):
    df = spark.createDataFrame(values)
    one = order.hash_take(df, 300, ["g"], seed=5).toPandas()
    two = order.hash_take(df.repartition(7), 300, ["g"], seed=5).toPandas()
    assert one.groupby("g").size().tolist() == [300, 300]
    assert set(one.particle_id) == set(two.particle_id)
    assert set(order.hash_take(df, 300, ["g"], seed=6).toPandas().particle_id) != set(one.particle_id)
    assert order.hash_take(df, 10**6, ["g"]).count() == len(values)


def test_hash_take_with_finer_buckets(spark, values, monkeypatch):
    whole = set(order.hash_take(spark.createDataFrame(values), 300, ["g"]).toPandas().particle_id)
    monkeypatch.setattr(order, "HELD_ROWS", 20)
    assert set(order.hash_take(spark.createDataFrame(values), 300, ["g"]).toPandas().particle_id) == whole


def test_hash_seeds_are_unrelated(spark):
    from phasefold.functions.hashing import normal, uniform

    u = spark.range(20000).select(*[uniform("id", s).alias(f"u{s}") for s in (0, 1, 2, 100)], normal("id", 5).alias("g")).toPandas()
    corr = np.corrcoef(u.to_numpy().T) - np.eye(5)
    assert np.abs(corr).max() < 0.04
    for c in ("u0", "u1", "u2", "u100"):
        assert np.abs(np.histogram(u[c], 20, (0, 1))[0] / 1000 - 1).max() < 0.15
    assert abs(u.g.mean()) < 0.03 and abs(u.g.std() - 1) < 0.03


def test_radix_selection_over_the_whole_range_of_doubles(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308], [2.5] * 900, [np.inf, -np.inf]])
    qs = [0.0, 0.1, 0.37, 0.5, 0.9, 0.99]
    df = spark.createDataFrame(pd.DataFrame({"_v": v}))
    got = order.radix_quantiles(df.repartition(5), qs).first()
    ranked = np.sort(v)
    for i, q in enumerate(qs):
        pos = q * (len(v) - 1)
        low, high, f = ranked[int(pos)], ranked[min(int(pos) + 1, len(v) - 1)], pos - int(pos)
        assert got[f"q{i}"] == pytest.approx(low if f == 0 or low == high else (1 - f) * low + f * high, rel=1e-15)
    assert got["n"] == len(v) and order.radix_quantiles(df.limit(0), qs).count() == 0


def test_prefix_sums_of_skewed_scores_keep_partitions_small(spark):
    """Most values crowd in a millionth of the range; every partition still holds about the rows asked for."""
    rng = np.random.default_rng(6)
    v = np.unique(np.concatenate([rng.random(6000) * 1e-6, rng.random(300) * 1e6]))
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(v)) % 2, "v": v, "n": 1}))
    seen = []
    plain = order.small_side
    order.small_side = lambda offsets, *rest: seen.append(offsets.count()) or plain(offsets, *rest)
    try:
        got = order.prefix_sums(df, "v", {"c": "n"}, by=["g"], part_rows=500).toPandas().sort_values(["g", "v"])
    finally:
        order.small_side = plain
    assert (got.c == got.groupby("g").n.cumsum()).all() and seen[0] >= len(v) // 500


def test_radix_selection_holds_only_rows_near_the_ranks(spark, monkeypatch):
    v = np.random.default_rng(8).lognormal(0.0, 8.0, 5000)
    held, plain = [], order.cut_lineage
    monkeypatch.setattr(order, "cut_lineage", lambda df: held.append(df.count()) or plain(df))
    got = order.radix_quantiles(spark.createDataFrame(pd.DataFrame({"_v": v})), [0.4]).first()
    assert got.q0 == pytest.approx(np.quantile(v, 0.4), rel=1e-12) and max(held) < len(v) // 5


def test_only_the_bucket_at_the_cut_is_ranked(spark):
    df = spark.range(5000).withColumnRenamed("id", "particle_id").withColumn("file_id", F.col("particle_id") % 2)
    ranked = order.hash_take(df, 900, ["file_id"], rank="r").drop("r")
    plain = order.hash_take(df, 900, ["file_id"])
    assert plain.exceptAll(ranked).count() == 0 and plain.count() == 1800
