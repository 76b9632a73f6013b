import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasefold.operators import spatial
from phasefold.plans import pipelines
from tests.conftest import BASE


def test_every_draw_is_a_patch_of_its_own(spark, cloud):
    rows = spark.createDataFrame(cloud.drop_duplicates(BASE[:3]).head(400))
    at = pipelines.patch_centres(rows.where("is_stream = 1 AND particle_id % 9 = 0").unionByName(rows.where("is_stream = 0")), 60, 20, seed=3).cache()
    n = at.count()
    assert n > at.select("centre_id").distinct().count()  # few stream rows, many draws
    points, summary = pipelines.patch_table(rows, at, k=10, augmented=True)
    got = points.toPandas()
    sizes = got.groupby(["centre_id", "draw"]).size()
    assert len(sizes) == n and (sizes == 10).all() and summary.count() == n
    # the draws of a centre hold the same neighbours, jittered differently
    draws = got.groupby("centre_id").draw.unique()
    centre = next(c for c, d in draws.items() if len(d) > 1)
    first, second = (got[(got.centre_id == centre) & (got.draw == d)].sort_values("rank") for d in sorted(draws[centre])[:2])
    assert first.neigh_id.tolist() == second.neigh_id.tolist()
    assert not np.allclose(first.pf03, second.pf03) and first.slot.tolist() != second.slot.tolist()
    for part in (first, second):
        assert sorted(part.slot) == list(range(10))


def test_centres_without_draws_stay_as_they_were(spark, cloud):
    rows = spark.createDataFrame(cloud.drop_duplicates(BASE[:3]).head(200))
    at = rows.select(F.col("particle_id").alias("centre_id"), F.lit(-1).cast("bigint").alias("source"), F.lit(0).alias("label"), *BASE).limit(20)
    points, _ = pipelines.patch_table(rows, at, k=8)
    assert "draw" not in points.columns and points.count() == 20 * 8


def test_brick_lattice_covers_the_range(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [-100.0, 155.0], "y": [0.0, 10.0], "z": [-64.0, 64.0]}))
    got = spatial.brick_lattice(df, 128.0, 0.5).toPandas()
    axes = [sorted(got[c].unique()) for c in ("cx", "cy", "cz")]
    assert axes[0] == [-36.0, 28.0, 92.0, 156.0] and axes[1] == [64.0] and axes[2] == [0.0, 64.0, 128.0]
    assert len(got) == 12 and not got.duplicated(["bi", "bj", "bk"]).any()
    assert (got.cx == -36.0 + got.bi * 64.0).all() and (got.cz == got.bk * 64.0).all()
    empty = spatial.brick_lattice(df.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns.tolist()
    with pytest.raises(ValueError):
        spatial.brick_lattice(df, 128.0, 0.0)
