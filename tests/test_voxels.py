import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasefold.functions import order, phase
from phasefold.operators import blending, serial, spatial, voxels
from phasefold.plans import pipelines, registry

COORDS = [f"c{i}" for i in range(6)]


def test_velocity_keeps_equal_positions_apart(spark):
    rows = [(0, 0.1, 0.2, 0.3, 0.0, 0.0, 0.0, 1.0, 0), (1, 0.1, 0.2, 0.3, 2.0, 0.0, 0.0, 1.0, 1)]
    df = spark.createDataFrame(rows, ["particle_id", *COORDS, "feat", "is_stream"])
    cells = voxels.sparse_cells(df, [], ["feat"], grid=0.5, keep_raw=True)
    assert cells.count() == 2
    assert cells.select("c0", "c1", "c2").distinct().count() == 1
    got = {tuple(r[g] for g in voxels.GRID): r.label for r in cells.collect()}
    assert got == {(0,) * 6: 0, (0, 0, 0, 4, 0, 0): 1}
    back = voxels.cell_to_particle(df, cells, [], ["label"], 0.5).select("particle_id", "label").collect()
    assert {r.particle_id: r.label for r in back} == {0: 0, 1: 1}


def test_cells_of_a_random_chunk(spark, cloud):
    full = phase.phase_columns(spark.createDataFrame(cloud))
    ready, cells = pipelines.cell_pipeline(full, ["file_id"], [F.lit(0.0)] * 3, grid_size=8.0)
    got = cells.toPandas()
    assert got.n.sum() == len(cloud) and (got[list(voxels.GRID)].groupby(got.file_id).min() == 0).all().all()
    part = ready.where("file_id = 1").toPandas()
    raw = np.floor(part[COORDS].to_numpy() / part.grid_eff.to_numpy()[:, None])
    keys, inverse, counts = np.unique(raw - raw.min(0), axis=0, return_inverse=True, return_counts=True)
    mine = got[got.file_id == 1].sort_values(list(voxels.GRID))
    np.testing.assert_array_equal(mine[list(voxels.GRID)], keys)
    np.testing.assert_array_equal(mine.n, counts)
    v = part[["vx", "vy", "vz"]].to_numpy()
    want = [np.std(v[inverse.ravel() == i]) for i in range(len(keys))]
    np.testing.assert_allclose(mine.voxel_sigma_v, want, atol=1e-6)
    unit = part[["lx", "ly", "lz"]].to_numpy()
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-8)
    np.testing.assert_allclose(mine.voxel_l_align, [np.linalg.norm(unit[inverse.ravel() == i].mean(0)) for i in range(len(keys))], atol=1e-9)


def test_cell_cap_and_its_guard(spark):
    rng = np.random.default_rng(2)
    grid = np.unique(rng.integers(0, 2**31 - 1, size=(500, 6)), axis=0)
    df = spark.createDataFrame(pd.DataFrame(grid, columns=voxels.GRID).assign(chunk=1))
    got = voxels.cell_hash_cap(df, ["chunk"], 50).toPandas()[list(voxels.GRID)].to_numpy()
    h = [sum(int(v) * p for v, p in zip(row, voxels.HASH_PRIMES)) % 2**64 for row in grid]
    want = grid[np.argsort(np.array(h, dtype=object))[:50]]
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
    with pytest.raises(ValueError):
        voxels.cell_hash_cap(df.withColumn("f0", F.lit(0)), ["chunk"], 5)
    with pytest.raises(ValueError):
        voxels.cell_label(F.lit(1), F.lit(2), "most")


def test_tasks_of_a_cell_cap_follow_the_rows(spark, monkeypatch):
    ask = lambda: registry.QUERIES["cell_hash_cap"](spark, "/root/testdata/sf0.001")
    plain = sorted(map(tuple, ask().collect()))
    monkeypatch.setattr(order, "TASK_ROWS", 500)
    cut = ask()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    parts = order.task_parts(spark, spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count())
    assert parts > 8
    assert plan.count(f", {parts}), REPARTITION_BY_NUM") >= 4, plan
    assert sorted(map(tuple, cut.collect())) == plain
    assert order.task_parts(spark, 400) is None


def test_label_rules(spark):
    df = spark.createDataFrame([(1, 2), (0, 2), (1, 3)], ["p", "n"])
    majority = [r[0] for r in df.select(voxels.cell_label(F.col("p"), F.col("n"), "majority")).collect()]
    anyone = [r[0] for r in df.select(voxels.cell_label(F.col("p"), F.col("n"))).collect()]
    assert (majority, anyone) == ([1, 0, 0], [1, 0, 1])


@pytest.mark.parametrize("order", ["z", "z-rev", "z-evenodd", "z-oddeven"])
def test_morton_is_a_bijection(spark, order):
    grid = [(a, b, c) for a in range(8) for b in range(8) for c in range(8)]
    df = spark.createDataFrame(grid, ["a", "b", "c"])
    rows = df.withColumn("code", serial.morton_code(["a", "b", "c"], 3, order)).collect()
    assert {r.code for r in rows} == set(range(512))
    axes = serial.axis_order(3, order)
    for r in rows:
        assert r.code == sum(((r[axes[d]] >> b) & 1) << (b * 3 + d) for b in range(3) for d in range(3))


def test_serial_budget():
    with pytest.raises(ValueError):
        serial.morton_code(list(voxels.GRID), 11)
    with pytest.raises(ValueError):
        serial.axis_order(3, "hilbert")


@pytest.mark.parametrize("n", [5, 8, 19, 24])
def test_serial_patches_borrow_from_the_previous_patch(spark, n):
    df = spark.range(n).select(F.lit(1).alias("chunk"), (F.col("id") * 3).alias("code"))
    got = serial.serial_patches(df, ["chunk"], "code", 8, 20).toPandas().sort_values(["patch", "slot"])
    slots = list(range(n))
    if n > 8 and n % 8:
        slots += [None] * (-n % 8)
        for i in range(n, len(slots)):
            slots[i] = slots[i - 8]
    assert got.position.tolist() == slots
    assert (got.patch * 8 + got.slot).tolist() == list(range(len(slots)))


def test_tiles_cover_their_box(spark, cloud):
    got = spatial.assign_tiles(spark.createDataFrame(cloud), 30.0, 12.0).toPandas()
    pos = cloud[["x", "y", "z"]].to_numpy()
    pairs = set(zip(got.ti, got.tj, got.tk, got.particle_id))
    want = set()
    for i in range(-9, 10):
        for j in range(-9, 10):
            for k in range(-9, 10):
                c = np.array([i, j, k]) * 12.0
                inside = np.all((pos >= c - 15.0) & (pos < c + 15.0), axis=1)
                want |= {(i, j, k, p) for p in cloud.particle_id[inside]}
    assert pairs == want


def test_box_query_broadcast_and_shuffled(spark, cloud, monkeypatch):
    at = cloud.iloc[::50].rename(columns={"particle_id": "centre_id", "x": "cx", "y": "cy", "z": "cz"})[["centre_id", "cx", "cy", "cz"]]
    args = spark.createDataFrame(at), spark.createDataFrame(cloud)
    few = {(r.centre_id, r.particle_id) for r in spatial.box_query(*args, 10.0).collect()}
    monkeypatch.setattr(spatial, "small_side", lambda df: df)
    many = {(r.centre_id, r.particle_id) for r in spatial.box_query(*args, 10.0, salts=3).collect()}
    pos = cloud[["x", "y", "z"]].to_numpy()
    want = {(c.centre_id, p) for c in at.itertuples() for p in cloud.particle_id[
        np.all((pos >= np.array([c.cx, c.cy, c.cz]) - 5) & (pos < np.array([c.cx, c.cy, c.cz]) + 5), axis=1)]}
    assert few == many == want


def test_constant_probability_blends_to_itself(spark, cloud):
    df = spark.createDataFrame(cloud)
    pairs = spatial.assign_tiles(df.where("x > 0"), 30.0, 15.0).withColumn("prob", F.lit(0.25))
    got = blending.gaussian_blend(pairs, 30.0, particles=df).join(df, "particle_id").toPandas()
    seen = got.x > 0
    np.testing.assert_allclose(got.probability[seen], 0.25)
    assert got.probability_variance.max() < 1e-12
    assert (got.probability[~seen] == 0).all() and (got.n_tiles_seen[~seen] == 0).all()


def test_a_winding_component_is_one(spark):
    """A snake of pixels across a 60 x 60 raster, longer than any fixed number of rounds would follow step by step."""
    from phasefold.operators import maps

    pixels = [(x, y) for y in range(0, 60, 2) for x in range(60)] + [(59 if (y // 2) % 2 == 0 else 0, y) for y in range(1, 59, 2)] + [(5, 200)]
    mask = spark.createDataFrame([(x, y, 1.0, 0.5) for x, y in pixels], "px int, py int, density double, density_cut double")
    labels = maps.components(mask, 60)
    assert {r.label: r["count"] for r in labels.groupBy("label").count().collect()} == {0: len(pixels) - 1, 200 * 60 + 5: 1}


def test_chunks_without_finite_norms_keep_their_rows(spark, monkeypatch):
    from phasefold.plans import pipelines, registry

    rows = [(c, float(i), 0.0, 0.0, 1.0, 0.0, 0.0) for c in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "chunk int, x double, y double, z double, vx double, vy double, vz double")
    bad = df.withColumn("x", F.when(F.col("chunk") == 2, F.lit(float("nan"))).otherwise(F.col("x"))).withColumn("vx", F.when(F.col("chunk") == 2, F.lit(float("inf"))).otherwise(F.col("vx")))
    small = sorted(pipelines.phase_scales(bad, ["chunk"]).collect())
    monkeypatch.setattr(pipelines, "HELD_ROWS", 0)
    assert sorted(pipelines.phase_scales(bad, ["chunk"]).collect()) == small and len(small) == 2


def test_no_cap_keeps_every_row(spark):
    from phasefold.operators import sampling

    df = spark.createDataFrame([(1, i, i % 4 == 0) for i in range(100)], "chunk int, particle_id long, s boolean").withColumn("is_stream", F.col("s").cast("int"))
    assert sampling.chunk_cap(df, ["chunk"], max_raw=0).count() == 100


def test_augmented_chunks_keep_their_rows(spark):
    """Every row of a chunk is in one of its cells, in chunks with more rows than the small cap of ``chunk_cap`` too."""
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from phasefold.operators import spatial
    from phasefold.plans import catalog_space
    from phasefold.plans.fixtures import centres, p_vol

    sf = "/root/testdata/sf0.01"
    rows = p_vol(spark, sf).select("particle_id", "x", "y", "z")
    want = {r.centre_id: r["count"] for r in spatial.box_query(centres(spark, sf), rows, 128.0).groupBy("centre_id").count().collect()}
    got = {r.centre_id: r.n for r in entry.queries()["chunk_table_augmented"](spark, sf).groupBy("centre_id").agg(F.sum("n").alias("n")).collect()}
    assert max(want.values()) > catalog_space.CAP and got == want


def test_sweep_over_shared_places_equals_brick_by_brick(spark, cloud):
    full = phase.phase_columns(spark.createDataFrame(cloud))
    stats = phase.feature_stats(full, voxels.CHANNELS_11)
    keys = [*voxels.BRICK, *voxels.VOXEL]
    one = voxels.brick_voxels(spatial.assign_bricks(full, 40.0, 0.3), stats, 40.0, 7).toPandas().sort_values(keys)
    two = voxels.swept_voxels(full, stats, 40.0, 0.3, 7).toPandas().sort_values(keys)
    assert len(one) > 1000 and (one[keys + ["n", "target"]].to_numpy() == two[keys + ["n", "target"]].to_numpy()).all()
    assert np.allclose(one.drop(columns=keys), two.drop(columns=keys), atol=1e-9)


def test_repeated_ids_count_once(spark, cloud):
    frame = cloud.head(300).copy()
    frame.loc[frame.index[:20], "particle_id"] = frame.particle_id.iloc[20]
    df = spark.createDataFrame(frame)
    pairs = spatial.assign_tiles(df, 30.0, 15.0).withColumn("prob", F.lit(0.5))
    got = blending.coverage_summary(blending.gaussian_blend(pairs, 30.0, particles=df)).first()
    assert tuple(got) == (frame.particle_id.nunique(), 300 - frame.particle_id.nunique())
    scorer = lambda grid: [F.col("target").cast("double")] * 4
    swept = pipelines.swept_inference(df, scorer, 40.0).toPandas()
    assert sorted(swept.particle_id) == sorted(set(frame.particle_id))


def test_centres_at_one_place_are_searched_once(spark, cloud, monkeypatch):
    at = cloud.iloc[::50].rename(columns={"x": "cx", "y": "cy", "z": "cz"})[["cx", "cy", "cz"]]
    at = pd.concat([at, at, at]).assign(centre_id=np.arange(3 * len(at)))
    places, plain = [], spatial.explode_cells
    monkeypatch.setattr(spatial, "explode_cells", lambda df, *rest: places.append(df.count()) or plain(df, *rest))
    df, where = spark.createDataFrame(cloud), spark.createDataFrame(at)
    got = spatial.box_query(where, df, 10.0).groupBy("centre_id").count().toPandas()
    pos, h = cloud[["x", "y", "z"]].to_numpy(), 5.0
    inside = lambda c: np.all((pos >= c - h) & (pos < c + h), axis=1)
    want = {c.centre_id: int(inside(np.array([c.cx, c.cy, c.cz])).sum()) for c in at.itertuples()}
    assert dict(zip(got.centre_id, got["count"])) == want and places == [at[["cx", "cy", "cz"]].drop_duplicates().shape[0]]
    counts = spatial.brick_occupancy(where, df, 10.0, 1).toPandas()
    assert dict(zip(counts.centre_id, counts.n_stream + counts.n_background)) == want


def test_tiles_write_no_row_per_pair(spark, cloud, monkeypatch):
    held, plain = [], pipelines.cut_lineage
    monkeypatch.setattr(pipelines, "cut_lineage", lambda df: held.append(df.count()) or plain(df))
    scorer = lambda cells: F.lit(0.5)
    got = pipelines.tiled_inference(spark.createDataFrame(cloud), scorer, 40.0, 20.0, strategy="all", grid_size=8.0)
    assert got["predictions"].where("abs(probability - 0.5) < 1e-9").count() == len(cloud)
    assert max(held) < len(cloud)


def test_centres_over_the_same_cells_share_a_sum(spark, cloud, monkeypatch):
    df = spark.createDataFrame(cloud)
    held, plain = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda part: held.append(part.count()) or plain(part))
    got = spatial.touched_population(spatial.candidate_centres(df), df, 400.0, 400.0).toPandas().set_index("centre_id").touched
    want = pd.Series(0, index=cloud.particle_id)
    for _, rows in cloud.groupby("is_stream"):
        pos, low = rows[["x", "y", "z"]].to_numpy(), rows[["x", "y", "z"]].min().to_numpy()
        cells = np.floor((pos - low) / 400.0)
        at = cloud[["x", "y", "z"]].to_numpy()
        lo, hi = np.floor((at - 200.0 - low) / 400.0), np.floor((at + 200.0 - low) / 400.0)
        want += [int(np.all((cells >= a) & (cells <= b), axis=1).sum()) for a, b in zip(lo, hi)]
    assert (got.sort_index() == want.sort_index()).all() and max(held) < len(cloud) / 2


def test_augmented_chunks_write_no_members(spark, cloud, monkeypatch):
    """Rotations and scales are drawn once a centre, and only tables of a row a centre are written."""
    from phasefold.operators import augment

    rows = spark.createDataFrame(cloud)
    at = spark.createDataFrame([(i, float(i % 3), 0.0, 1.0) for i in range(5)], "centre_id bigint, cx double, cy double, cz double")
    written, plain = [], pipelines.cut_lineage
    monkeypatch.setattr(pipelines, "cut_lineage", lambda df: written.append(df.count()) or plain(df))
    got = pipelines.chunk_table(rows, at, 40.0, augmented=True, relative=True, seed=3).groupBy("centre_id").agg(F.sum("n").alias("n")).toPandas()
    assert len(got) == 5 and written and max(written) <= 5

    members = rows.join(at)
    keys, cols = ["centre_id", "particle_id"], ["x", "y", "z", "vx", "vy", "vz", "cx", "cy", "cz", "unit_scale", "lmag"]
    a = augment.augment_chunk(members, "centre_id", 3, relative=True).toPandas().sort_values(keys)
    b = augment.augment_drawn(rows.join(augment.chunk_draws(at, "centre_id", 3, relative=True))).toPandas().sort_values(keys)
    assert (a[cols].to_numpy() == b[cols].to_numpy()).all()
