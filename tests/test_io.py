import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasefold.functions.phase import feature_stats
from phasefold.operators import metrics, runlogs
from phasefold.sources import cleaning, matrix_files, sinks, splits
from phasefold.streaming import incremental
from tests.conftest import BASE


def test_matrix_source(spark, tmp_path):
    matrix_files.register(spark)
    wide, plain = np.random.default_rng(0).normal(size=(250, 10)), np.random.default_rng(1).normal(size=(40, 8))
    wide[:, 8] = np.arange(250) + 7
    np.save(tmp_path / "a.npy", wide)
    np.save(tmp_path / "b.npy", plain)
    got = spark.read.format("npy_particles").option("split_rows", 64).load(str(tmp_path)).toPandas()
    a, b = (got[got.file_id == f].sort_values("row_index") for f in "ab")
    np.testing.assert_allclose(a[["x", "y", "z", "vx", "vy", "vz", "r", "vr"]], wide[:, :8])
    np.testing.assert_allclose(a.mass, wide[:, 9])
    assert a.particle_id.tolist() == list(range(7, 257)) and (b.mass == 1).all()
    assert b.particle_id.tolist() == [(1 << 40) + i for i in range(40)]  # unique over files
    np.save(tmp_path / "c.npy", plain[:, :7])
    with pytest.raises(Exception, match="must be"):
        spark.read.format("npy_particles").load(str(tmp_path)).count()


def test_matrix_sink_round_trip(spark, tmp_path, cloud):
    matrix_files.register(spark)
    rows = spark.createDataFrame(cloud.assign(r=0.0, vr=0.0, id=cloud.particle_id.astype(float)))[[*BASE, "r", "vr", "id"]]
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        rows.write.format("npy_particles").option("file_rows", 300).mode(mode).save(str(tmp_path / "out"))
        back = spark.read.format("npy_particles").load(str(tmp_path / "out")).toPandas()
        assert sorted(back.particle_id) == sorted(cloud.particle_id.tolist() * times)


@pytest.fixture()
def tree(spark, tmp_path):
    """Two splits of matrix files, one file without ids in each folder."""
    rng, rows = np.random.default_rng(2), {}
    for split in ("training", "validation"):
        for name in splits.CLASSES:
            (tmp_path / split / name).mkdir(parents=True)
            for file, width in (("a", 8), ("b", 10)):
                rows[split, name, file] = rng.normal(size=(rng.integers(50, 90), width))
                np.save(tmp_path / split / name / f"{file}.npy", rows[split, name, file])
    rows["training", "streams", "a"][3, 0] = np.nan
    np.save(tmp_path / "training" / "streams" / "a.npy", rows["training", "streams", "a"])
    return str(tmp_path), rows


def test_matrix_tree(spark, tree):
    root, rows = tree
    got = matrix_files.read_tree(spark, root, ("training", "validation"), split_rows=20).toPandas()
    assert len(got) == sum(map(len, rows.values()))
    for (split, name, file), want in rows.items():
        part = got[(got.split == split) & (got.is_stream == splits.CLASSES[name]) & (got.file_id == file)].sort_values("row_index")
        np.testing.assert_array_equal(part[list(matrix_files.MATRIX)], want[:, :8])
    assert got[got.file_id == "a"].particle_id.is_unique  # numbered without an id column
    via = splits.scan_splits(spark, root, ("validation",), layout="npy")
    assert via.count() == sum(len(r) for (s, *_), r in rows.items() if s == "validation")
    with pytest.raises(Exception, match="missing data directory"):
        matrix_files.read_tree(spark, root).count()


def test_matrix_tree_reads_asked_columns_only(spark, tree, monkeypatch):
    from pyspark.sql.types import StructType

    root, rows = tree
    asked = matrix_files.read_tree(spark, root, ("training",), ["vx", "is_stream"])
    assert asked.columns == ["vx", "is_stream"] and asked.count() == sum(len(r) for (s, *_), r in rows.items() if s == "training")
    reader = matrix_files.MatrixReader({"path": root, "tree": "true", "splits": "training"}, StructType.fromDDL("vx double, is_stream int"))
    taken = []
    plain = matrix_files.MatrixReader._column
    monkeypatch.setattr(matrix_files.MatrixReader, "_column", lambda self, name, *rest: taken.append(name) or plain(self, name, *rest))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert set(taken) == {"vx", "is_stream"} and all(b.schema.names == ["vx", "is_stream"] for b in batches)
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("npy_particles").schema("speed double").load(root + "/training/streams").count()


def test_matrix_headers_are_opened_by_tasks(tree, monkeypatch):
    from pyspark.sql.types import StructType

    reader = matrix_files.MatrixReader({"path": tree[0], "tree": "true", "splits": "training"}, StructType.fromDDL("x double"))
    monkeypatch.setattr(np, "load", lambda *a, **k: pytest.fail("planning opened a file"))
    assert len(reader.partitions()) == 4


def test_matrix_conditions_at_the_source(spark, tree):
    from pyspark.sql.types import StructType

    root, rows = tree
    options = {"path": root, "tree": "true", "splits": "training,validation", "where": '[["split", "=", "training"], ["x", ">", 0.5]]'}
    reader = matrix_files.MatrixReader(options, StructType.fromDDL("y double, split string"))
    assert {p.split for p in reader.partitions()} == {"training"}
    plain = matrix_files.read_tree(spark, root, ("training", "validation"))
    for where in ([("split", "=", "training"), ("x", ">", 0.5)], [("vx", "<", 0.0), ("is_stream", "=", 1)], [("file_id", "=", "b"), ("y", "<=", 0.25), ("x", ">=", -1.0)],
                  [("split", "=", "none")], [("x", "=", float(rows["training", "streams", "b"][0, 0]))]):
        condition = " AND ".join(f"{c} {how} {repr(v) + 'D' if isinstance(v, float) else repr(v)}" for c, how, v in where)
        got = matrix_files.read_tree(spark, root, ("training", "validation"), ["particle_id", "y"], where)
        want = plain.where(condition).select("particle_id", "y")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), condition
    for bad in ([("mass", "=", 1.0)], [("x", "~", 1.0)]):
        with pytest.raises(Exception, match="no such conditions"):
            matrix_files.read_tree(spark, root, ("training",), where=bad).count()


def test_matrix_tree_round_trip(spark, tmp_path, cloud):
    df = spark.createDataFrame(cloud.assign(r=1.0, vr=2.0, mass=3.0)).withColumn("split", F.when(F.col("file_id") == 0, "training").otherwise("validation"))
    for _ in range(2):  # the second write replaces the first
        matrix_files.write_tree(df, str(tmp_path), file_rows=100)
    back = matrix_files.read_tree(spark, str(tmp_path), ("training", "validation")).drop("file_id", "row_index")
    assert sorted(map(str, back.select("particle_id", "split", "is_stream", *BASE, "mass").collect())) == sorted(
        map(str, df.select("particle_id", "split", F.col("is_stream").cast("int").alias("is_stream"), *BASE, "mass").collect()))


def test_split_scan(spark, tmp_path, cloud):
    df = spark.createDataFrame(cloud)
    for i, split in enumerate(("training", "validation")):
        for name, flag in splits.CLASSES.items():
            df.where((F.col("is_stream") == flag) & (F.col("file_id") == i)).drop("is_stream").write.parquet(f"{tmp_path}/{split}/{name}")
    rows = splits.scan_splits(spark, str(tmp_path), ("training", "validation"))
    assert rows.where("split = 'training' AND is_stream = 1").count() == ((cloud.is_stream == 1) & (cloud.file_id == 0)).sum()
    with pytest.raises(RuntimeError, match="missing"):
        splits.scan_splits(spark, str(tmp_path))
    df.limit(0).drop("is_stream").write.parquet(f"{tmp_path}/testing/streams")
    with pytest.raises(RuntimeError, match="no rows"):
        splits.scan_splits(spark, str(tmp_path), ("testing",))


def test_cleaning(spark, cloud):
    df = spark.createDataFrame(cloud)
    kept = cleaning.dedup_first(df).toPandas()
    want = cloud.sort_values("particle_id").drop_duplicates(["x", "y", "z"])
    assert sorted(kept.particle_id) == sorted(want.particle_id)
    moved = cleaning.clean_snapshot(df).agg(*[F.avg(c) for c in "xyz"]).first()
    assert np.allclose(list(moved), 0, atol=1e-9)
    named = cleaning.default_columns(df.withColumnRenamed("particle_id", "ids").withColumn("Masses", F.lit(2.0)))
    assert {r.mass for r in named.select("mass").distinct().collect()} == {2.0} and "particle_id" in named.columns
    with pytest.raises(ValueError):
        cleaning.require_columns(df.drop("vx"))
    with pytest.raises(ValueError):
        cleaning.recentre(df, mode="median")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.55), (2, 0.7), (3, 0.99)], ["particle_id", "probability"])
    sinks.write_predictions(df, str(tmp_path / "p"), "global", expected_rows=3)
    with pytest.raises(ValueError):
        sinks.write_predictions(df, str(tmp_path / "p"), "tiled", expected_rows=4)
    got = sinks.read_predictions(spark, str(tmp_path / "p")).orderBy("particle_id").toPandas()
    assert got.thr_0p7.tolist() == [False, True, True] and (got.group == "global").all()
    stats = feature_stats(df, ["probability"])
    sinks.save_stats(stats, str(tmp_path / "s"))
    assert sinks.load_stats(spark, str(tmp_path / "s"), stats).first() == stats.first()


OLD = "epoch|val_thr0p5_iou|val_thr0p7_iou|note\n" + "".join(f"{e}|0.{e}|0.{e}|a\n" for e in range(1, 7)) + "7|0.9\n"
NEW = "epoch|val_thr0p5_iou|val_thr0p7_iou|note\n" + "".join(f"{e}|0.{e}5||b\n" for e in range(4, 9))
KEYS = ["val_thr0p5_iou", "val_thr0p7_iou"]


@pytest.fixture()
def logs(spark, tmp_path):
    import os

    for i, (name, text) in enumerate((("old.dat", OLD), ("new.dat", NEW))):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    return tmp_path


def test_log_merging(spark, logs):
    wide = runlogs.epochs_wide(runlogs.read_logs(spark, str(logs)), KEYS)
    assert wide.count() == 11  # the truncated line is gone
    first = lambda df: {r.epoch: r.val_thr0p5_iou for r in df.collect()}
    latest = first(runlogs.log_latest(wide))
    assert latest == {1: 0.1, 2: 0.2, 3: 0.3, 4: 0.45, 5: 0.55, 6: 0.65, 7: 0.75, 8: 0.85}
    assert first(runlogs.log_lineage(wide)) == latest
    assert [r.epoch for r in runlogs.log_concat(wide).collect()] == [1, 2, 3, 4, 4, 5, 5, 6, 6, 7, 8]
    best = runlogs.best_swept(runlogs.swept_long(runlogs.log_latest(wide), ["epoch"]), ["epoch"], "val", "iou")
    assert {r.epoch: (r.best_value, r.best_threshold) for r in best.collect()}[2] == (0.2, 0.5)
    assert runlogs.best_epoch(wide, "val_thr0p7_iou").first().epoch == 6  # blanks are NaN and never win
    assert runlogs.best_epoch(wide, "val_thr0p5_iou", maximize=False).first().epoch == 1
    assert sorted(r.epoch for r in runlogs.last_epochs(runlogs.log_latest(wide), 2).collect()) == [7, 8]


def test_log_stream_equals_batch(spark, logs):
    cols = ["line", "key", "value", "text"]
    batch = sorted(map(str, runlogs.read_logs(spark, str(logs)).select(*cols).collect()))
    stream = sorted(map(str, incremental.stream_logs(spark, str(logs)).select(*cols).collect()))
    assert batch == stream


def test_log_refresh_sees_grown_and_new_logs(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "table")
    logs.mkdir()
    (logs / "a.log").write_text("epoch|loss\n1|0.5\n")
    assert incremental.stream_logs(spark, str(logs), out).count() == 2
    assert incremental.stream_logs(spark, str(logs), out).count() == 2
    (logs / "a.log").write_text("epoch|loss\n1|0.5\n2|0.4\n")
    (logs / "b.log").write_text("epoch|loss\n1|0.7\n")
    cols = ["line", "key", "value"]
    got = incremental.stream_logs(spark, str(logs), out).select(*cols).collect()
    assert sorted(got) == sorted(runlogs.read_logs(spark, str(logs)).select(*cols).collect()) and len(got) == 6


def test_swept_epochs_without_values_stay(spark):
    nan = float("nan")
    wide = spark.createDataFrame([(1, 0.2, nan), (2, nan, nan)], "epoch int, val_thr0p5_iou double, val_thr0p7_iou double")
    best = {r.epoch: (r.best_value, r.best_threshold) for r in runlogs.best_swept(runlogs.swept_long(wide, ["epoch"]), ["epoch"], "val", "iou").collect()}
    assert best[1] == (0.2, 0.5) and all(np.isnan(x) for x in best[2])


def test_metric_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"y_true": rng.integers(0, 2, 900), "prob": rng.random(900)})
    for i in range(6):
        spark.createDataFrame(frame[i * 150:(i + 1) * 150]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    batch = spark.read.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = incremental.stream_metrics(stream).orderBy("threshold").toPandas()
    want = metrics.threshold_sweep(batch).orderBy("threshold").toPandas()
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want)


def test_unchanged_logs_are_not_opened_again(tmp_path):
    import os

    from phasefold.sources.log_versions import VersionReader

    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("epoch|loss\n1|0.5\n")
        os.utime(tmp_path / name, (1000, 1000))
    reader = VersionReader({"path": str(tmp_path)})
    first = reader.latestOffset()
    assert len(reader.partitions(reader.initialOffset(), first)) == 2
    assert [p.path for p in reader.partitions(first, reader.latestOffset())] == [""]
    (tmp_path / "b.log").write_text("epoch|loss\n1|0.5\n2|0.4\n")
    (tmp_path / "c.log").write_text("epoch|loss\n")
    second = reader.latestOffset()
    assert sorted(os.path.basename(p.path) for p in reader.partitions(first, second)) == ["b.log", "c.log"]
    # a batch that is run again after the file grew once more reads the version of its offset
    (tmp_path / "b.log").write_text("epoch|loss\n1|0.5\n2|0.4\n3|0.3\n")
    again = next(p for p in reader.partitions(first, second) if p.path.endswith("b.log"))
    assert next(reader.read(again)).column("value")[0].as_py().endswith("2|0.4\n")


def test_metric_stream_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    """Stopped in the third batch after its part was written: the restart repeats that batch and nothing is counted twice."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"y_true": rng.integers(0, 2, 600), "prob": rng.random(600)})
    for i in range(6):
        spark.createDataFrame(frame[i * 100:(i + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    batch = spark.read.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    out = str(tmp_path / "out")
    calls = []
    monkeypatch.setattr(incremental, "FOLD_EVERY", 2)
    plain = incremental.read_counts

    def stop(*args):
        calls.append(1)
        raise RuntimeError("stopped")

    monkeypatch.setattr(incremental, "read_counts", stop)  # the fold of batch 2 fails after its part is written
    with pytest.raises(Exception, match="stopped"):
        incremental.stream_metrics(stream(), out=out)
    monkeypatch.setattr(incremental, "read_counts", plain)
    assert plain(spark, out).agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == 300
    got = incremental.stream_metrics(stream(), out=out).orderBy("threshold").toPandas()
    want = metrics.threshold_sweep(batch).orderBy("threshold").toPandas()
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want)
    # new rows arrive: the next call adds only them
    spark.createDataFrame(frame[:100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    more = incremental.stream_metrics(stream(), out=out).orderBy("threshold").toPandas()
    want = metrics.threshold_sweep(spark.read.parquet(str(tmp_path / "s"))).orderBy("threshold").toPandas()
    pd.testing.assert_frame_equal(more[want.columns.tolist()], want)
