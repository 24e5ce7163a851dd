"""Dense arrays, state of runs, configuration files and score tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.functions import covariance
from orebed.operators import grid, samples, simulate
from orebed.sources import arrays, state, tables


def test_array_files(spark, tmp_path):
    r = np.random.default_rng(1)
    for k, (shape, dtype, order) in enumerate([((3, 4, 5, 6), "<f4", "C"), ((4, 5, 6), ">f8", "C"), ((4, 5, 6), "<i2", "F"), ((3, 4, 5, 6), "u1", "C"), ((7, 2), "<i8", "C"), ((4, 0, 2), "<f4", "C"), ((5,), "?", "C")]):
        a = np.asarray(r.integers(0, 2 if dtype == "?" else 99, shape).astype(dtype), order=order)
        if dtype == "<f4" and a.size:
            a.flat[3] = np.nan
        path = str(tmp_path / f"a{k}.npy")
        np.save(path, a)
        got = arrays.read_array(spark, path, slab_values=50)
        assert arrays.array_shape(path) == shape and got.count() == a.size
        dims = got.columns[: len(shape)]
        for row in got.limit(200).collect():
            want = a[tuple(row[d] for d in dims)]
            assert row["value"] == want or (np.isnan(want) and np.isnan(row["value"]))
            if "cell_id" in got.columns:
                assert row["cell_id"] == (row["ix"] * shape[-2] + row["iy"]) * shape[-1] + row["iz"]
    assert arrays.read_array(spark, str(tmp_path / "a0.npy"), slab_values=50).rdd.getNumPartitions() == 8
    whole = (tmp_path / "a0.npy").read_bytes()
    for bad in (whole[:-4], whole + b"1234", b"junk" + whole, whole[:60]):
        (tmp_path / "bad.npy").write_bytes(bad)
        with pytest.raises(Exception, match="cut off|no .npy|EOF|never closed|invalid"):
            arrays.read_array(spark, str(tmp_path / "bad.npy")).count()
    with pytest.raises(Exception, match="no array"):
        arrays.read_array(spark, str(tmp_path / "nothing"))


def test_array_round_trip(spark, tmp_path):
    shape = (3, 4, 5, 6)
    r = np.random.default_rng(2)
    a = r.normal(size=shape).astype("<f4")
    rows = [(k, c, float(v)) for k in range(3) for c, v in enumerate(a[k].ravel()) if (k, c) != (1, 7)]
    df = spark.createDataFrame(rows, "real_id int, cell_id long, value double").repartition(5)
    path = str(tmp_path / "stack")
    arrays.write_array(df, path, shape, ("real_id", "cell_id"), axes={"x": (100.0, 25.0), "y": (0.0, 25.0), "z": (-9.0, 2.0)}, slab_values=70)
    meta = arrays.sidecar(path)
    assert (meta["shape"], meta["x_min"], meta["x_max"], meta["dz"], meta["z_max"]) == ([3, 4, 5, 6], 100.0, 175.0, 2.0, 1.0)
    back = {(x["real_id"], x["cell_id"]): x["value"] for x in arrays.read_array(spark, path).collect()}
    assert len(back) == 360 and np.isnan(back[1, 7]) and all(back[k, c] == pytest.approx(v) for k, c, v in rows)
    arrays.join_slabs(path, str(tmp_path / "one.npy"))
    b = a.copy()
    b[1].flat[7] = np.nan
    assert np.array_equal(np.load(tmp_path / "one.npy"), b, equal_nan=True)
    # Written again, as whole numbers by three dimensions: the old slabs go, and a lost one is found out.
    cells = df.filter("real_id = 0").select((F.col("cell_id") / 30).cast("long").alias("i"), (F.floor(F.col("cell_id") / 6) % 5).alias("j"), (F.col("cell_id") % 6).alias("k"), F.lit(4).alias("v"))
    arrays.write_array(cells.filter("i < 3"), path, (4, 5, 6), ("i", "j", "k"), "v", "<i2", -1, slab_values=100)
    assert {tuple(x) for x in arrays.read_array(spark, path).groupBy("value").count().collect()} == {(4, 90), (-1, 30)}
    slabs = sorted((tmp_path / "stack").glob("*.bin"))
    assert len(slabs) == 2
    for bad, match in ((df.unionByName(df.limit(1)), "two values"), (df.withColumn("cell_id", F.col("cell_id") + 1), "outside")):
        with pytest.raises(Exception, match=match):
            arrays.write_array(bad, path, shape, ("real_id", "cell_id"))
    assert arrays.read_array(spark, path).count() == 120  # as it was
    slabs[1].write_bytes(slabs[1].read_bytes()[:-1])
    with pytest.raises(Exception, match="missing or cut off"):
        arrays.read_array(spark, path)
    with pytest.raises(ValueError, match="fill"):
        arrays.write_array(df, path, shape, ("real_id", "cell_id"), dtype="<i2")


def test_state_of_a_run(spark, tmp_path):
    path, shape, config = str(tmp_path / "run"), (4, 2, 2, 2), {"seed": 1, "search": {"k": 3}}
    one = spark.createDataFrame([(0, c, 1.0) for c in range(8)], "real_id int, cell_id long, value double")
    s = state.open_state(spark, path, shape, config)
    assert s.pending([0, 1, 2]) == [0, 1, 2] and s.read(spark) is None
    s.add(one, [0, 2])
    s.add(one.withColumn("real_id", F.lit(2)), [0, 2])
    again = state.open_state(spark, path, shape, {"search": {"k": 3}, "seed": 1})
    assert again.pending([0, 1, 2, 3]) == [1, 3] and again.read(spark).count() == 16
    assert json.loads((tmp_path / "run/manifest.json").read_text())["status"] == "complete"
    # A realisation that was written but not named in the manifest is not done.
    one.withColumn("real_id", F.lit(3)).write.mode("append").partitionBy("real_id").parquet(again.folder)
    assert state.open_state(spark, path, shape, config).pending([3]) == [3] and again.read(spark).count() == 16
    # Another shape or configuration, or a manifest that can't be read: everything is pending again.
    for other in ((4, 2, 2, 3), config), (shape, {"seed": 2}):
        fresh = state.open_state(spark, path, *other)
        assert fresh.pending([0, 1, 2]) == [0, 1, 2] and fresh.folder != again.folder
    for crc in (True, False):
        state.open_state(spark, path, shape, config).add(one)
        (tmp_path / "run/manifest.json").write_text('{"shape": [4')
        if not crc:
            (tmp_path / "run/.manifest.json.crc").unlink()
        assert state.open_state(spark, path, shape, config).pending([0]) == [0]


def test_a_run_takes_up_in_its_midst(spark, tmp_path):
    g = grid.Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (8, 8, 1))
    cells = g.cells(spark).withColumn("real_id", F.lit(0)).withColumn("domain", F.lit(0))
    data = spark.createDataFrame([(0, 2.0, 2.0, 0.0, 1.0)], "domain int, x double, y double, z double, score double")
    run = lambda seed: {r["cell_id"]: r["value"] for r in simulate.simulate(cells, data, {0: covariance.Model(reach=3.0)}, simulate.Search((2.0, 2.0, 2.0), 6), seed, block=2.0, progress=str(tmp_path / "p")).collect()}
    first = run(1)
    (folder,) = (tmp_path / "p").iterdir()
    rounds = sorted(folder.iterdir())
    assert len(rounds) == 4
    (rounds[-1] / "_SUCCESS").unlink()
    times = [x.stat().st_mtime_ns for x in rounds]
    assert run(1) == first and [x.stat().st_mtime_ns for x in rounds][:3] == times[:3] and (rounds[-1] / "_SUCCESS").exists()
    assert run(2) != first and len(list((tmp_path / "p").iterdir())) == 2


def test_configuration_files(spark, tmp_path, monkeypatch):
    config = {"a": {"b": 1, "c": 2}, "active_profile": "fine", "profiles": {"fine": {"a": {"b": 5}}, "other": {"a": {"c": 9}}}}
    tables.write_metadata(spark, config, str(tmp_path / "c.json"))
    assert tables.load_config(spark, str(tmp_path / "c.json"))["a"] == {"b": 5, "c": 2}
    assert tables.load_config(spark, str(tmp_path / "c.json"), "other")["a"] == {"b": 1, "c": 9}
    monkeypatch.setenv("OREBED_PROFILE", "other")
    assert tables.load_config(spark, str(tmp_path / "c.json"))["a"]["c"] == 9
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    assert tables.load_config(spark, str(tmp_path / "c.yaml"))["a"]["c"] == 9
    (tmp_path / "d.yaml").write_text("- 1")
    with pytest.raises(ValueError, match="no configuration"):
        tables.load_config(spark, str(tmp_path / "d.yaml"))
    with pytest.raises(FileNotFoundError):
        tables.load_config(spark, str(tmp_path / "none.json"))


def test_score_files(spark, tmp_path):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 2, 9)], "v double")
    table = samples.score_table(df, "v")
    tables.write_scores(table, str(tmp_path / "scores"))
    want = {r["value"]: r["score"] for r in table.collect()}
    assert {r["value"]: r["score"] for r in tables.read_scores(spark, str(tmp_path / "scores")).collect()} == pytest.approx(want)
    v = sorted(want)
    (tmp_path / "one.json").write_text(json.dumps({"sorted_data": v, "norm_scores": [want[x] for x in v]}, indent=1))
    assert {r["value"]: r["score"] for r in tables.read_scores(spark, str(tmp_path / "one.json")).collect()} == pytest.approx(want)
