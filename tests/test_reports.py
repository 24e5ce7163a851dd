"""Searches, documents, gates, ZIP members and streams in parts, on small cases."""

import zipfile

import numpy as np
import pytest

from orebed.functions.covariance import Model
from orebed.operators import pairs, reports, search, simulate
from orebed.sources import tables
from orebed.streaming.refresh import follow_curve

COLUMNS = "candidate int, weighted_rmse double, along_strike_rmse double, along_strike_bias double, total_missing_lags double, hist_overlap double, qq_rmse double, swath_corr_x double, swath_corr_y double, swath_corr_z double"


def test_scores_of_candidates(spark):
    fine = (0.3, 0.4, 0.0, 0.0, 0.98, 0.05, 0.6, 0.6, 0.6)
    nan = float("nan")
    rows = [(1, *fine), (2, None, *fine[1:]), (3, nan, *fine[1:]), (4, 0.3, 0.7, -0.4, 4.0, *fine[4:]), (5, *fine[:4], None, None, *fine[6:]), (6, *fine[:5], nan, nan, 0.6, 0.6), (7, 0.3, nan, nan, nan, *fine[4:])]
    out = {r["candidate"]: r for r in search.scored(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert out[1]["ok"] and out[1]["score"] == pytest.approx(0.3)
    assert all(not out[k]["ok"] and out[k]["score"] == 999.0 for k in (2, 3))
    assert out[4]["score"] == pytest.approx(0.3 + 1.5 * 0.2 + 0.05 * 2 + 0.7 * 0.2)
    assert out[5]["failures"] == ["hist_overlap", "qq_rmse"] and out[5]["score"] == pytest.approx(10.3)
    assert out[6]["ok"] and out[7]["score"] == pytest.approx(0.3)


def test_search_confirms_the_best(spark):
    c = search.candidates(spark, 1000)
    assert c.count() == 360 == c.select("candidate").distinct().count()
    ten = search.candidates(spark, 10)
    assert [r[0] for r in ten.collect()] == [r[0] for r in search.candidates(spark, 10).collect()]

    def measured(sign):
        fixed = ["0.0D AS along_strike_rmse", "0.0D AS along_strike_bias", "0 AS total_missing_lags", "1.0D AS hist_overlap", "0.0D AS qq_rmse", "1.0D AS swath_corr_x", "1.0D AS swath_corr_y", "1.0D AS swath_corr_z"]
        return lambda df: df.selectExpr("*", f"{sign} * candidate + 400.0D AS weighted_rmse", *fixed)

    least = sorted(r["candidate"] for r in ten.collect())[:3]
    assert [r["candidate"] for r in search.search(ten, measured(1), measured(-1)).collect()] == least[-1:]


def test_documents_and_gates(spark):
    x = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    got = dict(reports.document({"one": x.filter("a = 1")}, {"all": x, "none": x.filter("a > 2")}).collect())
    assert got == {"one": '{"a":1,"b":null}', "all": '[{"a":1,"b":null},{"a":2,"b":"b"}]', "none": "[]"}
    gate = reports.value_gate(x, "b", "b", ["b"])
    assert not gate.first()["passed"]
    assert reports.passed(reports.total_gate(x, "a", "a", 3)).count() == 1
    with pytest.raises(Exception, match="gate not passed: b"):
        reports.passed(gate).collect()
    assert reports.public_columns(spark.createDataFrame([(1, 2, 3)], "tonnage int, Contained_p50 int, other int")).columns == ["occupancy_proxy", "other"]
    both = reports.recomputed(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None)], "metric string, value double"), spark.createDataFrame([("a", 1.0 + 1e-7), ("b", 1.1), ("c", None)], "metric string, value double"))
    assert {r["metric"]: r["agrees"] for r in both.collect()} == {"a": True, "b": False, "c": False}


def test_csv_in_zip(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/OTHER_MODEL.csv", "a\n0\n")
        z.writestr("x/Model.CSV", "a,b\n1,2\n3,\n")
        z.writestr("model.txt", "")
    assert [tuple(r) for r in tables.csv_in_zip(spark, str(path), "model.csv").collect()] == [("1", "2"), ("3", None)]
    with pytest.raises(FileNotFoundError):
        tables.csv_in_zip(spark, str(path), "none.csv")


def test_nearest_anywhere(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1000.0, 0.0, 0.0)], "id int, x double, y double, z double")
    s = spark.createDataFrame([(7, 0.5, 0.0, 0.0, 4), (8, 3.0, 0.0, 0.0, 5)], "id int, x double, y double, z double, label int")
    assert sorted(map(tuple, pairs.nearest_anywhere(t, s, 1.0).collect())) == [(1, 4, 0.5), (2, 5, 997.0)]
    assert sorted(map(tuple, pairs.nearest_anywhere(t, s.filter("id > 8"), 100.0).collect())) == [(1, None, None), (2, None, None)]


def test_a_realisation_in_two_batches(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "real_id int, cell_id long, value double"
    for k in range(2):
        spark.createDataFrame([(0, 2 * k + c, float(2 * k + c)) for c in range(2)], schema).coalesce(1).write.mode("append").parquet(src)
        follow_curve(spark.readStream.schema(schema).parquet(src), out, mark, [1.0, 9.0], 1.0, 1.0).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).orderBy("cutoff").select("cutoff", "blocks", "avg_grade", "tonnage", "real_id").collect()] == [(1.0, 3, 2.0, 3.0, 0), (9.0, 0, 0.0, 0.0, 0)]


def test_fields_honour_samples_at_any_partitioning(spark):
    cells = spark.createDataFrame([(k, 10.0 * k, 0.0, 0.0) for k in range(6)] + [(9, 9000.0, 0.0, 0.0), (10, None, 0.0, 0.0)], "cell_id long, x double, y double, z double")
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.5), (2, 50.0, 0.0, 0.0, -0.5), (3, 50.0, 0.0, 0.0, None)], "id int, x double, y double, z double, score double")
    model, reach = Model("exponential", 0.2, 0.8, 30.0), simulate.Search((100.0, 100.0, 100.0), 4)
    got = {tuple(r)[:2]: r["value"] for r in simulate.conditional_fields(cells, points, model, reach, 3, 7).collect()}
    again = {tuple(r)[:2]: r["value"] for r in simulate.conditional_fields(cells.repartition(5), points.repartition(3), model, reach, 3, 7).collect()}
    assert len(got) == 21 and got.keys() == again.keys() and all(abs(got[k] - again[k]) < 1e-9 for k in got)
    assert all(abs(got[r, 0] - 1.5) < 1e-6 and abs(got[r, 5] + 0.5) < 1e-6 for r in range(3))
    assert len({got[r, 9] for r in range(3)}) == 3
    assert simulate.conditional_fields(cells, points.filter("id > 3"), model, reach, 2, 7).count() == 14


@pytest.mark.parametrize("kind", ["exponential", "gaussian"])
def test_waves_have_the_models_covariance(kind):
    model = Model(kind, 0.2, 0.8, 30.0)
    v = simulate.waves(np.array([[0.0, 0.0, 0.0], [20.0, 0.0, 0.0], [0.0, 40.0, 0.0]]), model, 3000, 1, 200)
    assert np.allclose(np.cov(v), model.covariance(np.array([[0, 20, 40], [20, 0, 2000**0.5], [40, 2000**0.5, 0]])), atol=0.07)
    with pytest.raises(ValueError):
        simulate.wave_numbers(Model("spherical"), 3, np.random.default_rng(0))


def test_a_mosaic_with_a_gap(spark):
    cells = spark.createDataFrame([(0, 1), (0, 2)], "real_id int, cell_id long")
    assert simulate.require_complete(cells, cells) is cells
    with pytest.raises(ValueError, match="cell 2 of realisation 0"):
        simulate.require_complete(cells.filter("cell_id = 1"), cells)
