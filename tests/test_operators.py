"""Closed forms, edge cases and plain NumPy or Python versions."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from orebed.functions import covariance, scalar
from orebed.operators import checks, compare, ensemble, forest, grid, intervals, order, pairs, samples, screen, simulate, trajectory
from orebed.sources import tables
from orebed.streaming.refresh import follow_curve

DEMO = {
    "collar.csv": "BHID, Easting,Northing,Elevation,Final_Depth\nA,10,20,100,30\n B ,0,0,50,10\n",
    "survey.csv": "bhid,at,brg,angle\nA,0,90,60\nA,x,90,60\n",
    "my_assay_file.csv": "bhid,from,to,TGC_%,litho code\nA,0,2,1.5,GSCH\nA,2,4,bad,nan\n",
    "lithology.csv": "bhid,from,to,litho\nA,0,3,GSCH\nA,3,9, None \n",
}


def test_reading_drillholes(spark, tmp_path):
    assert tables.read_drillholes(spark, tmp_path) is None
    for name, text in DEMO.items():
        (tmp_path / name).write_text(text)
    t = tables.read_drillholes(spark, tmp_path)
    assert sorted(r["hole_id"] for r in t["collar"].collect()) == ["A", "B"]
    assert [(r["depth"], r["azimuth_deg"], r["dip_deg"]) for r in t["survey"].orderBy(F.desc_nulls_last("depth")).collect()] == [(0.0, 90.0, -60.0), (None, 90.0, -60.0)]
    assert [(r["tgc_pct"], r["lith_code"]) for r in t["assay"].orderBy("from_m").collect()] == [(1.5, "GSCH"), (None, None)]
    assert [r["lith_code"] for r in t["lithology"].orderBy("from_m").collect()] == ["GSCH", None]


def test_config_profiles():
    base = {"a": {"b": 1, "c": 2}, "profiles": {"fast": {"a": {"b": 9}}}}
    assert tables.with_profile(base, "fast")["a"] == {"b": 9, "c": 2} and tables.with_profile(base, None) is base
    with pytest.raises(KeyError):
        tables.with_profile(base, "none")


def test_block_model(spark):
    df = spark.createDataFrame([("1", "2", "3", "4.5", None, 2.0), ("1", "x", "3", "4", "2", 1.0)], "X string, _Y string, Z string, `TGC_%` string, density string, sx double")
    out = tables.read_blocks(df.withColumn("sy", F.lit(2.0)).withColumn("SZ", F.lit(0.5)), density=2.5).collect()
    assert len(out) == 1 and out[0]["tonnage"] == 5.0
    with pytest.raises(ValueError, match="lacks"):
        tables.read_blocks(df.drop("X"))


def test_realisations_resume(spark, tmp_path):
    path = str(tmp_path / "r")
    assert tables.pending(spark, path, [0, 1]).count() == 2
    one = spark.createDataFrame([(0, 1, 2.0)], "real_id int, cell_id long, value double")
    tables.write_realisations(one, path)
    tables.write_realisations(one.withColumn("real_id", F.lit(2)), path)
    assert [r["real_id"] for r in tables.pending(spark, path, [0, 1, 2, 3]).orderBy("real_id").collect()] == [1, 3]


def test_inverse_normal(spark):
    p = [1e-6, 0.01, 0.074, 0.2, 0.5, 0.75, 0.99, 1 - 1e-6]
    rows = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0]], "p double").select("p", scalar.inverse_normal("p").alias("z")).collect()
    assert all(abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-9 for r in rows[: len(p)]) and rows[-1]["z"] is None


def test_straight_and_bent_holes(spark):
    collars = spark.createDataFrame([("V", 0.0, 0.0, 100.0, 50.0), ("N", 1.0, 2.0, 3.0, 40.0), ("Q", 0.0, 0.0, 0.0, 90.0)], "hole_id string, x double, y double, z double, total_depth double")
    stations = spark.createDataFrame([("V", 10.0, 77.0, -90.0), ("V", 50.0, 77.0, -90.0), ("Q", 0.0, 0.0, -90.0), ("Q", 90.0, 0.0, 0.0)], "hole_id string, depth double, azimuth_deg double, dip_deg double")
    path = trajectory.desurvey(stations, collars)
    at = {(r["hole_id"], r["depth"]): (r["x"], r["y"], r["z"]) for r in path.collect()}
    assert at["V", 50.0] == pytest.approx((0, 0, 50)) and at["N", 40.0] == pytest.approx((1, 2, -37))
    radius = 90 / (math.pi / 2)  # a quarter circle
    assert at["Q", 90.0] == pytest.approx((0, radius, -radius))
    mids = spark.createDataFrame([("V", 30.0), ("V", 90.0), ("V", -5.0), ("X", 1.0)], "hole_id string, mid double")
    got = {r["mid"]: r["z"] for r in trajectory.locate(mids, path).collect()}
    assert got[30.0] == pytest.approx(70) and got[90.0] == pytest.approx(50) and got[-5.0] == pytest.approx(100) and 1.0 not in got


def test_composites_edges(spark):
    rows = [("A", 0.0, 1.0, "G", 2.0), ("A", 1.0, 3.0, "G", None), ("A", 3.0, 3.3, "W", 5.0), ("A", 3.3, 5.0, None, 1.0), ("A", 5.0, 6.0, None, 3.0)]
    df = spark.createDataFrame(rows, "hole_id string, from_m double, to_m double, lith_code string, grade double")
    got = sorted((r["from_m"], r["to_m"], round(r["grade"], 6)) for r in intervals.composites(df).collect())
    assert got == [(0.0, 2.0, 1.0), (2.0, 3.0, 0.0), (3.3, 5.0, 1.0), (5.0, 6.0, 3.0)]
    fixed = {r["from_m"]: r["grade"] for r in intervals.composites(df, missing_as_zero=False).collect()}
    assert fixed[0.0] == 2.0 and fixed[2.0] is None


def test_stab_and_overlap_against_loops(spark):
    r = random.Random(2)
    spans = [("A", a := r.randrange(0, 100) / 2, a + r.randrange(1, 60) / 2, f"c{i}", i) for i in range(60)]
    base = [(i, "A", a := r.randrange(-10, 130) / 2, a + 2.0) for i in range(80)]
    s = spark.createDataFrame(spans, "hole_id string, from_m double, to_m double, v string, span_id int")
    p = spark.createDataFrame([(i, h, a) for i, h, a, _ in base], "point_id int, hole_id string, mid double")
    got = {x["point_id"]: x["v"] for x in intervals.stab(p, s, "v", tie="span_id").collect()}
    for i, _, a, _ in base:
        hits = sorted((x[1], x[4], x[3]) for x in spans if x[1] <= a < x[2])
        assert got[i] == (hits[0][2] if hits else None)
    b = spark.createDataFrame(base, "base_id int, hole_id string, from_m double, to_m double")
    got = {x["base_id"]: (x["v"], x["overlap_m"], x["matched"]) for x in intervals.most_overlap(b, s, "v").collect()}
    for i, _, a, e in base:
        hits = sorted((-(min(e, x[2]) - max(a, x[1])), x[4], x[3]) for x in spans if min(e, x[2]) > max(a, x[1]))
        assert got[i] == ((hits[0][2], -hits[0][0], True) if hits else (None, 0.0, False))


def test_contact_distance_bins(spark):
    rows = [("A", float(i), float(i + 1), "G" if i < 6 else "W", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "hole_id string, from_m double, to_m double, lith_code string, grade double")
    got = {r["from_m"]: (r["contact_depth_m"], r["signed_distance_m"]) for r in intervals.contact_distances(df, F.col("lith_code") == "G").collect()}
    assert got[5.0] == (6.0, -0.5) and got[15.0] == (6.0, 9.5) and 16.0 not in got and len(got) == 16


def test_contact_is_the_end_of_the_upper_interval(spark):
    rows = [("A", 0.0, 1.9, "G"), ("A", 2.1, 4.0, "W"), ("B", 0.0, 1.0, "G"), ("B", 1.3, 4.0, "W")]
    df = spark.createDataFrame(rows, "hole_id string, from_m double, to_m double, lith_code string")
    assert [tuple(r) for r in intervals.contacts(df, F.col("lith_code") == "G").collect()] == [("A", 1.9)]


def test_first_collar_row_and_depth_fallback(spark):
    collars = spark.createDataFrame([("A", 1.0, 0.0, 0.0, 9.0), ("A", 5.0, 0.0, 0.0, 9.0), ("B", 0.0, 0.0, 0.0, None), ("C", 0.0, 0.0, 0.0, None), ("D", 0.0, 0.0, 0.0, float("nan"))], "hole_id string, x double, y double, z double, total_depth double").coalesce(1)
    stations = spark.createDataFrame([("A", 0.0, 0.0, -90.0), ("A", 9.0, 0.0, -90.0)], "hole_id string, depth double, azimuth_deg double, dip_deg double")
    assays = spark.createDataFrame([("A", 3.0), ("B", 4.0), ("B", 7.0), ("D", -1.0)], "hole_id string, to_m double")
    path = trajectory.desurvey(stations, collars, assays).collect()
    assert sorted((r["hole_id"], r["depth"], r["x"]) for r in path) == [("A", 0.0, 1.0), ("A", 9.0, 1.0), ("B", 0.0, 0.0), ("B", 7.0, 0.0)]
    assert {r["hole_id"] for r in trajectory.complete_stations(stations, collars).collect()} == {"A"}
    assert {r["hole_id"] for r in trajectory.complete_stations(stations, collars, assays.filter("hole_id = 'B'")).collect()} == {"B"}


def test_header_that_counts(spark):
    df = spark.createDataFrame([("A", "1", "2", "3", "4")], "BHID string, Elevation string, `Elevation (m)` string, Final_Depth string, `Final_Depth (m)` string")
    r = tables.normalise(df, "collar").first()
    assert (r["z"], r["total_depth"]) == (2.0, 4.0)


def test_categories_and_fallbacks(spark):
    want = {"GRSC": "fresh_graphitic", " sap ": "weathered_graphitic", "SAPR(GRSC7)": "weathered_graphitic", "GRSC-3": "fresh_graphitic", "a grsc b": "fresh_graphitic", "QV": "host_waste", None: "host_waste"}
    df = spark.createDataFrame([(c,) for c in want], "code string")
    assert {r["code"]: r["g"] for r in df.select("code", samples.category(F.col("code")).alias("g")).collect()} == want


def test_order_statistics_against_plain(spark):
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=500), 1).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*v, None, float("nan")])], "id long, v double").repartition(5)
    marks = [0.0, 0.1, 0.333, 0.5, 0.99, 1.0]
    got = [x["q"] for x in order.quantiles(df, "v", marks).orderBy("k").collect()]
    assert got == pytest.approx(np.quantile(v, marks).tolist())
    assert order.quantiles(df.limit(0), "v", marks).count() == 0
    run = order.running(df.filter("id < 500"), ["v", "id"], {"s": F.col("id")}, {"m": F.col("id")}).collect()
    total, top = 0, -1
    for x in sorted(run, key=lambda x: (x["v"], x["id"])):
        total, top = total + x["id"], max(top, x["id"])
        assert (x["s"], x["m"], x["s_total"]) == (total, top, 499 * 250)
    knots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(sorted(r.normal(size=40)), r.normal(size=40), strict=True)], "x double, y double")
    k = knots.toPandas()
    out = samples.interpolated(df.filter("id < 501"), "v", knots, "x", "y", "o").toPandas()
    ok = out["v"].notna()
    assert len(out) == 501 and np.allclose(out["o"][ok], np.interp(out["v"][ok], k["x"], k["y"])) and out["o"][~ok].isna().all()


def test_tests_of_difference(spark):
    # Worked by hand from the ranks; tails of chi-square against their closed forms.
    assert samples.chi_square_tail(3.0, 2) == pytest.approx(math.exp(-1.5)) and samples.chi_square_tail(30.0, 2) == pytest.approx(math.exp(-15))
    assert samples.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05) and samples.chi_square_tail(0.0, 3) == 1.0
    rows = [("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", x) for x in (5.0, 6.0, 7.0, 8.0)] + [("c", x) for x in (2.0, 3.0, 9.0, None)]
    df = spark.createDataFrame(rows, "g string, v double")
    pair = {(r["a"], r["b"]): r for r in samples.rank_sums(df, "v", "g").collect()}
    ab = pair["a", "b"]
    assert (ab["u"], ab["delta"], ab["size"]) == (0.0, -1.0, "large") and ab["p"] == pytest.approx(math.erfc((8 - 0.5) / math.sqrt(12) / math.sqrt(2)))
    assert max(r["p_holm"] for r in pair.values()) <= 1.0 and ab["p_holm"] == pytest.approx(3 * ab["p"])
    k = samples.kruskal(df.filter("g <> 'c'"), "v", "g").first()
    assert (k["n"], k["groups"]) == (8, 2) and k["h"] == pytest.approx(16 / 3) and k["p"] == pytest.approx(samples.chi_square_tail(16 / 3, 1))
    assert samples.rank_sums(df.limit(0), "v", "g").count() == 0


def test_equal_rows_draw_apart(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 51, "v double")
    r = simulate.bootstrap_median(df, "v", 200, 3).first()
    assert (r["p05"], r["p95"]) == (1.0, 2.0) and r == simulate.bootstrap_median(df.repartition(7), "v", 200, 3).first()


def test_folds_see_their_training_rows_only(spark):
    rows = [(i, float(i % 20), float(i // 20), 0.0, float(i % 20) + (1000.0 if i == 7 else 0.0), 0 if i == 7 else 1 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, value double, fold int")
    out = {r["id"]: r["estimate"] for r in simulate.cross_validate(df, covariance.Model("exponential", 0.0, 1.0, 5.0), simulate.Search((3.0, 3.0, 3.0), 8)).collect()}
    assert out[7] <= 19.0 and max(out.values()) <= 1007.0


def test_screen_scores(spark):
    r = random.Random(1)
    rows = [(f"H{i % 12}", float(i % 7) if i % 5 else None, "g" if i % 2 else "w", i % 7 > 3) for i in range(240) if r.random() < 0.9]
    df = spark.createDataFrame(rows, "hole_id string, n double, t string, rich boolean")
    out = screen.screen(df, ["n"], ["t"], "rich", "hole_id", k=2, trees=5).toPandas()
    assert set(out["method"]) == {"forest", "logistic", "prior"} and (out.loc[out["method"] == "forest", "auc"] > 0.8).all() and (out.loc[out["method"] == "prior", "auc"] == 0.5).all()


def test_screen_is_fitted_on_all_cores(spark):
    """A small table came in one part, and all trees were grown by one core."""
    df = spark.range(1000).coalesce(1)
    x = screen.spread(df)
    assert x.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and sorted(r["id"] for r in x.collect()) == list(range(1000))


def test_screen_counts_equal_rows(spark, monkeypatch):
    """A forest once saw each of a table's equal rows by itself, for each tree: 60 times the rows took 60 times its time."""
    seen, grow = [], forest.grow
    monkeypatch.setattr(forest, "grow", lambda rows, *a: seen.append({r["of"]: (r["rows"], r["n"]) for r in rows.groupBy("of").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}) or grow(rows, *a))
    rows = [(f"H{i % 12}", float(i % 7) if i % 5 else None, "g" if i % 2 else "w", i % 7 > 3) for i in range(420)]
    df = spark.createDataFrame(rows, "hole_id string, n double, t string, rich boolean")
    out = screen.screen(df.crossJoin(spark.range(60)), ["n"], ["t"], "rich", "hole_id", k=2, trees=5).toPandas()
    assert len(out) == 6 and (out.loc[out["method"] == "forest", "auc"] > 0.8).all()
    assert sum(n for _, n in seen[0].values()) == 420 * 60 and all(r <= 7 * 2 * 2 for r, _ in seen[0].values())


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_counted_forest_is_the_forest_of_all_rows(spark, monkeypatch, block):
    """Against MLlib's, which draws row by row; copies draw apart, and blocks of rows add up."""
    monkeypatch.setattr(forest, "BLOCK_ROWS", block)
    r = np.random.default_rng(3)
    a, b, c = r.integers(0, 12, 1500), r.integers(0, 9, 1500), r.integers(0, 3, 1500)
    y = (r.random(1500) < 1 / (1 + np.exp(-(0.5 * (a - 6) + 0.4 * (b > 4) * (c == 1) * 4 - 0.5)))).astype(int)
    df = spark.createDataFrame(list(zip(*[map(int, v) for v in (a, b, c, y)], strict=True)), "f0 int, f1 int, f2 int, label int")
    counted = df.groupBy("f0", "f1", "f2", "label").count().withColumnRenamed("count", "n").withColumn("of", F.lit(0))
    grown = forest.grow(counted, ["f0", "f1", "f2"], [forest.Layout.of(2, [3])], 60, 6, 7)
    ours = {(q["f0"], q["f1"], q["f2"]): q["p"] for q in forest.shares(counted, ["f0", "f1", "f2"], grown).collect()}
    wide = df.selectExpr("*", "int(f2 = 0) g0", "int(f2 = 1) g1", "int(f2 = 2) g2", "double(label) y")
    wide = VectorAssembler(inputCols=["f0", "f1", "g0", "g1", "g2"], outputCol="features").transform(wide)
    theirs = RandomForestClassifier(labelCol="y", numTrees=60, maxDepth=6, seed=7).fit(wide).transform(wide).select("f0", "f1", "f2", "probability").collect()
    apart = [abs(ours[q["f0"], q["f1"], q["f2"]] - q["probability"][1]) for q in theirs]
    assert np.mean(apart) < 0.025 and max(apart) < 0.15, (np.mean(apart), max(apart))


def test_edges_of_bins(spark):
    rows = [(i % 2, float(i // 2 % 3), float(i // 2)) for i in range(2000)] + [(1, 9.0, math.nan), (1, None, None)]
    x = spark.createDataFrame(rows, "fold int, few double, many double")
    got = forest.edges(x, ["few", "many"], [[1.0, 500.0], [1.0, 500.0]])
    few, many = got[0]
    assert few == [0.5, 1.5, 5.5] and got[1][0] == [0.5, 1.5] and len(many) == 31
    seen = np.array([500.0 if v is None or math.isnan(v) else v for f, _, v in rows if f == 1])
    assert np.ptp(np.histogram(seen, [-math.inf, *many, math.inf])[0]) <= 3


def test_widths_and_models(spark):
    curve = lambda lo, hi: spark.createDataFrame([(5.0, lo, hi), (6.0, 0.0, 0.0)], "cutoff double, tonnage_p10 double, tonnage_p90 double")
    assert compare.width_reduction(curve(4.0, 7.0), curve(2.0, 8.0), 5.0).first()["reduction_pct"] == 50.0
    assert compare.width_reduction(curve(4.0, 7.0), curve(2.0, 8.0), 6.0).first()["reduction_pct"] == 0.0
    m = covariance.fit(np.arange(1.0, 9.0), 0.3 + 0.7 * (1 - np.exp(-np.arange(1.0, 9.0) / 2)))
    assert m.sill == pytest.approx(0.3 + 0.7 * (1 - math.exp(-4)), rel=0.05) and m.nugget == pytest.approx(0.3, abs=0.1)
    assert ensemble.evenly_chosen(100, 4) == [0, 33, 66, 99] and ensemble.evenly_chosen(3, 9) == [0, 1, 2] and ensemble.evenly_chosen(5, 1) == [0]
    with pytest.raises(ValueError, match="trend"):
        simulate.with_trend(curve(1.0, 2.0), [1.0], ["x"])


def test_declustering(spark):
    rows = [(1, 0.1, 0.1, 0.1, 1.0), (2, 0.2, 0.2, 0.2, 2.0), (3, 0.3, 0.1, 0.1, 3.0), (4, 5.0, 5.0, 5.0, 9.0), (5, 0.1, 0.1, 0.1, None), (6, 0.1, 0.1, 0.1, float("nan"))]
    out = {r["id"]: (r["decluster_weight"], r["cell_count"]) for r in samples.decluster(spark.createDataFrame(rows, "id int, x double, y double, z double, grade double"), (1.0, 1.0, 1.0)).collect()}
    assert out[1] == pytest.approx((2 / 3, 3)) and out[4] == pytest.approx((2.0, 1)) and out[5] == out[6] == (1.0, 1)
    assert sum(out[i][0] for i in (1, 2, 3, 4)) == pytest.approx(4)


def test_normal_scores_with_ties(spark):
    v = [3.0, 1.0, 2.0, 2.0, 2.0, 5.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v double")
    got = {r["id"]: r["score"] for r in samples.normal_scores(df, "v").collect()}
    rank = {1.0: 0.5, 2.0: 3.5, 3.0: 4.5, 5.0: 5.5}
    assert all(got[i] == pytest.approx(NormalDist().inv_cdf(rank[x] / 6)) for i, x in enumerate(v) if x is not None) and got[6] is None


def test_quantile_map_and_least_squares(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(2 * a + 3 * b + 1), float(b)) for a, b in r.random((300, 2))], "a double, y double, b double")
    assert simulate.least_squares(df, "y", ["a", "b"]) == pytest.approx([1, 2, 3])
    out = samples.quantile_map(df, "a", df, "y").toPandas()
    marks = np.linspace(0, 1, 1001)
    assert np.allclose(out["mapped"], np.interp(out["a"], np.quantile(out["a"], marks), np.quantile(out["y"], marks)))


def test_curves_and_percentiles(spark):
    rows = [(k, c, c, 0, 0, float(c + k)) for k in range(4) for c in range(5)]
    reals = spark.createDataFrame(rows, "real_id int, cell_id int, ix int, iy int, iz int, value double")
    p = {r["cell_id"]: r for r in ensemble.cell_percentiles(reals).collect()}
    assert p[2]["p50"] == 3.5 and p[2]["p10"] == pytest.approx(np.percentile([2, 3, 4, 5], 10))
    gap = ensemble.cell_percentiles(reals.withColumn("value", F.when(F.col("real_id") + F.col("cell_id") > 0, F.col("value"))))
    assert {r["cell_id"] for r in gap.collect() if r["p50"] is None} == {0}
    curve = {(r["real_id"], r["cutoff"]): r for r in ensemble.cutoff_curve(reals, [4.0, 100.0], 10.0, 2.0).collect()}
    assert curve[0, 4.0]["blocks"] == 1 and curve[0, 4.0]["contained"] == pytest.approx(0.8) and curve[3, 100.0]["avg_grade"] == 0.0
    assert ensemble.exceedance(reals, 4.0).filter("cell_id = 4").first()["probability"] == 0.75
    summary = ensemble.curve_summary(ensemble.cutoff_curve(reals, [1.0, 4.0], 10.0, 2.0))
    assert ensemble.curve_is_sane(summary).count() == 2
    bad = summary.withColumn("tonnage_p50", F.col("cutoff"))
    with pytest.raises(Exception, match="monotone"):
        ensemble.curve_is_sane(bad).collect()


def test_entropy_worked_example(spark):
    df = spark.createDataFrame([(0.7, 0.2, 0.1)], "a double, b double, c double")
    want = -sum(p * math.log(p) for p in (0.7, 0.2, 0.1)) / math.log(3)
    assert df.select(scalar.entropy([F.col(c) for c in "abc"]).alias("e")).first()["e"] == pytest.approx(want)


def test_draws_stay_in_range(spark):
    df = spark.createDataFrame([([0.3, 0.3, 0.39999], u) for u in (0.0, 0.3, 0.30001, 0.6, 0.99995, 1.0)], "s array<double>, u double")
    assert [r[0] for r in df.select(ensemble.draw_category(F.col("s"), F.col("u"))).collect()] == [0, 0, 1, 1, 2, 2]


def test_neighbours_and_variogram_against_loops(spark):
    r = np.random.default_rng(3)
    xyz = r.random((120, 3)) - 0.5
    rows = [(i, *map(float, p), i % 3, float(i % 7)) for i, p in enumerate(xyz)]
    pts = spark.createDataFrame(rows, "id int, x double, y double, z double, label int, value double")
    got = {}
    for x in pairs.neighbours(pts.filter("id < 20"), pts.filter("id >= 20"), 0.3, 4).collect():
        got.setdefault(x["target"], []).append((x["rank"], x["sample"]))
    for i in range(20):
        d = sorted((float(np.linalg.norm(xyz[i] - xyz[j])), j) for j in range(20, 120))
        assert [s for _, s in sorted(got.get(i, []))] == [j for h, j in d[:4] if h <= 0.3]
    v = {(x["direction"], x["lag"]): (x["pairs"], x["gamma"]) for x in pairs.variogram(pts, 0.4, 4, {"x": (1, 0, 0)}, 30.0).collect()}
    want: dict = {}
    for i in range(120):
        for j in range(i):
            d = xyz[i] - xyz[j]
            h = float(np.linalg.norm(d))
            if h < 0.4 and abs(d[0]) / h >= math.cos(math.radians(30)):
                want.setdefault(int(h / 0.1), []).append((rows[i][5] - rows[j][5]) ** 2 / 2)
    assert {k: n for (_, k), (n, _) in v.items()} == {k: len(x) for k, x in want.items()}
    assert all(v["x", k][1] == pytest.approx(np.mean(x)) for k, x in want.items())


def test_local_shares_without_neighbours(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 99.0, 0.0, 0.0)], "id int, x double, y double, z double")
    s = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 1), (8, 0.5, 0.0, 0.0, 0)], "id int, x double, y double, z double, label int")
    got = {r["target"]: r for r in pairs.local_shares(t, s, 1.0, 8, 2.0, 0, [0, 1]).collect()}
    assert got[2]["share_0"] == 1.0 and got[1]["share_1"] > 0.999
    assert all(r["share_0"] + r["share_1"] == pytest.approx(1) for r in got.values())


def test_kriging_and_models():
    m = covariance.Model("spherical", 0.2, 0.8, 10.0)
    pts, v = np.array([[0.0, 0, 0], [4.0, 0, 0]]), np.array([1.0, -1.0])
    assert covariance.krige(m, pts, v, pts[0])[0] == pytest.approx(1.0)
    est, var = covariance.krige(m, pts, v, np.array([2.0, 0, 0]))
    assert est == pytest.approx(0.0) and 0 <= var <= m.sill
    assert covariance.krige(m, np.zeros((3, 3)), np.ones(3), np.zeros(3))[0] == pytest.approx(1.0, abs=1e-6)
    h = np.linspace(5, 200, 12)
    true = covariance.Model("exponential", 0.2, 0.8, 50.0)
    got = covariance.fit(h, true.gamma(h))
    assert np.abs(got.gamma(h) - true.gamma(h)).max() < 0.05
    assert covariance.fit(h[:2], h[:2]) == covariance.Model() and got.with_sill(2.0).sill == pytest.approx(2.0)
    b = covariance.basis(30, 60)
    assert b @ b.T == pytest.approx(np.eye(3))


def test_buckets_against_loop():
    r = np.random.default_rng(5)
    pts = r.normal(0, 1.2, (300, 3))
    b = covariance.Buckets(pts[:150])
    for p in pts[150:]:
        b.add(tuple(p.tolist()))
    for t in r.normal(0, 1.2, (40, 3)):
        d = ((pts - t) ** 2).sum(1)
        want = [i for i in np.lexsort((np.arange(300), d)) if d[i] <= 1][:6]
        assert b.near(tuple(t.tolist()), 6) == want


def test_simulation_is_repeatable_and_honours_data(spark):
    g = grid.Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (4, 4, 2))
    cells = g.cells(spark).withColumn("real_id", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("domain", (F.col("ix") % 2).cast("int"))
    data = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.5), (1, 1.0, 1.0, 1.0, -2.0)], "domain int, x double, y double, z double, score double")
    m = {0: covariance.Model("exponential", 0.0, 1.0, 5.0), 1: covariance.Model("exponential", 0.0, 1.0, 5.0)}
    run = lambda n: {(r["real_id"], r["cell_id"]): r["value"] for r in simulate.simulate(cells.repartition(n), data, m, simulate.Search((3.0, 3.0, 3.0), 6), 9).collect()}
    a = run(2)
    assert a == run(5) and len(a) == 64 and a[0, 0] == pytest.approx(1.5, abs=1e-3) and a[0, 1] != a[1, 1]
    sim = simulate.simulate(cells, data, m, simulate.Search((3.0, 3.0, 3.0), 6), 9)
    assert simulate.complete(sim, cells).isEmpty() and simulate.complete(sim.filter("domain = 0"), cells).count() == 32


def test_cross_validation_falls_back(spark):
    rows = [(i, float(i), 0.0, 0.0, float(i % 2), i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, value double, fold int")
    out = simulate.cross_validate(df, covariance.Model(), simulate.Search((0.1, 0.1, 0.1)), least=8).collect()
    assert all(r["estimate"] == 1 - r["fold"] for r in out)


def test_grids():
    fine, coarse = grid.Grid((0.0,) * 3, (1.0,) * 3, (4, 4, 2)), grid.Grid((0.0,) * 3, (2.0, 2.0, 1.0), (2, 2, 2))
    assert grid.factors(fine, coarse) == (2, 2, 1)
    with pytest.raises(ValueError, match="nest"):
        grid.factors(fine, grid.Grid((0.5,) * 3, (2.0, 2.0, 1.0), (2, 2, 2)))


def test_requirements(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "x double, g double")
    checks.require(df, ["x", "g"])
    for bad in (df.limit(9), df.withColumn("g", F.lit(float("nan"))), df.drop("g")):
        with pytest.raises(ValueError):
            checks.require(bad, ["x", "g"])


def test_even_rounding_and_reproduction(spark):
    df = spark.createDataFrame([(12.5,), (37.5,), (40.0,)], "x double")
    assert [r[0] for r in df.select(scalar.even_bin(F.col("x"), 0.0, 25.0)).collect()] == [0, 2, 2]
    v = spark.createDataFrame([("a", 1.0, 50, 2.0), ("a", 9.0, 5, 2.0), ("b", 1.0, 3, 2.0)], "direction string, gamma_target double, target_pairs int, gamma_sim_mean double")
    out = {r["direction"]: r for r in compare.reproduction(v, {"a": 0.4, "b": 0.6}).collect()}
    assert out["a"]["rmse"] == 1.0 and out["b"]["rmse"] is None and out["b"]["weighted_rmse"] == 1.0


def test_stream_refreshes_curves(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "real_id int, cell_id long, value double"
    for k in range(2):
        spark.createDataFrame([(k, c, float(c + k)) for c in range(5)], schema).coalesce(1).write.mode("append").parquet(src)
        follow_curve(spark.readStream.schema(schema).parquet(src), out, mark, [2.0], 1.0, 1.0).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1
