"""Searches and pairs where a radius holds most of the points, copies of places, and grids without an end."""

import math

import numpy as np

from orebed.operators import compare, pairs


def crowd(spark, n=900, copies=300):
    """Points within one radius, the first of them many times over."""
    xyz = np.random.default_rng(11).normal(0, 0.1, (n, 3))
    xyz = np.concatenate([xyz, np.repeat(xyz[:3], copies // 3, axis=0)])
    rows = [(i, *map(float, p), i % 3, i % 4, float(i % 7)) for i, p in enumerate(xyz)]
    return xyz, rows, spark.createDataFrame(rows, "id long, x double, y double, z double, label int, fold int, value double")


def test_crowded_neighbours_of_other_folds(spark, monkeypatch):
    for name, rows in (("TARGET_ROWS", 64), ("SAMPLE_ROWS", 100), ("MEETING", 2), ("FIRST", 1)):
        monkeypatch.setattr(pairs, name, rows)
    xyz, rows, df = crowd(spark)
    got = {}
    for r in pairs.neighbours(df, df, 0.5, 6, apart="fold").collect():
        got.setdefault(r["target"], []).append((r["rank"], r["sample"], r["label"]))
    for i in range(0, len(rows), 13):
        d = np.sqrt((((xyz - xyz[i]) ** 2)[:, 0] + ((xyz - xyz[i]) ** 2)[:, 1]) + ((xyz - xyz[i]) ** 2)[:, 2])
        best = sorted((h, j) for j, h in enumerate(d.tolist()) if h <= 0.5 and j % 4 != i % 4)[:6]
        assert sorted(got.get(i, [])) == [(k + 1, j, j % 3) for k, (_, j) in enumerate(best)]


def test_a_search_moves_no_more_than_its_rows_ask_for(spark, monkeypatch):
    """Samples once went to every block of targets within reach of theirs: four times the points moved seven times the rows."""
    for name, rows in (("TARGET_ROWS", 64), ("SAMPLE_ROWS", 64)):
        monkeypatch.setattr(pairs, name, rows)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def moved():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    xyz = np.random.default_rng(5).normal(0, 0.1, (16000, 3))
    rows = [(i, *map(float, p), i % 3, i % 5) for i, p in enumerate(xyz)]
    out = []
    for n in (4000, 16000):
        df = spark.createDataFrame(rows[:n], "id long, x double, y double, z double, label int, fold int")
        before = moved()
        assert pairs.neighbours(df, df, 0.5, 6, apart="fold").count() == 6 * n
        out.append(sum(v for k, v in moved().items() if k not in before))
    assert out[1] < 6 * out[0], out


def test_blocks_are_bounded_where_points_crowd(spark):
    """One cell of the radius once held all of these: now no block has more rows than it may."""
    df = crowd(spark)[2]
    blocks = pairs._blocked(pairs._placed(df), ["fold"], 100).groupBy("_block").agg({"*": "count", "fold": "max"}).collect()
    assert max(r["count(1)"] for r in blocks) <= 100 and sum(r["count(1)"] for r in blocks) == df.count()


def test_pairs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_ROWS", 100)
    xyz, rows, df = crowd(spark)
    df = df.selectExpr("id", "x", "y", "z", "fold % 2 AS g", "CASE WHEN id % 10 > 0 THEN value END AS value")
    got = {(r["g"], r["direction"], r["lag"]): r for r in pairs.variogram(df, 0.3, 3, {"all": (1, 0, 0), "up": (0, 0, 1)}, {"all": 90.0, "up": 30.0}, by=("g",)).collect()}
    value = np.array([math.nan if r[0] % 10 == 0 else r[6] for r in rows])
    for g in (0, 1):
        own = np.array([r[0] % 4 % 2 == g for r in rows])
        a, b = np.triu_indices(own.sum(), 1)
        d = xyz[own][b] - xyz[own][a]
        h = np.sqrt((d**2).sum(1))
        half = (value[own][a] - value[own][b]) ** 2 / 2
        for name, ok in (("all", h > 0), ("up", (h > 0) & (np.abs(d[:, 2]) >= math.cos(math.radians(30)) * h))):
            for lag in range(3):
                at = ok & (h >= 0.1 * lag) & (h < 0.1 * (lag + 1))
                r = got[g, name, lag]
                assert r["pairs"] == at.sum() and np.isclose(r["distance"], h[at].mean()) and np.isclose(r["gamma"], np.nanmean(half[at]))


def test_runs_off_all_axes_are_left_out():
    """Of pairs of runs within reach all were compared, whatever their direction: few have pairs along an axis, and none of those may be lost."""
    a, b = (np.random.default_rng(s).uniform(0, 1, (16384, 3)) for s in (1, 2))
    a, b = a[pairs._in_order(a)], b[pairs._in_order(b)]
    cones = [((1.0, 0.0, 0.0), math.cos(math.radians(22.5))), ((0.0, 1.0, 0.0), math.cos(math.radians(22.5)))]
    made, along = [], []
    for given in (None, cones):
        n, held = 0, [0, 0]
        for _, _, d, h, ok in pairs._met(a, b, False, 0.5, 0.0, given):
            n += h.size
            held = [x + int((ok & (np.abs(d[k]) >= c * h)).sum()) for k, (x, (_, c)) in enumerate(zip(held, cones, strict=True))]
        made.append(n)
        along.append(held)
    assert along[0] == along[1] and made[1] < 0.8 * made[0], made


def test_support_of_an_open_axis(spark):
    blocks = spark.createDataFrame([(0.0, 0.0, 2.5 * k, 1.0, 2.0, 1.0) for k in (0, 499, 500, 9000)], "x double, y double, z double, volume double, grade double, density double")
    got = compare.to_support(blocks, (0.0, 0.0, 0.0), (12.5, 12.5, 2.5), (20, 20, None), 20.0)
    assert sorted(r["iz"] for r in got.collect()) == [0, 499, 500, 9000]
