"""Directional models, held-out folds and simulation against plain NumPy."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.functions import covariance
from orebed.operators import grid, pairs, samples, simulate

AXES = covariance.basis(30.0, 40.0)


def points(n, seed=1, hole=5):
    r = np.random.default_rng(seed)
    xyz = r.random((n, 3)) * 40
    v = 3 + 0.05 * xyz[:, 2] + np.sin(xyz[:, 0] / 6) + 0.3 * r.standard_normal(n)
    return [(i, *map(float, p), float(x), f"H{i % hole}") for i, (p, x) in enumerate(zip(xyz, v, strict=True))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, z double, value double, hole_id string")


def test_covariance_by_separation_vector():
    m = covariance.directional(covariance.Model("exponential", 0.2, 0.8, 99.0), {"strike": 250.0, "dip": 200.0, "normal": 20.0}, AXES)
    assert m.reach == 250 and m.ranges() == pytest.approx((250, 200, 20)) and covariance.anisotropy({"strike": 250.0, "dip": 200.0, "normal": 20.0}) == (250.0, (1.25, 12.5))
    zero = np.zeros((1, 3))
    for axis, reach in zip(AXES, (250.0, 200.0, 20.0), strict=True):
        assert m.between(zero, (axis * reach)[None])[0, 0] == pytest.approx(0.8 * math.exp(-1))
    r = np.random.default_rng(2)
    p, v, t = r.normal(0, 60, (12, 3)), r.normal(size=12), r.normal(0, 60, 3)

    def cov(a, b):
        # Dense: each separation vector turned into the axes and divided by the ranges.
        d = (a[:, None] - b[None]) @ AXES.T / np.array([250.0, 200.0, 20.0])
        return 0.8 * np.exp(-np.sqrt((d**2).sum(-1)))

    left, right = cov(p, p), cov(p, t[None])[:, 0]
    w = np.linalg.solve(left, right)
    assert covariance.krige(m, p, v, t) == pytest.approx((w @ v, 1.0 - w @ right), rel=1e-6)
    full = np.block([[left, np.ones((12, 1))], [np.ones((1, 12)), np.zeros((1, 1))]])
    w = np.linalg.solve(full, np.append(right, 1.0))
    assert w[:12].sum() == pytest.approx(1) and covariance.krige(m, p, v, t, ordinary=True)[0] == pytest.approx(w[:12] @ v, rel=1e-6)


def test_assembly_of_directional_models():
    base = covariance.Model("spherical", 0.1, 0.9, 50.0)
    assert covariance.directional(base, {"strike": 80.0, "dip": None, "normal": None}) is base
    assert covariance.directional(base, {"strike": 80.0, "dip": 900.0, "normal": None}, max_reach=500) is base
    two = covariance.directional(base, {"strike": 80.0, "dip": None, "normal": 10.0})
    assert two.ratios == (1.0, 1.0, 8.0) and two.axes is None and two.sill == base.sill
    assert covariance.directional(base, {"strike": 40.0, "dip": 80.0, "normal": 10.0}).ranges() == (40.0, 80.0, 10.0)


@pytest.mark.parametrize("kind", ["exponential", "spherical", "gaussian"])
def test_fit_recovers_a_model(kind):
    h = np.linspace(5, 300, 30)
    for nugget, variance, reach in ((0.2, 0.8, 51.7), (0.0, 1.3, 73.1), (0.33, 0.41, 137.3)):
        true = covariance.Model(kind, nugget, variance, reach)
        got = covariance.fit(h, true.gamma(h), kind)
        assert got.reach == pytest.approx(reach, rel=1e-3) and got.nugget / got.sill == pytest.approx(nugget / true.sill, abs=1e-3)
    # Bounds hold: a range that is not to exceed a limit.
    assert covariance.fit(h, h / 300, kind, 120.0).reach <= 120.0 + 1e-9


def test_models_by_group_equal_models_apart(spark):
    rows = points(120)
    df = frame(spark, rows).withColumn("score", F.col("value")).withColumn("domain", F.col("id") % 2)
    o = simulate.Orientation(30.0, 40.0, tolerance=60.0)
    got = simulate.fitted_by(df, "domain", 20.0, 5, orientation=o)
    for k in (0, 1):
        one = simulate.fitted_by(df.filter(F.col("domain") == k), "domain", 20.0, 5, orientation=o)[k]
        assert (*got[k].ranges(), got[k].nugget, got[k].sill) == pytest.approx((*one.ranges(), one.nugget, 1.0)) and np.allclose(got[k].axes, AXES)
    given = simulate.Orientation(30.0, 40.0, ranges=(250.0, 200.0, 20.0))
    assert simulate.fitted_by(df, "domain", 20.0, 5, orientation=given)[0].ranges() == pytest.approx((250.0, 200.0, 20.0))


def scores(values):
    order = np.argsort(values, kind="stable")
    p = np.clip((np.arange(len(values)) + 0.5) / len(values), 1e-6, 1 - 1e-6)
    return values[order], np.array([NormalDist().inv_cdf(x) for x in p])


def brute_folds(rows, fold_of, model, search, least, trend, ordinary):
    xyz, v = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    fold = np.array([fold_of(r) for r in rows], dtype=object)
    cols = ["xyz".index(c) for c in trend]
    design = np.column_stack([np.ones(len(v)), *[xyz[:, c] for c in cols]])
    scaled = search.scaled(xyz)
    out = {}
    for f in set(fold):
        train = np.flatnonzero(fold != f)
        slope = np.linalg.lstsq(design[train], v[train], rcond=None)[0] if trend else np.zeros(1)
        left = v - (design @ slope if trend else 0)
        knots, marks = scores(left[train])
        for i in np.flatnonzero(fold == f):
            d = np.sqrt(((scaled[train] - scaled[i]) ** 2).sum(1))
            near = [train[k] for k in np.lexsort((train, d)) if d[k] <= 1][: search.k]
            if len(near) < max(1, least):
                out[rows[i][0]] = v[train].mean()
            else:
                s = np.interp(left[near], knots, marks)
                e = covariance.krige(model, xyz[near], s, xyz[i], ordinary=ordinary)[0]
                out[rows[i][0]] = np.interp(e, marks, knots) + (design[i] @ slope if trend else 0)
    return out


def test_folds_against_loops(spark):
    rows = points(90)
    df = frame(spark, rows)
    model = covariance.directional(covariance.Model("exponential", 0.2, 0.8, 9.0), {"strike": 20.0, "dip": 12.0, "normal": 6.0}, AXES)
    search = simulate.Search((14.0, 10.0, 8.0), 6, tuple(map(tuple, AXES.tolist())))
    families = {"hole": simulate.hole_folds(df), "section": simulate.section_folds(df, 10.0), "one": df.withColumn("fold", F.lit("all"))}
    both = None
    for n, x in families.items():
        x = x.withColumn("fold", F.col("fold").cast("string")).withColumn("family", F.lit(n))
        both = x if both is None else both.unionByName(x)
    got = {(r["family"], r["method"], r["id"]): r["estimate"] for r in simulate.cross_validated(both, model, search, 3, ("z",), simulate.KRIGING, "family").collect()}
    assert len(got) == 6 * 90 and all(got["one", m, i] is None for m in simulate.KRIGING for i in range(90))
    for name, fold_of in (("hole", lambda r: r[5]), ("section", lambda r: math.floor(r[2] / 10.0))):
        for method in simulate.KRIGING:
            want = brute_folds(rows, fold_of, model, search, 3, ("z",), method == "ordinary_kriging")
            assert {i: got[name, method, i] for i in want} == pytest.approx(want, rel=1e-4, abs=1e-4)
    plain = {r["id"]: r["estimate"] for r in simulate.cross_validate(simulate.hole_folds(df), model, search).collect()}
    assert plain == pytest.approx(brute_folds(rows, lambda r: r[5], model, search, 1, (), False), rel=1e-4, abs=1e-4)
    e = simulate.baselines(both.filter("family <> 'one'"), model, search).collect()
    assert {(r["family"], r["method"]) for r in e} == set(itertools.product(["hole", "section"], [*simulate.KRIGING, "inverse_distance"])) and all(r["n"] == 90 for r in e)


def test_kriging_of_many_at_once():
    """One solution for all rows with as many neighbours; a row once took a call, and folds were kriged twice."""
    rng, model = np.random.default_rng(3), covariance.directional(covariance.Model("exponential", 0.2, 0.8, 9.0), {"strike": 20.0, "dip": 12.0, "normal": 6.0}, AXES)
    p, v, t = rng.uniform(0, 20, (40, 7, 3)), rng.normal(size=(40, 7)), rng.uniform(0, 20, (40, 3))
    p[5], p[6, 1] = p[5, 0], p[6, 0]
    for ordinary in (False, True):
        want = [covariance.krige(model, *each, ordinary=ordinary)[0] for each in zip(p, v, t, strict=True)]
        assert covariance.krige_many(model, p, v, t, ordinary) == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_inverse_distances_against_loops(spark):
    rows = points(70, 4)
    got = {r["id"]: r["estimate"] for r in simulate.inverse_distances(simulate.hole_folds(frame(spark, rows)), simulate.Search((12.0, 12.0, 12.0), 5), least=2).collect()}
    for i, x, y, z, _, hole in rows:
        near = sorted((math.dist((x, y, z), r[1:4]) / 12.0, r[0], r[4]) for r in rows if r[5] != hole)
        near = [n for n in near if n[0] <= 1][:5]
        w = [1 / max(d, 1e-6) ** 2 for d, *_ in near]
        others = [r[4] for r in rows if r[5] != hole]
        want = sum(a * n[2] for a, n in zip(w, near, strict=True)) / sum(w) if len(near) >= 2 else sum(others) / len(others)
        assert got[i] == pytest.approx(want)


def test_folds_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0), (2, 1.0, None, 0.0, 1.0, 0), (3, 1.0, 0.0, 0.0, None, 1), (4, 1.0, 0.0, 0.0, 5.0, 1)], "id long, x double, y double, z double, value double, fold int")
    got = {r["id"]: r["estimate"] for r in simulate.cross_validate(df, covariance.Model(), simulate.Search((9.0, 9.0, 9.0))).collect()}
    assert got == pytest.approx({1: 5.0, 4: 1.0})
    assert simulate.cross_validate(df.limit(0), covariance.Model(), simulate.Search((9.0, 9.0, 9.0))).count() == 0
    assert simulate.inverse_distances(df.limit(0), simulate.Search((9.0, 9.0, 9.0))).count() == 0


def test_simulation_in_blocks(spark):
    g = grid.Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (12, 12, 3))
    cells = g.cells(spark).withColumn("real_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("domain", F.lit(0))
    data = spark.createDataFrame([(0, 6.0, 6.0, 1.0, 2.5), (0, 0.0, 11.0, 2.0, -2.0), (0, 99.0, 0.0, 0.0, 0.0), (0, None, 0.0, 0.0, 9.0)], "domain int, x double, y double, z double, score double")
    model, search = covariance.Model("exponential", 0.0, 1.0, 4.0), simulate.Search((2.5, 2.5, 2.5), 10, least=3)
    out = simulate.simulate(cells, data, {0: model}, search, 5, block=2.0)
    a = {(r["real_id"], r["cell_id"]): (r["value"], r["neighbours"]) for r in out.collect()}
    assert len(a) == 4 * 432
    assert a == {(r["real_id"], r["cell_id"]): (r["value"], r["neighbours"]) for r in simulate.simulate(cells.repartition(7), data.repartition(3), {0: model}, search, 5, block=2.0).collect()}
    for k in range(4):
        assert a[k, (6 * 12 + 6) * 3 + 1][0] == pytest.approx(2.5, abs=1e-3) and a[k, 11 * 3 + 2][0] == pytest.approx(-2.0, abs=1e-3)
    # Cells that lie on either side of a block's face belong together as much as others do.
    v = np.array([[a[k, c][0] for c in range(432)] for k in range(4)]).reshape(4, 12, 12, 3)
    steps = np.abs(np.diff(v, axis=1)).mean((0, 2, 3))
    assert steps.max() < 1.8 * steps.min() and 0.4 < v.var() < 1.8
    n = {r["real_id"]: r for r in simulate.neighbourhoods(out, 3).collect()}
    for k in range(4):
        met = [a[k, c][1] for c in range(432)]
        assert n[k]["nodes"] == 432 and n[k]["avg_neighbours"] == pytest.approx(np.mean(met)) and n[k]["under_least_pct"] == pytest.approx(100 * np.mean(np.array(met) < 3))
    with pytest.raises(Exception, match="no neighbour"):
        simulate.simulate(cells, data.limit(0), {0: model}, simulate.Search((2.5, 2.5, 2.5), 10, least=3, required=True), 5).collect()
    with pytest.raises(ValueError, match="2 search radii"):
        simulate.simulate(cells, data, {0: model}, search, 5, block=1.0)
    assert simulate.simulate(cells.limit(0), data, {0: model}, search, 5).count() == 0


def test_cascade_uses_prepared_domains(spark):
    rows = [(*r, "GRSC" if r[0] % 2 else "QV") for r in points(80)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, value double, hole_id string, lith_code string")
    d = samples.with_domains(df, "value")
    p = simulate.prepare_domains(d, ["fresh_graphitic", "host_waste"], (10.0, 10.0, 10.0), 20.0, 5, orientation=simulate.Orientation(30.0, 40.0, tolerance=60.0))
    for k, name in enumerate(["fresh_graphitic", "host_waste"]):
        own = samples.decluster(d.filter(F.col("domain_group") == name), (10.0, 10.0, 10.0), "value")
        table = {r["value"]: r["score"] for r in samples.score_table(own, "value", "decluster_weight", "id").collect()}
        got = {r["value"]: r["score"] for r in p.samples.filter(F.col("domain") == k).collect()}
        assert got == pytest.approx(table) and p.models[k].axes is not None
    g = grid.Grid((0.0, 0.0, 0.0), (10.0, 10.0, 10.0), (4, 4, 4))
    cells = g.cells(spark).withColumn("real_id", F.lit(0)).withColumn("domain", (F.col("ix") % 2).cast("int"))
    out = simulate.cascade(p, cells, simulate.Search((20.0, 20.0, 20.0), 8), 3).toPandas()
    lo, hi = df.agg(F.min("value"), F.max("value")).first()
    assert len(out) == 64 and out["value"].between(lo, hi).all()
    lifted = simulate.cascade(p, cells, simulate.Search((20.0, 20.0, 20.0), 8), 3, ([100.0, 1.0], ["z"])).toPandas()
    both = out.merge(lifted, on="cell_id")
    assert np.allclose(both["value_y"] - both["value_x"], 100 + 10.0 * (both["cell_id"] % 4))
    with pytest.raises(ValueError, match="weathered"):
        simulate.prepare_domains(d, ["fresh_graphitic", "weathered_graphitic"], (10.0, 10.0, 10.0), 20.0, 5)


def test_scores_and_knots_by_group(spark):
    r = np.random.default_rng(8)
    rows = [(i, f"g{i % 4}", float(r.normal()) if i % 11 else None, float(r.random() + 0.2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double, w double")
    table = samples.score_table(df, "v", "w", "id", by=("g",))
    back = samples.interpolated(df.withColumn("v", F.col("v") * 1.5), "v", table, "value", "score", "s", by=("g",)).toPandas()
    assert len(back) == 300
    for g in ("g0", "g1", "g2", "g3"):
        one = {x["value"]: x["score"] for x in samples.score_table(df.filter(F.col("g") == g), "v", "w", "id").collect()}
        assert {x["value"]: x["score"] for x in table.filter(F.col("g") == g).collect()} == pytest.approx(one)
        own = back[(back["g"] == g) & back["v"].notna()]
        assert np.allclose(own["s"], np.interp(own["v"], sorted(one), [one[k] for k in sorted(one)]))
    none = samples.interpolated(df.filter("v IS NOT NULL"), "v", table.filter("g <> 'g1'"), "value", "score", "s", by=("g",))
    assert none.filter("(g = 'g1') <> (s IS NULL)").isEmpty()


def test_many_groups_are_compared(spark):
    # More than the 200 groups that were once refused.
    r = np.random.default_rng(5)
    rows = [(g, float(v)) for g in range(230) for v in r.integers(0, 12, 3)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(x["a"], x["b"]): x for x in samples.rank_sums(df, "v", "g").collect()}
    assert len(got) == 230 * 229 // 2
    by = {g: np.array([v for k, v in rows if k == g]) for g in range(230)}
    for a, b in list(got)[::97]:
        x, y = by[a], by[b]
        u = (x[:, None] > y[None]).sum() + (x[:, None] == y[None]).sum() / 2
        t = np.unique(np.concatenate([x, y]), return_counts=True)[1].astype(float)
        spread = math.sqrt(9 / 12 * (7 - (t**3 - t).sum() / 30))
        p = 1.0 if spread == 0 else min(1.0, math.erfc((abs(u - 4.5) - 0.5) / spread / math.sqrt(2)))
        assert got[a, b]["u"] == u and got[a, b]["p"] == pytest.approx(p) and got[a, b]["n_a"] == got[a, b]["n_b"] == 3
    k = samples.kruskal(df, "v", "g").first()
    v = np.array([x for _, x in rows])
    order = np.sort(v)
    rank = (np.searchsorted(order, v) + np.searchsorted(order, v, "right") + 1) / 2
    n = len(v)
    h = 12 / (n * (n + 1)) * sum(rank[3 * g : 3 * g + 3].sum() ** 2 / 3 for g in range(230)) - 3 * (n + 1)
    t = np.unique(v, return_counts=True)[1].astype(float)
    assert k["groups"] == 230 and k["h"] == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)))


def test_holm_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i, (i * 37 % 101 + 1) / 2000.0) for i in range(60)], "id long, p double")
    one = {r["id"]: r["adjusted"] for r in samples.adjusted(df).collect()}
    monkeypatch.setattr(samples, "FEW_ROWS", 10)
    assert {r["id"]: r["adjusted"] for r in samples.adjusted(df).collect()} == pytest.approx(one)


def test_pair_funnel_of_groups(spark):
    rows = points(40, 9)
    df = frame(spark, rows).withColumn("g", F.col("id") % 3)
    got = {(r["g"], r["direction"]): r for r in pairs.pair_funnel(df, 15.0, {"strike": tuple(AXES[0]), "normal": tuple(AXES[2])}, 30.0, least_distance=2.0, by=("g",)).collect()}
    for g in range(3):
        own = np.array([r[1:4] for r in rows if r[0] % 3 == g])
        for name, axis in (("strike", AXES[0]), ("normal", AXES[2])):
            d = np.array([b - a for a, b in itertools.combinations(own, 2)])
            h = np.sqrt((d**2).sum(1))
            d, h = d[(h < 15) & (h >= 2)], h[(h < 15) & (h >= 2)]
            angle = np.degrees(np.arccos(np.minimum(1, np.abs(d @ axis) / h)))
            r = got[g, name]
            assert (r["points"], r["possible"], r["within"], r["accepted"]) == (len(own), len(own) * (len(own) - 1) // 2, len(h), (angle <= 30).sum())
            assert r["angles"] == np.histogram(angle, np.arange(0, 95, 5))[0].tolist()
