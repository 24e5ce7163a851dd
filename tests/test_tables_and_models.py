"""Summary tables, guards of models, documents of any length, nearest samples far away."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.functions.covariance import Model
from orebed.operators import intervals, order, pairs, reports, simulate, tabulate, validate
from orebed.operators.grid import Grid


def test_guards_of_models():
    assert Model("exponential", 0.2, 0.05).guarded() == Model("exponential", 0.2, 1.0)
    assert Model("exponential", 0.1, 0.3).guarded().sill == pytest.approx(1.0) and Model("exponential", 0.1, 0.3).guarded().nugget == pytest.approx(0.25)
    assert Model("exponential", 0.3, 0.7).guarded() == Model("exponential", 0.3, 0.7)
    m = Model(reach=100.0, ratios=(1.0, 2.0, 4.0))
    assert m.bounded(150, 300).ranges() == (150.0, 75.0, 37.5) and m.bounded(target=80.0).reach == 80.0 and m.bounded().reach == 100.0
    assert m.tuned(2.0).nugget == pytest.approx(0.95) and m.tuned(-1.0).nugget == 0.0


def test_warnings_of_models(spark):
    rows = simulate.model_rows(spark, {"fine": Model(reach=300.0), "short": Model(reach=5.0), "long": Model(reach=50_000.0), "noisy": Model("exponential", 0.9, 0.1, 300.0), "flat": Model("exponential", 0.005, 0.009, 300.0)})
    got = {tuple(r) for r in simulate.model_warnings(rows, Grid((0.0, 0.0, 0.0), (25.0, 25.0, 2.0), (52, 184, 135))).collect()}
    assert got == {("short", "range is very small for the grid"), ("short", "error: range is unrealistic"), ("long", "range is extremely large for the grid"), ("long", "error: range is unrealistic"), ("noisy", "nugget effect is high"), ("flat", "variance is very small")}


def test_long_lists_of_documents(spark, monkeypatch):
    # More rows than a section holds, equal ones among them: none is left out.
    monkeypatch.setattr(reports, "SECTION_ROWS", 10)
    df = spark.createDataFrame([((i * 7) % 23, "x") for i in range(37)], "a int, b string").repartition(4)
    got = dict(reports.document({}, {"all": df, "few": df.limit(10)}).collect())
    assert sorted(got) == ["all", "all.2", "all.3", "all.4", "few"]
    rows = [r["a"] for n in ("all", "all.2", "all.3", "all.4") for r in json.loads(got[n])]
    assert rows == sorted((i * 7) % 23 for i in range(37)) and len(json.loads(got["all"])) == 10


@pytest.mark.parametrize("crowd", [1, 400])
def test_nearest_of_far_targets(spark, crowd):
    r = np.random.default_rng(crowd)
    s = np.concatenate([r.normal(0, 1, (300, 3)), r.normal(50, 0.001, (crowd, 3)), np.tile([[7.0, 7.0, 7.0]], (70, 1))])
    t = np.concatenate([r.normal(0, 300, (40, 3)), r.normal(0, 1, (5, 3)), [[1e6, 0, 0], [7.0, 7.0, 900.0]]])
    samples = spark.createDataFrame([(i, *map(float, p), i % 9) for i, p in enumerate(s)], "id int, x double, y double, z double, label int")
    targets = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(t)], "id int, x double, y double, z double")
    got = {x["target"]: (x["label"], x["distance"]) for x in pairs.nearest_anywhere(targets, samples, 0.5).collect()}
    assert len(got) == len(t)
    for i, p in enumerate(t):
        d = np.sqrt(((s - p) ** 2).sum(1))
        k = int(np.lexsort((np.arange(len(s)), d))[0])
        assert got[i][1] == pytest.approx(d[k]) and (got[i][0] == k % 9 or abs(np.sort(d)[1] - d[k]) < 1e-9)


def test_running_sums_by_group(spark):
    r = np.random.default_rng(3)
    rows = [(f"g{i % 3}" if i % 17 else None, int(v), float(w)) for i, (v, w) in enumerate(zip(r.permutation(200), r.normal(size=200), strict=True))]
    df = spark.createDataFrame(rows, "g string, v int, w double").repartition(5)
    for inclusive in (True, False):
        got = {(x["g"], x["v"]): (x["s"], x["s_total"]) for x in order.running_by(df, ["g"], ["v"], {"s": F.col("w")}, inclusive).collect()}
        for g in ("g0", "g1", "g2", None):
            own = sorted((v, w) for k, v, w in rows if k == g)
            total = 0.0
            for v, w in own:
                assert got[g, v] == (pytest.approx(total + w if inclusive else total, abs=1e-9), pytest.approx(sum(x for _, x in own), abs=1e-9))
                total += w


def test_resampled_holes(spark):
    r = np.random.default_rng(6)
    rows = [(f"H{i % 9}", "ab"[int(r.integers(0, 2))], float(r.normal())) for i in range(120)] + [("H0", "a", None), (None, "a", 5.0), ("H1", "c", 99.0)]
    df = spark.createDataFrame(rows, "hole string, kind string, v double")
    got = validate.cluster_bootstrap(df, "v", "kind", "hole", "a", "b", 300, 7).first()
    import hashlib

    real = [x for x in rows if x[0] and x[2] is not None and x[1] in "ab"]
    draws = []
    for k in range(300):
        times = {h: np.searchsorted(validate.POISSON, (int(hashlib.md5(f"{h}:7:{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32, "right") for h in {x[0] for x in real}}
        a, b = ([(x[2], times[x[0]]) for x in real if x[1] == g and times[x[0]]] for g in "ab")
        if a and b:
            draws.append(np.average([v for v, _ in a], weights=[n for _, n in a]) - np.average([v for v, _ in b], weights=[n for _, n in b]))
    assert got["drawn"] == len(draws) and got["clusters"] == 9
    assert (got["p025"], got["p500"], got["p975"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.5, 0.975])))
    none = validate.cluster_bootstrap(df.limit(0), "v", "kind", "hole", "a", "b", 10).first()
    assert none["drawn"] == 0 and none["difference"] is None and none["p500"] is None


def test_signed_ranks(spark):
    import math

    d = [1.5, -0.5, 2.0, 2.0, -2.0, 0.0, 3.0, 0.5, 0.5, 4.0, None, float("nan")]
    got = validate.signed_ranks(spark.createDataFrame([(x,) for x in d], "difference double")).first()
    # Ranks by hand: 0.5 thrice (2), 1.5 (4), 2 thrice (6), 3 (8), 4 (9).
    assert (got["n"], got["zeros"], got["w_plus"], got["w_minus"], got["statistic"]) == (9, 1, 4 + 6 + 6 + 8 + 2 + 2 + 9, 2 + 6, 8.0)
    z = (37 - 22.5) / math.sqrt(9 * 10 * 19 / 24 - (24 + 24) / 48)
    assert got["z"] == pytest.approx(z) and got["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    none = validate.signed_ranks(spark.createDataFrame([(0.0,)], "difference double")).first()
    assert (none["n"], none["zeros"], none["z"], none["p"]) == (0, 1, None, None)
    pairs_ = spark.createDataFrame([("H1", "a", 3.0), ("H1", "a", 5.0), ("H1", "b", 1.0), ("H2", "a", 1.0)], "hole string, kind string, v double")
    assert [tuple(r) for r in validate.paired_differences(pairs_, "v", "kind", "hole", "a", "b").collect()] == [("H1", 4.0, 1.0, 3.0)]


def test_subsets_of_an_ensemble(spark):
    r = np.random.default_rng(2)
    v = r.normal(25, 5, (8, 60))
    v[3, 5] = v[6, 5] = np.nan
    v[:, 9] = np.nan
    df = spark.createDataFrame([(k, c, None if np.isnan(v[k, c]) else float(v[k, c])) for k in range(8) for c in range(60) if (k, c) != (2, 7)], "real_id int, cell_id int, value double")
    v[2, 7] = np.nan
    got = {(x["size"], x["draw"]): x for x in validate.subset_convergence(df.repartition(3), 8, [1, 3, 8], 5, 26.0, 9).collect()}
    members = validate.subset_members(8, [1, 3, 8], 5, 9)
    assert len(got) == 15 and all(len(set(m)) == n for (n, _), m in members.items())
    with np.errstate(all="ignore"):
        import warnings

        warnings.simplefilter("ignore")
        maps = lambda x: (np.where(np.isfinite(x).any(0), np.nansum(x > 26, 0) / np.maximum(np.isfinite(x).sum(0), 1), np.nan), np.nanquantile(x, 0.9, axis=0) - np.nanquantile(x, 0.1, axis=0))
        whole = maps(v)
        for key, m in members.items():
            for name, one, every in zip(("probability", "spread"), maps(v[m]), whole, strict=True):
                ok = np.isfinite(one) & np.isfinite(every)
                assert got[key][f"{name}_mae"] == pytest.approx(np.abs(one - every)[ok].mean(), abs=1e-9)
                if np.std(one[ok]) > 1e-6:
                    assert got[key][f"{name}_r"] == pytest.approx(np.corrcoef(one[ok], every[ok])[0, 1])
    assert got[8, 0]["spread_r"] == pytest.approx(1.0) and got[1, 0]["spread_r"] is None


def test_plan_edges_and_tables(spark):
    cells = {(i, j) for i in range(6) for j in range(5)} - {(2, 2)}
    df = spark.createDataFrame([(*c, 1.0) for c in cells], "ix int, iy int, v double")
    got = {(r["ix"], r["iy"]): r["edge"] for r in validate.footprint_edge(df).collect()}
    assert got == {c: any((c[0] + i, c[1] + j) not in cells for i in (-1, 0, 1) for j in (-1, 0, 1)) for c in cells}
    x = spark.createDataFrame([("a", "1.5"), ("a", "x"), ("b", None)], "s string, v string")
    assert {r["s"]: (r["n"], r["v"]) for r in tabulate.means_by_state(x, "s", ["v"]).collect()} == {"a": (2, 1.5), "b": (1, None)}
    assert tabulate.association(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()["r"] is None
    best = spark.createDataFrame([("f", "m", 1.0), ("f", "a", 1.0), ("f", "n", float("nan")), ("g", "m", None)], "family string, method string, e double")
    assert [tuple(r) for r in tabulate.best_method(best, "family", "method", "e").collect()] == [("f", "a", 1.0)]
    spans = spark.createDataFrame([("H", 0.0, 5.0, "L")], "hole_id string, from_m double, to_m double, code string")
    points = spark.createDataFrame([(1, "H", 1.0, "own"), (2, "H", 7.0, "own"), (3, "H", 8.0, " nan "), (4, "G", 1.0, None)], "point_id int, hole_id string, mid double, own string")
    assert {r["point_id"]: r["code"] for r in intervals.stab(points, spans, "code", own="own", unknown="UNKNOWN").collect()} == {1: "L", 2: "own", 3: "UNKNOWN", 4: "UNKNOWN"}


def test_class_tables_of_odd_rows(spark):
    rows = [(0, 1.0, 0.0, 0), (1, 0.5, 0.5, 0), (1, 0.0, 1.0, 1), (0, 0.2, 0.8, 1)]
    df = spark.createDataFrame(rows, "label int, share_0 double, share_1 double, fold int").withColumn("share_2", F.lit(0.0))
    x = validate.with_guess(df, [0, 1])
    assert [r["guess"] for r in x.collect()] == [0, 0, 1, 1]
    one = validate.multiclass_summary(x, [0, 1, 2]).first()
    assert (one["accuracy"], one["macro_f1"], one["balanced_accuracy"]) == (0.5, 0.5, 0.5)
    assert one["log_loss"] == pytest.approx(-np.mean(np.log([1.0, 0.5, 1.0, 0.2])))
    auc = {r["class"]: r["auc"] for r in validate.one_against_rest(x, [0, 1, 2]).collect()}
    assert auc[0] == pytest.approx(0.75) and auc[1] == pytest.approx(0.75) and auc[2] is None
    bins = {r["bin"]: (r["n"], r["observed"]) for r in validate.reliability(x, "share_1", "label").collect()}
    assert bins == {0: (1, 0.0), 5: (1, 1.0), 8: (1, 0.0), 9: (1, 1.0)}
    b = validate.brier(x.withColumn("hit", F.col("label") == 1), "share_1", "hit").first()
    assert b["brier"] == pytest.approx((0 + 0.25 + 0 + 0.64) / 4) and b["reference"] == pytest.approx(0.25) and b["skill"] == pytest.approx(1 - 0.2225 / 0.25)
    assert validate.multiclass_summary(x.limit(0), [0, 1]).first()["accuracy"] is None
