"""Queries on validation: resampled holes, paired tests, subsets of an ensemble, held-out classes, plan patterns, envelopes and swaths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import covariance
from ..operators import ensemble, pairs, simulate, validate
from . import views
from .registry import query, r, rounded
from .views import with_views

INTERVALS, STACK, POINTS = with_views("intervals"), with_views("stack"), with_views("points")

_TIMES = "CASE " + " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(validate.POISSON)) + f" ELSE {len(validate.POISSON)} END"


def _logged(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of two kinds in each hole."""
    return views.intervals(spark, sf).withColumn("kind", F.when(F.col("event_id") % 3 == 0, "weathered").otherwise("fresh"))


@query("n1_cluster_bootstrap", f"{INTERVALS}, c AS (SELECT hole_id, coalesce(sum(grade) FILTER (event_id % 3 = 0), 0) AS sa, count(grade) FILTER (event_id % 3 = 0) AS na, coalesce(sum(grade) FILTER (event_id % 3 <> 0), 0) AS sb, count(grade) FILTER (event_id % 3 <> 0) AS nb FROM intervals GROUP BY 1), d AS (SELECT k, c.*, (CAST('0x' || substr(md5(hole_id || ':1337:' || k), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0 AS u FROM c, (SELECT unnest(range(0, 200)) AS k)), t AS (SELECT *, {_TIMES} AS n FROM d), m AS (SELECT k, sum(sa * n) / sum(na * n) - sum(sb * n) / sum(nb * n) AS d FROM t GROUP BY k HAVING sum(na * n) > 0 AND sum(nb * n) > 0) SELECT (SELECT count(*) FROM c) AS clusters, (SELECT round(sum(sa) / sum(na) - sum(sb) / sum(nb), 6) + 0e0 FROM c) AS difference, count(*) AS drawn, {r('quantile_cont(d, 0.025)', 'p025')}, {r('quantile_cont(d, 0.5)', 'p500')}, {r('quantile_cont(d, 0.975)', 'p975')} FROM m")
def n1_cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of means of two kinds of intervals, and its interval over resampled holes."""
    return rounded(validate.cluster_bootstrap(_logged(spark, sf), "grade", "kind", "hole_id", "weathered", "fresh", 200))


@query("n2_signed_ranks", f"{INTERVALS}, p AS (SELECT hole_id, avg(grade) FILTER (event_id % 3 = 0) - avg(grade) FILTER (event_id % 3 <> 0) AS d FROM intervals GROUP BY 1), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS rk FROM p WHERE d <> 0), t AS (SELECT sum(m * m * m - m) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM k GROUP BY abs(d))), s AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS wp, coalesce(sum(rk) FILTER (d < 0), 0) AS wm FROM k) SELECT n, (SELECT count(*) FROM p WHERE d = 0) AS zeros, {r('wp', 'w_plus')}, {r('wm', 'w_minus')}, {r('least(wp, wm)', 'statistic')}, {r('(wp - n * (n + 1) / 4e0) / sqrt(n * (n + 1e0) * (2 * n + 1) / 24 - ties / 48)', 'z')} FROM s, t")
def n2_signed_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Wilcoxon's test of the holes' differences between two kinds of intervals."""
    d = validate.paired_differences(_logged(spark, sf), "grade", "kind", "hole_id", "weathered", "fresh")
    return rounded(validate.signed_ranks(d).drop("p"))


_SIZES, _DRAWS = [2, 5, 10], 20


@query("n3_subset_convergence", f"""{STACK}, g AS (SELECT n, d, real_id, row_number() OVER (PARTITION BY n, d ORDER BY md5(n || ':' || d || ':' || real_id || ':20260706'), real_id) AS rank FROM (SELECT unnest({_SIZES}) AS n), (SELECT unnest(range(0, {_DRAWS})) AS d), (SELECT unnest(range(0, 10)) AS real_id)),
  s AS (SELECT n, d, cell_id, avg(CAST(value > 25 AS INT)) AS p, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS w FROM stack JOIN (SELECT * FROM g WHERE rank <= n) USING (real_id) GROUP BY ALL),
  a AS (SELECT cell_id, avg(CAST(value > 25 AS INT)) AS p, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS w FROM stack GROUP BY 1)
  SELECT CAST(n AS INT) AS size, CAST(d AS INT) AS draw, {r('avg(abs(s.p - a.p))', 'probability_mae')}, {r('corr(s.p, a.p)', 'probability_r')}, {r('avg(abs(s.w - a.w))', 'spread_mae')}, {r('corr(s.w, a.w)', 'spread_r')}, count(*) AS cells FROM s JOIN a USING (cell_id) GROUP BY ALL""")
def n3_subset_convergence(spark: SparkSession, sf: str) -> DataFrame:
    """Maps from 20 random subsets of each size against those from all realisations."""
    s = views.stack(spark, sf).withColumn("value", F.col("value").cast("double"))
    return rounded(validate.subset_convergence(s, 10, _SIZES, _DRAWS, 25.0))


_CLASSES = [0, 1, 2]
_NEAR = "f AS (SELECT id, x, y, z, label % 3 AS c, id % 5 AS fold FROM points), n AS (SELECT t.id, s.c, row_number() OVER (PARTITION BY t.id ORDER BY sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z)), s.id) AS k, sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z)) AS h FROM f t JOIN f s ON t.fold <> s.fold WHERE h <= 0.15e0)"
_PRIORS = "pr AS (SELECT a.fold, " + ", ".join(f"avg(CAST(b.c = {c} AS INT)) AS p{c}" for c in _CLASSES) + " FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY 1)"
_RAW = "w AS (SELECT id, min(h) AS near, " + ", ".join(f"sum(CASE WHEN c = {c} THEN 1 / greatest(h, 1e-6) END) AS w{c}" for c in _CLASSES) + " FROM n WHERE k <= 8 GROUP BY 1)"
_SHARES = f"{_NEAR}, {_PRIORS}, {_RAW}, q AS (SELECT f.id, f.c, f.fold, near IS NOT NULL AS supported, coalesce(w0 + p0 * 2, 0) + coalesce(near / 0.15e0 * 2, 1) AS r0, coalesce(w1 + p1 * 2, 0) AS r1, coalesce(w2 + p2 * 2, 0) AS r2 FROM f JOIN pr USING (fold) LEFT JOIN w ON f.id = w.id), sh AS (SELECT *, r0 / (r0 + r1 + r2) AS s0, r1 / (r0 + r1 + r2) AS s1, r2 / (r0 + r1 + r2) AS s2, CASE WHEN r0 >= greatest(r0, r1, r2) THEN 0 WHEN r1 >= greatest(r0, r1, r2) THEN 1 ELSE 2 END AS g FROM q)"


def _held_out(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of three classes at points whose own fold of holes is left out."""
    p = views.points(spark, sf).withColumn("label", F.col("label") % 3).withColumn("fold", F.col("id") % 5)
    shares = pairs.local_shares(p, p, 0.15, 8, 2.0, 0, _CLASSES, apart="fold")
    x = p.select("id", "label", "fold").join(shares, F.col("id") == F.col("target")).drop("target")
    return validate.with_guess(x, _CLASSES).withColumns({"p": 1 - F.col("share_0"), "hit": F.col("label") != 0})


@query("n4_held_out_shares", f"{POINTS}, {_SHARES} SELECT id, fold, c AS label, supported, {r('s0', 'share_0')}, {r('s1', 'share_1')}, {r('s2', 'share_2')}, CAST(g AS INT) AS guess FROM sh")
def n4_held_out_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_held_out(spark, sf).select("id", "fold", "label", "supported", "share_0", "share_1", "share_2", "guess"))


@query("n4_multiclass", f"{POINTS}, {_SHARES}, k AS (SELECT u AS cls, count(*) FILTER (c = u) AS t, count(*) FILTER (g = u) AS s, count(*) FILTER (c = u AND g = u) AS h, supported FROM sh, (SELECT unnest([0, 1, 2]) AS u) GROUP BY u, supported) SELECT sh.supported, count(*) AS n, {r('avg(CAST(c = g AS INT))', 'accuracy')}, (SELECT round(avg(2e0 * h / (t + s)) FILTER (t + s > 0), 6) + 0e0 FROM k WHERE k.supported = sh.supported) AS macro_f1, (SELECT round(avg(h / t) FILTER (t > 0), 6) + 0e0 FROM k WHERE k.supported = sh.supported) AS balanced_accuracy, {r('avg(-ln(greatest([s0, s1, s2][c + 1], 1e-15)))', 'log_loss')} FROM sh GROUP BY sh.supported")
def n4_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy and log loss with and without a neighbour in other folds."""
    return rounded(validate.multiclass_summary(_held_out(spark, sf), _CLASSES, by=["supported"]))


@query("n4_class_scores", f"{POINTS}, {_SHARES} SELECT u AS class, count(*) FILTER (c = u) AS support, {r('coalesce(count(*) FILTER (c = u AND g = u) / nullif(count(*) FILTER (g = u), 0), 0)', 'precision')}, {r('count(*) FILTER (c = u AND g = u) / nullif(count(*) FILTER (c = u), 0)', 'recall')}, {r('2e0 * count(*) FILTER (c = u AND g = u) / (count(*) FILTER (c = u) + count(*) FILTER (g = u))', 'f1')} FROM sh, (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS u) GROUP BY u HAVING count(*) FILTER (c = u) + count(*) FILTER (g = u) > 0")
def n4_class_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.class_scores(validate.confusion(_held_out(spark, sf).withColumn("guess", F.col("guess").cast("long")))))


@query("n4_one_against_rest", f"{POINTS}, {_SHARES}, e AS (SELECT u, c = u AS hit, [s0, s1, s2][u + 1] AS s FROM sh, (SELECT unnest([0, 1, 2]) AS u)), x AS (SELECT u, hit, rank() OVER (PARTITION BY u ORDER BY round(s, 12)) + (count(*) OVER (PARTITION BY u, round(s, 12)) - 1) / 2e0 AS rk FROM e) SELECT CAST(u AS INT) AS class, count(*) AS n, count(*) FILTER (hit) AS hits, {r('(sum(rk) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2e0) / nullif(count(*) FILTER (hit), 0) / nullif(count(*) FILTER (NOT hit), 0)', 'auc')} FROM x GROUP BY u")
def n4_one_against_rest(spark: SparkSession, sf: str) -> DataFrame:
    x = _held_out(spark, sf)
    return rounded(validate.one_against_rest(x.withColumns({f"share_{c}": F.round(f"share_{c}", 12) for c in _CLASSES}), _CLASSES))


@query("n4_reliability", f"{POINTS}, {_SHARES} SELECT least(CAST(floor((1 - s0) * 10) AS INT), 9) AS bin, count(*) AS n, {r('avg(1 - s0)', 'mean_p')}, {r('avg(CAST(c <> 0 AS INT))', 'observed')} FROM sh GROUP BY 1")
def n4_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.reliability(_held_out(spark, sf), "p", "hit"))


@query("n4_brier", f"{POINTS}, {_SHARES}, b AS (SELECT a.fold, avg(CAST(o.c <> 0 AS INT)) AS prior FROM (SELECT DISTINCT fold FROM f) a JOIN f o ON a.fold <> o.fold GROUP BY 1), e AS (SELECT count(*) AS n, avg(((1 - s0) - CAST(c <> 0 AS INT)) ** 2) AS brier, avg((prior - CAST(c <> 0 AS INT)) ** 2) AS reference FROM sh JOIN b USING (fold)) SELECT n, {r('brier', 'brier')}, {r('reference', 'reference')}, {r('1 - brier / reference', 'skill')} FROM e")
def n4_brier(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score of ore against waste, and its skill over each fold's training share."""
    return rounded(validate.brier(_held_out(spark, sf), "p", "hit"))


_PLAN = "pc AS (SELECT ix, iy, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS spread, avg(CAST(value > 20 AS INT)) AS probability, min(abs(value - 25)) * 100 AS distance, count(DISTINCT iz) * 2e0 AS occupied FROM stack WHERE (ix * 7 + iy * 3) % 11 > 0 GROUP BY ALL), pe AS (SELECT p.ix, p.iy, count(q.ix) < 8 AS edge FROM pc p LEFT JOIN pc q ON abs(p.ix - q.ix) <= 1 AND abs(p.iy - q.iy) <= 1 AND (p.ix <> q.ix OR p.iy <> q.iy) GROUP BY ALL), pl AS (SELECT pc.*, edge, spread >= (SELECT quantile_cont(spread, 0.9) FROM pc) AS high_spread, probability >= 0.6 AS persistent FROM pc JOIN pe USING (ix, iy))"


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    s = views.stack(spark, sf).filter((F.col("ix") * 7 + F.col("iy") * 3) % 11 > 0)
    marks = [F.percentile("value", F.lit(p)) for p in (0.9, 0.1)]
    x = s.groupBy("ix", "iy").agg((marks[0] - marks[1]).alias("spread"), F.avg((F.col("value") > 20).cast("double")).alias("probability"), (F.min(F.abs(F.col("value") - 25)) * 100).alias("distance"), (F.count_distinct("iz") * F.lit(2.0)).alias("occupied"))
    return validate.plan_classes(x, 0.9, 0.6)


@query("n5_plan_classes", f"{STACK}, {_PLAN} SELECT ix, iy, {r('spread', 'spread')}, {r('probability', 'probability')}, edge, high_spread, persistent FROM pl")
def n5_plan_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Plan columns of high spread, of persistent occupancy, and on the footprint's edge."""
    return rounded(_plan(spark, sf).select("ix", "iy", "spread", "probability", "edge", "high_spread", "persistent"))


@query("n5_plan_summary", f"{STACK}, {_PLAN}, e AS (SELECT min(iy) AS lo, max(iy) AS hi, count(*) AS n FROM pc), k AS (SELECT unnest(['all', CASE WHEN high_spread THEN 'high_spread' END, CASE WHEN persistent THEN 'persistent' END, CASE WHEN high_spread AND persistent THEN 'both' END]) AS class, * FROM pl) SELECT class, count(*) AS columns, {r('100 * count(*) / any_value(n)', 'pct')}, {r('median(distance)', 'median_distance')}, {r('100 * avg(CAST(distance > 100 AS INT))', 'far_pct')}, {r('100 * avg(CAST(edge AS INT))', 'edge_pct')}, {r('100 * avg(CAST(least(CAST(floor(3 * (iy - lo) / (hi - lo + 1)) AS INT), 2) = 1 AS INT))', 'middle_pct')}, {r('avg(occupied)', 'mean_occupied')} FROM k, e WHERE class IS NOT NULL GROUP BY class")
def n5_plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validate.plan_summary(_plan(spark, sf), "distance", 100.0, "occupied"))


_ENVELOPE = "fi AS (SELECT p_partkey % 20 AS ix, p_partkey // 20 % 20 AS iy, p_partkey // 400 AS iz FROM part WHERE p_size > 15), fs AS (SELECT ix // 2 AS ix, iy // 2 AS iy, iz, count(*) / 4e0 AS share FROM (SELECT DISTINCT * FROM fi) GROUP BY ALL), co AS (SELECT real_id, ix // 2 AS ix, iy // 2 AS iy, iz, avg(value) AS value FROM stack GROUP BY ALL)"


@query("n6_envelope_means", f"{STACK}, {_ENVELOPE} SELECT real_id, {r('avg(value)', 'whole_mean')}, {r('avg(value) FILTER (share > 0)', 'any_mean')}, {r('sum(value * share) / sum(share)', 'share_mean')}, {r('avg(value) FILTER (share >= 1)', 'core_mean')} FROM co LEFT JOIN fs USING (ix, iy, iz) GROUP BY real_id")
def n6_envelope_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means by realisation over the grid, and within an envelope by any part, by share and by whole cells."""
    k = F.col("p_partkey")
    fine = spark.read.parquet(f"{sf}/part.parquet").filter("p_size > 15").select((k % 20).alias("ix"), (F.floor(k / 20) % 20).alias("iy"), F.floor(k / 400).alias("iz"))
    coarse = ensemble.regularise(views.stack(spark, sf), 2, 2, 1).withColumnsRenamed({"bix": "ix", "biy": "iy", "biz": "iz"})
    return rounded(validate.envelope_means(coarse, validate.envelope_shares(fine, (2, 2, 1))))


_AXES = dict(zip(simulate.AXES, map(tuple, covariance.basis(30.0, 40.0).tolist()), strict=True))
_AXIS_ROWS = ", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for n, (a, b, c) in _AXES.items())


@query("n7_axis_swaths", f"""{with_views('stack', 'blocks')}, ax AS (SELECT * FROM (VALUES {_AXIS_ROWS}) AS v(axis, a, b, c)),
  ce AS (SELECT real_id, value, axis, ix * 12.5e0 * a + iy * 12.5e0 * b + iz * 2.5e0 * c AS t FROM stack, ax), ob AS (SELECT grade, axis, x * a + y * b + z * c AS t FROM blocks, ax WHERE block_id % 3 = 0),
  en AS (SELECT axis, min(t) AS lo, max(t) AS hi FROM ce GROUP BY 1), cb AS (SELECT ce.axis, real_id, value, least(CAST(floor((t - lo) / (hi - lo) * 10) AS INT), 9) AS bin FROM ce JOIN en USING (axis)),
  sb AS (SELECT axis, least(CAST(floor((t - lo) / (hi - lo) * 10) AS INT), 9) AS bin, count(*) AS samples, avg(grade) AS m FROM ob JOIN en USING (axis) WHERE t BETWEEN lo AND hi GROUP BY ALL),
  m AS (SELECT axis, bin, real_id, avg(value) AS m FROM cb GROUP BY ALL), q AS (SELECT axis, bin, quantile_cont(m, 0.1) AS p10, quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.9) AS p90 FROM m GROUP BY ALL)
  SELECT q.axis, q.bin, coalesce(samples, 0) AS samples, CASE WHEN samples >= 5 THEN round(sb.m, 6) + 0e0 END AS observed, {r('p10', 'p10')}, {r('p50', 'p50')}, {r('p90', 'p90')} FROM q LEFT JOIN sb USING (axis, bin)""")
def n7_axis_swaths(spark: SparkSession, sf: str) -> DataFrame:
    """Ten bins along strike, dip and normal: every third block's grade against the realisations' means."""
    cells = views.stack(spark, sf).select("real_id", (F.col("ix") * 12.5).alias("x"), (F.col("iy") * 12.5).alias("y"), (F.col("iz") * 2.5).alias("z"), "value")
    seen = views.blocks(spark, sf).filter("block_id % 3 = 0").select("x", "y", "z", F.col("grade").alias("value"))
    return rounded(validate.axis_swaths(cells, seen, _AXES))


@query("e1_search_ellipsoid", f"{POINTS}, u AS (SELECT id, label % 3 AS c, {', '.join(f'(x * {a!r}::DOUBLE + y * {b!r}::DOUBLE + z * {c!r}::DOUBLE) / {s!r}::DOUBLE AS {n}' for n, (a, b, c), s in zip('xyz', _AXES.values(), (0.25, 0.2, 0.12), strict=True))} FROM points), h AS (SELECT t.id, s.id AS sid, s.c, sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z)) AS h FROM u t JOIN u s ON t.id % 10 = 0 AND s.id % 10 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h, sid) AS rank FROM h WHERE h <= 1), w AS (SELECT id, {', '.join(f'sum(CASE WHEN c = {c} THEN 1 / greatest(h, 1e-6) END) AS w{c}' for c in _CLASSES)} FROM k WHERE rank <= 6 GROUP BY 1), pr AS (SELECT {', '.join(f'avg(CAST(c = {c} AS INT)) AS p{c}' for c in _CLASSES)} FROM u WHERE id % 10 <> 0), e AS (SELECT u.id, {', '.join(f'CASE WHEN w.id IS NULL THEN 1 ELSE coalesce(w{c} + p{c} * 2, 0) END AS r{c}' for c in _CLASSES)} FROM u CROSS JOIN pr LEFT JOIN w ON u.id = w.id WHERE u.id % 10 = 0) SELECT id AS target, {', '.join(r(f'r{c} / (r0 + r1 + r2)', f'share_{c}', 5) for c in _CLASSES)} FROM e")
def e1_search_ellipsoid(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of three classes without a waste class, from neighbours within a turned ellipsoid."""
    space = pairs.search_space(views.points(spark, sf).withColumn("label", F.col("label") % 3), (0.25, 0.2, 0.12), tuple(_AXES.values()))
    return rounded(pairs.local_shares(space.filter("id % 10 = 0"), space.filter("id % 10 <> 0"), 1.0, 6, 2.0, None, _CLASSES), 5)
