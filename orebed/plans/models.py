"""Queries on transforms, fitted models, simulation kernels and text audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import covariance
from ..functions.scalar import inverse_normal_sql
from ..operators import compare, ensemble, pairs, samples, screen, simulate, tabulate
from ..operators.grid import Grid
from ..sources.scratch import stored
from . import views
from .registry import query, r, rounded
from .views import with_views

POINTS = with_views("points")
SEARCH = simulate.Search((0.15, 0.15, 0.15), k=8)
MODEL = covariance.Model("exponential", 0.2, 0.8, 0.1)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return samples.normal_scores(views.points(spark, sf), "value")


@query("m2_m3_round_trip", f"{POINTS} SELECT id, {r('value', 'back')} FROM points")
def m2_m3_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """To normal scores and back again by interpolation in the table."""
    p = views.points(spark, sf)
    knots = samples.score_table(p, "value")
    there = samples.interpolated(p, "value", knots, "value", "score", "score")
    return rounded(samples.interpolated(there, "score", knots, "score", "value", "back").select("id", "back"))


@query("m5_m6_detrended", f"{POINTS}, f AS (SELECT regr_slope(value, z) AS s, regr_intercept(value, z) AS i FROM points) SELECT id, {r('value - (i + s * z)', 'residual', 5)} FROM points, f")
def m5_m6_detrended(spark: SparkSession, sf: str) -> DataFrame:
    p = views.points(spark, sf)
    i, s = simulate.least_squares(p, "value", ["z"])
    return rounded(p.select("id", (F.col("value") - (i + s * F.col("z"))).alias("residual")), 5)


@query("m5_m7_trend_round_trip", f"{POINTS} SELECT id, {r('value', 'back', 5)} FROM points")
def m5_m7_trend_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Trend taken off, residuals to normal scores and back again, and the trend put on again."""
    p = views.points(spark, sf)
    trend = simulate.least_squares(p, "value", ["z"])
    left = simulate.with_trend(p, [-c for c in trend], ["z"])
    knots = samples.score_table(left, "value")
    scores = samples.interpolated(left, "value", knots, "value", "score", "score").drop("value")
    back = samples.interpolated(scores, "score", knots, "score", "value", "value")
    return rounded(simulate.with_trend(back, trend, ["z"]).select("id", F.col("value").alias("back")), 5)


_MARKS = ", ".join(f"{k / 1000}" for k in range(1001))


@query(
    "m8_w9_quantile_map",
    f"""{with_views('points', 'blocks')}, k AS (SELECT generate_series AS k FROM generate_series(0, 1000)),
  a AS (SELECT quantile_cont(value, [{_MARKS}]) AS qs FROM points), b AS (SELECT quantile_cont(grade, [{_MARKS}]) AS qs FROM blocks),
  q AS (SELECT k, max(x - k * 1e-8) OVER w + k * 1e-8 AS qx, max(y - k * 1e-8) OVER w + k * 1e-8 AS qy FROM (SELECT k, a.qs[k + 1] AS x, b.qs[k + 1] AS y FROM k, a, b) WINDOW w AS (ORDER BY k)),
  s AS (SELECT *, lead(qx) OVER (ORDER BY k) AS nx, lead(qy) OVER (ORDER BY k) AS ny FROM q)
  SELECT id, {r('value', 'value', 4)}, {r('CASE WHEN nx IS NULL THEN qy ELSE qy + (value - qx) * (ny - qy) / (nx - qx) END', 'mapped', 4)} FROM points ASOF JOIN s ON value + 1e-12 >= qx""",
)
def m8_w9_quantile_map(spark: SparkSession, sf: str) -> DataFrame:
    """Points' values at their own quantiles of the blocks' grades."""
    return rounded(samples.quantile_map(views.points(spark, sf), "value", views.blocks(spark, sf), "grade").select("id", "value", "mapped"), 4)


@query("m12_m15_fitted_models")
def m12_m15_fitted_models(spark: SparkSession, sf: str) -> DataFrame:
    """Model of raw and of logarithmic values, and the share of their nuggets."""
    p = views.points(spark, sf).withColumn("log_value", F.log1p(F.greatest("value", F.lit(0.0))))
    out = []
    for name in ("value", "log_value"):
        v = sorted(pairs.variogram(p, 0.3, 8, {"all": (1.0, 0.0, 0.0)}, 90.0, value=name).collect(), key=lambda x: x["lag"])
        m = covariance.fit([x["distance"] for x in v], [x["gamma"] for x in v])
        out.append((name, m.kind, m.nugget, m.variance, m.reach, m.nugget / m.sill))
    return spark.createDataFrame(out, "variable string, kind string, nugget double, variance double, reach double, nugget_ratio double")


GRID = Grid((-0.2, -0.2, -0.2), (0.1, 0.1, 0.1), (5, 5, 5))


def _cells(spark: SparkSession, n_real: int) -> DataFrame:
    return GRID.cells(spark).withColumn("real_id", F.explode(F.sequence(F.lit(0), F.lit(n_real - 1))))


@query("e6_e7_simulation")
def e6_e7_simulation(spark: SparkSession, sf: str) -> DataFrame:
    """Five realisations of a small grid, summarised by cell."""
    cells = _cells(spark, 5).withColumn("domain", F.lit(0))
    s = scored(spark, sf).withColumn("domain", F.lit(0))
    out = simulate.simulate(cells, s, {0: MODEL}, SEARCH, 1337)
    return ensemble.cell_percentiles(out.join(cells.select("real_id", "cell_id", "ix", "iy", "iz"), ["real_id", "cell_id"]))


@query("e7_neighbourhoods")
def e7_neighbourhoods(spark: SparkSession, sf: str) -> DataFrame:
    """How many neighbours the simulated nodes had, by realisation."""
    cells = _cells(spark, 3).withColumn("domain", F.lit(0))
    s = scored(spark, sf).withColumn("domain", F.lit(0))
    return simulate.neighbourhoods(simulate.simulate(cells, s, {0: MODEL}, SEARCH, 1337), 3)


@query("e8_conditional_fields")
def e8_conditional_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Five random fields that honour the points' scores, on a small grid."""
    return simulate.conditional_fields(GRID.cells(spark), scored(spark, sf), MODEL, SEARCH, 5, 1337)


ORIENTATION = simulate.Orientation(30.0, 40.0, tolerance=30.0)
DOMAINS = ["fresh_graphitic", "host_waste"]


def prepared(spark: SparkSession, sf: str, orientation: simulate.Orientation | None = None) -> simulate.Prepared:
    p = views.points(spark, sf).withColumn("lith_code", F.when(F.col("label") % 2 == 0, "QV").otherwise("GRSC4"))
    return simulate.prepare_domains(samples.with_domains(p, "value"), DOMAINS, (0.2, 0.2, 0.2), 0.3, 8, orientation=orientation)


@query("e9_cascade")
def e9_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Each domain of each realisation by its own samples, scores and directional model, then put together."""
    cells = _cells(spark, 3).withColumn("domain", (F.pmod(F.col("ix") + F.col("real_id"), F.lit(2))).cast("int"))
    out = simulate.require_complete(simulate.cascade(prepared(spark, sf, ORIENTATION), cells, SEARCH, 1337), cells)
    return out.groupBy("real_id", "domain").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


@query("m14_directional_models")
def m14_directional_models(spark: SparkSession, sf: str) -> DataFrame:
    """Nugget, sill, ranges along strike, dip and normal, and their ratios, by domain."""
    out = []
    for k, m in sorted(prepared(spark, sf, ORIENTATION).models.items()):
        ranges = dict(zip(simulate.AXES, m.ranges(), strict=True))
        reach, (dip, normal) = covariance.anisotropy(ranges)
        out.append((DOMAINS[k], m.nugget, m.variance, reach, dip, normal, *ranges.values()))
    return spark.createDataFrame(out, "domain string, nugget double, variance double, reach double, strike_over_dip double, strike_over_normal double, strike double, dip double, normal double")


_AXIS_SQL = "list_sum(list_transform(range(1, 4), lambda i: [b.x - a.x, b.y - a.y, b.z - a.z][i] * d.axis[i]))"


def _directions_sql() -> str:
    rows = [f"('{n}', [{', '.join(f'{v!r}e0' if 'e' not in repr(v) else repr(v) for v in a)}], {30})" for n, a in zip(simulate.AXES, ORIENTATION.axes.tolist(), strict=True)]
    return f"d AS (SELECT * FROM (VALUES ('all', [1e0, 0e0, 0e0], 90), {', '.join(rows)}) AS t(direction, axis, degrees))"


@query("g1_m14_directional_variograms", f"{POINTS}, {_directions_sql()}, p AS (SELECT *, label % 2 AS half FROM points), q AS (SELECT a.half, a.value AS va, b.value AS vb, d.direction, d.degrees, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS h, {_AXIS_SQL} AS dot FROM p a JOIN p b ON a.id < b.id AND a.half = b.half, d) SELECT half, direction, CAST(floor(h / 0.0375e0) AS INT) AS lag, count(*) AS pairs, {r('avg(h)', 'distance')}, {r('avg((va - vb) * (va - vb) / 2)', 'gamma')} FROM q WHERE h < 0.3e0 AND h > 0 AND (degrees >= 90 OR abs(dot) / h >= cos(radians(degrees))) GROUP BY ALL")
def g1_m14_directional_variograms(spark: SparkSession, sf: str) -> DataFrame:
    """Variograms of both halves of the points along strike, dip and normal and in all directions, in one job."""
    p = views.points(spark, sf).withColumn("half", F.col("label") % 2)
    directions = {"all": (1.0, 0.0, 0.0)} | {n: tuple(a) for n, a in zip(simulate.AXES, ORIENTATION.axes.tolist(), strict=True)}
    v = pairs.variogram(p, 0.3, 8, directions, {"all": 90.0} | dict.fromkeys(simulate.AXES, 30.0), by=("half",))
    return rounded(v)


@query("a49_pair_funnel", f"{POINTS}, {_directions_sql()}, q AS (SELECT d.direction, degrees(acos(least(1e0, abs({_AXIS_SQL}) / h))) AS angle, abs({_AXIS_SQL}) / h >= cos(radians(30)) AS ok FROM (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS h FROM points a JOIN points b ON a.id < b.id) JOIN points a ON a.id = i JOIN points b ON b.id = j, d WHERE h < 0.3e0 AND h > 0 AND d.direction <> 'all'), n AS (SELECT count(*) AS points FROM points) SELECT direction, any_value(points) AS points, any_value(points * (points - 1) // 2) AS possible, count(*) AS within, count(*) FILTER (ok) AS accepted, {', '.join(f'count(*) FILTER (least(CAST(floor(angle / 15) AS INT), 5) = {k}) AS from_{15 * k}' for k in range(6))} FROM q, n GROUP BY direction")
def a49_pair_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs each rule lets through, and their angles off each axis in steps of 15 degrees."""
    directions = {n: tuple(a) for n, a in zip(simulate.AXES, ORIENTATION.axes.tolist(), strict=True)}
    f = pairs.pair_funnel(views.points(spark, sf), 0.3, directions, 30.0, step=15)
    return f.select("direction", "points", "possible", "within", "accepted", *[F.col("angles")[k].alias(f"from_{15 * k}") for k in range(6)])


@query("e10_cross_validation")
def e10_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of kriging, in values, by random and by blocked folds; each fold is detrended and scored by its training rows."""
    families = {"random": None, "blocked": 0.1}
    both = [simulate.folds(views.points(spark, sf), 5, 42, block).withColumn("family", F.lit(name)) for name, block in families.items()]
    x = stored(simulate.cross_validated(both[0].unionByName(both[1]), MODEL, SEARCH, trend=("z",), family="family"), "held-out")
    errors = [compare.errors(x.filter(F.col("family") == name), "value", "estimate").select(F.lit(name).alias("family"), "*") for name in families]
    return errors[0].unionByName(errors[1])


@query("e11_fallback_mean")
def e11_fallback_mean(spark: SparkSession, sf: str) -> DataFrame:
    x = simulate.folds(views.points(spark, sf), 5, 42)
    return compare.errors(simulate.cross_validate(x, MODEL, SEARCH, least=8), "value", "estimate", ["fold"])


def _families(spark: SparkSession, sf: str) -> DataFrame:
    """Spatial blocks, holes (labels) and sections of the points."""
    p = views.points(spark, sf)
    blocks = p.withColumn("fold", F.pmod(F.floor(F.col("x") / 0.1) * 3 + F.floor(F.col("y") / 0.1) * 5, F.lit(5)))
    named = {"block": blocks, "hole": simulate.hole_folds(p, "label"), "section": simulate.section_folds(p, 0.1)}
    made = [x.select(F.lit(n).alias("family"), "id", "x", "y", "z", "value", F.col("fold").cast("long").alias("fold")) for n, x in named.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("b1_fold_baselines")
def b1_fold_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse distances, ordinary and simple kriging beside each other, in three families of folds."""
    return simulate.baselines(_families(spark, sf), MODEL, SEARCH)


_FAMILY_SQL = "f AS (SELECT 'block' AS family, *, CAST(((CAST(floor(x / 0.1e0) AS BIGINT) * 3 + CAST(floor(y / 0.1e0) AS BIGINT) * 5) % 5 + 5) % 5 AS BIGINT) AS fold FROM points UNION ALL SELECT 'hole', *, label FROM points UNION ALL SELECT 'section', *, CAST(floor(y / 0.1e0) AS BIGINT) FROM points)"


@query("b1_inverse_distance", f"{POINTS}, {_FAMILY_SQL}, n AS (SELECT t.family, t.id, s.value, sqrt((t.x / 0.15e0 - s.x / 0.15e0) * (t.x / 0.15e0 - s.x / 0.15e0) + (t.y / 0.15e0 - s.y / 0.15e0) * (t.y / 0.15e0 - s.y / 0.15e0) + (t.z / 0.15e0 - s.z / 0.15e0) * (t.z / 0.15e0 - s.z / 0.15e0)) AS h, s.id AS sid FROM f t JOIN f s ON t.family = s.family AND t.fold <> s.fold), k AS (SELECT *, row_number() OVER (PARTITION BY family, id ORDER BY h, sid) AS rank FROM n WHERE h <= 1), e AS (SELECT family, id, sum(value / greatest(h, 1e-6) ** 2) / sum(1 / greatest(h, 1e-6) ** 2) AS near FROM k WHERE rank <= 8 GROUP BY ALL), m AS (SELECT a.family, a.fold, avg(b.value) AS mean FROM (SELECT DISTINCT family, fold FROM f) a JOIN f b ON a.family = b.family AND a.fold <> b.fold GROUP BY ALL) SELECT f.family, f.id, {r('coalesce(near, mean)', 'estimate', 5)} FROM f LEFT JOIN e ON f.family = e.family AND f.id = e.id LEFT JOIN m ON f.family = m.family AND f.fold = m.fold")
def b1_inverse_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates of held-out points by inverse distances, in three families of folds."""
    return rounded(simulate.inverse_distances(_families(spark, sf), SEARCH, family="family").select("family", "id", "estimate"), 5)


@query("e12_a45_hole_subset")
def e12_a45_hole_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Tonnage width at a cutoff from all holes and from a seeded 60 percent, fitted and simulated anew; labels stand for holes."""
    p = views.points(spark, sf).withColumn("hole_id", F.concat(F.lit("H"), "label"))
    return simulate.spacing_sensitivity(p, 0.6, 5.0, grid=GRID, n_real=5, search=SEARCH, seed=1337, density=2.0, reach=0.3, lags=8)


@query("e13_block_sizes")
def e13_block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Cutoff curves simulated on cells of two sizes over the same box."""
    p, out = views.points(spark, sf), None
    for grid in (GRID, Grid((-0.15, -0.15, -0.15), (0.2, 0.2, 0.2), (2, 2, 2))):
        c = simulate.simulated_curve(p, grid, 4, SEARCH, 1337, [3.0, 5.0], 2.0, 0.3, 8).withColumn("cell", F.lit(grid.step[0]))
        out = c if out is None else out.unionByName(c)
    return out


@query("e3_e4_domains", f"{POINTS}, d AS (SELECT *, CASE WHEN label % 2 = 0 THEN 'host_waste' ELSE 'fresh_graphitic' END AS g FROM points), m AS (SELECT g, min(x) AS mx, min(y) AS my, min(z) AS mz FROM d GROUP BY 1), c AS (SELECT d.*, count(*) OVER (PARTITION BY d.g, floor((x - mx) / 0.2), floor((y - my) / 0.2), floor((z - mz) / 0.2)) AS k FROM d JOIN m USING (g)), w AS (SELECT *, count(*) OVER (PARTITION BY g) / sum(1e0 / k) OVER (PARTITION BY g) / k AS w FROM c), v AS (SELECT g, value, sum(w) AS s, arg_max(w, id) AS last FROM w GROUP BY ALL), p AS (SELECT g, value, greatest(1e-6, least(1 - 1e-6, (sum(s) OVER (PARTITION BY g ORDER BY value) - last / 2) / sum(s) OVER (PARTITION BY g))) AS p FROM v) SELECT w.g AS domain_group, id, {r('w', 'weight', 10)}, {r(inverse_normal_sql('p'), 'score', 4)} FROM w JOIN p ON w.g = p.g AND w.value = p.value")
def e3_e4_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Declustering weights and weighted normal scores, by domain."""
    x = prepared(spark, sf).samples
    return x.select("domain_group", "id", (F.round("decluster_weight", 10) + 0.0).alias("weight"), (F.round("score", 4) + 0.0).alias("score"))


@query("e14_simulated_variograms")
def e14_simulated_variograms(spark: SparkSession, sf: str) -> DataFrame:
    """Simulated against data variograms: pairs of cells once, values by realisation."""
    cells = _cells(spark, 3).withColumn("domain", F.lit(0))
    sim = simulate.simulate(cells, scored(spark, sf).withColumn("domain", F.lit(0)), {0: MODEL}, SEARCH, 1337)
    at = sim.join(cells.select("real_id", "cell_id", "x", "y", "z"), ["real_id", "cell_id"])
    by_real = pairs.variogram(at.withColumnRenamed("cell_id", "id"), 0.3, 3, {"east": (1.0, 0.0, 0.0), "north": (0.0, 1.0, 0.0)}, 22.5, by=("real_id",))
    sims = by_real.groupBy("direction", "lag").agg(F.avg("gamma").alias("gamma_sim_mean"))
    data = pairs.variogram(scored(spark, sf), 0.3, 3, {"east": (1.0, 0.0, 0.0), "north": (0.0, 1.0, 0.0)}, 22.5, value="score")
    both = data.select("direction", "lag", F.col("gamma").alias("gamma_target"), F.col("pairs").alias("target_pairs")).join(sims, ["direction", "lag"], "left")
    return compare.reproduction(both, {"east": 0.45, "north": 0.4})


@query("a43_bootstrap_median")
def a43_bootstrap_median(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.bootstrap_median(views.points(spark, sf).select("id", "value"), "value", 300, 1337)


@query("l1_l2_screen")
def l1_l2_screen(spark: SparkSession, sf: str) -> DataFrame:
    """Is an interval's grade above 50? From its depth, length and lithology, tested on other holes."""
    i = views.intervals(spark, sf).select("hole_id", F.when(F.col("event_id") % 17 > 0, F.col("from_m")).alias("from_m"), "length", "lith_code", (F.col("grade") >= 50).alias("rich"))
    return screen.screen(i, ["from_m", "length"], ["lith_code"], "rich", "hole_id", trees=400)


@query("w10_holm", "WITH p AS (SELECT l_suppkey AS id, (l_suppkey * 37 % 101 + 1) / 2000e0 AS p FROM (SELECT DISTINCT l_suppkey FROM lineitem)), k AS (SELECT *, least(1e0, (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) * p) AS raw FROM p) SELECT id, round(p, 9) + 0e0 AS p, round(max(raw) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING), 9) + 0e0 AS adjusted FROM k")
def w10_holm(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("id")).distinct()
    return rounded(samples.adjusted(x.withColumn("p", (F.col("id") * 37 % 101 + 1) / 2000.0)), 9)


@query("t8_seeded_sample", f"{POINTS} SELECT id FROM points ORDER BY md5(id || ':42'), id LIMIT 100")
def t8_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred points by the order of a seeded digest: the feature is the limit."""
    return views.points(spark, sf).orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), "id").limit(100).select("id")


@query("p4_inventory", "SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes, regexp_extract(url, '^[a-z]+') AS kind FROM pages")
def p4_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return tabulate.inventory(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html", "url")


@query("p5_inner_fields", "SELECT page_id, string_split(url, '/')[1] AS first, array_to_string(string_split(url, '/')[2:len(string_split(url, '/')) - 1], '/') AS middle, string_split(url, '/')[len(string_split(url, '/'))] AS last FROM pages")
def p5_inner_fields(spark: SparkSession, sf: str) -> DataFrame:
    """First and last field, and all between them joined again."""
    return tabulate.inner_fields(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "url", "/")


@query("p6_drift_ids", "SELECT lang, count(*) AS n, count(DISTINCT sha256(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))) AS distinct_texts, CAST(coalesce(sum(len(regexp_extract_all(text, '[0-9]+'))), 0) AS BIGINT) AS ids FROM documents GROUP BY lang")
def p6_drift_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tabulate.text_drift(spark.read.parquet(f"{sf}/documents.parquet"), "lang", "text")


@query("p6_id_differences", "WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) AS id FROM documents WHERE source <> 'src0'), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) AS id FROM documents WHERE source = 'src0') SELECT coalesce(a.id, b.id) AS id, b.id IS NULL AS missing, a.id IS NULL AS extra FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def p6_id_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in the texts of one source or of the others, but not of both."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return tabulate.id_differences(d.filter("source <> 'src0'"), d.filter("source = 'src0'"), "text")


def _uniform_sql(salt: int) -> str:
    return f"((CAST('0x' || substr(md5(id || ':{salt}'), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0)"


@query("s16_synthetic_field", f"{POINTS}, u AS (SELECT id, x * 1000 AS x, y * 1000 AS y, z * 1000 AS z, {_uniform_sql(7)} AS e FROM points) SELECT id, {r('greatest(0, least(15, 3 + 0.002e0 * x + sin(y / 150) + 0.5e0 * cos(z / 80) + 0.3e0 * (' + inverse_normal_sql('e') + ')))', 'grade', 4)} FROM u")
def s16_synthetic_field(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up grade at the points' places, a thousand times as wide."""
    p = views.points(spark, sf).select("id", *[(F.col(a) * 1000).alias(a) for a in "xyz"])
    return rounded(samples.synthetic_field(p).select("id", "grade"), 4)


@query("a24_support_errors", f"{with_views('stack', 'blocks')}, c AS (SELECT CAST(round_even(x / 12.5, 0) AS BIGINT) AS ix, CAST(round_even(y / 12.5, 0) AS BIGINT) AS iy, CAST(round_even(z / 2.5, 0) AS BIGINT) AS iz, sum(grade * volume * density) / sum(volume * density) AS grade, sum(volume) / 20 AS filled FROM blocks GROUP BY ALL), p AS (SELECT ix, iy, iz, quantile_cont(value, 0.5) AS p50 FROM stack GROUP BY ALL) SELECT count(*) AS n, {r('avg(p50 - grade)', 'bias')}, {r('avg(abs(p50 - grade))', 'mae')}, {r('sqrt(avg((p50 - grade) * (p50 - grade)))', 'rmse')}, {r('corr(grade, p50)', 'r')} FROM c JOIN p USING (ix, iy, iz)")
def a24_support_errors(spark: SparkSession, sf: str) -> DataFrame:
    c = compare.to_support(views.blocks(spark, sf), (0.0, 0.0, 0.0), (12.5, 12.5, 2.5), (20, 20, None), 20.0)
    p = ensemble.cell_percentiles(views.stack(spark, sf))
    return rounded(compare.errors(c.join(p.select("ix", "iy", "iz", "p50"), ["ix", "iy", "iz"]), "grade", "p50"))


@query("t6_ranked_candidates", "SELECT l_suppkey AS candidate, round(score, 6) + 0e0 AS score FROM (SELECT l_suppkey, avg(l_discount) * 10 - stddev_samp(l_tax) AS score FROM lineitem GROUP BY 1) WHERE isfinite(score) ORDER BY round(score, 9) DESC, candidate LIMIT 10")
def t6_ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("candidate")).agg((F.avg("l_discount") * 10 - F.stddev_samp("l_tax")).alias("score"))
    return rounded(tabulate.ranked(x, "score", "candidate", 10))


_FEATURES = "f AS (SELECT unnest(['num__l_tax', 'num__l_discount', 'cat__l_returnflag_A', 'cat__l_returnflag_R', 'cat__weathering_bin_HW']) AS feature, unnest([abs(corr(l_tax, l_quantity)), abs(corr(l_discount, l_quantity)), avg(CAST(l_returnflag = 'A' AS INT)), avg(CAST(l_returnflag = 'R' AS INT)), avg(l_tax)]) AS importance FROM lineitem), g AS (SELECT CASE feature WHEN 'num__l_tax' THEN 'l_tax' WHEN 'num__l_discount' THEN 'l_discount' WHEN 'cat__weathering_bin_HW' THEN 'weathering_bin' ELSE 'l' END AS feature, sum(importance) AS importance, avg(importance) AS mean, count(*) AS columns FROM f GROUP BY 1)"


def _importances(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda v: F.avg((F.col("l_returnflag") == v).cast("double"))
    named = {"num__l_tax": F.abs(F.corr("l_tax", "l_quantity")), "num__l_discount": F.abs(F.corr("l_discount", "l_quantity")), "cat__l_returnflag_A": flag("A"), "cat__l_returnflag_R": flag("R"), "cat__weathering_bin_HW": F.avg("l_tax")}
    one = spark.read.parquet(f"{sf}/lineitem.parquet").agg(*[c.alias(n) for n, c in named.items()])
    return one.unpivot([], list(named), "feature", "importance")


@query("l3_grouped_importances", f"WITH {_FEATURES} SELECT feature, {r('importance', 'importance')}, {r('mean', 'mean')}, columns FROM g")
def l3_grouped_importances(spark: SparkSession, sf: str) -> DataFrame:
    """Strengths of encoded columns, summed by the feature that they encode."""
    return rounded(screen.importance_by_group(_importances(spark, sf)))


@query("j13_importances", f"WITH {_FEATURES}, o AS (SELECT l_linestatus AS feature, avg(l_tax) AS importance FROM lineitem GROUP BY 1 UNION ALL SELECT 'l_tax', 1e0) SELECT coalesce(g.feature, o.feature) AS feature, {r('coalesce(g.importance, 0)', 'first')}, {r('coalesce(o.importance, 0)', 'second')} FROM g FULL JOIN o ON g.feature = o.feature")
def j13_importances(spark: SparkSession, sf: str) -> DataFrame:
    """Importances by two methods, features of both."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_linestatus").alias("feature")).agg(F.avg("l_tax").alias("importance"))
    other = line.unionByName(spark.createDataFrame([("l_tax", 1.0)], "feature string, importance double"))
    return rounded(screen.side_by_side(screen.importance_by_group(_importances(spark, sf)), other, ("first", "second")))


@query("w4_centred_shares", f"{POINTS} SELECT id, {r('greatest(1e-6, least(1 - 1e-6, (sum(w) OVER (PARTITION BY label ORDER BY value, id ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY label)))', 'p', 5)} FROM (SELECT *, abs(value) + 1 AS w FROM points)")
def w4_centred_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Centred cumulative weights within each label."""
    p = views.points(spark, sf).withColumn("w", F.abs("value") + 1)
    return rounded(samples.centred_shares(p, "label", "w", ["value", "id"]).select("id", "p"), 5)


@query("v10_model_warnings", "WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS model, p_size / 50e0 AS nugget, CASE WHEN p_partkey % 5 = 0 THEN 0.005e0 ELSE 1.2e0 - p_size / 50e0 END AS variance, CAST(p_size * p_size * p_size AS DOUBLE) / 2 AS reach FROM part) SELECT model, warning FROM (SELECT model, unnest([CASE WHEN reach < 0.05e0 * 4600 THEN 'range is very small for the grid' WHEN reach > 10 * 4600 THEN 'range is extremely large for the grid' END, CASE WHEN nugget / (nugget + variance) > 0.8e0 THEN 'nugget effect is high' END, CASE WHEN variance < 0.01e0 THEN 'variance is very small' END, CASE WHEN NOT reach BETWEEN 10 AND 10000 THEN 'error: range is unrealistic' END]) AS warning FROM m) WHERE warning IS NOT NULL")
def v10_model_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """What is doubtful about models whose parameters the parts' sizes stand for."""
    grid = Grid((0.0, 0.0, 0.0), (25.0, 25.0, 2.0), (52, 184, 135))
    size, k = F.col("p_size"), F.col("p_partkey")
    p = spark.read.parquet(f"{sf}/part.parquet").select(k.cast("string").alias("model"), (size / 50.0).alias("nugget"), F.when(k % 5 == 0, 0.005).otherwise(1.2 - size / 50.0).alias("variance"), ((size * size * size).cast("double") / 2).alias("reach"))
    return simulate.model_warnings(p, grid)
