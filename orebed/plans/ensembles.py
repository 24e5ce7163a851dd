"""Queries on realisations, categories, blocks and point pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import even_bin
from ..operators import compare, ensemble, order, pairs, samples, tabulate
from . import views
from .registry import query, r, rounded
from .views import with_views

STACK, CATS, POINTS, BLOCKS = with_views("stack"), with_views("categories"), with_views("points"), with_views("blocks")
CUTOFFS = [10.0, 20.0, 25.0, 30.0, 40.0]
_PCT = "pct AS (SELECT cell_id, ix, iy, iz, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, count(*) AS n FROM stack GROUP BY ALL)"
_CURVE = f"curve AS (SELECT real_id, c AS cutoff, count(*) FILTER (value >= c) AS blocks, coalesce(avg(value) FILTER (value >= c), 0) AS avg_grade, count(*) FILTER (value >= c) * 200e0 AS tonnage, count(*) FILTER (value >= c) * 200e0 * coalesce(avg(value) FILTER (value >= c), 0) / 100 AS contained FROM stack, (SELECT unnest([{', '.join(f'{c}e0' for c in CUTOFFS)}]) AS c) GROUP BY ALL)"
_MARKS = (("p05", 0.05), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95))
_MEASURES = (("tonnage", "tonnage"), ("grade", "avg_grade"), ("contained", "contained"))
_SUMMARY = "summary AS (SELECT cutoff, " + ", ".join([f"quantile_cont({c}, {p}) AS {n}_{m}" for n, c in _MEASURES for m, p in _MARKS] + [f"avg({c}) AS {n}_mean" for n, c in _MEASURES]) + ", count(*) FILTER (blocks > 0) AS nonzero_count FROM curve GROUP BY cutoff)"
_SUMMARY_OUT = ", ".join(["cutoff", *[r(f"{n}_{m}", f"{n}_{m}") for n, _ in _MEASURES for m in [*[k for k, _ in _MARKS], "mean"]], "nonzero_count"])


@query("a6_cell_percentiles", f"{STACK}, {_PCT} SELECT cell_id, ix, iy, iz, n, {r('p10', 'p10')}, {r('p50', 'p50')}, {r('p90', 'p90')} FROM pct")
def a6_cell_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.cell_percentiles(views.stack(spark, sf)))


@query("a7_exceedance", f"{STACK} SELECT cell_id, ix, iy, iz, {r('count(*) FILTER (value > 25) / CAST(count(*) AS DOUBLE)', 'probability')} FROM stack GROUP BY ALL")
def a7_exceedance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.exceedance(views.stack(spark, sf), 25.0))


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.cutoff_curve(views.stack(spark, sf), CUTOFFS, 100.0, 2.0)


@query("a8_cutoff_curve", f"{STACK}, {_CURVE} SELECT real_id, cutoff, blocks, tonnage, {r('avg_grade', 'avg_grade')}, {r('contained', 'contained')} FROM curve")
def a8_cutoff_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_curve(spark, sf))


@query("a9_curve_summary", f"{STACK}, {_CURVE}, {_SUMMARY} SELECT {_SUMMARY_OUT} FROM summary")
def a9_curve_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.curve_summary(_curve(spark, sf)))


@query("v12_checked_curve", f"{STACK}, {_CURVE}, {_SUMMARY} SELECT {_SUMMARY_OUT} FROM summary")
def v12_checked_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.curve_is_sane(ensemble.curve_summary(_curve(spark, sf))))


def _hw(n: str) -> str:
    return f"greatest(abs({n}_p95 - {n}_p50), abs({n}_p50 - {n}_p05)) / greatest(abs({n}_p50), 1e-9)"


@query("a10_interval_benchmark", f"{STACK}, {_CURVE}, {_SUMMARY} SELECT cutoff, {r(_hw('tonnage'), 'tonnage_half_width')}, {r(_hw('grade'), 'grade_half_width')}, cutoff = 25 AS is_target FROM summary")
def a10_interval_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.interval_benchmark(ensemble.curve_summary(_curve(spark, sf)), 26.0))


@query("p2_cutoff_range", f"{STACK}, {_CURVE}, {_SUMMARY} SELECT cutoff, {r('tonnage_p50', 'tonnage_p50')} FROM summary WHERE cutoff BETWEEN 20 AND 30")
def p2_cutoff_range(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.curve_summary(_curve(spark, sf)).filter(F.col("cutoff").between(20, 30)).select("cutoff", "tonnage_p50"))


@query("t7_first_at_cutoff", f"{STACK}, {_CURVE}, {_SUMMARY} SELECT cutoff, {r('grade_mean', 'grade_mean')} FROM summary ORDER BY abs(cutoff - 27), cutoff LIMIT 1")
def t7_first_at_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    s = ensemble.curve_summary(_curve(spark, sf))
    return rounded(s.agg(F.min_by(F.struct("cutoff", "grade_mean"), F.struct(F.abs(F.col("cutoff") - 27), "cutoff")).alias("r")).select("r.*"))


@query("a42_tonnage_share", f"{STACK}, {_CURVE} SELECT cutoff, {r('100 * avg(CAST(tonnage >= 150000 AS INT))', 'share_pct')}, {r('quantile_cont(tonnage, 0.9) - quantile_cont(tonnage, 0.1)', 'width')} FROM curve GROUP BY cutoff")
def a42_tonnage_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_curve(spark, sf).groupBy("cutoff").agg((100 * F.avg((F.col("tonnage") >= 150_000).cast("double"))).alias("share_pct"), (F.percentile("tonnage", F.lit(0.9)) - F.percentile("tonnage", F.lit(0.1))).alias("width")))


@query("a11_regularised", f"{STACK} SELECT real_id, ix // 2 AS bix, iy // 2 AS biy, iz AS biz, {r('avg(value)', 'value')} FROM stack GROUP BY ALL")
def a11_regularised(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.regularise(views.stack(spark, sf), 2, 2, 1))


_SWATH = "sl AS (SELECT real_id, iz, avg(value) AS m FROM stack GROUP BY ALL)"


@query("a12_swath", f"{STACK}, {_SWATH} SELECT iz, {r('quantile_cont(m, 0.1)', 'p10')}, {r('quantile_cont(m, 0.5)', 'p50')}, {r('quantile_cont(m, 0.9)', 'p90')} FROM sl GROUP BY iz")
def a12_swath(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.swath(views.stack(spark, sf), "iz"))


@query("a13_axis_means", f"{BLOCKS}, g AS (SELECT CAST(floor(x / 25) AS BIGINT) AS bin, avg(grade) AS m, count(*) AS n FROM blocks GROUP BY 1) SELECT b.bin, {r('m', 'mean')}, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 14)) AS bin) b LEFT JOIN g ON b.bin = g.bin")
def a13_axis_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.axis_means(views.blocks(spark, sf), "x", "grade", 0.0, 25.0, 14))


@query("a14_swath_correlation", f"{STACK}, b AS (SELECT p_partkey % 20 AS ix, avg(p_size) AS d FROM part GROUP BY 1), s AS (SELECT ix, quantile_cont(m, 0.5) AS p50 FROM (SELECT real_id, ix, avg(value) AS m FROM stack GROUP BY ALL) GROUP BY 1) SELECT {r('corr(p50, d)', 'r')}, count(*) AS n FROM s JOIN b USING (ix)")
def a14_swath_correlation(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/part.parquet").groupBy((F.col("p_partkey") % 20).alias("ix")).agg(F.avg("p_size").alias("d"))
    return rounded(ensemble.swath(views.stack(spark, sf), "ix").join(d, "ix").agg(F.corr("p50", "d").alias("r"), F.count(F.lit(1)).alias("n")))


@query("a15_swath_cover", f"{STACK}, {_PCT}, l AS (SELECT iz, avg(p10) AS lo, avg(p90) AS hi FROM pct GROUP BY 1), d AS (SELECT p_partkey // 400 AS iz, avg(p_size) AS m FROM part GROUP BY 1) SELECT {r('100 * avg(CAST(m BETWEEN lo AND hi AS INT))', 'cover_pct')}, count(*) AS slices FROM l JOIN d USING (iz)")
def a15_swath_cover(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/part.parquet").select(F.floor(F.col("p_partkey") / 400).cast("long").alias("iz"), F.col("p_size").alias("value"))
    return rounded(ensemble.swath_cover(ensemble.cell_percentiles(views.stack(spark, sf)), d, "iz"))


_BOTH = "ab AS (SELECT value AS v, 1 AS a FROM stack UNION ALL SELECT CAST(p_size AS DOUBLE), 0 FROM part), e AS (SELECT min(v) AS lo, max(v) AS hi, sum(a) AS na, sum(1 - a) AS nb FROM ab)"


@query("a16_histogram_overlap", f"{STACK}, {_BOTH}, h AS (SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49) AS k, sum(a) / any_value(na) AS fa, sum(1 - a) / any_value(nb) AS fb FROM ab, e GROUP BY 1) SELECT {r('sum(least(fa, fb))', 'overlap')} FROM h")
def a16_histogram_overlap(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").cast("double").alias("v"))
    return rounded(compare.histogram_overlap(views.stack(spark, sf), p, "value", "v"))


@query("a17_a19_quantile_profile", f"{STACK}, q AS (SELECT unnest(range(1, 100)) AS k), m AS (SELECT k, (SELECT quantile_cont(value, [{', '.join(str(k / 100) for k in range(1, 100))}]) FROM stack)[k] AS x, (SELECT quantile_cont(CAST(p_size AS DOUBLE), [{', '.join(str(k / 100) for k in range(1, 100))}]) FROM part)[k] AS y FROM q) SELECT count(*) AS n, {r('avg(y - x)', 'bias')}, {r('avg(abs(y - x))', 'mae')}, {r('sqrt(avg((y - x) * (y - x)))', 'rmse')}, {r('corr(x, y)', 'r')} FROM m")
def a17_a19_quantile_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").cast("double").alias("v"))
    return rounded(compare.quantile_profile(views.stack(spark, sf), p, "value", "v"))


@query("a17_sampled_quantiles", f"{with_views('points', 'blocks')}, s AS (SELECT value FROM points ORDER BY md5(id || ':42'), id LIMIT 100), q AS (SELECT unnest(range(0, 101)) AS k), m AS (SELECT k, (SELECT quantile_cont(value, [{', '.join(str(k / 100) for k in range(101))}]) FROM s)[k + 1] AS x, (SELECT quantile_cont(grade, [{', '.join(str(k / 100) for k in range(101))}]) FROM blocks)[k + 1] AS y FROM q) SELECT count(*) AS n, {r('avg(y - x)', 'bias')}, {r('avg(abs(y - x))', 'mae')}, {r('sqrt(avg((y - x) * (y - x)))', 'rmse')}, {r('corr(x, y)', 'r')} FROM m")
def a17_sampled_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles from 0 to 100 percent of a seeded sample, which is the feature, against those of all blocks."""
    p = compare.seeded_sample(views.points(spark, sf), 100, 42, "id")
    return rounded(compare.quantile_profile(p, views.blocks(spark, sf), "value", "grade", ends=True))


@query("a18_distribution", f"{BLOCKS} SELECT count(grade) AS n, {r('avg(grade)', 'mean')}, {r('stddev_samp(grade)', 'std')}, {r('quantile_cont(grade, 0.1)', 'p10')}, {r('quantile_cont(grade, 0.5)', 'p50')}, {r('quantile_cont(grade, 0.9)', 'p90')}, {r('avg(CAST(grade >= 3 AS INT))', 'share_3')} FROM blocks")
def a18_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.distribution(views.blocks(spark, sf), "grade"))


@query("a20_a55_cell_errors", f"{STACK}, {_PCT} SELECT count(*) AS n, {r('avg(p50 - p_size)', 'bias')}, {r('avg(abs(p50 - p_size))', 'mae')}, {r('sqrt(avg((p50 - p_size) * (p50 - p_size)))', 'rmse')}, {r('corr(p_size, p50)', 'r')} FROM pct JOIN part ON cell_id = p_partkey")
def a20_a55_cell_errors(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("cell_id"), "p_size")
    return rounded(compare.errors(ensemble.cell_percentiles(views.stack(spark, sf)).join(p, "cell_id"), "p_size", "p50"))


@query("a21_a22_model_curve", f"{BLOCKS} SELECT c AS cutoff, {r('sum(CASE WHEN grade >= c THEN volume * density ELSE 0 END)', 'tonnage', 4)}, {r('sum(CASE WHEN grade >= c THEN volume * density * grade ELSE 0 END) / sum(CASE WHEN grade >= c THEN volume * density ELSE 0 END)', 'avg_grade', 4)}, {r('sum(CASE WHEN grade >= c THEN volume ELSE 0 END) / sum(volume)', 'volume_share', 4)}, {r('sum(CASE WHEN grade >= c THEN volume * density ELSE 0 END) / sum(volume * density)', 'tonnage_share', 4)} FROM blocks, (SELECT unnest([1e0, 2e0, 3e0, 4e0]) AS c) GROUP BY c")
def a21_a22_model_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.model_curve(views.blocks(spark, sf), [1.0, 2.0, 3.0, 4.0]), 4)


@query("j11_a44_curve_change", f"{BLOCKS}, m AS (SELECT c AS cutoff, sum(CASE WHEN grade >= c THEN volume * density ELSE 0 END) AS t, sum(CASE WHEN grade >= c THEN volume * density * grade ELSE 0 END) / sum(CASE WHEN grade >= c THEN volume * density ELSE 0 END) AS g, sum(CASE WHEN grade >= c THEN volume * density ELSE 0 END) FILTER (z < 5) AS t2, sum(CASE WHEN grade >= c THEN volume * density * grade ELSE 0 END) FILTER (z < 5) / sum(CASE WHEN grade >= c THEN volume * density ELSE 0 END) FILTER (z < 5) AS g2 FROM blocks, (SELECT unnest([1e0, 3e0]) AS c) GROUP BY c) SELECT cutoff, {r('t', 'tonnage', 4)}, {r('g', 'avg_grade', 4)}, {r('100 * (t2 - t) / t', 'tonnage_change_pct', 4)}, {r('100 * (g2 - g) / g', 'grade_change_pct', 4)} FROM m")
def j11_a44_curve_change(spark: SparkSession, sf: str) -> DataFrame:
    b = views.blocks(spark, sf)
    return rounded(compare.curve_change(compare.model_curve(b, [1.0, 3.0]), compare.model_curve(b.filter("z < 5"), [1.0, 3.0])), 4)


@query("a23_to_support", f"{BLOCKS}, c AS (SELECT *, CAST(round_even((x - 10) / 25, 0) AS BIGINT) AS ix, CAST(round_even((y - 10) / 25, 0) AS BIGINT) AS iy, CAST(round_even(z / 5, 0) AS BIGINT) AS iz FROM blocks) SELECT ix, iy, iz, count(*) AS n, {r('sum(volume)', 'volume', 4)}, {r('sum(volume * density)', 'tonnage', 4)}, {r('sum(grade * volume * density) / sum(volume * density)', 'grade', 4)}, {r('sum(volume) / 100', 'filled', 4)} FROM c WHERE ix BETWEEN 0 AND 8 AND iy BETWEEN 0 AND 8 AND iz BETWEEN 0 AND 2 GROUP BY ALL")
def a23_to_support(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.to_support(views.blocks(spark, sf), (10.0, 10.0, 0.0), (25.0, 25.0, 5.0), (9, 9, 3), 100.0), 4)


@query("g11_even_bins", f"{BLOCKS} SELECT block_id, CAST(round_even(x / 25, 0) AS BIGINT) AS k FROM blocks")
def g11_even_bins(spark: SparkSession, sf: str) -> DataFrame:
    return views.blocks(spark, sf).select("block_id", even_bin(F.col("x"), 0.0, 25.0).alias("k"))


@query("g13_spacing", f"{BLOCKS}, d AS (SELECT DISTINCT x FROM blocks) SELECT median(s) AS spacing FROM (SELECT x - lag(x) OVER (ORDER BY x) AS s FROM d) WHERE s > 0")
def g13_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return compare.infer_spacing(views.blocks(spark, sf), "x", 5.0)


@query("v14_box_filter", f"{BLOCKS} SELECT block_id, grade FROM blocks WHERE x BETWEEN 50 AND 150 AND y BETWEEN 0 AND 100")
def v14_box_filter(spark: SparkSession, sf: str) -> DataFrame:
    return views.blocks(spark, sf).filter(F.col("x").between(50, 150) & F.col("y").between(0, 100)).select("block_id", "grade")


@query("a25_share_above", f"{STACK}, s AS (SELECT real_id, avg(CAST(value >= 25 AS INT)) AS s FROM stack GROUP BY 1) SELECT {r('quantile_cont(s, 0.1)', 'p10')}, {r('quantile_cont(s, 0.5)', 'p50')}, {r('quantile_cont(s, 0.9)', 'p90')} FROM s")
def a25_share_above(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.share_above(views.stack(spark, sf), 25.0))


_SHARES = "cs AS (SELECT cell_id, ix, iy, iz, count(*) FILTER (category_id = 0) / CAST(count(*) AS DOUBLE) AS s0, count(*) FILTER (category_id = 1) / CAST(count(*) AS DOUBLE) AS s1, count(*) FILTER (category_id = 2) / CAST(count(*) AS DOUBLE) AS s2 FROM categories GROUP BY ALL), ce AS (SELECT *, -(greatest(s0, 1e-12) * ln(greatest(s0, 1e-12)) + greatest(s1, 1e-12) * ln(greatest(s1, 1e-12)) + greatest(s2, 1e-12) * ln(greatest(s2, 1e-12))) / ln(3) AS entropy, greatest(s0, s1, s2) AS max_share FROM cs)"


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.category_shares(views.categories(spark, sf), 3)


@query("a28_g22_category_shares", f"{CATS}, {_SHARES} SELECT cell_id, ix, iy, iz, {r('s0', 's0')}, {r('s1', 's1')}, {r('s2', 's2')}, {r('entropy', 'entropy')}, {r('max_share', 'max_share')} FROM ce")
def a28_g22_category_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_shares(spark, sf))


@query("a29_prior_shares", f"{CATS} SELECT category_id, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM categories GROUP BY 1")
def a29_prior_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tabulate.shares(views.categories(spark, sf), ["category_id"]).drop("n"))


@query("a30_entropy_summary", f"{CATS}, {_SHARES} SELECT {r('avg(entropy)', 'mean_entropy')}, {r('quantile_cont(entropy, 0.9)', 'p90_entropy')}, {r('avg(CAST(entropy >= 0.5 AS INT))', 'share_uncertain')}, {r('avg(CAST(s1 + s2 >= 0.1 AS INT))', 'share_ore')} FROM ce")
def a30_entropy_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.entropy_summary(_shares(spark, sf), [1, 2]))


_THICK = "tk AS (SELECT real_id, ix, iy, count(*) FILTER (category_id IN (1, 2)) * 2e0 AS t FROM categories GROUP BY ALL), tq AS (SELECT ix, iy, quantile_cont(t, 0.1) AS p10, quantile_cont(t, 0.5) AS p50, quantile_cont(t, 0.9) AS p90, avg(CAST(t > 0 AS INT)) AS present FROM tk GROUP BY ALL), tr AS (SELECT *, CASE WHEN abs(p50) > 1e-9 THEN 100 * (p90 - p10) / p50 END AS aperture_pct FROM tq)"


@query("a31_thickness", f"{CATS}, {_THICK} SELECT ix, iy, {r('p10', 'p10')}, {r('p50', 'p50')}, {r('p90', 'p90')}, {r('present', 'present')}, {r('aperture_pct', 'aperture_pct')} FROM tr")
def a31_thickness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.thickness(views.categories(spark, sf), [1, 2], 2.0))


@query("t3_top_apertures", f"{CATS}, {_THICK} SELECT ix, iy, {r('aperture_pct', 'aperture_pct')} FROM tr WHERE aperture_pct IS NOT NULL AND (p50 > 2 OR present >= 0.5) ORDER BY aperture_pct DESC, ix, iy LIMIT 20")
def t3_top_apertures(spark: SparkSession, sf: str) -> DataFrame:
    x = ensemble.thickness(views.categories(spark, sf), [1, 2], 2.0).filter(F.col("aperture_pct").isNotNull() & ((F.col("p50") > 2) | (F.col("present") >= 0.5)))
    return rounded(x.orderBy(F.desc("aperture_pct"), "ix", "iy").limit(20).select("ix", "iy", "aperture_pct"))


@query("t2_hotspots", f"{CATS}, {_SHARES} SELECT cell_id, {r('entropy', 'entropy')}, {r('s1 + s2', 'ore')} FROM (SELECT *, round(entropy, 9) AS e, round(s1 + s2, 9) AS o FROM ce) WHERE s1 + s2 >= 0.1 ORDER BY e DESC, o DESC, cell_id LIMIT 25")
def t2_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    x = _shares(spark, sf)
    x = x.withColumns({c: F.round(c, 9) for c in ("entropy", "s0", "s1", "s2")})
    return rounded(ensemble.hotspots(x, [1, 2], 25).withColumn("ore", F.round("ore", 9)).select("cell_id", "entropy", "ore"))


@query("a32_collapse", f"{CATS}, {_SHARES} SELECT ix, iy, {r('coalesce(avg(entropy) FILTER (s1 >= 0.1), avg(entropy))', 'entropy')} FROM ce GROUP BY ALL")
def a32_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.collapse(_shares(spark, sf), "entropy", "s1"))


@query("a33_confidence_gradient", f"{STACK}, {_PCT}, x AS (SELECT *, p90 - p10 AS spread, CASE WHEN abs(p50) > 1e-9 THEN 100 * (p90 - p10) / p50 END AS ap FROM pct) SELECT ix, iy, {r('max(spread)', 'max_spread')}, {r('max(ap)', 'max_aperture_pct')}, {r('max(spread) / (SELECT median(spread) FROM x)', 'relative')} FROM x GROUP BY ALL")
def a33_confidence_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.confidence_gradient(ensemble.cell_percentiles(views.stack(spark, sf))))


@query("w8_convergence", f"{STACK}, m AS (SELECT real_id, avg(value) AS m FROM stack GROUP BY 1) SELECT n AS n_real, {r('avg(m)', 'mean')}, {r('stddev_samp(m)', 'spread')}, count(*) AS n FROM m JOIN (SELECT unnest([2, 5, 10]) AS n) ON real_id < n GROUP BY 1")
def w8_convergence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.convergence(views.stack(spark, sf), [2, 5, 10]))


_U = "CAST((1337 + r * 7919 + cell_id * 104729) % 1000003 AS DOUBLE) / 1000003"


@query("e2_w7_category_draws", f"{CATS}, {_SHARES} SELECT cell_id, CAST(r AS INT) AS real_id, CAST(CASE WHEN u > s0 + s1 THEN 2 WHEN u > s0 THEN 1 ELSE 0 END AS INT) AS category_id FROM (SELECT cell_id, s0, s1, r, {_U} AS u FROM ce, (SELECT unnest(range(0, 5)) AS r))")
def e2_w7_category_draws(spark: SparkSession, sf: str) -> DataFrame:
    x = _shares(spark, sf).select("cell_id", F.array("s0", "s1", "s2").alias("shares"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("real_id"))
    u = F.pmod(1337 + F.col("real_id") * 7919 + F.col("cell_id") * 104729, F.lit(1000003)).cast("double") / 1000003
    return x.withColumn("u", u).select("cell_id", "real_id", ensemble.draw_category(F.col("shares"), F.col("u")).alias("category_id"))


@query("a46_variance_ratio", f"{STACK}, {_PCT}, s AS (SELECT iz, avg(p50) AS m FROM pct GROUP BY 1), d AS (SELECT p_partkey // 400 AS iz, avg(p_size) AS d FROM part GROUP BY 1) SELECT {r('corr(m, d)', 'r')}, {r('CASE WHEN var_pop(d) > 0 THEN var_pop(m) / var_pop(d) END', 'variance_ratio')}, {r('max(m)', 'max_model')}, {r('max(d)', 'max_data')} FROM s JOIN d USING (iz)")
def a46_variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.floor(F.col("p_partkey") / 400).cast("long").alias("iz")).agg(F.avg("p_size").alias("d"))
    s = ensemble.cell_percentiles(views.stack(spark, sf)).groupBy("iz").agg(F.avg("p50").alias("m"))
    return rounded(s.join(d, "iz").agg(F.corr("m", "d").alias("r"), F.when(F.var_pop("d") > 0, F.try_divide(F.var_pop("m"), F.var_pop("d"))).alias("variance_ratio"), F.max("m").alias("max_model"), F.max("d").alias("max_data")))


@query("a52_physical_audit", f"{POINTS} SELECT {r('min(value - 4)', 'least')}, {r('avg(CAST(value - 4 < 0 AS INT))', 'negative_share')}, {r('avg(value - 4)', 'mean')}, {r('avg(greatest(value - 4, 0))', 'floored_mean')} FROM points")
def a52_physical_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tabulate.physical_audit(views.points(spark, sf).withColumn("value", F.col("value") - 4), "value"))


@query("a53_binned_median", f"{CATS}, {_SHARES} SELECT CAST(CASE WHEN s1 < 0.2 THEN 0 WHEN s1 < 0.4 THEN 1 WHEN s1 < 0.6 THEN 2 WHEN s1 < 0.8 THEN 3 ELSE 4 END AS INT) AS class, count(*) AS n, {r('median(entropy)', 'median')} FROM ce GROUP BY 1")
def a53_binned_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.binned_median(_shares(spark, sf), "s1", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], "entropy"))


@query("a54_best_method", "SELECT l_returnflag AS family, l_linestatus AS method, round(rmse, 6) + 0e0 AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY rmse, l_linestatus) AS k FROM (SELECT l_returnflag, l_linestatus, stddev_pop(l_quantity) AS rmse FROM lineitem GROUP BY ALL)) WHERE k = 1")
def a54_best_method(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("method")).agg(F.stddev_pop("l_quantity").alias("rmse"))
    return rounded(tabulate.best_method(x, "family", "method", "rmse"))


@query("a56_unpivoted_sums", "SELECT l_returnflag, measure, round(sum(v), 2) + 0e0 AS total FROM (SELECT l_returnflag, unnest(['quantity', 'tax']) AS measure, unnest([l_quantity, l_tax]) AS v FROM lineitem WHERE regexp_matches(l_linestatus, '^[OF]$')) GROUP BY ALL")
def a56_unpivoted_sums(spark: SparkSession, sf: str) -> DataFrame:
    x = tabulate.matching(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_linestatus", "^[OF]$")
    x = x.select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return rounded(tabulate.unpivoted_sums(x, ["l_returnflag"], ["quantity", "tax"]), 2)


@query("a56_means_by_state", f"SELECT l_linestatus AS state, count(*) AS n, {r('avg(l_quantity)', 'quantity')}, {r('avg(l_tax)', 'tax')} FROM lineitem WHERE regexp_matches(l_returnflag, '^[AR]$') GROUP BY 1")
def a56_means_by_state(spark: SparkSession, sf: str) -> DataFrame:
    x = tabulate.matching(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag", "^[AR]$")
    x = x.select(F.col("l_linestatus").alias("state"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return rounded(tabulate.means_by_state(x, "state", ["quantity", "tax"]))


@query("a56_category_totals", "SELECT sample, round(coalesce(sum(v) FILTER (f = 'A'), 0), 4) + 0e0 AS a, round(coalesce(sum(v) FILTER (f IN ('A', 'R')), 0), 4) + 0e0 AS a_and_r FROM (SELECT l_returnflag AS f, unnest(['l_quantity', 'l_tax', 'l_discount']) AS sample, unnest([l_quantity, l_tax, l_discount]) AS v FROM lineitem) GROUP BY 1")
def a56_category_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over one category and over two, of each of three columns."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_tax", "l_discount")
    return rounded(tabulate.category_totals(x, "l_returnflag", ["l_quantity", "l_tax", "l_discount"], {"a": ["A"], "a_and_r": ["A", "R"]}), 4)


@query("a53_plan_quantiles", f"{STACK}, {_PCT}, q AS (SELECT pct.ix, pct.iy, quantile_cont(p90 - p10, 0.9) AS spread, quantile_cont(ch, 0.9) AS chance FROM pct JOIN (SELECT cell_id, avg(CAST(value > 25 AS INT)) AS ch FROM stack GROUP BY 1) USING (cell_id) GROUP BY ALL) SELECT ix, iy, {r('spread', 'spread')}, {r('chance', 'chance')} FROM q")
def a53_plan_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """The 90 percent mark over z of spread and of chance, by plan column."""
    s = views.stack(spark, sf)
    chance = s.groupBy("cell_id").agg(F.avg((F.col("value") > 25).cast("double")).alias("chance"))
    x = ensemble.cell_percentiles(s).withColumn("spread", F.col("p90") - F.col("p10")).join(chance, "cell_id")
    return rounded(tabulate.plan_quantiles(x, ["spread", "chance"]))


@query("a53_association", f"{STACK}, {_PCT}, q AS (SELECT pct.ix, pct.iy, quantile_cont(p90 - p10, 0.9) AS spread, quantile_cont(ch, 0.9) AS chance FROM pct JOIN (SELECT cell_id, avg(CAST(value > 25 AS INT)) AS ch FROM stack GROUP BY 1) USING (cell_id) GROUP BY ALL) SELECT count(*) AS n, {r('corr(spread, chance)', 'r')} FROM q WHERE spread IS NOT NULL AND chance IS NOT NULL")
def a53_association(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tabulate.association(a53_plan_quantiles(spark, sf), "spread", "chance"))


@query("a41_linear_trend", f"{POINTS} SELECT " + ", ".join(r(f"regr_{n}(value, {a})", f"{n}_{a}") for a in "xyz" for n in ("slope", "intercept")) + " FROM points")
def a41_linear_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(samples.linear_trend(views.points(spark, sf), "value"))


@query("a40_panel_slopes", f"{POINTS}, q AS (SELECT quantile_cont(z, [0.25, 0.5, 0.75]) AS q FROM points) SELECT CAST(CASE WHEN z <= q[1] THEN 0 WHEN z <= q[2] THEN 1 WHEN z <= q[3] THEN 2 ELSE 3 END AS INT) AS panel, count(*) AS n, {r('regr_slope(value, x)', 'slope_x')}, {r('regr_slope(value, y)', 'slope_y')} FROM points, q GROUP BY 1 HAVING count(*) >= 20")
def a40_panel_slopes(spark: SparkSession, sf: str) -> DataFrame:
    p = views.points(spark, sf)
    q = order.quantile_row(p, "z", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    panel = F.when(F.col("z") <= F.col("q1"), 0).when(F.col("z") <= F.col("q2"), 1).when(F.col("z") <= F.col("q3"), 2).otherwise(3)
    return rounded(p.crossJoin(F.broadcast(q)).groupBy(panel.alias("panel")).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "x").alias("slope_x"), F.regr_slope("value", "y").alias("slope_y")).filter("n >= 20"))


@query("a39_spans", f"{POINTS} SELECT label, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('max(x) - min(x)', 'span_x')}, {r('max(y) - min(y)', 'span_y')}, {r('max(z) - min(z)', 'span_z')} FROM points GROUP BY label")
def a39_spans(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tabulate.spans(views.points(spark, sf), "label", "value"))


@query("a4_a5_decluster", f"{POINTS}, m AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM points WHERE id % 9 > 0), c AS (SELECT p.*, CASE WHEN id % 9 > 0 THEN count(*) OVER (PARTITION BY id % 9 > 0, floor((x - mx) / 0.15), floor((y - my) / 0.15), floor((z - mz) / 0.15)) END AS k FROM points p, m), t AS (SELECT sum(1e0 / k) AS cells, count(k) AS n FROM c) SELECT id, {r('coalesce(n / cells / k, 1)', 'decluster_weight')}, coalesce(k, 1) AS cell_count FROM c, t")
def a4_a5_decluster(spark: SparkSession, sf: str) -> DataFrame:
    p = views.points(spark, sf).withColumn("value", F.when(F.col("id") % 9 > 0, F.col("value")))
    return rounded(samples.decluster(p, (0.15, 0.15, 0.15), "value").select("id", "decluster_weight", "cell_count"))


_NEAR = "nb AS (SELECT * FROM (SELECT t.id AS target, s.id AS sample, s.label, sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z)) AS distance, row_number() OVER (PARTITION BY t.id ORDER BY sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z)), s.id) AS rank FROM points t, points s WHERE t.id % 5 = 0 AND s.id % 5 > 0 AND sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z)) <= 0.12) WHERE rank <= 8)"


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = views.points(spark, sf)
    return p.filter("id % 5 = 0"), p.filter("id % 5 > 0")


@query("j8_neighbours", f"{POINTS}, {_NEAR} SELECT target, sample, {r('distance', 'distance')}, rank FROM nb")
def j8_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    t, s = _split(spark, sf)
    return rounded(pairs.neighbours(t, s, 0.12, 8).select("target", "sample", "distance", F.col("rank").cast("long").alias("rank")))


@query("j7_nearest_label", f"{POINTS}, {_NEAR} SELECT id AS target, label, {r('distance', 'distance')} FROM points LEFT JOIN (SELECT target, label, distance FROM nb WHERE rank = 1) n ON id = target WHERE id % 5 = 0".replace("SELECT id AS target, label,", "SELECT id AS target, n.label,"))
def j7_nearest_label(spark: SparkSession, sf: str) -> DataFrame:
    t, s = _split(spark, sf)
    return rounded(pairs.nearest_label(t, s, 0.12))


_W = ", ".join(f"coalesce((SELECT sum(1 / greatest(distance, 1e-6)) FROM nb WHERE target = p.id AND label % 3 = {c}) + (SELECT avg(CAST(label % 3 = {c} AS INT)) FROM points WHERE id % 5 > 0) * 2, 0)" + (" + coalesce((SELECT min(distance) FROM nb WHERE target = p.id) / 0.12 * 2, 1)" if c == 0 else "") + f" AS w{c}" for c in range(3))


@query("e1_local_shares", f"{POINTS}, {_NEAR}, w AS (SELECT id AS target, {_W} FROM points p WHERE id % 5 = 0) SELECT target, {r('w0 / (w0 + w1 + w2)', 'share_0')}, {r('w1 / (w0 + w1 + w2)', 'share_1')}, {r('w2 / (w0 + w1 + w2)', 'share_2')} FROM w")
def e1_local_shares(spark: SparkSession, sf: str) -> DataFrame:
    t, s = _split(spark, sf)
    return rounded(pairs.local_shares(t, s.withColumn("label", F.col("label") % 3), 0.12, 8, 2.0, 0, [0, 1, 2]))


_PAIRS = "pr AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS h FROM (SELECT b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, (a.value - b.value) * (a.value - b.value) / 2 AS g FROM points a, points b WHERE a.id < b.id)), pd AS (SELECT unnest(['east', 'north']) AS direction, unnest([abs(dx) / h >= cos(radians(22.5)), abs(dy) / h >= cos(radians(22.5))]) AS ok, h, g FROM pr WHERE h < 0.3 AND h > 0), vg AS (SELECT direction, CAST(floor(h / (0.3e0 / 6)) AS INT) AS lag, count(*) AS pairs, avg(h) AS distance, avg(g) AS gamma FROM pd WHERE ok GROUP BY ALL)"


def _variogram(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.variogram(views.points(spark, sf), 0.3, 6, {"east": (1.0, 0.0, 0.0), "north": (0.0, 1.0, 0.0)}, 22.5)


@query("j10_a49_variogram", f"{POINTS}, {_PAIRS} SELECT direction, lag, pairs, {r('distance', 'distance')}, {r('gamma', 'gamma')} FROM vg")
def j10_a49_variogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_variogram(spark, sf))


_DIGEST = "CAST('0x' || substr(md5({0}.id || ':1337'), 1, 8) AS BIGINT)"
_SAMPLED = _PAIRS.replace("WHERE a.id < b.id", f"WHERE a.id < b.id AND ({_DIGEST.format('a')} + {_DIGEST.format('b')}) % 4 = 0")


@query("m9_sampled_variogram", f"{POINTS}, {_SAMPLED} SELECT direction, lag, pairs, {r('distance', 'distance')}, {r('gamma', 'gamma')} FROM vg")
def m9_sampled_variogram(spark: SparkSession, sf: str) -> DataFrame:
    """About a quarter of the pairs, by a seeded digest: the feature is the sample."""
    return rounded(pairs.variogram(views.points(spark, sf), 0.3, 6, {"east": (1.0, 0.0, 0.0), "north": (0.0, 1.0, 0.0)}, 22.5, one_in=4))


@query("a50_lag_shares", f"{POINTS}, {_PAIRS} SELECT direction, lag, pairs, {r('100e0 * pairs / sum(pairs) OVER (PARTITION BY direction)', 'pct')} FROM vg")
def a50_lag_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.lag_shares(_variogram(spark, sf)).select("direction", "lag", "pairs", "pct"))


@query("a51_reproduction", f"{POINTS}, {_PAIRS}, d AS (SELECT direction, count(*) AS lags, count(*) FILTER (pairs >= 200) AS usable, sqrt(avg((gamma - 8) * (gamma - 8)) FILTER (pairs >= 200)) AS rmse, avg(abs(8 - gamma)) FILTER (pairs >= 200) AS mae, avg(8 - gamma) FILTER (pairs >= 200) AS bias FROM vg GROUP BY 1), w AS (SELECT *, CASE WHEN rmse IS NOT NULL THEN CASE direction WHEN 'east' THEN 0.45e0 ELSE 0.4e0 END END AS w FROM d) SELECT direction, lags, usable, {r('rmse', 'rmse')}, {r('mae', 'mae')}, {r('bias', 'bias')}, {r('sum(w * rmse) OVER () / sum(w) OVER ()', 'weighted_rmse')} FROM w")
def a51_reproduction(spark: SparkSession, sf: str) -> DataFrame:
    v = _variogram(spark, sf).select("direction", F.col("gamma").alias("gamma_target"), F.col("pairs").alias("target_pairs"), F.lit(8.0).alias("gamma_sim_mean"))
    return rounded(compare.reproduction(v, {"east": 0.45, "north": 0.4}, 200))


@query("u3_j15_pending", f"{STACK} SELECT r AS real_id FROM (SELECT unnest(range(0, 14)) AS r) WHERE r NOT IN (SELECT real_id FROM stack WHERE real_id <> 3)")
def u3_j15_pending(spark: SparkSession, sf: str) -> DataFrame:
    done = views.stack(spark, sf).filter("real_id <> 3").select(F.col("real_id").cast("long").alias("real_id")).distinct()
    return spark.range(14).select(F.col("id").alias("real_id")).join(done, "real_id", "left_anti")


@query("j16_dense_axis", f"{STACK} SELECT k, CAST(coalesce(count(cell_id), 0) AS BIGINT) AS n FROM (SELECT unnest(range(0, 8)) AS k) LEFT JOIN stack ON iz = k GROUP BY k")
def j16_dense_axis(spark: SparkSession, sf: str) -> DataFrame:
    n = views.stack(spark, sf).groupBy(F.col("iz").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(8).select(F.col("id").alias("k")).join(n, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("g9_grid_cells", "SELECT k AS cell_id, k // 30 AS ix, k // 6 % 5 AS iy, k % 6 AS iz FROM (SELECT unnest(range(0, 120)) AS k)")
def g9_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.grid import cells

    return cells(spark, 4, 5, 6)


@query("t4_t5_largest_spreads", f"{STACK}, {_PCT} SELECT cell_id, {r('p90 - p10', 'spread')} FROM pct ORDER BY round(p90 - p10, 9) DESC, cell_id LIMIT 5")
def t4_t5_largest_spreads(spark: SparkSession, sf: str) -> DataFrame:
    """The five cells of largest spread: the limit is the feature."""
    x = ensemble.cell_percentiles(views.stack(spark, sf)).withColumn("spread", F.round(F.col("p90") - F.col("p10"), 9))
    return rounded(ensemble.largest(x, "spread", 5, ("cell_id",)).select("cell_id", "spread"))


@query("t9_chosen_realisations", f"{STACK} SELECT real_id, count(*) AS n, {r('avg(value)', 'mean')} FROM stack WHERE real_id IN (0, 2, 4, 6, 9) GROUP BY 1")
def t9_chosen_realisations(spark: SparkSession, sf: str) -> DataFrame:
    s = views.stack(spark, sf)
    return rounded(s.filter(F.col("real_id").isin(ensemble.evenly_chosen(10, 5))).groupBy("real_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query("w8_convergence_by_cell", f"{STACK}, s AS (SELECT n, cell_id, avg(CAST(value > 25 AS INT)) AS chance, avg(value) AS mean, var_pop(value) AS variance, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM stack JOIN (SELECT unnest([2, 5, 10]) AS n) ON real_id < n GROUP BY ALL), l AS (UNPIVOT s ON chance, mean, variance, p10, p50, p90 INTO NAME map VALUE v) SELECT a.n AS n_real, a.map, {r('avg(abs(a.v - b.v))', 'mae', 5)}, {r('corr(a.v, b.v)', 'r', 5)} FROM l a JOIN l b ON b.n = 10 AND a.cell_id = b.cell_id AND a.map = b.map GROUP BY ALL")
def w8_convergence_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.convergence_by_cell(views.stack(spark, sf), [2, 5, 10], 25.0), 5)


@query("a34_support_ladder", f"{STACK}, m AS (SELECT 1 AS support, 'std' AS metric, stddev_samp(value) AS value FROM stack UNION ALL SELECT 4, 'std', stddev_samp(v) FROM (SELECT avg(value) AS v FROM stack GROUP BY real_id, ix // 2, iy // 2, iz)) SELECT CAST(support AS INT) AS support, metric, {r('value', 'value')}, {r('value / (SELECT value FROM m WHERE support = 1)', 'relative')} FROM m")
def a34_support_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of values by support, and relative to the finest."""
    s = views.stack(spark, sf)
    one = lambda df, n: df.agg(F.stddev_samp("value").alias("value")).select(F.lit(n).alias("support"), F.lit("std").alias("metric"), "value")
    return rounded(compare.support_ladder(one(s, 1).unionByName(one(ensemble.regularise(s, 2, 2, 1), 4))))
