"""Queries on parameter searches, search ellipsoids, documents, exports and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, ensemble, pairs, reports, search
from . import views
from .registry import query, r, rounded
from .views import with_views


def _values(name: str, values: list) -> str:
    return "(VALUES " + ", ".join(f"({k}, {v})" for k, v in enumerate(values)) + f") AS {name}(k, v)"


_POOLS = ", ".join(_values(n, v) for n, v in zip("abcde", search.POOLS.values(), strict=True))


_METRES = f"{with_views('points')}, v AS (SELECT CAST(floor(h / 25) AS INT) AS lag, count(*) AS n, avg(h) AS d, avg(g) AS gamma FROM (SELECT sqrt((a.x * 500 - b.x * 500) * (a.x * 500 - b.x * 500) + (a.y * 500 - b.y * 500) * (a.y * 500 - b.y * 500) + (a.z * 500 - b.z * 500) * (a.z * 500 - b.z * 500)) AS h, (a.value - b.value) * (a.value - b.value) / 2 AS g FROM points a JOIN points b ON a.id < b.id) WHERE h > 0 AND h < 150 GROUP BY 1)"


@query("e16_candidates", f"{_METRES}, c AS (SELECT (((a.k * 3 + b.k) * 4 + c.k) * 3 + d.k) * 2 + e.k AS candidate, CAST(a.v AS DOUBLE) AS target_range, CAST(b.v AS DOUBLE) AS nugget_ratio, c.v AS normal_range, d.v[1] AS strike_radius, e.v[2] AS most_neighbours FROM {_POOLS}), t AS (SELECT * FROM c ORDER BY md5(candidate || ':1337') LIMIT 60) SELECT t.*, (SELECT round(sqrt(sum(n * pow(12e0 * (1 - (1 - nugget_ratio) * exp(-d / target_range)) - gamma, 2)) / sum(n)), 6) + 0e0 FROM v) AS weighted_rmse FROM t")
def e16_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty of the 360 combinations, the limit being the feature, each held against the points' variogram."""
    p = views.points(spark, sf).withColumns({a: F.col(a) * 500 for a in "xyz"})
    v = pairs.variogram(p, 150.0, 6, {"all": (1.0, 0.0, 0.0)}, 90.0)
    c = search.variogram_errors(search.candidates(spark, 60), v, sill=12.0)
    return rounded(c.select("candidate", "target_range", "nugget_ratio", "normal_range", F.col("search_radii")[0].alias("strike_radius"), F.col("neighbours")[1].alias("most_neighbours"), "weighted_rmse"))


_METRICS = """m AS (SELECT l_suppkey AS candidate, avg(CAST(l_discount AS DOUBLE)) * 10 AS weighted_rmse, avg(CAST(l_tax AS DOUBLE)) * 15 AS along_strike_rmse, count(*) % 6 AS total_missing_lags, avg(CAST(l_tax AS DOUBLE)) - 0.26e0 AS along_strike_bias,
  0.955e0 + l_suppkey % 5 / 100e0 AS hist_overlap, 0.075e0 + l_suppkey % 3 * 0.02e0 AS qq_rmse, 0.45e0 + l_suppkey % 4 / 10e0 AS swath_corr_x, CASE WHEN l_suppkey % 7 > 0 THEN 0.55e0 END AS swath_corr_y, 0.3e0 + l_suppkey % 2 / 10e0 AS swath_corr_z FROM lineitem GROUP BY l_suppkey)"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_suppkey")
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(k.alias("candidate"), "l_suppkey").agg(
        (F.avg(F.col("l_discount").cast("double")) * 10).alias("weighted_rmse"),
        (F.avg(F.col("l_tax").cast("double")) * 15).alias("along_strike_rmse"),
        (F.count(F.lit(1)) % 6).alias("total_missing_lags"),
        (F.avg(F.col("l_tax").cast("double")) - 0.26).alias("along_strike_bias"),
    ).select("*", (0.955 + k % 5 / 100.0).alias("hist_overlap"), (0.075 + k % 3 * 0.02).alias("qq_rmse"), (0.45 + k % 4 / 10.0).alias("swath_corr_x"), F.when(k % 7 > 0, 0.55).alias("swath_corr_y"), (0.3 + k % 2 / 10.0).alias("swath_corr_z"))


_SCORE = """s AS (SELECT *, CAST(hist_overlap < 0.97e0 AS INT) + CAST(qq_rmse > 0.1e0 AS INT) + CAST(swath_corr_x < 0.5e0 AS INT) + CAST(coalesce(swath_corr_y < 0.5e0, true) AS INT) + CAST(swath_corr_z < 0.35e0 AS INT) AS missed FROM m),
  t AS (SELECT candidate, missed = 0 AS ok, missed, weighted_rmse + 1.5e0 * greatest(0, along_strike_rmse - 0.5e0) + 0.05e0 * greatest(0, total_missing_lags - 2) + 0.7e0 * greatest(0, -0.2e0 - along_strike_bias) + 5 * missed + 20 * greatest(0, qq_rmse - 0.1e0) + 20 * greatest(0, 0.97e0 - hist_overlap)
    + 0.4e0 * greatest(0, 0.55e0 - (swath_corr_x + coalesce(swath_corr_y, 0) + swath_corr_z) / 3) AS score FROM s)"""


@query("e16_scores", f"WITH {_METRICS}, {_SCORE} SELECT candidate, ok, missed, {r('score', 'score')} FROM t")
def e16_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = search.scored(_metrics(spark, sf), balanced=True)
    return rounded(x.select("candidate", "ok", F.size("failures").alias("missed"), "score"))


def _ellipsoid(t: str, s: str) -> str:
    d = {c: f"({t}.{c} - {s}.{c})" for c in "xyz"}
    return f"sqrt(pow((0.6e0 * {d['x']} + 0.8e0 * {d['y']}) / 0.2e0, 2) + pow((-0.8e0 * {d['x']} + 0.6e0 * {d['y']}) / 0.1e0, 2) + pow({d['z']} / 0.15e0, 2))"


@query("g3_g4_ellipsoid", f"{with_views('points')}, p AS (SELECT t.id AS target, s.id AS sample, {_ellipsoid('t', 's')} AS distance FROM points t, points s WHERE t.id % 5 = 0 AND s.id % 5 > 0), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, sample) AS rank FROM p WHERE distance <= 1) SELECT target, sample, {r('distance', 'distance')}, rank FROM k WHERE rank <= 6")
def g3_g4_ellipsoid(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours within a turned ellipsoid."""
    p = pairs.search_space(views.points(spark, sf), (0.2, 0.1, 0.15), ((0.6, 0.8, 0.0), (-0.8, 0.6, 0.0), (0.0, 0.0, 1.0)))
    n = pairs.neighbours(p.filter("id % 5 = 0"), p.filter("id % 5 > 0"), 1.0, 6)
    return rounded(n.select("target", "sample", "distance", F.col("rank").cast("long").alias("rank")))


_APART = "sqrt(pow(t.x - s.x, 2) + pow(t.y - s.y, 2) + pow(t.z - s.z, 2))"


@query("j7_nearest_anywhere", f"{with_views('points')}, p AS (SELECT t.id AS target, s.id AS sample, s.label, {_APART} AS distance FROM points t, points s WHERE t.id % 5 = 0 AND s.id % 5 > 0) SELECT target, arg_min(label, (distance, sample)) AS label, {r('min(distance)', 'distance')} FROM p GROUP BY target")
def j7_nearest_anywhere(spark: SparkSession, sf: str) -> DataFrame:
    p = views.points(spark, sf)
    return rounded(pairs.nearest_anywhere(p.filter("id % 5 = 0"), p.filter("id % 5 > 0"), 0.05))


@query("v7_report", f"{with_views('intervals', 'collars')} SELECT 'collar' AS table_name, count(*) AS n, count(DISTINCT hole_id) AS holes, CAST(NULL AS DOUBLE) AS metres, 0 AS faults, true AS passes FROM collars UNION ALL SELECT 'assay', count(*), count(DISTINCT hole_id), sum(to_m - from_m), (SELECT count(*) FROM intervals i JOIN collars c USING (hole_id) WHERE c.x > 0 AND i.to_m > c.total_depth - 3), false FROM intervals")
def v7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with their checks; collars that are three metres short put assays at fault."""
    c, i = views.collars(spark, sf), views.intervals(spark, sf)
    short = c.filter("x > 0").withColumn("total_depth", F.col("total_depth") - 3)
    return checks.report({"collar": c, "assay": i}, [checks.check_collars(c), checks.check_intervals(i, "assay"), checks.check_depths(i, short)])


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.curve_summary(ensemble.cutoff_curve(views.stack(spark, sf), [20.0, 25.0, 30.0], 100.0, 2.0))


_CURVE = "k AS (SELECT unnest([20e0, 25e0, 30e0]) AS cutoff), q AS (SELECT cutoff, real_id, count(*) FILTER (value >= cutoff) AS blocks, coalesce(avg(value) FILTER (value >= cutoff), 0) AS g FROM stack, k GROUP BY ALL), c AS (SELECT cutoff, blocks * 200e0 AS t, g, blocks * 200e0 * g / 100 AS m FROM q)"


@query("p1_key_figures", f"{with_views('stack')}, {_CURVE} SELECT cutoff, " + ", ".join([r(f"quantile_cont(t, {p}) / 1e6", f"tonnage_mt_p{round(100 * p)}") for p in (0.1, 0.5, 0.9)] + [r(f"quantile_cont(g, {p})", f"grade_pct_p{round(100 * p)}") for p in (0.1, 0.5, 0.9)]) + f", {r('quantile_cont(m, 0.5) / 1e6', 'contained_mt_p50')} FROM c WHERE cutoff = 25 GROUP BY cutoff")
def p1_key_figures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.key_figures(_summary(spark, sf), 25.0))


@query("k9_public_columns", f"{with_views('stack')}, {_CURVE} SELECT cutoff, " + ", ".join(r(f"quantile_cont({c}, {p})", f"{n}_p{round(100 * p):02d}") for c, n in (("t", "occupancy_proxy"), ("g", "mean_tgc_above_cutoff")) for p in (0.05, 0.1, 0.5, 0.9, 0.95)) + f", {r('avg(t)', 'occupancy_proxy_mean')}, {r('avg(g)', 'mean_tgc_above_cutoff_mean')}, (SELECT count(*) FROM q WHERE q.cutoff = c.cutoff AND blocks > 0) AS nonzero_count FROM c GROUP BY cutoff")
def k9_public_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.public_columns(_summary(spark, sf)))


@query("p3_document", "SELECT 'orders' AS section, CAST(to_json({'n': count(*), 'clerks': count(DISTINCT o_custkey)}) AS VARCHAR) AS body FROM orders UNION ALL SELECT 'flags', CAST(to_json(list({'flag': f, 'n': n} ORDER BY f)) AS VARCHAR) FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1)")
def p3_document(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("clerks"))
    flags = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return reports.document({"orders": orders}, {"flags": flags})


@query("g24_substituted", "SELECT page_id, '| ' || page_id || ' | ' || coalesce(regexp_replace(regexp_replace(url, '[0-9]+', '#', 'g'), '^https?://', ''), '') || ' |' AS line FROM pages")
def g24_substituted(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", reports.table_row("page_id", reports.substituted("url", [("[0-9]+", "#"), ("^https?://", "")])).alias("line"))


@query("v13_recomputed", f"{with_views('points')}, o AS (SELECT avg(value) AS m, stddev_samp(value) AS s, max(value) AS x FROM points) SELECT metric, {r('kept', 'kept')}, {r('again', 'again')}, agrees FROM (SELECT unnest(['mean', 'std', 'max', 'min']) AS metric, unnest([m, s * 1.01, x, NULL]) AS kept, unnest([m, s, NULL, NULL]) AS again, unnest([true, false, false, false]) AS agrees FROM o) WHERE metric <> 'min'")
def v13_recomputed(spark: SparkSession, sf: str) -> DataFrame:
    p = views.points(spark, sf)
    kept = p.agg(F.avg("value").alias("mean"), (F.stddev_samp("value") * 1.01).alias("std"), F.max("value").alias("max"))
    again = p.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    long = lambda d: d.unpivot([], d.columns, "metric", "value")
    return rounded(reports.recomputed(long(kept), long(again)))


@query("p7_gates", "WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem), g AS (SELECT count(*) AS k FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey % 5) > 1)) SELECT 'folds' AS gate, 5e0 AS found, 5e0 AS wanted, true AS passed UNION ALL SELECT 'groups in several folds', CAST(k AS DOUBLE), 0e0, k = 0 FROM g UNION ALL SELECT 'flags', 3e0, 3e0, true UNION ALL SELECT 'rows', n, n, true FROM n")
def p7_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Folds by order, which split suppliers; flags; and parts that make up the whole."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") % 5).alias("fold"))
    by_flag = x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    gates = reports.fold_gates(x, 5, group="l_suppkey")
    return gates.unionByName(reports.value_gate(x, "flags", "l_returnflag", ["A", "N", "R"])).unionByName(reports.total_gate(by_flag, "rows", "n", x.count()))
