"""Queries on holes, intervals and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import axis_angle, half_width, inverse_normal_sql, number, unit_vector
from ..operators import checks, intervals, order, samples, tabulate, trajectory
from ..sources import tables
from . import views
from .registry import query, r, rounded
from .views import with_views

ISLANDS = """isl AS (
  SELECT *, min(from_m) OVER (PARTITION BY hole_id, island) AS a, max(to_m) OVER (PARTITION BY hole_id, island) AS b FROM (
    SELECT *, CAST(sum(new) OVER (PARTITION BY hole_id ORDER BY from_m, to_m ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
      SELECT *, CASE WHEN lith_code = lag(lith_code) OVER (PARTITION BY hole_id ORDER BY from_m, to_m) THEN 0 ELSE 1 END AS new FROM intervals)))"""
COMPOSITES = (
    ISLANDS
    + """, bins AS (
  SELECT DISTINCT hole_id, island, lith_code, a + 2 * k AS lo, least(a + 2 * k + 2, b) AS hi FROM (
    SELECT DISTINCT hole_id, island, lith_code, a, b, unnest(range(0, CAST(ceil((b - a) / 2) AS BIGINT))) AS k FROM isl)
), composites AS (
  SELECT x.hole_id, x.lith_code, lo AS from_m, hi AS to_m, hi - lo AS length,
    sum(grade * (least(to_m, hi) - greatest(from_m, lo))) / sum(least(to_m, hi) - greatest(from_m, lo)) AS grade
  FROM bins x JOIN isl i ON x.hole_id = i.hole_id AND x.island = i.island AND least(to_m, hi) - greatest(from_m, lo) > 0.001
  WHERE hi - lo >= 0.5 GROUP BY x.hole_id, x.lith_code, x.island, lo, hi)"""
)


@query("w2_islands", f"{with_views('intervals')}, {ISLANDS} SELECT hole_id, island, lith_code, a AS island_from, b AS island_to, count(*) AS n FROM isl GROUP BY ALL")
def w2_islands(spark: SparkSession, sf: str) -> DataFrame:
    x = intervals.islands(views.intervals(spark, sf))
    return x.groupBy("hole_id", F.col("island").cast("long").alias("island"), "lith_code", "island_from", "island_to").agg(F.count(F.lit(1)).alias("n"))


def composites(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.composites(views.intervals(spark, sf))


@query("w3_composites", f"{with_views('intervals')}, {COMPOSITES} SELECT hole_id, lith_code, from_m, to_m, length, {r('grade', 'grade')} FROM composites")
def w3_composites(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(composites(spark, sf))


_STATS = "count(*) AS n, " + ", ".join([r("avg(grade)", "mean"), r("stddev_samp(grade)", "std"), r("CASE WHEN avg(grade) > 0 THEN stddev_samp(grade) / avg(grade) ELSE 0e0 END", "cv"), r("min(grade)", "least"), r("max(grade)", "most"), r("median(grade)", "median"), r("avg(CAST(grade >= 3 AS INT))", "share_3")])


@query("a2_group_stats", f"{with_views('intervals')}, {COMPOSITES} SELECT lith_code, {_STATS} FROM composites GROUP BY lith_code")
def a2_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(samples.group_stats(composites(spark, sf), ["lith_code"], "grade"))


@query("a35_grade_by_category", f"{with_views('intervals')} SELECT hole_id, lith_code, {_STATS} FROM intervals GROUP BY ALL HAVING count(*) >= 12")
def a35_grade_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(samples.group_stats(views.intervals(spark, sf), ["hole_id", "lith_code"], "grade", least=12))


@query("a3_value_counts", f"{with_views('intervals')} SELECT lith_code, CASE WHEN grade >= 50 THEN 'high' ELSE 'low' END AS class, count(*) AS n, CAST(grouping(lith_code) * 2 + grouping(class) AS BIGINT) AS level FROM intervals GROUP BY GROUPING SETS ((lith_code), (class), (lith_code, class))")
def a3_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = views.intervals(spark, sf).withColumn("class", F.when(F.col("grade") >= 50, "high").otherwise("low"))
    sets = [[F.col("lith_code")], [F.col("class")], [F.col("lith_code"), F.col("class")]]
    return x.groupingSets(sets, "lith_code", "class").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


@query("a36_logged_length", f"{with_views('intervals')} SELECT lith_code, sum(length) AS metres, {r('100 * sum(length) / sum(sum(length)) OVER ()', 'pct')} FROM intervals GROUP BY lith_code")
def a36_logged_length(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tabulate.shares(views.intervals(spark, sf), ["lith_code"], "length", "metres", "pct", 100.0))


@query("a37_domain_summary", f"{with_views('intervals')} SELECT lith_code, count(*) AS n, count(DISTINCT hole_id) AS holes, {r('avg(grade)', 'mean')}, {r('median(grade)', 'median')}, {r('count(*) / sum(count(*)) OVER ()', 'share')}, {r('avg(CAST(grade >= 50 AS INT))', 'share_rich')} FROM intervals GROUP BY lith_code")
def a37_domain_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tabulate.domain_summary(views.intervals(spark, sf), ["lith_code"], "grade", "hole_id", {"share_rich": F.col("grade") >= 50}))


@query("a37_two_keys", f"{with_views('intervals')} SELECT lith_code, CASE WHEN from_m < 50 THEN 'upper' ELSE 'lower' END AS part, count(*) AS n, count(DISTINCT hole_id) AS holes, {r('avg(grade)', 'mean')}, {r('median(grade)', 'median')}, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM intervals GROUP BY ALL")
def a37_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    x = views.intervals(spark, sf).withColumn("part", F.when(F.col("from_m") < 50, "upper").otherwise("lower"))
    return rounded(tabulate.domain_summary(x, ["lith_code", "part"], "grade", "hole_id"))


@query("a48_length_histogram", f"{with_views('intervals')}, {COMPOSITES} SELECT least(CAST(floor((length - 0.5) / 0.05) AS BIGINT), 29) AS bin, count(*) AS n FROM composites GROUP BY ALL")
def a48_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return composites(spark, sf).groupBy(F.least(F.floor((F.col("length") - 0.5) / 0.05), F.lit(29)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("a47_depth_means", f"{with_views('intervals')} SELECT CAST(least(floor((from_m - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n, {r('avg(grade)', 'mean')} FROM intervals, (SELECT min(from_m) AS lo, max(from_m) AS hi FROM intervals) GROUP BY ALL")
def a47_depth_means(spark: SparkSession, sf: str) -> DataFrame:
    x = views.intervals(spark, sf)
    ends = x.agg(F.min("from_m").alias("lo"), F.max("from_m").alias("hi"))
    k = F.least(F.floor((F.col("from_m") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20)), F.lit(19)).cast("long")
    return rounded(x.crossJoin(F.broadcast(ends)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("grade").alias("mean")))


_STABBED = "best AS (SELECT event_id, lith FROM (SELECT i.event_id, l.lith_code AS lith, row_number() OVER (PARTITION BY i.event_id ORDER BY l.from_m, l.lith_id) AS k FROM intervals i JOIN lithology l ON i.hole_id = l.hole_id AND (i.from_m + i.to_m) / 2 >= l.from_m AND (i.from_m + i.to_m) / 2 < l.to_m) WHERE k = 1)"


@query("j4_stab", f"{with_views('intervals', 'lithology')}, {_STABBED} SELECT i.event_id, i.hole_id, coalesce(lith, 'UNKNOWN') AS lith FROM intervals i LEFT JOIN best USING (event_id)")
def j4_stab(spark: SparkSession, sf: str) -> DataFrame:
    p = views.intervals(spark, sf).select(F.col("event_id").alias("point_id"), "hole_id", ((F.col("from_m") + F.col("to_m")) / 2).alias("mid"))
    out = intervals.stab(p, views.lithology(spark, sf).withColumnRenamed("lith_code", "lith"), "lith", tie="lith_id")
    return out.select(F.col("point_id").alias("event_id"), "hole_id", F.coalesce("lith", F.lit("UNKNOWN")).alias("lith"))


@query("j4_own_code", f"{with_views('intervals', 'lithology')}, {_STABBED} SELECT i.event_id, i.hole_id, coalesce(b.lith, CASE WHEN i.event_id % 2 = 0 THEN i.lith_code END, 'UNKNOWN') AS lith FROM intervals i LEFT JOIN best b USING (event_id)")
def j4_own_code(spark: SparkSession, sf: str) -> DataFrame:
    """Logged code at each interval's middle, else its own code, of which every other one is missing."""
    own = F.when(F.col("event_id") % 2 == 0, F.col("lith_code")).otherwise(F.when(F.col("event_id") % 3 > 0, "nan"))
    p = views.intervals(spark, sf).select(F.col("event_id").alias("point_id"), "hole_id", ((F.col("from_m") + F.col("to_m")) / 2).alias("mid"), own.alias("own"))
    out = intervals.stab(p, views.lithology(spark, sf).withColumnRenamed("lith_code", "lith"), "lith", tie="lith_id", own="own", unknown="UNKNOWN")
    return out.select(F.col("point_id").alias("event_id"), "hole_id", "lith")


@query("j5_most_overlap", f"{with_views('intervals', 'lithology')}, best AS (SELECT event_id, lith, part FROM (SELECT i.event_id, l.lith_code AS lith, least(i.to_m, l.to_m) - greatest(i.from_m, l.from_m) AS part, row_number() OVER (PARTITION BY i.event_id ORDER BY least(i.to_m, l.to_m) - greatest(i.from_m, l.from_m) DESC, l.lith_id) AS k FROM intervals i JOIN lithology l ON i.hole_id = l.hole_id AND least(i.to_m, l.to_m) > greatest(i.from_m, l.from_m)) WHERE k = 1) SELECT i.event_id, lith, coalesce(part, 0e0) AS overlap_m, part IS NOT NULL AS matched FROM intervals i LEFT JOIN best USING (event_id)")
def j5_most_overlap(spark: SparkSession, sf: str) -> DataFrame:
    base = views.intervals(spark, sf).select(F.col("event_id").alias("base_id"), "hole_id", "from_m", "to_m")
    out = intervals.most_overlap(base, views.lithology(spark, sf).withColumnRenamed("lith_code", "lith"), "lith", tie="lith_id")
    return out.select(F.col("base_id").alias("event_id"), "lith", "overlap_m", "matched")


@query("a38_coverage", f"{with_views('intervals', 'lithology')}, {_STABBED} SELECT {r('100 * avg(CAST(lith IS NOT NULL AS INT))', 'matched_pct')}, {r('100 * avg(CAST(grade IS NOT NULL AS INT))', 'graded_pct')} FROM intervals LEFT JOIN best USING (event_id)")
def a38_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.compare import coverage

    x = j4_stab(spark, sf).join(views.intervals(spark, sf).select("event_id", "grade"), "event_id")
    return rounded(coverage(x, {"matched_pct": F.col("lith") != "UNKNOWN", "graded_pct": F.col("grade").isNotNull()}))


_CONTACTS = "marked AS (SELECT *, lith_code IN ('click', 'error') AS c FROM intervals), contacts AS (SELECT hole_id, to_m AS d FROM (SELECT *, lead(c) OVER w AS nc, lead(from_m) OVER w AS nf FROM marked WINDOW w AS (PARTITION BY hole_id ORDER BY from_m, to_m)) WHERE c <> nc AND abs(nf - to_m) <= 0.25), near AS (SELECT event_id, c, grade, d, (from_m + to_m) / 2 - d AS s FROM (SELECT m.*, k.d, row_number() OVER (PARTITION BY event_id ORDER BY abs((from_m + to_m) / 2 - k.d), k.d) AS r FROM marked m JOIN contacts k ON m.hole_id = k.hole_id) WHERE r = 1 AND abs((from_m + to_m) / 2 - d) <= 10)"


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.contact_distances(views.intervals(spark, sf), F.col("lith_code").isin("click", "error"))


@query("w6_contact_distance", f"{with_views('intervals')}, {_CONTACTS} SELECT event_id, d AS contact_depth_m, s AS signed_distance_m FROM near")
def w6_contact_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _contacts(spark, sf).select("event_id", "contact_depth_m", "signed_distance_m")


@query("a26_contact_profile", f"{with_views('intervals')}, {_CONTACTS} SELECT c AS inside, CASE WHEN abs(s) < 2 THEN '0-2' WHEN abs(s) < 5 THEN '2-5' ELSE '5-10' END AS distance_bin, count(*) AS n, {r('avg(grade)', 'mean')}, {r('stddev_samp(grade)', 'std')} FROM near WHERE abs(s) < 10 GROUP BY ALL")
def a26_contact_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = F.abs("signed_distance_m")
    x = _contacts(spark, sf).filter(d < 10)
    return rounded(x.groupBy(F.col("category").alias("inside"), F.when(d < 2, "0-2").when(d < 5, "2-5").otherwise("5-10").alias("distance_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("grade").alias("mean"), F.stddev_samp("grade").alias("std")))


@query("a27_weathering_summary", f"{with_views('intervals')} SELECT {r('avg(CASE WHEN lith_code = $$error$$ THEN grade END)', 'weathered')}, {r('avg(CASE WHEN lith_code <> $$error$$ THEN grade END)', 'fresh')}, {r('100 * (avg(CASE WHEN lith_code = $$error$$ THEN grade END) / avg(CASE WHEN lith_code <> $$error$$ THEN grade END) - 1)', 'difference_pct')} FROM intervals".replace("$$", "'"))
def a27_weathering_summary(spark: SparkSession, sf: str) -> DataFrame:
    w, f = F.avg(F.when(F.col("lith_code") == "error", F.col("grade"))), F.avg(F.when(F.col("lith_code") != "error", F.col("grade")))
    return rounded(views.intervals(spark, sf).agg(w.alias("weathered"), f.alias("fresh"), (100 * (w / f - 1)).alias("difference_pct")))


_COMPLETE = "full_stations AS (SELECT * FROM stations UNION ALL SELECT hole_id, 0e0, azimuth_deg, dip_deg FROM (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY depth) AS k FROM stations) WHERE k = 1 AND depth > 0 UNION ALL SELECT hole_id, unnest([0e0, total_depth]), 0e0, -90e0 FROM collars ANTI JOIN stations USING (hole_id))"
_PATH = """ang AS (
  SELECT hole_id, depth, radians(dip_deg + 90) AS i1, radians(azimuth_deg) AS a1, lag(radians(dip_deg + 90)) OVER w AS i0, lag(radians(azimuth_deg)) OVER w AS a0, depth - lag(depth) OVER w AS step
  FROM full_stations WINDOW w AS (PARTITION BY hole_id ORDER BY depth)
), seg AS (
  SELECT *, step / 2 * CASE WHEN bend < 1e-6 THEN 1 ELSE 2 / bend * tan(bend / 2) END AS h FROM (
    SELECT *, acos(greatest(-1e0, least(1e0, cos(i1 - i0) - sin(i0) * sin(i1) * (1 - cos(a1 - a0))))) AS bend FROM ang)
), path AS (
  SELECT s.hole_id, depth, x + sum(coalesce(h * (sin(i0) * sin(a0) + sin(i1) * sin(a1)), 0)) OVER w AS x, y + sum(coalesce(h * (sin(i0) * cos(a0) + sin(i1) * cos(a1)), 0)) OVER w AS y, z + sum(coalesce(-h * (cos(i0) + cos(i1)), 0)) OVER w AS z
  FROM seg s JOIN collars c ON s.hole_id = c.hole_id WINDOW w AS (PARTITION BY s.hole_id ORDER BY depth ROWS UNBOUNDED PRECEDING))"""


def _path(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.desurvey(views.stations(spark, sf), views.collars(spark, sf))


@query("w1_desurvey", f"{with_views('collars', 'stations')}, {_COMPLETE}, {_PATH} SELECT hole_id, depth, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM path")
def w1_desurvey(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_path(spark, sf))


@query("j2_station_fallback", f"{with_views('collars', 'stations')}, {_COMPLETE} SELECT * FROM full_stations")
def j2_station_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.complete_stations(views.stations(spark, sf), views.collars(spark, sf))


@query(
    "j3_locate",
    f"""{with_views('collars', 'stations')}, {_COMPLETE}, {_PATH}, m AS (SELECT event_id, hole_id, (from_m + to_m) / 2 AS mid FROM intervals), b AS (
  SELECT m.*, p.depth AS d0, p.x AS x0, p.y AS y0, p.z AS z0, p.d1, p.x1, p.y1, p.z1, row_number() OVER (PARTITION BY event_id ORDER BY p.depth DESC) AS k
  FROM m JOIN (SELECT *, lead(depth) OVER w AS d1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM path WINDOW w AS (PARTITION BY hole_id ORDER BY depth)) p ON m.hole_id = p.hole_id AND p.depth <= m.mid)
SELECT event_id, {r('CASE WHEN d1 IS NULL THEN x0 ELSE x0 + (mid - d0) / (d1 - d0) * (x1 - x0) END', 'x')}, {r('CASE WHEN d1 IS NULL THEN y0 ELSE y0 + (mid - d0) / (d1 - d0) * (y1 - y0) END', 'y')}, {r('CASE WHEN d1 IS NULL THEN z0 ELSE z0 + (mid - d0) / (d1 - d0) * (z1 - z0) END', 'z')} FROM b WHERE k = 1""",
)
def j3_locate(spark: SparkSession, sf: str) -> DataFrame:
    m = views.intervals(spark, sf).select("event_id", "hole_id", ((F.col("from_m") + F.col("to_m")) / 2).alias("mid"))
    return rounded(trajectory.locate(m, _path(spark, sf)).select("event_id", "x", "y", "z"))


_FAULTY = "faulty AS (SELECT hole_id, CASE WHEN event_id % 50 = 0 THEN to_m WHEN event_id % 70 = 0 THEN from_m - 1 ELSE from_m END AS from_m, to_m, event_id FROM intervals)"


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    x = views.intervals(spark, sf)
    return x.withColumn("from_m", F.when(F.col("event_id") % 50 == 0, F.col("to_m")).when(F.col("event_id") % 70 == 0, F.col("from_m") - 1).otherwise(F.col("from_m")))


@query("v3_v4_interval_checks", f"{with_views('intervals')}, {_FAULTY}, o AS (SELECT hole_id, from_m < lag(to_m) OVER (PARTITION BY hole_id ORDER BY from_m, to_m) AS over_, to_m <= from_m AS bad FROM faulty) SELECT 'assay' AS table_name, 'no_length' AS rule, (SELECT count(*) FROM o WHERE bad) AS n UNION ALL SELECT 'assay', 'overlapping_holes', (SELECT count(DISTINCT hole_id) FROM o WHERE over_)")
def v3_v4_interval_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_intervals(_faulty(spark, sf), "assay")


@query("v1_collar_checks", f"{with_views('collars')}, f AS (SELECT * FROM collars UNION ALL SELECT hole_id, NULL, y, z, total_depth FROM collars WHERE x = 0) SELECT 'collar' AS table_name, unnest(['duplicate_ids', 'no_place', 'no_id']) AS rule, unnest([count(*) - count(DISTINCT hole_id), count(*) FILTER (x IS NULL), 0]) AS n FROM f")
def v1_collar_checks(spark: SparkSession, sf: str) -> DataFrame:
    c = views.collars(spark, sf)
    return checks.check_collars(c.unionByName(c.filter("x = 0").withColumn("x", F.lit(None).cast("double"))))


@query("v2_survey_checks", f"{with_views('stations')}, f AS (SELECT hole_id, depth, azimuth_deg + 10 AS azimuth_deg, dip_deg - 2 AS dip_deg FROM stations UNION ALL SELECT * FROM stations WHERE azimuth_deg < 20) SELECT 'survey' AS table_name, unnest(['repeated_depth', 'azimuth', 'dip']) AS rule, unnest([count(*) - count(DISTINCT (hole_id, depth)), count(*) FILTER (azimuth_deg > 360), count(*) FILTER (dip_deg < -90)]) AS n FROM f")
def v2_survey_checks(spark: SparkSession, sf: str) -> DataFrame:
    s = views.stations(spark, sf)
    return checks.check_stations(s.withColumns({"azimuth_deg": F.col("azimuth_deg") + 10, "dip_deg": F.col("dip_deg") - 2}).unionByName(s.filter("azimuth_deg < 20")))


@query("v5_below_hole", f"{with_views('collars')} SELECT 'assay' AS table_name, 'below_hole' AS rule, count(*) AS n FROM intervals i JOIN collars c USING (hole_id) WHERE c.x > 0 AND i.to_m > c.total_depth - 3")
def v5_below_hole(spark: SparkSession, sf: str) -> DataFrame:
    c = views.collars(spark, sf).filter("x > 0").withColumn("total_depth", F.col("total_depth") - 3)
    return checks.check_depths(views.intervals(spark, sf), c)


@query("v7_summary", f"{with_views('intervals')} SELECT count(DISTINCT hole_id) AS holes, count(*) AS n, sum(to_m - from_m) AS metres FROM intervals")
def v7_summary(spark: SparkSession, sf: str) -> DataFrame:
    return checks.summary(views.intervals(spark, sf))


@query("v8_box_cover", f"{with_views('points')} SELECT {r('100 * avg(CAST(x BETWEEN -0.1 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AS INT))', 'inside_pct')}, {r('greatest(0, least(max(x), 0.2) - greatest(min(x), -0.1)) / (max(x) - min(x))', 'overlap_x')}, {r('greatest(0, least(max(y), 0.2) - greatest(min(y), -0.2)) / (max(y) - min(y))', 'overlap_y')} FROM points")
def v8_box_cover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checks.box_cover(views.points(spark, sf), {"x": (-0.1, 0.2), "y": (-0.2, 0.2)}))


@query("s7_normalise_survey", f"{with_views('stations')} SELECT hole_id, CASE WHEN depth > 50 THEN NULL ELSE depth END AS depth, azimuth_deg, dip_deg FROM stations")
def s7_normalise_survey(spark: SparkSession, sf: str) -> DataFrame:
    """A vendor's table: other headers, text, unreadable numbers, dips counted downwards."""
    s = views.stations(spark, sf).select(F.concat(F.lit(" "), "hole_id").alias(" BHID"), F.when(F.col("depth") > 50, "n/a").otherwise(F.col("depth").cast("string")).alias("At "), F.col("azimuth_deg").cast("string").alias("BRG"), (-F.col("dip_deg")).cast("string").alias("Dip"))
    return tables.normalise(s, "survey").select("hole_id", "depth", "azimuth_deg", "dip_deg")


@query("s5_s6_cleaning", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS text_value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS number_value FROM events")
def s5_s6_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalar import cleaned

    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.when(F.col("event_id") % 4 == 0, F.element_at(F.array(F.lit(" "), F.lit("nan "), F.lit("None")), (F.floor(F.col("event_id") / 4) % 3 + 1).cast("int"))).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    num = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "NaN").otherwise("x1")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", cleaned(text).alias("text_value"), number(num).alias("number_value"))


@query("g1_unit_vectors", f"{with_views('stations')} SELECT hole_id, depth, {r('sin(radians(azimuth_deg)) * cos(radians(dip_deg))', 'east')}, {r('cos(radians(azimuth_deg)) * cos(radians(dip_deg))', 'north')}, {r('-sin(radians(dip_deg))', 'up')} FROM stations")
def g1_unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e, n, u = unit_vector(F.col("azimuth_deg"), F.col("dip_deg"))
    return rounded(views.stations(spark, sf).select("hole_id", "depth", e.alias("east"), n.alias("north"), u.alias("up")))


@query("g14_axis_angle", f"{with_views('stations')} SELECT hole_id, depth, {r('abs(((azimuth_deg - 30 + 90) - 180 * floor((azimuth_deg - 30 + 90) / 180)) - 90)', 'angle')} FROM stations")
def g14_axis_angle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.stations(spark, sf).select("hole_id", "depth", axis_angle(F.col("azimuth_deg"), F.lit(30.0)).alias("angle")))


# Codes as they are logged, with blanks, aliases, other cases and codes that only the fallback rules know.
_CODES = ["GRSC", " GRSC2 ", "SAP", "sapr", "SAPR (GRSC2)", "GRSC-3", "SAPROCK GRSC9", "xgrscx", "QV", "grsc"]
_CODED = "coded AS (SELECT *, CASE WHEN event_id % 11 < 10 THEN [" + ", ".join(f"'{c}'" for c in _CODES) + "][event_id % 11 + 1] END AS code FROM intervals)"


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("event_id") % 11).cast("int")
    return views.intervals(spark, sf).withColumn("code", F.when(k < 10, F.element_at(F.array(*map(F.lit, _CODES)), k + 1)))


@query("g15_categories", f"{with_views('intervals')}, {_CODED} SELECT CASE WHEN code IS NULL OR code = 'QV' THEN 'host_waste' WHEN trim(code) IN ('GRSC', 'GRSC2', 'GRSC-3', 'xgrscx', 'grsc') THEN 'fresh_graphitic' ELSE 'weathered_graphitic' END AS domain_group, count(*) AS n FROM coded GROUP BY ALL")
def g15_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _coded(spark, sf).groupBy(samples.category(F.col("code")).alias("domain_group")).agg(F.count(F.lit(1)).alias("n"))


@query("g16_g17_study_domains", f"{with_views('intervals')}, {_CODED} SELECT CASE WHEN upper(code) LIKE 'SAP%' THEN 'weathered' ELSE 'fresh' END AS weathering, CASE trim(code) WHEN 'GRSC' THEN 'GRSC' WHEN 'GRSC2' THEN 'GRSC2' WHEN 'SAP' THEN 'weathered_graphitic' WHEN 'SAPR (GRSC2)' THEN 'weathered_graphitic' WHEN 'GRSC-3' THEN 'mixed_graphitic_supplementary' WHEN 'SAPROCK GRSC9' THEN 'mixed_graphitic_supplementary' ELSE 'other_non_graphitic' END AS domain, CASE WHEN trim(code) IN ('GRSC', 'GRSC2', 'SAP', 'SAPR (GRSC2)') THEN 'primary' WHEN trim(code) IN ('GRSC-3', 'SAPROCK GRSC9') THEN 'supplementary' ELSE 'excluded' END AS tier, CASE event_id % 4 WHEN 0 THEN 'HW' WHEN 1 THEN 'MW' ELSE 'UW_plus_other' END AS bin, count(*) AS n FROM coded GROUP BY ALL")
def g16_g17_study_domains(spark: SparkSession, sf: str) -> DataFrame:
    name, tier = samples.study_domain(F.col("code"))
    raw = F.element_at(F.array(F.lit(" hw"), F.lit("MW"), F.lit("UW"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    x = _coded(spark, sf).select(samples.weathering(F.col("code")).alias("weathering"), name.alias("domain"), tier.alias("tier"), samples.weathering_bin(raw).alias("bin"))
    return x.groupBy("weathering", "domain", "tier", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("g18_top_cut", f"{with_views('intervals')} SELECT event_id, {r('least(grade, cap)', 'grade')}, least(grade, cap) >= cap AS capped FROM intervals, (SELECT quantile_cont(grade, 0.95) AS cap FROM intervals)")
def g18_top_cut(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(samples.top_cut(views.intervals(spark, sf), "grade", 0.95).select("event_id", "grade", "capped"))


@query("g19_log_grade", f"{with_views('intervals')} SELECT event_id, {r('ln(1 + greatest(grade - 5, 0))', 'log_grade')} FROM intervals")
def g19_log_grade(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.intervals(spark, sf).select("event_id", F.log1p(F.greatest(F.col("grade") - 5, F.lit(0.0))).alias("log_grade")))


@query("g21_half_width", f"{with_views('intervals')} SELECT lith_code, {r('greatest(abs(quantile_cont(grade, 0.9) - median(grade)), abs(median(grade) - quantile_cont(grade, 0.1))) / median(grade)', 'half_width')} FROM intervals GROUP BY ALL")
def g21_half_width(spark: SparkSession, sf: str) -> DataFrame:
    q = views.intervals(spark, sf).groupBy("lith_code").agg(*[F.percentile("grade", F.lit(p)).alias(n) for n, p in (("lo", 0.1), ("mid", 0.5), ("hi", 0.9))])
    return rounded(q.select("lith_code", half_width(F.col("lo"), F.col("mid"), F.col("hi")).alias("half_width")))


@query("m1_normal_scores", f"{with_views('intervals')}, v AS (SELECT grade, count(*) AS n FROM intervals GROUP BY 1), p AS (SELECT grade, greatest(1e-6, least(1 - 1e-6, (sum(n) OVER (ORDER BY grade ROWS UNBOUNDED PRECEDING) - 0.5e0) / sum(n) OVER ())) AS p FROM v) SELECT event_id, {r(inverse_normal_sql('p'), 'score')} FROM intervals JOIN p USING (grade)")
def m1_normal_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(samples.normal_scores(views.intervals(spark, sf), "grade").select("event_id", "score"))


@query("m16_rank_sums", f"{with_views('intervals')}, k AS (SELECT lith_code, grade FROM intervals), d AS (SELECT a.lith_code AS a, b.lith_code AS b, sum(CASE WHEN a.grade > b.grade THEN 1e0 WHEN a.grade = b.grade THEN 0.5e0 ELSE 0 END) AS u, 2 * sum(CASE WHEN a.grade > b.grade THEN 1e0 WHEN a.grade = b.grade THEN 0.5e0 ELSE 0 END) / count(*) - 1 AS delta FROM k a JOIN k b ON a.lith_code < b.lith_code GROUP BY ALL) SELECT a, b, {r('u', 'u')}, {r('delta', 'delta')}, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS size FROM d")
def m16_rank_sums(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(samples.rank_sums(views.intervals(spark, sf), "grade", "lith_code").select("a", "b", "u", "delta", "size"))


@query("m16_kruskal", f"{with_views('intervals')}, k AS (SELECT lith_code, rank() OVER (ORDER BY grade) + (count(*) OVER (PARTITION BY grade) - 1) / 2e0 AS rk, grade FROM intervals), t AS (SELECT sum(n * n * n - n) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY grade)), g AS (SELECT lith_code, count(*) AS n, sum(rk) AS s FROM k GROUP BY 1), h AS (SELECT sum(n) AS n, count(*) AS c, (12 / (sum(n) * (sum(n) + 1e0)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - (SELECT ties FROM t) / (sum(n) * 1e0 * sum(n) * sum(n) - sum(n))) AS h FROM g) SELECT CAST(n AS BIGINT) AS n, CAST(c AS INT) AS groups, {r('h', 'h', 5)}, {r('(h - c + 1) / (n - c)', 'epsilon_squared')} FROM h")
def m16_kruskal(spark: SparkSession, sf: str) -> DataFrame:
    x = samples.kruskal(views.intervals(spark, sf), "grade", "lith_code")
    return x.select("n", "groups", (F.round("h", 5) + 0.0).alias("h"), (F.round("epsilon_squared", 6) + 0.0).alias("epsilon_squared"))


@query("t1_sorted_rows", f"{with_views('intervals')} SELECT hole_id, from_m, row_number() OVER (ORDER BY hole_id, from_m, to_m, event_id) AS k FROM intervals")
def t1_sorted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rows by hole and depth, with their place in that order."""
    keys = ["hole_id", "from_m", "to_m", "event_id"]
    placed = order.running(views.intervals(spark, sf).select(*keys), keys, {"k": F.lit(1)})
    return placed.sort(*keys).select("hole_id", "from_m", F.col("k").cast("long").alias("k"))


@query("s8_vendor_tables", f"{with_views('collars')} SELECT hole_id, unnest([0e0, coalesce(CASE WHEN x > 100 THEN total_depth END, 100)]) AS depth, 0e0 AS azimuth_deg, -90e0 AS dip_deg FROM collars WHERE x >= 100")
def s8_vendor_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A vendor's collars, known by position, and the vertical stations that stand in for a missing survey."""
    c = views.collars(spark, sf).select(F.when(F.col("x") >= 100, F.concat(F.lit(" "), "hole_id")).alias("Hole No"), F.col("x").cast("string").alias("E"), F.col("y").cast("string").alias("N"), F.when(F.col("x") > 100, F.col("total_depth").cast("string")).otherwise("-").alias("EOH"))
    return tables.straight_down(tables.from_vendor(c, {"hole_id": 0, "x": 1, "y": 2, "total_depth": 3}, "collar"))


@query("s15_s17_reference_data", "SELECT CAST(p_partkey AS DOUBLE) AS x, p_retailprice AS grade FROM part WHERE p_size % 2 = 0")
def s15_s17_reference_data(spark: SparkSession, sf: str) -> DataFrame:
    """The first table that has the columns, as numbers under our names, complete rows only."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("X"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("TGC_%"))
    return tables.reference_data(tables.first_with([p.select("X"), p], {"X", "TGC_%"}), {"x": "X", "grade": "TGC_%"})
