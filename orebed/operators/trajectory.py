"""From survey stations to coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bend, ratio_factor


def first_rows(collars: DataFrame) -> DataFrame:
    """The first row of each hole, in the order of reading."""
    rest = [c for c in collars.columns if c != "hole_id"]
    first = collars.withColumn("_row", F.monotonically_increasing_id()).groupBy("hole_id").agg(F.min_by(F.struct(*rest), "_row").alias("_first"))
    return first.select(*[F.col("hole_id") if c == "hole_id" else F.col(f"_first.{c}").alias(c) for c in collars.columns])


def complete_stations(stations: DataFrame, collars: DataFrame, assays: DataFrame | None = None) -> DataFrame:
    """A station at depth 0 for every hole that has none, like its shallowest.

    A hole without stations goes straight down to the depth of its collar, or
    where that is missing to the end of its last assay; without a depth above 0
    it is left out.  With ``assays`` holes without any are left out as well.
    """
    usable = F.col("total_depth").isNotNull() & ~F.isnan("total_depth")
    holes = first_rows(collars).select("hole_id", F.when(usable, F.col("total_depth")).alias("total_depth"))
    if assays is not None:
        deepest = assays.groupBy("hole_id").agg(F.max("to_m").alias("_deepest"))
        holes = holes.join(deepest, "hole_id").select("hole_id", F.coalesce("total_depth", "_deepest").alias("total_depth"))
        stations = stations.join(deepest.select("hole_id"), "hole_id", "left_semi")
    top = stations.groupBy("hole_id").agg(F.max((F.col("depth") == 0).cast("int")).alias("has"), F.min_by(F.struct("azimuth_deg", "dip_deg"), "depth").alias("first"))
    top = top.filter("has = 0").select("hole_id", F.lit(0.0).alias("depth"), "first.azimuth_deg", "first.dip_deg")
    bare = holes.filter("total_depth > 0").join(stations.select("hole_id"), "hole_id", "left_anti")
    bare = bare.select("hole_id", F.explode(F.array(F.lit(0.0), "total_depth")).alias("depth"), F.lit(0.0).alias("azimuth_deg"), F.lit(-90.0).alias("dip_deg"))
    return stations.select("hole_id", "depth", "azimuth_deg", "dip_deg").unionByName(top).unionByName(bare)


def desurvey(stations: DataFrame, collars: DataFrame, assays: DataFrame | None = None) -> DataFrame:
    """Coordinates of every station by minimum curvature, summed down from the hole's first collar row."""
    down = Window.partitionBy("hole_id").orderBy("depth")
    s = complete_stations(stations, collars, assays)
    inc, az = F.radians(F.col("dip_deg") + 90.0), F.radians("azimuth_deg")
    s = s.select("hole_id", "depth", inc.alias("i1"), az.alias("a1"))
    s = s.withColumns({"i0": F.lag("i1").over(down), "a0": F.lag("a1").over(down), "step": F.col("depth") - F.lag("depth").over(down)})
    half = F.col("step") / 2 * ratio_factor(bend(F.col("i0"), F.col("a0"), F.col("i1"), F.col("a1")))
    east = half * (F.sin("i0") * F.sin("a0") + F.sin("i1") * F.sin("a1"))
    north = half * (F.sin("i0") * F.cos("a0") + F.sin("i1") * F.cos("a1"))
    up = -half * (F.cos("i0") + F.cos("i1"))
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    moved = s.select("hole_id", "depth", *[F.sum(F.coalesce(v, F.lit(0.0))).over(so_far).alias(n) for n, v in (("dx", east), ("dy", north), ("dz", up))])
    return moved.join(first_rows(collars).select("hole_id", "x", "y", "z"), "hole_id").select("hole_id", "depth", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z"))


def locate(samples: DataFrame, path: DataFrame) -> DataFrame:
    """Adds x, y, z at each sample's ``mid`` by linear interpolation between stations; samples
    beyond either end take its place.  One window over stations and samples together."""
    down = Window.partitionBy("hole_id").orderBy("depth")
    here = path.withColumn("station", F.struct("depth", "x", "y", "z")).withColumn("next", F.lead("station").over(down))
    here = here.select("hole_id", "depth", "station", "next", F.lit(None).alias("row"))
    rows = samples.select("hole_id", F.col("mid").alias("depth"), F.struct(*samples.columns).alias("row"))
    both = here.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy("hole_id").orderBy("depth", F.col("station").isNull())
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("station").isNotNull(), F.struct("station", "next"))
    both = both.withColumns({"at": F.last(known, ignorenulls=True).over(seen), "top": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    both = both.filter("row IS NOT NULL AND (at IS NOT NULL OR top IS NOT NULL)")
    share = (F.col("depth") - F.col("at.station.depth")) / (F.col("at.next.depth") - F.col("at.station.depth"))

    def place(c: str):
        return (
            F.when(F.col("at").isNull(), F.col(f"top.station.{c}"))
            .when(F.col("at.next").isNull() | (F.col("at.next.depth") == F.col("at.station.depth")), F.col(f"at.station.{c}"))
            .otherwise(F.col(f"at.station.{c}") + share * (F.col(f"at.next.{c}") - F.col(f"at.station.{c}")))
        )

    return both.select("row.*", place("x").alias("x"), place("y").alias("y"), place("z").alias("z"))
