"""Drillhole tables and block models: reading, header and type normalisation."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cleaned, number
from .files import read_text, write_text
from .scratch import scratch

# Names that vendors give to the columns.
SYNONYMS = {
    "collar": {"bhid": "hole_id", "easting": "x", "northing": "y", "elevation (m)": "z", "elevation": "z", "final_depth (m)": "total_depth", "final_depth": "total_depth"},
    "survey": {"bhid": "hole_id", "at": "depth", "depth_m": "depth", "final_depth": "depth", "final_depth (m)": "depth", "brg": "azimuth_deg", "azimuth": "azimuth_deg", "dip": "dip_deg", "angle": "dip_deg"},
    "assay": {"bhid": "hole_id", "from": "from_m", "to": "to_m", "graphitic carbon": "tgc_pct", "predicted_value": "tgc_pct", "tgc_%": "tgc_pct", "tgc": "tgc_pct", "litho code": "lith_code"},
    "lithology": {"bhid": "hole_id", "from": "from_m", "to": "to_m", "litho": "lith_code", "lithology": "lith_code"},
    "blocks": {"_x": "x", "_y": "y", "_z": "z", "tgc_%": "grade"},
}
NUMBERS = {
    "collar": ("x", "y", "z", "total_depth"),
    "survey": ("depth", "azimuth_deg", "dip_deg"),
    "assay": ("from_m", "to_m", "tgc_pct"),
    "lithology": ("from_m", "to_m"),
    "blocks": ("x", "y", "z", "grade", "density", "sx", "sy", "sz"),
}
TEXTS = {"collar": ("hole_id",), "survey": ("hole_id",), "assay": ("hole_id", "lith_code"), "lithology": ("hole_id", "lith_code", "weathering"), "blocks": ()}
FILES = {"collar": ("collar.csv",), "survey": ("survey.csv",), "assay": ("assay.csv", "assays.csv"), "lithology": ("lithology.csv",)}
TOKENS = {"collar": ("collar",), "survey": ("survey",), "assay": ("assay",), "lithology": ("litho",)}


def plain_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename a column where it exists and its new name does not yet."""
    for old, new in mapping.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def normalise(df: DataFrame, kind: str) -> DataFrame:
    """Headers, synonyms, numbers and texts of one table.  A survey whose dips are all 0 or
    more gets them negated: one aggregate of one row decides for the table."""
    df = renamed(plain_headers(df), SYNONYMS[kind])
    df = df.withColumns({c: number(F.col(c).cast("string")) for c in NUMBERS[kind] if c in df.columns} | {c: cleaned(F.col(c).cast("string")) for c in TEXTS[kind] if c in df.columns})
    if kind == "survey" and "dip_deg" in df.columns:
        least = df.agg(F.min("dip_deg").alias("least_dip"))
        df = df.crossJoin(F.broadcast(least)).withColumn("dip_deg", F.when(F.col("least_dip") >= 0, -F.col("dip_deg")).otherwise(F.col("dip_deg"))).drop("least_dip")
    return df


def find_file(spark: SparkSession, folder: str, kind: str) -> str | None:
    """A preferred name, else the first CSV whose name contains a token of the table, in any
    file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(str(folder))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = {f.getPath().getName(): f.getPath().toString() for f in files.listStatus(path)}
    for name in FILES[kind]:
        if name in found:
            return found[name]
    named = [n for n in sorted(found) if n.endswith(".csv") and any(t in n.lower() for t in TOKENS[kind])]
    return found[named[0]] if named else None


def read_drillholes(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The four tables, normalised; None if a file is missing."""
    paths = {kind: find_file(spark, folder, kind) for kind in FILES}
    if None in paths.values():
        return None
    return {kind: normalise(spark.read.csv(p, header=True), kind) for kind, p in paths.items()}


def csv_in_zip(spark: SparkSession, path: str, member: str) -> DataFrame:
    """The CSV member of a ZIP file, by its whole name, else the first of that name in any folder and case.

    The member is unpacked as a stream, in any file system that Spark reads,
    into the shared folder, and read from there by all tasks.
    """
    java = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    source = java.org.apache.hadoop.fs.Path(str(path))

    def entries():
        stream = java.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
        try:
            while (entry := stream.getNextEntry()) is not None:
                yield entry.getName(), stream
        finally:
            stream.close()

    names = [n for n, _ in entries()]
    alike = [n for n in names if n == member] or [n for n in names if ("/" + n.lower()).endswith("/" + member.lower())]
    if not alike:
        raise FileNotFoundError(f"no {member} in {path}")
    target = java.org.apache.hadoop.fs.Path(scratch(spark, "member") + "/member.csv")
    for name, stream in entries():
        if name == alike[0]:
            out = target.getFileSystem(conf).create(target)
            java.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65_536, False)
            out.close()
            break
    return spark.read.csv(target.toString(), header=True)


def from_vendor(df: DataFrame, positions: dict[str, int], kind: str) -> DataFrame:
    """A vendor's table whose columns are known by position: named, then normalised; rows without a hole are left out."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    named = normalise(plain.select(*[F.col(f"_{i}").alias(n) for n, i in positions.items()]), kind)
    return named.filter("hole_id IS NOT NULL")


def straight_down(collars: DataFrame, depth: float = 100.0) -> DataFrame:
    """Two survey stations of a vertical hole for each collar, to its depth or a default one."""
    end = F.coalesce(F.col("total_depth"), F.lit(float(depth))) if "total_depth" in collars.columns else F.lit(float(depth))
    holes = collars.filter("hole_id IS NOT NULL").select("hole_id", end.alias("_end")).groupBy("hole_id").agg(F.max("_end").alias("_end"))
    return holes.select("hole_id", F.explode(F.array(F.lit(0.0), "_end")).alias("depth"), F.lit(0.0).alias("azimuth_deg"), F.lit(-90.0).alias("dip_deg"))


def reference_data(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A table to validate against: columns chosen and renamed (ours by theirs), numbers read, incomplete rows left out."""
    lacking = sorted(set(columns.values()) - set(df.columns))
    if lacking:
        raise ValueError(f"reference data lacks {lacking}")
    return df.select(*[number(F.col(theirs).cast("string")).alias(ours) for ours, theirs in columns.items()]).dropna()


def first_with(tables: list[DataFrame], columns: set[str]) -> DataFrame:
    """The first table that has the columns."""
    for t in tables:
        if columns <= set(t.columns):
            return t
    raise ValueError(f"no table has {sorted(columns)}")


def read_blocks(df: DataFrame, density: float | None = None) -> DataFrame:
    """Block model rows with x, y, z and grade; density by default, volume and tonnage where block sizes exist."""
    df = normalise(df, "blocks")
    missing = {"x", "y", "z", "grade"} - set(df.columns)
    if missing:
        raise ValueError(f"block model lacks {sorted(missing)}")
    if "density" not in df.columns:
        df = df.withColumn("density", F.lit(density).cast("double"))
    elif density is not None:
        df = df.withColumn("density", F.coalesce("density", F.lit(float(density))))
    if {"sx", "sy", "sz"} <= set(df.columns):
        df = df.withColumn("volume", F.col("sx") * F.col("sy") * F.col("sz")).withColumn("tonnage", F.col("volume") * F.col("density"))
    return df.dropna(subset=["x", "y", "z", "grade"])


def merged_config(base: dict, *layers: dict) -> dict:
    """Nested dictionaries laid over each other; later ones win."""
    out = dict(base)
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def active_profile(config: dict, variable: str = "OREBED_PROFILE") -> dict:
    """The configuration with the profile laid over it that the environment, or else its own ``active_profile``, names."""
    return with_profile(config, os.environ.get(variable) or config.get("active_profile"))


def with_profile(config: dict, profile: str | None) -> dict:
    """The configuration with one of its ``profiles`` laid over it."""
    if profile is None:
        return config
    profiles = config.get("profiles", {})
    if profile not in profiles:
        raise KeyError(f"unknown profile {profile}")
    return merged_config(config, profiles[profile])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_realisations(df: DataFrame, path: str) -> None:
    """A Parquet partition for each realisation; written again, only its own partitions change."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("real_id").parquet(path)


def pending(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """Realisations asked for that the folder does not hold yet."""
    asked = spark.createDataFrame([(r,) for r in wanted], "real_id int")
    try:
        done = spark.read.parquet(path).select("real_id").distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return asked
    return asked.join(done, "real_id", "left_anti")


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """A JSON file on any Hadoop file system."""
    write_text(spark, str(path), json.dumps(meta, indent=2, default=str))


def load_config(spark: SparkSession, path: str, profile: str | None = None) -> dict:
    """A configuration file, JSON or (where the yaml package is there) YAML, with its active profile, or the one
    named, laid over it."""
    text = read_text(spark, str(path))
    if text is None:
        raise FileNotFoundError(path)
    if str(path).endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML needs the yaml package; write the configuration as JSON") from e
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no configuration")
    return with_profile(found, profile) if profile else active_profile(found)


def write_scores(table: DataFrame, path: str) -> None:
    """A table of scores (``value, score``) as rows of JSON."""
    table.select("value", "score").write.mode("overwrite").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A table of scores from rows of JSON, or from one document of the arrays ``sorted_data`` and ``norm_scores``."""
    df = spark.read.option("multiLine", "false").json(path)
    if "norm_scores" not in df.columns:
        df = spark.read.option("multiLine", "true").json(path) if "value" not in df.columns else df
    if "norm_scores" in df.columns:
        df = df.select(F.explode(F.arrays_zip("sorted_data", "norm_scores")).alias("r")).select(F.col("r.sorted_data").alias("value"), F.col("r.norm_scores").alias("score"))
    return df.select(F.col("value").cast("double").alias("value"), F.col("score").cast("double").alias("score"))
