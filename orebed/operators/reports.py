"""Key figures, documents, exports and the gates that they must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import order

#: Rows of a list in one section of a document; further ones are in sections of their own.
SECTION_ROWS = 10_000

# Public names of the columns of a cutoff curve.
OCCUPANCY_NAMES = {
    "tonnage": "occupancy_proxy",
    "tonnage_p05": "occupancy_proxy_p05",
    "tonnage_p10": "occupancy_proxy_p10",
    "tonnage_mean": "occupancy_proxy_mean",
    "tonnage_p50": "occupancy_proxy_p50",
    "tonnage_p90": "occupancy_proxy_p90",
    "tonnage_p95": "occupancy_proxy_p95",
    "grade_p05": "mean_tgc_above_cutoff_p05",
    "grade_p10": "mean_tgc_above_cutoff_p10",
    "grade_mean": "mean_tgc_above_cutoff_mean",
    "grade_p50": "mean_tgc_above_cutoff_p50",
    "grade_p90": "mean_tgc_above_cutoff_p90",
    "grade_p95": "mean_tgc_above_cutoff_p95",
}


def key_figures(summary: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """Tonnage and contained in millions and grade at a cutoff of a curve's summary; no row without that cutoff."""
    at = summary.filter(F.abs(F.col("cutoff") - cutoff) < 1e-9)
    marks = ("p10", "p50", "p90")
    return at.select(
        "cutoff",
        *[(F.col(f"tonnage_{m}") / 1e6).alias(f"tonnage_mt_{m}") for m in marks],
        *[F.col(f"grade_{m}").alias(f"grade_pct_{m}") for m in marks],
        (F.col("contained_p50") / 1e6).alias("contained_mt_p50"),
    )


def document(scalars: dict[str, DataFrame], lists: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows ``section, body``: JSON of a one-row table, or an array of a table's rows in their own order.

    A list of more rows than ``SECTION_ROWS`` goes on in sections ``name.2``,
    ``name.3`` and so on, each with so many rows: rows are numbered by ranges, and
    no task holds more than a section.  An empty one-row table has no section,
    an empty list is ``[]``.
    """
    row = lambda d: F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"})
    out = [d.limit(1).select(F.lit(n).alias("section"), row(d).alias("body")) for n, d in scalars.items()]
    for n, d in (lists or {}).items():
        rows = stored(d.select(F.struct(*d.columns).alias("r")), "section")
        count = rows.count()
        if count <= SECTION_ROWS:
            parts = rows.agg(F.array_sort(F.collect_list("r")).alias("rows")).withColumn("part", F.lit(0))
        else:
            tied = rows.withColumn("_tie", F.monotonically_increasing_id())
            at = order.running(tied, ["r", "_tie"], {"_no": F.lit(1)}, inclusive=False)
            parts = at.groupBy(F.floor(F.col("_no") / SECTION_ROWS).cast("int").alias("part")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
        name = F.when(F.col("part") == 0, F.lit(n)).otherwise(F.concat(F.lit(f"{n}."), F.col("part") + 1))
        out.append(parts.select(name.alias("section"), F.to_json("rows", {"ignoreNullFields": "false"}).alias("body")))
    return reduce(DataFrame.unionByName, out)


def public_columns(df: DataFrame, names: dict[str, str] | None = None, leave_out: str = "contained") -> DataFrame:
    """Columns under their public names, those whose name begins with ``leave_out`` in any case left out."""
    names = OCCUPANCY_NAMES if names is None else names
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns if not names.get(c, c).lower().startswith(leave_out)])


def substituted(text: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The text after each pattern in turn has been replaced."""
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, F.col(text) if isinstance(text, str) else text)


def table_row(*cells: Column | str) -> Column:
    """A row of a Markdown table; null is an empty cell."""
    return F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells]), " | "), F.lit(" |"))


def recomputed(kept: DataFrame, again: DataFrame, rtol: float = 1e-6, atol: float = 1e-6) -> DataFrame:
    """Rows ``metric, kept, again, agrees`` of two tables ``metric, value``: the kept value lies within
    ``atol + rtol * |again|`` of the other; a metric that one side lacks, or that is null, doesn't agree."""
    both = kept.select("metric", F.col("value").alias("kept")).join(again.select("metric", F.col("value").alias("again")), "metric", "full")
    return both.withColumn("agrees", F.coalesce(F.abs(F.col("kept") - F.col("again")) <= atol + rtol * F.abs("again"), F.lit(False)))


def _gate(df: DataFrame, name: str, found: Column, wanted: float) -> DataFrame:
    one = df.agg(F.coalesce(found.cast("double"), F.lit(0.0)).alias("found"), F.lit(float(wanted)).alias("wanted"))
    return one.select(F.lit(name).alias("gate"), "found", "wanted", F.coalesce(F.abs(F.col("found") - F.col("wanted")) <= 1e-6, F.lit(False)).alias("passed"))


def fold_gates(df: DataFrame, k: int, fold: str = "fold", group: str = "hole_id") -> DataFrame:
    """As many folds as wanted, and no group in more than one."""
    held = df.groupBy(group).agg(F.count_distinct(fold).alias("n"))
    return _gate(df, "folds", F.count_distinct(fold), k).unionByName(_gate(held, "groups in several folds", F.count_if(F.col("n") > 1), 0))


def value_gate(df: DataFrame, name: str, column: str, allowed: list) -> DataFrame:
    """Every allowed value occurs, and no other: null counts as another."""
    v = df.select(column).distinct()
    good = F.col(column).isin(allowed)
    return _gate(v, name, F.count_if(good) - F.count_if(~F.coalesce(good, F.lit(False))), len(allowed))


def total_gate(parts: DataFrame, name: str, part: str, total: float) -> DataFrame:
    """The parts add up to the total."""
    return _gate(parts, name, F.sum(part), total)


def passed(*gates: DataFrame) -> DataFrame:
    """All rows of the gates, once read; the first one that fails is an error."""
    rows = reduce(DataFrame.unionByName, gates)
    return rows.filter(F.when(F.col("passed"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gate not passed: "), "gate")).cast("boolean")))
