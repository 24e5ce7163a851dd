"""Summary tables: shares, spans, rankings, means by state, inventories and differences of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shares(df: DataFrame, by: list[str], amount: str | None = None, out: str = "n", share: str = "share", scale: float = 1.0) -> DataFrame:
    """By category the number of rows, or the sum of ``amount``, and its share of all; ``scale`` 100 for percent."""
    x = df.groupBy(*by).agg((F.sum(amount) if amount else F.count(F.lit(1))).alias(out))
    return x.crossJoin(F.broadcast(x.agg(F.sum(out).alias("_all")))).select(*by, out, (scale * F.col(out) / F.col("_all")).alias(share))


def domain_summary(df: DataFrame, by: list[str], value: str, hole: str, marks: dict[str, Column] | None = None) -> DataFrame:
    """By one key or several: rows with a value, distinct holes, mean, median, the share of all such rows, and for each of
    ``marks`` the share of the group's rows for which the condition holds."""
    real = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    held = [F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in (marks or {}).items()]
    x = real.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(hole).alias("holes"), F.avg(value).alias("mean"), F.median(value).alias("median"), *held)
    every = x.agg(F.sum("n").alias("_all"))
    return x.crossJoin(F.broadcast(every)).select(*by, "n", "holes", "mean", "median", (F.col("n") / F.col("_all")).alias("share"), *(marks or {}))


def spans(df: DataFrame, by: str, value: str) -> DataFrame:
    """By group: rows, mean and deviation of the value, and the extent along each axis."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), *[(F.max(a) - F.min(a)).alias(f"span_{a}") for a in "xyz"])


def best_method(df: DataFrame, family: str, method: str, error: str) -> DataFrame:
    """Of each family the method of least error; of equal ones the first by name.  Errors that are null or not a number don't count."""
    real = df.filter(F.col(error).isNotNull() & ~F.isnan(F.col(error).cast("double")))
    return real.groupBy(family).agg(F.min_by(F.struct(method, error), F.struct(error, method)).alias("_b")).select(family, "_b.*")


def ranked(df: DataFrame, score: str, key: str, n: int, places: int = 9, largest: bool = True) -> DataFrame:
    """The n rows of best score, rounded so that engines agree, then by key; scores that are null, infinite or not a number don't
    count.  The limit is the feature."""
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    place = F.round(s, places)
    return df.filter(finite).orderBy(place.desc() if largest else place.asc(), key).limit(n)


def physical_audit(df: DataFrame, value: str) -> DataFrame:
    """One row: the least value, the share below 0, the mean, and the mean once negative values are 0."""
    v = F.col(value)
    return df.agg(F.min(v).alias("least"), F.avg((v < 0).cast("double")).alias("negative_share"), F.avg(v).alias("mean"), F.avg(F.greatest(v, F.lit(0.0))).alias("floored_mean"))


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text matches the pattern; null doesn't."""
    return df.filter(F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def means_by_state(df: DataFrame, state: str, columns: list[str]) -> DataFrame:
    """By state the mean of each column, read as numbers; what is no number is left out."""
    return df.groupBy(state).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).try_cast("double")).alias(c) for c in columns])


def unpivoted_sums(df: DataFrame, by: list[str], columns: list[str], measure: str = "measure", total: str = "total") -> DataFrame:
    """By group and column the column's sum, a row each."""
    x = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])
    return x.unpivot(by, columns, measure, total)


def category_totals(df: DataFrame, category: str, samples: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """Of each sample, a column of ``df``, the sum over the categories of each named group: rows ``sample`` and a column for each group."""
    x = df.unpivot([category], samples, "sample", "_v").withColumn("_v", F.col("_v").cast("double"))
    return x.groupBy("sample").agg(*[F.coalesce(F.sum(F.when(F.col(category).isin(*own), F.col("_v"))), F.lit(0.0)).alias(n) for n, own in groups.items()])


def plan_quantiles(cells: DataFrame, columns: list[str], p: float = 0.9, keys: tuple[str, str] = ("ix", "iy")) -> DataFrame:
    """By plan column the quantile of each value over its cells, missing ones left out."""
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return cells.groupBy(*keys).agg(*[F.percentile(real(c), F.lit(p)).alias(c) for c in columns])


def association(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rows that have both values, and their correlation; null where one does not vary."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))


def inventory(df: DataFrame, key: str, body: str, name: str) -> DataFrame:
    """Of each file its digest, its bytes and the kind that its name begins with; ``body`` is text or binary (as binaryFile gives it)."""
    return df.select(key, F.sha2(F.col(body), 256).alias("sha256"), F.octet_length(body).cast("long").alias("bytes"), F.regexp_extract(name, "^[a-z]+", 0).alias("kind"))


def inner_fields(df: DataFrame, key: str, column: str, separator: str) -> DataFrame:
    """First and last field of a delimited text, and all between them joined again."""
    parts = F.split(F.col(column), separator)
    return df.select(key, F.element_at(parts, 1).alias("first"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), separator).alias("middle"), F.element_at(parts, -1).alias("last"))


def text_drift(df: DataFrame, by: str, text: str, pattern: str = "([0-9]+)") -> DataFrame:
    """By group: texts, how many differ once white space is one blank, and the ids that a pattern finds in them."""
    flat = F.sha2(F.regexp_replace(text, "[ \\t\\n]+", " "), 256)
    ids = F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).cast("long")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(flat).alias("distinct_texts"), F.sum(ids).alias("ids"))


def id_differences(base: DataFrame, other: DataFrame, text: str, pattern: str = "([0-9]+)") -> DataFrame:
    """Rows ``id, missing, extra`` of the ids that a pattern finds in the texts of one table and not of the other: ``missing`` from the
    other, or ``extra`` in it.  Each table's distinct ids meet once by key."""

    def ids(df: DataFrame, flag: str) -> DataFrame:
        return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("id")).distinct().withColumn(flag, F.lit(True))

    x = ids(base, "_a").join(ids(other, "_b"), "id", "full")
    return x.filter(F.col("_a").isNull() | F.col("_b").isNull()).select("id", F.col("_b").isNull().alias("missing"), F.col("_a").isNull().alias("extra"))
