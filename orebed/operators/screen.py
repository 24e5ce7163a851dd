"""Machine-learning screen of categories: imputation, encoding, and classifiers tested by groups of holes."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import forest, order

# Prefixes of encoded categories that are features of their own.
CATEGORY_PREFIXES = ("paper_domain_", "weathering_bin_", "geo_ALTERATION_", "geo_SULPHIDES_", "geo_STRUCTURE_")


def feature_group(name: Column) -> Column:
    """The feature that an encoded column (``num__...``, ``cat__...``) belongs to: a number's own name,
    a known prefix of a category, or else what stands before its first underscore."""
    body = F.substring(name, 6, 1 << 20)
    out = F.when(name.startswith("num__"), body)
    for p in CATEGORY_PREFIXES:
        out = out.when(name.startswith("cat__" + p), F.lit(p[:-1]))
    return out.when(name.startswith("cat__"), F.substring_index(body, "_", 1)).otherwise(name)


def importance_by_group(df: DataFrame) -> DataFrame:
    """Importances (``feature, importance``) summed by feature group, with the number of columns and their mean."""
    return df.groupBy(feature_group(F.col("feature")).alias("feature")).agg(F.sum("importance").alias("importance"), F.avg("importance").alias("mean"), F.count(F.lit(1)).alias("columns"))


def side_by_side(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Importances by two methods; a feature that one lacks has 0 there."""
    x, y = (d.select("feature", F.col("importance").alias(n)) for d, n in zip((a, b), names, strict=True))
    return x.join(y, "feature", "full").na.fill(0.0, list(names))


def stages(numbers: list[str], texts: list[str], scale: bool) -> list:
    """Medians for missing numbers, a class of its own for missing or new texts, one-hot, optional scaling."""
    out: list = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"_{c}" for c in numbers])]
    if texts:
        out.append(StringIndexer(inputCols=texts, outputCols=[f"_i{c}" for c in texts], handleInvalid="keep"))
        out.append(OneHotEncoder(inputCols=[f"_i{c}" for c in texts], outputCols=[f"_o{c}" for c in texts]))
    out.append(VectorAssembler(inputCols=[f"_{c}" for c in numbers] + [f"_o{c}" for c in texts], outputCol="_raw" if scale else "features"))
    if scale:
        out.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return out


def scores(predicted: DataFrame, by: list[str]) -> DataFrame:
    """By group, balanced accuracy, F1 and the area under the curve (by average ranks) of ``label, prediction, p`` and ``n``,
    the number of such rows; null where a group has one class only."""
    n = F.col("n")
    counts = predicted.groupBy(*by).agg(*[F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), n).otherwise(0)).alias(c) for c, a, b in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))])
    each = predicted.groupBy(*by, "p").agg(F.sum(F.col("label") * n).alias("pos"), F.sum((1 - F.col("label")) * n).alias("neg"))
    auc = order.running_by(each, by, ["p"], {"less": F.col("neg")}, inclusive=False).groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("less") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    return counts.join(auc, by).select(
        *by,
        ((F.try_divide("tp", F.col("tp") + F.col("fn")) + F.try_divide("tn", F.col("tn") + F.col("fp"))) / 2).alias("balanced_accuracy"),
        F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1"),
        "auc",
    )


def spread(df: DataFrame) -> DataFrame:
    """The rows, written once, as each step of each fit reads them, in parts for all cores: a forest is fitted on as many as its table has."""
    return stored(df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism), "screened")


def screen(df: DataFrame, numbers: list[str], texts: list[str], label: str, group: str, k: int = 5, trees: int = 100, seed: int = 42) -> DataFrame:
    """By method and fold, scores on holes that the fit has not seen; ``prior`` answers with the commoner class."""
    spark = df.sparkSession
    x = df.withColumn("label", F.col(label).cast("double")).withColumn("fold", F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(k)).cast("int"))
    x = spread(x.select(*numbers, *texts, "label", "fold"))
    ready, medians, sizes, linear = [], [], [], []
    for fold in range(k):
        made = Pipeline(stages=stages(numbers, texts, scale=True)).fit(x.filter(F.col("fold") != fold))
        ready.append(made.transform(x))
        first = made.stages[0].surrogateDF.first()
        medians.append([first[c] for c in numbers])
        sizes.append([len(names) for names in made.stages[1].labelsArray] if texts else [])
        fit = LogisticRegression(regParam=0.01).fit(ready[fold].filter(F.col("fold") != fold))
        linear.append(fit.transform(ready[fold].filter(F.col("fold") == fold)).select("fold", "label", "prediction", vector_to_array("probability")[1].alias("p")))

    kinds = [f"_{c}" for c in numbers] + [f"_i{c}" for c in texts]
    bins = forest.edges(x, numbers, medians)
    columns = [f"f{j}" for j in range(len(kinds))]
    parts = []
    for fold in range(k):
        of = [sum(((F.col(c) > e).cast("int") for e in bins[fold][j]), F.lit(0)) if j < len(numbers) else F.col(c).cast("int") for j, c in enumerate(kinds)]
        parts.append(ready[fold].select(F.lit(fold).alias("of"), (F.col("fold") == fold).alias("held"), F.col("label").cast("int").alias("label"), *[c.alias(n) for c, n in zip(of, columns, strict=True)]))
    binned = stored(reduce(DataFrame.unionByName, parts).groupBy("of", "held", *columns, "label").agg(F.count(F.lit(1)).alias("n")), "binned")
    grown = forest.grow(binned.filter(~F.col("held")), columns, [forest.Layout.of(len(numbers), s) for s in sizes], trees, 6, seed)
    voted = forest.shares(binned.filter("held"), columns, grown).select(F.lit("forest").alias("method"), F.col("of").alias("fold"), F.col("label").cast("double").alias("label"), (F.col("p") > 0.5).cast("double").alias("prediction"), "p", "n")

    counts = {(r["fold"], r["label"]): r["n"] for r in x.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain = []
    for fold in range(k):
        others = [(c, n) for (f, c), n in counts.items() if f != fold]
        p = sum(c * n for c, n in others) / sum(n for _, n in others)
        plain += [("prior", f, c, float(p >= 0.5), p, n) for (f, c), n in counts.items() if f == fold]
    prior = spark.createDataFrame(plain, "method string, fold int, label double, prediction double, p double, n long")
    logistic = reduce(DataFrame.unionByName, linear).groupBy("fold", "label", "prediction", "p").agg(F.count(F.lit(1)).alias("n")).withColumn("method", F.lit("logistic"))
    answers = stored(prior.unionByName(voted).unionByName(logistic), "answers")

    # A fold without holes has its rows too.
    rows = spark.createDataFrame([(m, f) for f in range(k) for m in ("prior", "forest", "logistic")], "method string, fold int")
    return rows.join(scores(answers, ["method", "fold"]), ["method", "fold"], "left").na.fill(0.0, ["f1"])
