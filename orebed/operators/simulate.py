"""Sequential Gaussian simulation block by block, kriging of held-out folds, conditional fields and what is built on them."""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.covariance import Buckets, Model, basis, directional, fit, krige, krige_many
from ..sources.files import exists
from ..sources.scratch import stored
from . import compare, ensemble, order, pairs, samples
from .grid import Grid

#: Edge of the blocks that are simulated apart, in radii of the search: 2 at least.
BLOCK = 4.0


@dataclasses.dataclass(frozen=True)
class Search:
    """Ellipsoid radii (after an optional rotation), how many neighbours count, and how many there should be."""

    radii: tuple[float, float, float]
    k: int = 20
    axes: tuple[tuple[float, float, float], ...] | None = None
    least: int = 0
    #: A node without any neighbour is an error.
    required: bool = False

    def scaled(self, xyz: np.ndarray) -> np.ndarray:
        return (xyz @ np.array(self.axes).T if self.axes else xyz) / np.array(self.radii)


def simulate_one(cells: np.ndarray, points: np.ndarray, values: np.ndarray, model: Model, search: Search, seed: int | list[int], nugget_on_diagonal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One realisation at the cells, in a random order, each conditioned on data and on cells before it, and how many
    neighbours each had.  Without any a cell is drawn from the model's whole variance."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate([points, np.empty((len(cells), 3))])
    known = np.concatenate([values, np.empty(len(cells))])
    scaled = search.scaled(cells)
    buckets = Buckets(search.scaled(points) if len(points) else np.empty((0, 3)))
    out, met = np.empty(len(cells)), np.zeros(len(cells), int)
    n = len(points)
    noise = rng.standard_normal(len(cells))
    for step, c in enumerate(rng.permutation(len(cells)).tolist()):
        at = tuple(scaled[c].tolist())
        near = buckets.near(at, search.k)
        met[c] = len(near)
        if not near and search.required:
            raise RuntimeError(f"no neighbour for a node; {search.least} are wanted")
        mean, variance = krige(model, everything[near], known[near], cells[c], nugget_on_diagonal) if near else (0.0, model.sill)
        out[c] = mean + np.sqrt(variance) * noise[step]
        everything[n], known[n] = cells[c], out[c]
        n += 1
        buckets.add(at)
    return out, met


@dataclasses.dataclass(frozen=True)
class _Blocks:
    """Cubes of search space, ``size`` search radii wide, from ``origin`` on."""

    search: Search
    size: float
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def _scaled(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        out = pairs.search_space(df.select("*", *[F.col(a).alias(f"_{a}") for a in "xyz"]), self.search.radii, self.search.axes)
        return out, [F.col(a) - o for a, o in zip("xyz", self.origin, strict=True)]

    def snapped(self, df: DataFrame) -> _Blocks:
        """The same with their origin at the least place of the rows."""
        scaled, place = self._scaled(df)
        least = scaled.agg(*[F.min(p).alias(a) for p, a in zip(place, "xyz", strict=True)]).first()
        return dataclasses.replace(self, origin=tuple(least[a] or 0.0 for a in "xyz"))

    def dealt(self, df: DataFrame) -> DataFrame:
        """Adds the block of each row, ``bx, by, bz``, and its colour: 0 to 7 by odd and even."""
        scaled, place = self._scaled(df)
        out = scaled.select(*[F.col(f"_{c}").alias(c) if c in "xyz" else F.col(c) for c in df.columns], *[F.floor(p / self.size).cast("long").alias(f"b{a}") for p, a in zip(place, "xyz", strict=True)])
        return out.withColumn("colour", (F.pmod("bx", F.lit(2)) + 2 * F.pmod("by", F.lit(2)) + 4 * F.pmod("bz", F.lit(2))).cast("int"))

    def around(self, df: DataFrame) -> DataFrame:
        """The rows, once for each block that they lie in or within reach of: 8 at most."""
        scaled, place = self._scaled(df)
        reach = [F.sequence(*[F.floor((p + d) / self.size).cast("long") for d in (-1.0, 1.0)]) for p in place]
        out = scaled.select(*[F.col(f"_{c}").alias(c) if c in "xyz" else F.col(c) for c in df.columns], *[r.alias(f"_b{a}") for r, a in zip(reach, "xyz", strict=True)])
        for a in "xyz":
            out = out.withColumn(f"b{a}", F.explode(f"_b{a}"))
        return out.drop("_bx", "_by", "_bz")


def _wanted(data: DataFrame, cells: DataFrame, search: Search) -> DataFrame:
    """The samples that can be among the nearest of a cell of their domain: however many lie in reach, a cell asks for no more than
    k, and twice as many are kept, lest equal distances are rounded otherwise here."""
    names = ["domain", "x", "y", "z", "score"]
    numbered = order.running(data, names, {"id": F.lit(1)}).drop("id_total").withColumn("label", F.lit(0))
    places = cells.select("domain", "x", "y", "z").distinct().withColumn("id", F.lit(0).cast("long"))
    numbered = stored(numbered, "samples")
    space = lambda d: pairs.search_space(d, search.radii, search.axes)
    near = pairs.neighbours(space(places), space(numbered), 1.0 + 1e-9, 2 * search.k, within="domain")
    return stored(numbered.join(near.select(F.col("sample").alias("id")).distinct(), "id", "left_semi").select(*names), "wanted")


_DRAWN = "real_id int, domain int, cell_id long, value double, neighbours int, x double, y double, z double"


def simulate(cells: DataFrame, samples: DataFrame, models: dict[int, Model], search: Search, seed: int, nugget_on_diagonal: bool = False, block: float = BLOCK, progress: str | None = None) -> DataFrame:
    """Rows ``real_id, domain, cell_id, value, neighbours`` for cells ``real_id, domain, cell_id, x, y, z``.

    A domain of a realisation sees the samples of its own domain only
    (``domain, x, y, z, score``), and its own cells that came before.

    Space is cut in blocks of ``block`` search radii.  Blocks of one colour, of
    eight, lie more than a radius apart, so they don't see each other: the path
    goes through all blocks of a colour, then of the next, in random order
    within each block.  So one task holds one block of one domain of one
    realisation, with the samples and earlier cells within a radius of it, and a
    path of any number of cells takes eight rounds at most.  What is simulated
    is written after each.  A block run again gives the same values: its rows
    are sorted, and its seed is made of ``seed + real_id + 100000 * domain`` and
    its place.  Rows without a place are left out, as are samples without a score.

    With ``progress``, a folder, a run that was cut off takes up again after its
    last whole round, in the midst of its realisations: rounds lie under a
    digest of cells, samples, models, search and seed, so others are not taken.
    """
    spark = cells.sparkSession
    if block < 2:
        raise ValueError("blocks are 2 search radii wide at least")
    here = ["real_id", "domain", "bx", "by", "bz"]
    at = cells.select(F.col("real_id").cast("int").alias("real_id"), F.col("domain").cast("int").alias("domain"), F.col("cell_id").cast("long").alias("cell_id"), *[F.col(a).cast("double").alias(a) for a in "xyz"]).dropna()
    blocks = _Blocks(search, block).snapped(at)
    at = stored(blocks.dealt(at), "blocks")
    data = samples.select(F.col("domain").cast("int").alias("domain"), *[F.col(a).cast("double").alias(a) for a in ("x", "y", "z", "score")]).dropna()
    if progress is not None:
        mark = lambda d: list(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)"))).first())
        given = [mark(at), mark(data), sorted(models.items()), search, seed, nugget_on_diagonal, block]
        progress = f"{progress.rstrip('/')}/{hashlib.sha256(repr(given).encode()).hexdigest()[:24]}"
    data = blocks.around(_wanted(data, at, search))

    def kernel(key: tuple, group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"real_id": [], "domain": [], "cell_id": [], "value": [], "neighbours": [], "x": [], "y": [], "z": []})
        real_id, domain, *place = (int(k) for k in key)
        group = group.sort_values("cell_id")
        known = known.sort_values(["x", "y", "z", "score"])
        seeds = [(seed + real_id + 100_000 * domain) % 2**64, *[p % 2**64 for p in place]]
        v, met = simulate_one(group[["x", "y", "z"]].to_numpy(float), known[["x", "y", "z"]].to_numpy(float), known["score"].to_numpy(float), models[domain], search, seeds, nugget_on_diagonal)
        return pd.DataFrame({"real_id": group["real_id"], "domain": group["domain"], "cell_id": group["cell_id"], "value": v, "neighbours": met, "x": group["x"], "y": group["y"], "z": group["z"]})

    out: DataFrame | None = None
    for colour in sorted(r["colour"] for r in at.select("colour").distinct().collect()):
        round_path = progress and f"{progress}/colour-{colour}"
        if round_path and exists(spark, f"{round_path}/_SUCCESS"):
            drawn = spark.read.schema(_DRAWN).parquet(round_path)
            out = drawn if out is None else out.unionByName(drawn)
            continue
        own = at.filter(F.col("colour") == colour)
        asked = own.select(*here).distinct()
        known = asked.join(data, ["domain", "bx", "by", "bz"]).select(*here, "x", "y", "z", "score")
        if out is not None:
            before = blocks.around(out.select("real_id", "domain", "x", "y", "z", F.col("value").alias("score")))
            known = known.unionByName(before.join(asked, here, "left_semi").select(*here, "x", "y", "z", "score"))
        known = known.withColumnsRenamed({c: f"of_{c}" for c in here})
        drawn = own.groupBy(*here).cogroup(known.groupBy(*[f"of_{c}" for c in here])).applyInPandas(kernel, _DRAWN)
        if round_path:
            drawn.write.mode("overwrite").parquet(round_path)
            drawn = spark.read.schema(_DRAWN).parquet(round_path)
        else:
            drawn = stored(drawn, "simulated")
        out = drawn if out is None else out.unionByName(drawn)
    if out is None:
        return at.select("real_id", "domain", "cell_id", F.lit(0.0).alias("value"), F.lit(0).alias("neighbours"))
    return out.select("real_id", "domain", "cell_id", "value", "neighbours")


def neighbourhoods(simulated: DataFrame, least: int) -> DataFrame:
    """By realisation and domain: nodes, the mean number of neighbours, and the percentage with fewer than ``least`` and with none."""
    share = lambda c: 100 * F.avg(c.cast("double"))
    n = F.col("neighbours")
    return simulated.groupBy("real_id", "domain").agg(F.count(F.lit(1)).alias("nodes"), F.avg(n).alias("avg_neighbours"), share(n < least).alias("under_least_pct"), share(n == 0).alias("none_pct"))


def wave_numbers(model: Model, n: int, rng: np.random.Generator) -> np.ndarray:
    """Wave vectors whose cosines, of random phase, have the model's correlation on average."""
    g = rng.standard_normal((n, 3))
    if model.kind == "gaussian":
        return g * np.sqrt(2) / model.reach
    if model.kind == "exponential":
        return g / (np.abs(rng.standard_normal((n, 1))) * model.reach)
    raise ValueError(f"no wave numbers for a {model.kind} model")


def waves(xyz: np.ndarray, model: Model, n_real: int, seed: int, modes: int) -> np.ndarray:
    """The structured part of ``n_real`` unconditional fields at the points, one column each."""
    xyz = model.space(xyz)
    out = np.empty((len(xyz), n_real))
    for r in range(n_real):
        rng = np.random.default_rng([seed, r])
        k = wave_numbers(model, modes, rng)
        out[:, r] = np.cos(xyz @ k.T + rng.uniform(0, 2 * np.pi, modes)).sum(1) * np.sqrt(2 * model.variance / modes)
    return out


def conditional_fields(cells: DataFrame, samples: DataFrame, model: Model, search: Search, n_real: int, seed: int, modes: int = 1000) -> DataFrame:
    """Rows ``real_id, cell_id, value`` of random fields at cells ``cell_id, x, y, z`` that honour samples ``id, x, y, z, score``.

    A field is a sum of cosine waves, the same at any place however rows are
    dealt out, so cells don't wait for each other: each is lifted by the kriged
    difference of its neighbours' scores from the field.  Weights are found once
    for all fields; nothing is broadcast.  The nugget is noise of each cell,
    but where a sample lies.  Without neighbours a cell keeps the bare field;
    rows without a place or a score are left out; ids should be unique.
    """
    held = samples.select("id", "x", "y", "z", F.col("score").cast("double").alias("score")).dropna()
    at = cells.select(F.col("cell_id").cast("long").alias("id"), "x", "y", "z").dropna()

    def apart(batches):
        for b in batches:
            left = b["score"].to_numpy()[:, None] - waves(b[["x", "y", "z"]].to_numpy(float), model, n_real, seed, modes)
            yield b.assign(left=list(left))[["id", "x", "y", "z", "left"]]

    known = held.mapInPandas(apart, f"id {dict(held.dtypes)['id']}, x double, y double, z double, left array<double>").withColumnsRenamed({"id": "sample", "x": "sx", "y": "sy", "z": "sz"})
    space = lambda d: pairs.search_space(d, search.radii, search.axes)
    near = pairs.neighbours(space(at), space(held.withColumn("label", F.lit(0))), 1.0, search.k).select("target", "sample", "rank")
    listed = near.join(known, "sample").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "sx", "sy", "sz", "left"))).alias("near"))

    def kernel(batches):
        for b in batches:
            places = b[["x", "y", "z"]].to_numpy(float)
            field = waves(places, model, n_real, seed, modes)
            for i, (cell, near) in enumerate(zip(b["id"], b["near"], strict=True)):
                on_sample = False
                if near is not None and len(near):
                    xyz = np.array([[s["sx"], s["sy"], s["sz"]] for s in near])
                    left = np.array([s["left"] for s in near])
                    between = model.between(xyz, xyz)
                    between[np.diag_indices_from(between)] += 1e-10
                    field[i] += np.linalg.lstsq(between, model.between(xyz, places[i : i + 1])[:, 0], rcond=None)[0] @ left
                    on_sample = bool((xyz == places[i]).all(1).any())
                if not on_sample:
                    field[i] += np.sqrt(model.nugget) * np.random.default_rng([seed, int(cell) % 2**64, 1]).standard_normal(n_real)
            yield pd.DataFrame({"real_id": np.tile(np.arange(n_real), len(b)), "cell_id": np.repeat(b["id"].to_numpy(), n_real), "value": field.ravel()})

    return at.join(listed, "id", "left").mapInPandas(kernel, "real_id int, cell_id long, value double")


def complete(simulated: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that no domain has filled; a mosaic is whole if there are none."""
    return cells.select("real_id", "cell_id").join(simulated, ["real_id", "cell_id"], "left_anti")


def require_complete(simulated: DataFrame, cells: DataFrame) -> DataFrame:
    """The simulated rows; an error if a cell lacks a value."""
    gap = complete(simulated, cells).first()
    if gap is not None:
        raise ValueError(f"no value for cell {gap['cell_id']} of realisation {gap['real_id']}")
    return simulated


def folds(df: DataFrame, k: int, seed: int, block: float | None = None, key: str = "id") -> DataFrame:
    """Adds ``fold``: by row, or the same for all rows of a block of the plan."""
    parts = [F.col(key)] if block is None else [F.floor(F.col(a) / block) for a in "xy"]
    return df.withColumn("fold", F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(k)).cast("int"))


def section_folds(df: DataFrame, width: float, axis: str = "y") -> DataFrame:
    """Adds ``fold``: one for each section of so much width across an axis."""
    return df.withColumn("fold", F.floor(F.col(axis) / width).cast("int"))


def hole_folds(df: DataFrame, by: str = "hole_id") -> DataFrame:
    """Adds ``fold``: one for each hole."""
    return df.withColumn("fold", F.col(by))


def _families(df: DataFrame, family: str | None) -> DataFrame:
    """Rows ``_family, id, x, y, z, value, fold`` that have all of these, written once."""
    one = F.lit("") if family is None else F.col(family).cast("string")
    return stored(df.select(one.alias("_family"), "id", *[F.col(a).cast("double").alias(a) for a in ("x", "y", "z", "value")], "fold").dropna(), "folded")


def _held_apart(held: DataFrame, search: Search) -> DataFrame:
    """Neighbours of each row in the other folds of its family, within the search: ``_family, target, sample, rank, distance``."""
    scaled = pairs.search_space(held.select("id", "x", "y", "z", "fold", "_family", F.lit(0).alias("label")), search.radii, search.axes)
    return pairs.neighbours(scaled, scaled, 1.0, search.k, apart="fold", within="_family").select("_family", "target", "sample", "rank", "distance")


KRIGING = ("simple_kriging", "ordinary_kriging")


def kriged(df: DataFrame, model: Model, methods: tuple[str, ...] = KRIGING[:1]) -> DataFrame:
    """The rows, once for each method, with ``method`` and ``estimate`` from ``near``, an array of neighbours
    ``rank, x, y, z, score``; null without any."""
    names = [c for c in df.columns if c != "near"]
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes if c != "near") + ", method string, estimate double"

    def kernel(batches):
        for b in batches:
            size, near = b.column("near").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), b.column("near").flatten()
            known, scores = np.column_stack([near.field(c).to_numpy(zero_copy_only=False) for c in "xyz"]), near.field("score").to_numpy(zero_copy_only=False)
            places, first = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in "xyz"]), np.cumsum(size) - size
            out = np.full((len(methods), len(size)), np.nan)
            # Rows of as many neighbours are solved together.
            for n in set(size.tolist()) - {0}:
                rows = np.flatnonzero(size == n)
                for some in np.split(rows, range(1024, len(rows), 1024)):
                    at = first[some][:, None] + np.arange(n)
                    for m, method in enumerate(methods):
                        out[m, some] = krige_many(model, known[at], scores[at], places[some], method == KRIGING[1])
            for m, method in enumerate(methods):
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array([method] * len(size), pa.string()), pa.array(out[m], mask=np.isnan(out[m]))], [*names, "method", "estimate"])

    return df.mapInArrow(kernel, schema)


def cross_validated(df: DataFrame, model: Model, search: Search, least: int = 1, trend: tuple[str, ...] = (), methods: tuple[str, ...] = KRIGING[:1], family: str | None = None) -> DataFrame:
    """Rows ``family, method, id, fold, value, estimate``: each fold kriged from all others (``id, x, y, z, value, fold``).

    Each fold fits its own linear trend over the coordinates ``trend`` and its
    own normal scores on its training rows alone, kriges in scores, and takes
    estimates back to values and trend.  With fewer than ``least`` neighbours
    the mean of the training values stands in; without training rows the
    estimate is null.  Rows without a place, a value or a fold are left out.
    ``family`` names a column of tables of folds that are tested side by side,
    each id once in each: they share all jobs.

    Nothing is collected but sums, one row a fold.  Every row is handed to the
    folds that it trains, as many copies as there are other folds; scores of all
    folds come of one sort, neighbours of one join that leaves the row's own
    fold out, and only rows with their neighbours are kriged.
    """
    held = _families(df, family)
    kind = dict(held.dtypes)["fold"]
    # Sums over all rows less those of the fold: its training rows' trend and mean.
    cols = [F.lit(1.0), *[F.col(c) for c in trend]]
    sums = [F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j] + [F.sum(a * F.col("value")).alias(f"b{i}") for i, a in enumerate(cols)]
    by_fold = [r.asDict() for r in held.groupBy("_family", "fold").agg(*sums).collect()]
    whole: dict[str, dict[str, float]] = {}
    for r in by_fold:
        own = whole.setdefault(r["_family"], dict.fromkeys(set(r) - {"_family", "fold"}, 0.0))
        for c in own:
            own[c] += r[c]
    rows, n = [], len(cols)
    for r in by_fold:
        left = {c: v - r[c] for c, v in whole[r["_family"]].items()}
        a = np.array([[left[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        b = np.array([left[f"b{i}"] for i in range(n)])
        slope = np.linalg.lstsq(a, b, rcond=None)[0] if trend else np.zeros(1)
        rows.append((r["_family"], r["fold"], slope.tolist(), float(b[0] / a[0, 0]) if a[0, 0] > 0 else None))
    fits = df.sparkSession.createDataFrame(rows, f"_f string, of {kind}, slope array<double>, mean double")

    def lift(slope: str) -> Column:
        return sum((F.col(slope)[i + 1] * F.col(c) for i, c in enumerate(trend)), F.col(slope)[0])

    train = held.join(fits, (F.col("_family") == F.col("_f")) & (F.col("fold") != F.col("of")))
    train = stored(train.select("_family", F.col("of").alias("_fold"), "id", "x", "y", "z", (F.col("value") - lift("slope")).alias("left")), "training")
    table = stored(samples.score_table(train, "left", by=("_family", "_fold")), "fold-scores")
    known = table.withColumnsRenamed({"_family": "_f", "_fold": "_o", "value": "_v"})
    scored = train.join(known, (F.col("left") == F.col("_v")) & (F.col("_fold") == F.col("_o")) & (F.col("_family") == F.col("_f")))
    scored = scored.select("_family", "_fold", F.col("id").alias("sample"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "score")
    near = _held_apart(held, search).join(held.select("_family", F.col("id").alias("target"), F.col("fold").alias("_fold")), ["_family", "target"])
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), "score"))).alias("near")
    near = near.join(scored, ["_family", "_fold", "sample"]).groupBy(F.col("_family").alias("_f"), "target").agg(listed)
    at = held.join(near, (F.col("id") == F.col("target")) & (F.col("_family") == F.col("_f")), "left").drop("target", "_f")
    enough = F.coalesce(F.size("near") >= max(1, least), F.lit(False))
    # Written, as it is read twice: kriging is done once.
    at = stored(kriged(at.withColumn("near", F.when(enough, F.col("near"))), model, methods).withColumnRenamed("estimate", "drawn"), "kriged")
    back = samples.interpolated(at, "drawn", table.withColumnRenamed("_fold", "fold"), "score", "value", "back", by=("_family", "fold"))
    out = back.join(fits, (F.col("fold") == F.col("of")) & (F.col("_family") == F.col("_f")), "left")
    return out.select(F.col("_family").alias("family"), "method", "id", "fold", "value", F.coalesce(F.col("back") + lift("slope"), F.col("mean")).alias("estimate"))


def cross_validate(df: DataFrame, model: Model, search: Search, least: int = 1, trend: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``id, fold, value, estimate`` of simple kriging, see ``cross_validated``."""
    return cross_validated(df, model, search, least, trend).select("id", "fold", "value", "estimate")


def inverse_distances(df: DataFrame, search: Search, power: float = 2.0, least: int = 1, family: str | None = None) -> DataFrame:
    """Rows ``family, id, fold, value, estimate`` as ``cross_validated`` has them, by inverse distances (at least 1e-6) in search space."""
    held = _families(df, family)
    near = _held_apart(held, search).join(held.select("_family", F.col("id").alias("sample"), F.col("value").alias("known")), ["_family", "sample"])
    weight = F.pow(F.greatest("distance", F.lit(1e-6)), -power)
    near = near.groupBy(F.col("_family").alias("_f"), "target").agg(F.count(F.lit(1)).alias("n"), (F.sum(weight * F.col("known")) / F.sum(weight)).alias("near"))
    sums = held.groupBy("_family", "fold").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    whole = sums.groupBy("_family").agg(F.sum("s").alias("whole_s"), F.sum("c").alias("whole_c"))
    mean = F.when(F.col("whole_c") > F.col("c"), (F.col("whole_s") - F.col("s")) / (F.col("whole_c") - F.col("c")))
    mean = sums.join(whole, "_family").select(F.col("_family").alias("_m"), F.col("fold").alias("of"), mean.alias("mean"))
    out = held.join(near, (F.col("id") == F.col("target")) & (F.col("_family") == F.col("_f")), "left").join(mean, (F.col("fold") == F.col("of")) & (F.col("_family") == F.col("_m")))
    return out.select(F.col("_family").alias("family"), "id", "fold", "value", F.when(F.col("n") >= max(1, least), F.col("near")).otherwise(F.col("mean")).alias("estimate"))


def baselines(df: DataFrame, model: Model, search: Search, least: int = 1, trend: tuple[str, ...] = ()) -> DataFrame:
    """Errors by family of folds and method: inverse distances, ordinary and simple kriging beside each other, all
    from the same folds (``family, id, x, y, z, value, fold``)."""
    drawn = inverse_distances(df, search, least=least, family="family").withColumn("method", F.lit("inverse_distance"))
    both = cross_validated(df, model, search, least, trend, KRIGING, "family").unionByName(drawn)
    return compare.errors(both, "value", "estimate", ["family", "method"])


def fitted(points: DataFrame, reach: float, lags: int, kind: str = "exponential", value: str = "score") -> Model:
    """Model of the points' omnidirectional variogram, its total sill brought to 1."""
    v = sorted(pairs.variogram(points, reach, lags, {"all": (1.0, 0.0, 0.0)}, 90.0, value=value).collect(), key=lambda r: r["lag"])
    return fit([r["distance"] for r in v], [r["gamma"] for r in v], kind).with_sill(1.0)


@dataclasses.dataclass(frozen=True)
class Orientation:
    """Strike and dip of a body, the tolerance of its directional variograms, the longest range that counts, and ranges that
    are given rather than fitted."""

    strike: float
    dip: float
    dip_direction: float | None = None
    tolerance: float = 22.5
    max_reach: float = float("inf")
    ranges: tuple[float, float, float] | None = None

    @property
    def axes(self) -> np.ndarray:
        return basis(self.strike, self.dip, self.dip_direction)


AXES = ("strike", "dip", "normal")


def fitted_by(points: DataFrame, by: str, reach: float, lags: int, kind: str = "exponential", value: str = "score", orientation: Orientation | None = None) -> dict:
    """A model for each value of ``by``: sill and nugget of the omnidirectional variogram, and with an
    orientation the ranges of three directional ones.  One job makes all variograms; what is collected are
    four rows a lag for each value."""
    directions, tolerance = {"all": (1.0, 0.0, 0.0)}, {"all": 90.0}
    if orientation is not None:
        directions |= {n: tuple(a) for n, a in zip(AXES, orientation.axes.tolist(), strict=True)}
        tolerance |= dict.fromkeys(AXES, orientation.tolerance)
    rows = pairs.variogram(points, reach, lags, directions, tolerance, value=value, by=(by,)).collect()
    out = {}
    for k in sorted({r[by] for r in rows}):
        curves = {d: sorted(((r["distance"], r["gamma"]) for r in rows if r[by] == k and r["direction"] == d)) for d in directions}
        one = {d: fit(*map(np.array, zip(*c, strict=True)), kind, 2.5 * reach) if len(c) >= 3 else None for d, c in curves.items()}
        base = one["all"] or Model(kind)
        if orientation is not None:
            ranges = dict(zip(AXES, orientation.ranges, strict=True)) if orientation.ranges else {n: one[n].reach if one[n] else None for n in AXES}
            base = directional(base, ranges, orientation.axes, orientation.max_reach)
        out[k] = base.with_sill(1.0)
    return out


@dataclasses.dataclass
class Prepared:
    """Samples with ``domain_group, domain, decluster_weight, score``, their score tables by domain, and models by its number."""

    samples: DataFrame
    scores: DataFrame
    models: dict[int, Model]


def prepare_domains(df: DataFrame, names: list[str], size: tuple[float, float, float], reach: float, lags: int, kind: str = "exponential", orientation: Orientation | None = None) -> Prepared:
    """For each domain (``domain_group``) with samples ``id, x, y, z, value``: declustering weights within the
    domain, weighted normal scores, and a model, all domains in the same jobs.  ``domain`` is the place of its
    name.  A domain without samples is an error."""
    number = F.create_map(*[F.lit(v) for k, n in enumerate(names) for v in (n, k)])
    own = df.withColumn("domain", number[F.col("domain_group")]).filter(F.col("domain").isNotNull())
    own = samples.decluster(own, size, "value", by="domain")
    table = stored(samples.score_table(own, "value", "decluster_weight", "id", by=("domain",)), "domain-scores")
    known = table.withColumnsRenamed({"value": "_v", "domain": "_d"})
    scored = stored(own.join(known, (F.col("value") == F.col("_v")) & (F.col("domain") == F.col("_d"))).drop("_v", "_d"), "domain-samples")
    found = {r["domain"] for r in scored.select("domain").distinct().collect()}
    if len(found) < len(names):
        raise ValueError(f"no samples in {[n for k, n in enumerate(names) if k not in found]}")
    models = fitted_by(scored, "domain", reach, lags, kind, orientation=orientation)
    return Prepared(scored, table, {k: models.get(k, Model(kind).with_sill(1.0)) for k in range(len(names))})


def cascade(prepared: Prepared, cells: DataFrame, search: Search, seed: int, trend: tuple[list[float], list[str]] | None = None) -> DataFrame:
    """Rows ``real_id, domain, cell_id, value, neighbours`` in the samples' units: each domain of each realisation
    (cells ``real_id, domain, cell_id, x, y, z``) simulated from its own samples by its own model, taken back by its own
    scores, and the trend put on again."""
    drawn = simulate(cells, prepared.samples, prepared.models, search, seed).withColumnRenamed("value", "drawn")
    out = samples.interpolated(drawn, "drawn", prepared.scores, "score", "value", "value", by=("domain",)).drop("drawn")
    if trend is not None:
        places = cells.select("real_id", "cell_id", "x", "y", "z")
        out = with_trend(out.join(places, ["real_id", "cell_id"]), *trend)
    return out.select("real_id", "domain", "cell_id", "value", "neighbours")


def simulated_curve(points: DataFrame, grid: Grid, n_real: int, search: Search, seed: int, cutoffs: list[float], density: float, reach: float, lags: int) -> DataFrame:
    """Summary over realisations of the cutoff curve: scores and model fitted on the points
    (``id, x, y, z, value``), simulated on the grid, and taken back to values."""
    table = samples.score_table(points, "value")
    scored = points.join(table.withColumnRenamed("value", "_v"), F.col("value") == F.col("_v")).drop("_v").withColumn("domain", F.lit(0))
    cells = grid.cells(points.sparkSession).withColumn("real_id", F.explode(F.sequence(F.lit(0), F.lit(n_real - 1)))).withColumn("domain", F.lit(0))
    drawn = simulate(cells, scored, {0: fitted(scored, reach, lags)}, search, seed).withColumnRenamed("value", "drawn")
    back = samples.interpolated(drawn, "drawn", table, "score", "value", "value")
    return ensemble.curve_summary(ensemble.cutoff_curve(back, cutoffs, grid.volume, density))


def spacing_sensitivity(points: DataFrame, share: float, cutoff: float, hole_seed: int = 42, by: str = "hole_id", **given) -> DataFrame:
    """Tonnage widths at a cutoff, simulated from all holes and from a seeded share of them, and by how much all narrow it."""
    both = [simulated_curve(p, cutoffs=[cutoff], **given) for p in (points, hole_subset(points, share, hole_seed, by))]
    return compare.width_reduction(*both, cutoff)


def model_warnings(models: DataFrame, grid: Grid) -> DataFrame:
    """Rows ``model, warning`` of what makes models (``model, nugget, variance, reach``) doubtful for simulation on a grid: the range
    against the grid's extent and in itself, nugget and sill."""
    extent = max(n * s for n, s in zip(grid.shape, grid.step, strict=True))
    reach, sill = F.col("reach"), F.col("nugget") + F.col("variance")
    found = [
        F.when(reach < 0.05 * extent, "range is very small for the grid").when(reach > 10 * extent, "range is extremely large for the grid"),
        F.when((sill > 0) & (F.col("nugget") / sill > 0.8), "nugget effect is high"),
        F.when((sill > 0) & (F.col("variance") < 0.01), "variance is very small"),
        F.when(~reach.between(10, 10_000), "error: range is unrealistic"),
    ]
    return models.select("model", F.explode(F.array_compact(F.array(*found))).alias("warning"))


def model_rows(spark: SparkSession, models: dict) -> DataFrame:
    """Rows ``model, nugget, variance, reach`` of named models."""
    return spark.createDataFrame([(str(k), m.nugget, m.variance, m.reach) for k, m in models.items()], "model string, nugget double, variance double, reach double")


def with_trend(cells: DataFrame, coefficients: list[float], columns: list[str], value: str = "value") -> DataFrame:
    """The value and the trend at each cell's coordinates."""
    if len(coefficients) != len(columns) + 1 or not set(columns) <= set("xyz"):
        raise ValueError("a trend has an intercept and a slope for each of x, y and z that it uses")
    return cells.withColumn(value, F.col(value) + sum((F.col(c) * b for c, b in zip(columns, coefficients[1:], strict=True)), F.lit(coefficients[0])))


def hole_subset(df: DataFrame, share: float, seed: int, by: str = "hole_id") -> DataFrame:
    """Rows of a seeded share of the holes."""
    keep = df.select(by).distinct().filter(F.pmod(F.xxhash64(by, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    return df.join(keep, by, "left_semi")


def bootstrap_median(df: DataFrame, value: str, resamples: int, seed: int) -> DataFrame:
    """5, 50 and 95 percent marks of the median over resamples of the values, drawn by Poisson weights.

    A value that n rows have is drawn a Poisson number of times with mean n: as
    often as n rows that draw apart from each other.  So rows are first counted
    by value, and equal rows share no luck.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def draw(batches):
        for batch in batches:
            times = np.stack([np.random.default_rng([seed, int(np.float64(v).view(np.uint64))]).poisson(n, resamples) for v, n in zip(batch["v"], batch["n"], strict=True)]) if len(batch) else np.zeros((0, resamples), int)
            row, sample = np.nonzero(times)
            yield pd.DataFrame({"resample": sample, "v": batch["v"].to_numpy()[row], "n": times[row, sample]})

    drawn = counts.mapInPandas(draw, "resample long, v double, n long")
    med = drawn.groupBy("resample").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("m"))
    return med.agg(*[F.percentile("m", F.lit(p)).alias(f"p{round(100 * p):02d}") for p in (0.05, 0.5, 0.95)])


def least_squares(df: DataFrame, y: str, xs: list[str]) -> list[float]:
    """Intercept and slopes from sums of products: one pass, one row to the driver."""
    cols = [F.lit(1.0), *map(F.col, xs)]
    n = len(cols)
    sums = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(cols[i] * F.col(y)).alias(f"b{i}") for i in range(n)]).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    return np.linalg.lstsq(a, np.array([sums[f"b{i}"] for i in range(n)], float), rcond=None)[0].tolist()
