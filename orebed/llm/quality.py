"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

import dataclasses
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import order
from .common import pick, stored, table
from .words import Words, slices

#: Labelled ids that a fit uses at most, those with the least hash.
FIT_ROWS = 20_000
#: Preferred texts that each rejected text is compared with, and the reverse.
PARTNERS = 4
#: Rows and pairs that the fit holds in full precision at a time.
FIT_BLOCK = 4096
#: Classes of hashed words, and of hashed runs of three bytes, whose shares of a text are features.
HASHED = 128
#: Ridge of the named features' weights, and of the hashed ones'.
RIDGE = (1.0, 30.0)
NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "other_bytes", "line_feeds", "commas_stops",
    "bangs", "bars", "signs", "brackets", "distinct_words", "repeats", "top_word", "long_words", "repeats_any", "signs_any",
    *[f"word_{k}" for k in range(HASHED)], *[f"bytes_{k}" for k in range(HASHED)],
)
_FIRST, _SECOND, _THIRD = (np.random.default_rng(31).integers(0, 1 << 32, (3, 256), dtype=np.uint32))


def features(text: str | None) -> list[float]:
    """Shares and sizes of one whole text; a null or empty text gives finite values as well."""
    text = text or ""
    data = text.encode()
    n = len(data) or 1
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    m = len(words) or 1
    seen = set(words)
    repeats = sum(map(operator.eq, words, words[1:])) / m
    letters = int(count[65:91].sum() + count[97:123].sum()) or 1
    signs = int(count[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 126]].sum())
    stops = count[[44, 46]].sum()
    longest = max(map(len, seen), default=0)
    return [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / m, count[65:91].sum() / letters, count[48:58].sum() / n, count[128:].sum() / n, count[10] / n, stops / m,
        count[33] / m, count[124] / m, signs / m, count[[40, 41, 91, 93, 123, 125]].sum() / m, len(seen) / m, repeats, np.sqrt(len(seen)) / np.sqrt(m), min(longest, 64) / 64, float(repeats > 0.2), float(signs > 0.2 * m),
    ]


def hashed(texts: list[str | None]) -> np.ndarray:
    """Of each whole text the square roots of the shares of its words, and of its runs of three bytes, in each class of hashes."""
    w = Words(texts, lower=True)
    out = np.zeros((len(texts), 2 * HASHED), np.float32)
    n = w.counts
    doc = np.repeat(np.arange(len(texts)), n)
    words = np.bincount(doc * HASHED + (w.hashes() % np.uint64(HASHED)).astype(np.int64), minlength=len(texts) * HASHED).reshape(-1, HASHED)
    out[:, :HASHED] = words / np.maximum(n, 1)[:, None]
    raw = np.frombuffer(w.data, np.uint8)
    ends = np.cumsum([len((t or "").encode()) + 1 for t in texts])
    for k, (start, end) in enumerate(zip([0, *ends[:-1]], ends - 1, strict=True)):
        x = raw[start:end]
        if len(x) >= 3:
            h = (_FIRST[x[:-2]] ^ _SECOND[x[1:-1]] ^ _THIRD[x[2:]]) & np.uint32(HASHED - 1)
            out[k, HASHED:] = np.bincount(h, minlength=HASHED) / len(h)
    return np.sqrt(out)


def measured(texts: list[str | None]) -> np.ndarray:
    """The features of each text, a row each."""
    if not len(texts):
        return np.zeros((0, len(NAMES)), np.float32)
    return np.concatenate([np.array([features(t) for t in texts], np.float32), hashed(texts)], axis=1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            x = measured(texts[a:b])
            rows = batch.slice(a, b - a)
            columns = [rows.column("doc_id"), rows.column("label"), rows.column("tie"), pa.array(list(x), pa.list_(pa.float32()))]
            yield pa.record_batch(columns, names=["doc_id", "label", "tie", "x"])


@dataclasses.dataclass
class Ranker:
    """Strength of a text is weights . (x - mean) / scale, each term cut off at 8 deviations; ``near`` is the strength
    that parts the labels of the fit best (balanced accuracy)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    near: float = 0.0

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def column(self, text: Column) -> Column:
        """The strength of every text."""

        @F.pandas_udf(T.DoubleType())
        def strength(texts: pd.Series) -> pd.Series:
            held = texts.tolist()
            parts = [self.strengths(measured(held[a:b])) for a, b in slices(held)]
            return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        return strength(text)


def score(strength: Column, cut: float, threshold: float) -> Column:
    """From 0 to 1, and exactly the threshold where the strength is the cut."""
    shift = float(np.log(threshold / (1 - threshold)))
    return F.when(strength == cut, F.lit(threshold)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-(strength - cut + shift))))


def fit(x: np.ndarray, label: np.ndarray, seed: int = 5, ridge: tuple[float, float] = RIDGE) -> Ranker:
    """Weights by Newton's method on the logistic loss of feature differences, held small by a ridge,
    which is weaker for the named features than for the hashed ones.

    Each rejected text is paired with PARTNERS preferred ones and the reverse.
    With one label only, or none, all weights are 0."""
    d = x.shape[1] if x.size else len(NAMES)
    if not len(x) or label.min() == label.max():
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d))
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float)
    scale[scale < 1e-9] = 1.0
    z = np.empty(x.shape, np.float32)
    for k in range(0, len(x), FIT_BLOCK):
        z[k : k + FIT_BLOCK] = np.clip((x[k : k + FIT_BLOCK] - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(seed)
    a = np.concatenate([rng.choice(good, PARTNERS * len(bad)), np.repeat(good, PARTNERS)])
    b = np.concatenate([np.repeat(bad, PARTNERS), rng.choice(bad, PARTNERS * len(good))])
    w, share = np.zeros(d), len(x) / len(a)
    hold = np.where(np.arange(d) < d - 2 * HASHED, *ridge) if d > 2 * HASHED else np.full(d, ridge[0])
    for _ in range(25):
        grad, hess = hold * w, np.diag(hold)
        # Differences are made a block at a time: what is held doesn't follow the number of pairs.
        for k in range(0, len(a), FIT_BLOCK):
            diff = (z[a[k : k + FIT_BLOCK]] - z[b[k : k + FIT_BLOCK]]).astype(float)
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = grad - share * (diff * p[:, None]).sum(0)
            hess = hess + share * (diff * (p * (1 - p))[:, None]).T @ diff
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return Ranker(mean, scale, w, parting(z @ w, label))


def parting(strength: np.ndarray, label: np.ndarray) -> float:
    """Halfway between the two strengths between which the labels part best; of equal partings the middle one."""
    order = np.argsort(strength, kind="stable")
    s, y = strength[order], label[order]
    gain = np.cumsum(y == 0) / (y == 0).sum() - np.cumsum(y == 1) / (y == 1).sum()
    gain[:-1][s[1:] == s[:-1]] = -np.inf  # equal strengths can't be parted
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(best[len(best) // 2])
    return float(s[k] + s[min(k + 1, len(s) - 1)]) / 2


def held_out(column: str = "doc_id", folds: int = 5) -> Column:
    """True for ids whose CRC-32, taken of the id as text, is a multiple of folds; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "quality", fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Ranker:
    """The ranker fitted on labelled rows that are not held out, an id and a label counting once.

    The fit takes at most ``fit_rows`` ids, those with the least hash, and of rows that
    repeat an id the one with the least hash of its text: so what reaches the
    driver is bounded, whatever repeats."""
    marks = pick(labels, doc_id=id_column, label=label_column).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    marks = stored(marks.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("label").cast("int").alias("label")).distinct(), "labels")
    ids = marks.agg(F.count_distinct("doc_id")).first()[0]
    if ids > fit_rows:
        # Below the limit by four deviations of what a hash lets through.
        share = max(0.5 * fit_rows, fit_rows - 4 * fit_rows**0.5) / ids
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most fit_rows ids, twice if both labels name one.
    known = rows.join(F.broadcast(marks), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("tie"), "text")
    x = known.mapInArrow(_measured, "doc_id long, label int, tie long, x array<float>")
    x = x.groupBy("doc_id", "label").agg(F.min(F.struct("tie", "x")).alias("one")).select("doc_id", "label", "one.x")
    sample = x.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    flat = sample.column("x").combine_chunks().flatten().to_numpy()
    return fit(flat.reshape(sample.num_rows, len(NAMES)), sample.column("label").to_numpy())


def cut_at(strengths: DataFrame, quantile: float) -> float:
    """The exact quantile of the column ``strength`` of all rows; without rows, 0."""
    found = order.quantiles(strengths, "strength", [quantile]).first()
    return 0.0 if found is None else float(found["q"])


def _decided(docs: DataFrame, labels: DataFrame, label_column: str, quantile: float | None, fit_rows: int, id_column: str, text_column: str) -> tuple[DataFrame, Ranker, float]:
    """Strengths of all rows (``doc_id, strength``), the ranker, and the cut."""
    ranker = learn(docs, labels, label_column, fit_rows, id_column, text_column)
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), ranker.column(F.col("text")).alias("strength"))
    strengths = stored(rows, "strengths")
    if not ranker.weights.any():
        return strengths, ranker, -1.0  # nothing to choose by: all pass
    if quantile is None:
        quantile = strengths.agg(F.avg((F.col("strength") < ranker.near).cast("double"))).first()[0] or 0.0
    return strengths, ranker, cut_at(strengths, quantile)


def score_quality(docs: DataFrame, labels: DataFrame, label_column: str = "quality", threshold: float = 0.3, quantile: float | None = None, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted``, one for each input row.

    Learns from labelled rows that are not held out, at most ``fit_rows`` of
    them; only features of the text enter a score.  Texts below the exact
    ``quantile`` of all texts' strengths are rejected; the score there is
    ``threshold``.  Without ``quantile`` it is the share of all texts that are
    weaker than the strength which parts the labels of the fit best.

    Null and empty texts are scored alike, very long ones whole; equal texts
    have equal scores.  Null ids are never learnt from; rows that repeat an id
    are learnt from once; null labels not at all.  Without usable labels, or
    with labels of one kind, every text passes.  An empty table gives an empty
    result.  Other columns are ignored.
    """
    strengths, _, cut = _decided(docs, labels, label_column, quantile, fit_rows, id_column, text_column)
    scored = strengths.select("doc_id", held_out().alias("held_out"), score(F.col("strength"), cut, threshold).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, label_column: str = "quality", threshold: float = 0.3, quantile: float | None = None, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input rows whose text ``score_quality`` accepts, with all their columns.

    Texts are measured once for the cut, and again where rows are filtered:
    joining strengths back would move every text.  Rows with equal texts, at
    the cut too, are kept or rejected alike; null, empty and very long texts
    are treated as there; an empty table stays empty."""
    _, ranker, cut = _decided(docs, labels, label_column, quantile, fit_rows, id_column, text_column)
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    plain = plain.withColumn("strength", ranker.column(F.col(f"_{names.index(text_column)}")))
    return plain.filter(F.col("strength") >= cut).drop("strength").toDF(*names)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by what labels.quality marks."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
