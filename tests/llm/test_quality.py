"""The quality classifier against plain NumPy, and the pipeline's stages on tables without rows."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

import corpus_pipeline  # noqa: E402
from orebed.llm import quality  # noqa: E402
from orebed.llm.common import table  # noqa: E402
from orebed.llm.words import Words  # noqa: E402


def test_hashed_features():
    texts = ["a b a é", "", None, " \n ", "aaaa", "ab", "x" * 30_000 + " y"]
    got = quality.hashed(texts)
    k = quality.HASHED
    for row, t in zip(got, texts, strict=True):
        words = (t or "").lower().split()
        want = np.zeros(2 * k)
        for w in words:
            want[int(Words([w]).hashes()[0] % np.uint64(k))] += 1 / len(words)
        data = (t or "").encode()
        for i in range(len(data) - 2):
            a, b, c = (int(x[data[i + j]]) for j, x in enumerate((quality._FIRST, quality._SECOND, quality._THIRD)))
            want[k + ((a ^ b ^ c) & (k - 1))] += 1 / (len(data) - 2)
        assert np.allclose(row, np.sqrt(want), atol=1e-5)
    assert quality.measured(texts).shape == (7, len(quality.NAMES)) and np.isfinite(quality.measured(texts)).all()
    assert quality.measured([]).shape == (0, len(quality.NAMES))


def test_fit_is_the_optimum():
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 6))
    y = (x @ [1.0, -2, 0.5, 0, 0, 0] + r.normal(size=300) > 0.4).astype(int)
    got = quality.fit(x, y, ridge=(1.0, 9.0))
    z = np.clip((x - got.mean) / got.scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.choice(good, quality.PARTNERS * len(bad)), np.repeat(good, quality.PARTNERS)])
    b = np.concatenate([np.repeat(bad, quality.PARTNERS), rng.choice(bad, quality.PARTNERS * len(good))])

    def loss(w):
        return np.log1p(np.exp(-(z[a] - z[b]) @ w)).mean() * len(x) + (w @ w) / 2

    best = loss(got.weights)
    slope = [(loss(got.weights + e) - loss(got.weights - e)) / 2e-4 for e in 1e-4 * np.eye(6)]
    assert np.abs(slope).max() < 1e-2 and all(loss(got.weights + 0.05 * r.normal(size=6)) > best for _ in range(20))
    assert np.allclose(got.strengths(x), z @ got.weights)
    # The labels part best at the strength found, of all there are.
    s = got.strengths(x)
    gain = lambda t: (s[y == 0] < t).mean() - (s[y == 1] < t).mean()
    assert gain(got.near) >= max(gain(t) for t in np.concatenate([s, s + 1e-9])) - 1e-12
    assert not quality.fit(x, np.ones(300, int)).weights.any() and not quality.fit(np.zeros((0, 4)), np.zeros(0, int)).weights.any()
    assert quality.parting(np.array([1.0, 1.0, 2.0, 2.0]), np.array([0, 1, 1, 1])) == 1.5


@pytest.fixture(scope="module")
def plain():
    """Strengths of the smallest documents, by the fit's own labels."""
    d, m = (pd.read_parquet(f"{cases.SF}/{t}.parquet") for t in ("documents", "labels"))
    m = m.dropna(subset=["quality"])[["doc_id", "quality"]].drop_duplicates()
    m = m[[zlib.crc32(str(i).encode()) % 5 != 0 for i in m["doc_id"]]]
    x = quality.measured(d["text"].tolist())
    known = d[["doc_id"]].assign(row=range(len(d))).merge(m, on="doc_id").sort_values(["doc_id", "quality"])
    ranker = quality.fit(x[known["row"]], known["quality"].to_numpy(int))
    return d["doc_id"].tolist(), ranker.strengths(x), ranker


@pytest.mark.parametrize("quantile", [None, 0.0, 0.25, 0.9])
def test_quality_against_numpy(spark, plain, quantile):
    ids, s, ranker = plain
    q = (s < ranker.near).mean() if quantile is None else quantile
    cut = np.quantile(s, q)
    docs, labels = (table(spark, cases.SF, t) for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in (quality.op5_quality(spark, cases.SF) if quantile is None else quality.score_quality(docs.repartition(5), labels, quantile=quantile)).collect()}
    assert sorted(got) == sorted(ids)
    rejected = 0
    for i, v in zip(ids, s, strict=True):
        want = 1 / (1 + np.exp(-(v - cut + np.log(0.3 / 0.7))))
        assert got[i]["score"] == pytest.approx(want, abs=2e-4) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3) and (abs(v - cut) < 1e-3 or got[i]["predicted"] == int(v >= cut))
        rejected += 1 - got[i]["predicted"]
    assert abs(rejected - q * len(ids)) <= 1
    kept = quality.keep_quality(docs, labels, quantile=quantile)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i in ids if got[i]["predicted"])


def test_what_reaches_the_driver_is_bounded(spark, monkeypatch):
    seen = []
    whole = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **k: seen.append(len(x)) or whole(x, y, **k))
    docs = spark.createDataFrame([(7, f"same id {i}") for i in range(300)] + [(i, f"text {i} " + "!! ## " * (i % 2)) for i in range(100, 400)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 500 + [(7, 0)] * 2 + [(i, i % 2) for i in range(100, 400)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels, fit_rows=40)
    assert out.count() == 600 and len(seen) == 1 and 10 <= seen[0] <= 80
    quality.score_quality(docs, labels)
    assert seen[1] <= 2 * 301


def test_equal_texts_have_equal_scores(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " ", "a b c"] * 3 + ["x " * 30_000])], "doc_id long, text string").withColumn("strength", F.lit("mine"))
    labels = spark.createDataFrame([(0, 0), (3, 1), (7, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).toPandas().sort_values("doc_id")["score"].to_numpy()
    assert got[0] == got[1] == got[4] and got[3] == got[7] == got[11] and ((got >= 0) & (got <= 1)).all()
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.filter("strength <> 'mine'").isEmpty()


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES])
def test_stages_without_rows(spark, stage):
    docs = table(spark, cases.SF, "documents").limit(0)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, cases.SF).count() == 0
