import sys
import zlib
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

import corpus_pipeline  # noqa: E402
from orebed.llm import quality, tokens  # noqa: E402
from orebed.llm.common import stored, table  # noqa: E402

SF = cases.SF


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage, over driver documents and awkward rows."""
    docs = table(spark, SF, "documents")
    own = [(i, t, "en", "s", 3) for i, t in cases.rows(4)[4:]]
    docs = docs.unionByName(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("component_id", F.lit("x"))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        done = stored(stage(spark, docs, SF), name)
        out.append((docs, done))
        docs = done
    return out


def pairs(df):
    return [(None if pd.isna(r[0]) else int(r[0]), r[1]) for r in df.select("doc_id", "text").toPandas().astype(object).itertuples(index=False)]


def test_stages_return_the_columns_of_documents(steps):
    for docs, done in steps[:-1]:
        assert done.columns == docs.columns and done.dtypes == docs.dtypes
    assert len(corpus_pipeline.STAGES) == 5


def test_clashing_columns_come_back(spark, steps):
    docs = steps[1][0].withColumn("n_lines", F.lit("mine")).withColumn("N_Dropped", F.lit("too"))
    done = corpus_pipeline.drop_lines(spark, docs, SF)
    assert done.columns == docs.columns and done.dtypes == docs.dtypes
    assert done.filter("n_lines <> 'mine' OR N_Dropped <> 'too'").isEmpty() and done.count() == docs.count()


def test_quality_stage(spark, steps):
    docs, done = steps[0]
    scored = quality.score_quality(docs, table(spark, SF, "labels"))
    assert done.count() == scored.filter("predicted = 1").count()
    labels = table(spark, SF, "labels")
    clean = labels.filter("quality = 1").join(docs.select("doc_id"), "doc_id")
    assert done.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    junk = labels.filter("quality = 0").join(docs.select("doc_id"), "doc_id")
    assert done.join(junk, "doc_id", "left_semi").count() <= 0.05 * junk.count() + 1


def test_lines_stage(steps):
    docs, done = steps[1]
    cases.same(done.select("doc_id", "text").toPandas(), [(r[0], r[3]) for r in cases.recurring(pairs(docs), 10, 0.8)])


def test_near_stage(steps):
    docs, done = steps[2]
    data = pairs(docs)
    want = [d for d, (_, _, _, kept) in zip(data, cases.near(data, 80), strict=True) if kept]
    cases.same(done.select("doc_id", "text").toPandas(), want)


def test_leaks_stage(spark, steps):
    docs, done = steps[3]
    bench = table(spark, SF, "benchmark").toPandas()
    items = list(zip(bench["item_id"].tolist(), bench["text"].tolist(), strict=True))
    data = pairs(docs)
    # Every place of every item is too many: only items that share four words in a row with a text.
    runs = lambda t: {tuple(w[i : i + 4]) for w in [cases.plain_words(t)] for i in range(len(w) - 3)}
    by_run = {}
    for k, (_, t) in enumerate(items):
        for x in runs(t):
            by_run.setdefault(x, set()).add(k)
    clean = []
    for row in data:
        near = sorted({k for x in runs(row[1]) for k in by_run.get(x, ())})
        if len(row[1] or "") > 50_000 or not cases.overlaps([row], [items[k] for k in near], 13, 0.8)[0][1]:
            clean.append(row)
    assert 0 < len(clean) < len(data)
    cases.same(done.select("doc_id", "text").toPandas(), clean)


def test_packing_stage(steps):
    docs, done = steps[4]
    got = done.toPandas()
    enc, want = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json")), []
    for i, t in pairs(docs):
        x = enc.direct(t or "") + (1).to_bytes(4, "little")
        for k, a in enumerate(range(0, len(x) // 4, 4096)):
            part = x[4 * a : 4 * (a + 4096)]
            want.append((i, k, a, len(part) // 4, zlib.crc32(part)))
    cases.same(got[["doc_id", "piece", "start", "length", "ids_crc32"]], want)
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")["length"]
    assert (by.cumsum() - got["length"] == got["offset"]).all() and by.sum().max() <= 4096
