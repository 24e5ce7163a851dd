import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from orebed.llm import bitplanes, common, packing, quality, token_counts, tokens  # noqa: E402

BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def data():
    return cases.rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return cases.frame(spark, data).cache()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_gives_the_ids_of_the_library(path, data):
    enc, r = tokens.Encoder(path), random.Random(5)
    parts = [" ", "\n", "\t", "a", "B", "'s", "1", "é", "É", "ß", ".", " ", "\x1c", "\0", "<|endoftext|>", "́", "\r", "!!", " x", "'ll", " ", "\x85", "　", "Σ"]
    odd = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    for text in [*odd, *(t for _, t in data if len(t or "") < 20_000)]:
        assert enc.encode(text) == enc.direct(text or ""), repr(text)[:80]


def test_counts_and_cache(spark, docs, data):
    enc, cache = tokens.Encoder(BYTE), common.scratch(spark, "cache")
    want = [(i, len((t or "").encode()), len(enc.direct(t or "")) // 4) for i, t in data]
    some = docs.filter("doc_id % 2 = 0")
    cases.same(token_counts.count_tokens(some, BYTE, cache).toPandas(), [w for w in want if w[0] is not None and w[0] % 2 == 0])
    version = tokens.version_digest(BYTE)
    first = token_counts.read_cache(spark, cache, version).count()
    assert first == len({t or "" for i, t in data if i is not None and i % 2 == 0})
    cases.same(token_counts.count_tokens(docs, BYTE, cache).toPandas(), want)
    stored = spark.read.parquet(f"{cache}/version={version}")
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in data})
    cases.same(token_counts.count_tokens(docs, WORD, cache).select("doc_id", "n_bytes").toPandas(), [w[:2] for w in want])
    assert token_counts.count_tokens(docs.limit(0), BYTE, common.scratch(spark, "cache")).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(spark, docs, data, kind, monkeypatch):
    monkeypatch.setattr(bitplanes, "BLOCK_IDS", 1000)
    monkeypatch.setattr(bitplanes, "SHARD_IDS", 5000)
    enc = tokens.Encoder(BYTE)
    got = bitplanes.read_tokens(bitplanes.write_tokens(docs, BYTE, common.scratch(spark, "planes"), kind=kind)).toPandas()
    end = np.zeros(1, "<u4").tobytes()
    ids = [(i, enc.direct(t or "") + end) for i, t in data]
    cases.same(got[["doc_id", "n_tokens", "ids_crc32"]], [(i, len(x) // 4, zlib.crc32(x)) for i, x in ids])
    got = got.sort_values("start")
    assert (got["start"].to_numpy() == np.cumsum(got["n_tokens"]) - got["n_tokens"]).all()
    order = got["doc_id"].fillna(-1).to_numpy()
    assert (np.diff(order) >= 0).all()
    assert bitplanes.read_tokens(bitplanes.write_tokens(docs.limit(0), BYTE, common.scratch(spark, "planes"))).count() == 0


def test_planes_of_all_ids(tmp_path):
    ids = np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint32)
    for kind in ("byte", "bit"):
        with open(tmp_path / kind, "wb") as f:
            w = bitplanes.Writer(f, kind, block=64)
            w.add(7, ids[:1].tobytes())
            w.add(None, b"")
            w.add(7, ids[1:].tobytes())
            w.close()
        assert list(bitplanes.read_shard(str(tmp_path / kind))) == [(7, ids[:1].tobytes()), (None, b""), (7, ids[1:].tobytes())]


@pytest.mark.parametrize("group", [200_000, 40])
def test_packing(docs, data, group, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", group)
    got = packing.pack(docs, WORD, capacity=512).toPandas()
    enc, want = tokens.Encoder(WORD), []
    for i, t in data:
        x = enc.direct(t or "") + np.array([1], "<u4").tobytes()
        for k, a in enumerate(range(0, len(x) // 4, 512)):
            part = x[4 * a : 4 * (a + 512)]
            want.append((i, k, a, len(part) // 4, zlib.crc32(part)))
    cases.same(got[["doc_id", "piece", "start", "length", "ids_crc32"]], want)
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")["length"]
    assert (by.cumsum() - got["length"] == got["offset"]).all() and by.sum().max() <= 512
    underfull = sorted(int(x) for x in by.sum() if x < 512 - int(512 * packing.SLACK))
    assert len(underfull) < 2 or underfull[0] + underfull[1] > 512
    least = -(-int(got["length"].sum()) // 512)
    assert by.ngroups <= (1.02 if group > 1000 else 1.2) * least + 1
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_best_fit_against_plain():
    r = random.Random(8)
    sizes = sorted((r.randint(1, 100) for _ in range(500)), reverse=True)
    bins, places, fill = packing.best_fit(np.array(sizes), 100)
    room: list[int] = []
    for s in sizes:
        fits = [x for x in room if x >= s]
        if fits:
            room[room.index(min(fits))] -= s
        else:
            room.append(100 - s)
    assert sorted(fill) == sorted(100 - x for x in room)


def test_quality(spark, docs):
    sf = "/root/testdata/sf0.01"
    out = quality.op5_quality(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    x = out.merge(labels, on="doc_id")
    x = x[x["held_out"]]
    assert (x["predicted"] == x["quality"]).mean() >= 0.95


def test_quality_odd_inputs(spark, docs):
    marks = spark.createDataFrame([(9001, 0), (9002, None), (None, 1), (1, 1), (1, 1), (3, 1), (9014, 0)], "doc_id long, quality int")
    out = quality.score_quality(docs, marks).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    for labels in (marks.limit(0), marks.filter("quality = 1")):
        assert quality.score_quality(docs, labels).agg(F.min("predicted")).first()[0] == 1
    assert quality.score_quality(docs.limit(0), marks).count() == 0
