import gzip
import io
import itertools
import random
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from orebed.llm import common, decontaminate, warc  # noqa: E402


def test_arc_versions_and_lengths():
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nline\nmore\r\n\r\n"
        data = gzip.compress(warc.arc_version_block(version, "a.arc.gz")) + gzip.compress(warc.arc_header(version, "http://x/a b", "20080430204825", "text/html", len(body), "a.arc.gz", 9) + body + b"\n")
        (r,) = warc.read_arc(io.BytesIO(data))
        assert r.content == body and r.fields["URL"] == "http://x/a%20b" and r.fields["Archive-length"] == str(len(body))
        with pytest.raises((ValueError, EOFError)):
            list(warc.read_arc(io.BytesIO(data[:-12])))
    assert warc.warc_date("20080430204825") == "2008-04-30T20:48:25Z"
    assert warc.warc_date("200804302048") == "2008-04-30T20:48:00Z"
    assert warc.warc_date("junk") == "1970-01-01T00:00:00Z"
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


@pytest.mark.parametrize("small", [True, False])
def test_arc_however_compressed(small, monkeypatch):
    bodies = [b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i]) * (i * 40) + b"\n\n" for i in range(4)] + [b"x" * 300_000, b""]
    head = warc.arc_version_block(1, "a.arc")
    records = [warc.arc_header(1, f"http://x/{i}", "20080430204825", "text/html", len(b), "a.arc", 9) + b + b"\n" for i, b in enumerate(bodies)]
    plain = head + b"".join(records)
    pairs = gzip.compress(head + records[0]) + gzip.compress(records[1] + records[2]) + gzip.compress(b"".join(records[3:]))
    split = gzip.compress(plain[:200]) + gzip.compress(plain[200:])
    each = gzip.compress(head) + b"".join(map(gzip.compress, records))
    inflated = warc.inflated
    if small:
        monkeypatch.setattr(warc, "inflated", lambda f: inflated(f, 997))
    for data in (plain, gzip.compress(plain), pairs, split, each):
        got = list(warc.read_arc(io.BytesIO(data)))
        assert [r.content for r in got] == bodies
        assert [r.fields["URL"] for r in got] == [f"http://x/{i}" for i in range(len(bodies))]
        assert len({r.offset for r in got}) == len(bodies)
    for junk in (b"left over", b"left over\n"):
        for data in (plain + junk, gzip.compress(plain + junk)):
            with pytest.raises(ValueError):
                list(warc.read_arc(io.BytesIO(data)))


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    pages = [(i, f"http://e/{i % 3}", f"<p>{i % 7}</p>" * 40) for i in range(60)]
    pages += [(100, None, None), (101, "http://e/ x\n", ""), (102, "u", ""), (None, "u", "<p>0</p>" * 40), (None, None, "alone"), (5, "u", "é\r\n\r\n\0"), (5, "u", "é\r\n\r\n\0"), (103, "u", "HTTP/1.1 404\r\n\r\nx"), (104, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, record_type string, offset int").repartition(3)
    arcs = warc.write_arc(df, common.scratch(spark, "arc"))
    assert arcs.count() > 3
    files = warc.convert(arcs, common.scratch(spark, "warc"), least)
    got = warc.read_archives(files).toPandas()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    done = set()
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (h or "").encode()
        again = len(data) >= least and (h or "") in done
        done.add(h or "")
        want.append((i, len(data), warc.digest(data), "revisit" if again else "response", first[h or ""] if again else None))
    cases.same(got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]], want)
    ids = set(got.loc[got["record_type"] == "response", "record_id"])
    assert got["record_id"].is_unique and set(got["refers_to_record"].dropna()) <= ids
    empty = warc.write_arc(df.limit(0), common.scratch(spark, "arc"))
    assert warc.read_archives(warc.convert(empty, common.scratch(spark, "warc"))).count() == 0


def test_longest_overlap_against_plain():
    r = random.Random(4)
    for _ in range(300):
        same = np.array([r.random() < 0.75 for _ in range(r.randint(1, 40))])
        best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i:j].mean() >= 0.8 - 1e-12), default=0)
        assert decontaminate.longest_overlap(same, 0.8) == best


@pytest.mark.parametrize(("min_words", "similarity"), [(13, 0.8), (6, 0.7)])
def test_masks_hit_every_overlap(min_words, similarity):
    for length in range(1, 2 * min_words + 1):
        masks = [sum(1 << i for i, c in enumerate(m) if c == "1") for m in decontaminate.masks_for(length, min_words, similarity)]
        spans = [m.bit_length() for m in masks]
        for n in range(min(min_words, length), min(length, 2 * min_words - 1) + 1):
            changed = itertools.combinations(range(n), int(n * (1 - similarity) + 1e-9))
            same = np.array([(1 << n) - 1 - sum(1 << i for i in c) for c in changed])
            hit = np.zeros(len(same), bool)
            for m, span in zip(masks, spans, strict=True):
                for at in range(n - span + 1):
                    hit |= same & (m << at) == m << at
            assert hit.all(), (length, n)


def test_short_items_with_changed_words():
    for length in range(1, 21):
        own = [f"w{i}" for i in range(length)]
        index = decontaminate.Index.build([(7, " ".join(own))])
        texts = []
        for changed in itertools.combinations(range(length), length // 5):
            texts.append(" ".join(["a", "b", *("zzz" if i in changed else w for i, w in enumerate(own)), "c"]))
        step = max(1, len(texts) // 300)
        assert all(x == {7: length} for x in index.overlaps(texts[::step], 13, 0.8)), length
        too_many = " ".join("zzz" if i <= length // 5 else w for i, w in enumerate(own))
        assert length > 13 or index.overlaps([too_many], 13, 0.8) == [{}]


def test_leaks(spark):
    bench = pd.read_parquet(f"{cases.SF}/benchmark.parquet")
    docs = pd.read_parquet(f"{cases.SF}/documents.parquet")
    r = random.Random(6)
    data = [(int(i), t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)]
    clean = {i for i, t in data if not any(" ".join(b.split()[:6]) in " ".join(t.split()) for b in bench["text"])}
    planted = {}
    for n in range(60):
        k = r.randrange(len(bench))
        words = bench["text"][k].split()
        if n % 3:  # one word in ten replaced
            words = ["zzz" if j % 10 == n % 10 else w for j, w in enumerate(words)]
        host = data[r.randrange(100)][1].split()
        at = r.randrange(len(host) + 1)
        planted[20_000 + n] = int(bench["item_id"][k])
        data.append((20_000 + n, " ".join(host[:at] + [w.upper() if n % 2 and w.isascii() else w for w in words] + host[at:])))
    data += [(30_000, None), (30_001, ""), (None, bench["text"][0]), (30_002, "short item"), (30_002, "a short item b")]
    items = [(int(i), t) for i, t in zip(bench["item_id"], bench["text"], strict=True)] + [(None, "x y"), (900, None), (901, "short item"), (902, "")]
    df = cases.frame(spark, data)
    b = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    for words in (decontaminate.INDEX_WORDS, 500):
        out = decontaminate.find_overlaps(df, b, index_words=words).collect()
        assert len(out) == len(data)
        found = {x["doc_id"]: x["items"] for x in out if x["doc_id"] is not None}
        assert all(k in found[d] for d, k in planted.items())
        assert found[30_002] == [901] and found[30_000] == found[30_001] == []
        assert any(x["doc_id"] is None and x["items"] == [int(bench["item_id"][0])] for x in out)
        assert not [d for d in clean if found[d]]
    assert decontaminate.find_overlaps(df, b.limit(0)).filter("size(items) > 0").isEmpty()
    assert decontaminate.find_overlaps(df.limit(0), b).count() == 0


def test_leaks_against_every_place(spark):
    r = random.Random(12)
    word = lambda: "abcdefg"[r.randrange(7)] * r.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 6, 8, 9, 11, 12, 13, 14, 17, 22, 30, 30])]
    data = [(i, " ".join(word() for _ in range(r.randrange(0, 60)))) for i in range(60)]
    for i in range(60, 200):
        own = items[r.randrange(len(items))][1].split()
        part = own[r.randrange(0, 3) :]
        part = [word() if r.random() < 0.15 else w for w in part]
        data.append((i, ", ".join([*(word() for _ in range(r.randrange(4))), *part, *(word().upper() for _ in range(r.randrange(4)))])))
    data += [(200, None), (201, ""), (None, items[9][1]), (60, data[60][1]), (202, "a " * 300)]
    items += [(100, "a " * 40)]
    got = decontaminate.find_overlaps(cases.frame(spark, data), spark.createDataFrame(items, "item_id long, text string"))
    got = got.select("doc_id", F.array_join(F.col("items").cast("array<string>"), " ").alias("items"), "overlap").toPandas()
    cases.same(got, cases.overlaps(data, items, 13, 0.8))


def test_one_word_text_is_quick():
    items = [(k, "word " * 200) for k in range(5)]
    index = decontaminate.Index.build(items)
    began = time.perf_counter()
    assert index.overlaps(["word " * 8000], 13, 0.8) == [dict.fromkeys(range(5), 200)]
    assert time.perf_counter() - began < 5


def test_warc_ids_and_empty_archives(spark):
    pages = [(1152921504606846977, "u", "same"), (1152921504606846979, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    arcs = warc.write_arc(df, folder := common.scratch(spark, "arc"))
    with common.committed(f"{folder}/none.arc.gz") as out:
        out.write(gzip.compress(warc.arc_version_block(1, "none.arc.gz")))
    arcs = arcs.unionByName(spark.createDataFrame([(f"{folder}/none.arc.gz", 0)], "path string, records long"))
    files = warc.convert(arcs, common.scratch(spark, "warc"))
    assert sorted(r["records"] for r in files.collect())[0] == 0
    got = {r["page_id"]: r["refers_to"] for r in warc.read_archives(files).collect()}
    assert got == {1152921504606846977: None, 1152921504606846979: 1152921504606846977, None: None}


def test_arc_names_its_fields_and_dates(spark):
    body = b"1 0 x\nURL Archive-length Archive-date IP-address Content-type\n"
    head = b"filedesc://a 0.0.0.0 20080430204825 text/plain %d\n" % len(body) + body + b"\n"
    (r,) = warc.read_arc(io.BytesIO(head + b"http://x 3 20080430204825 1.2.3.4 text/html\nabc\n"))
    assert r.content == b"abc" and r.fields["Archive-date"] == "20080430204825" and r.fields["IP-address"] == "1.2.3.4"
    df = spark.sql("SELECT 1L AS page_id, 'u' AS url, 'x' AS html, TIMESTAMP '2008-04-30 20:48:25' AS at UNION ALL SELECT 2L, 'u', 'y', NULL")
    files = warc.convert(warc.write_arc(df, common.scratch(spark, "arc"), date_column="at"), common.scratch(spark, "warc"))
    assert {r["page_id"]: r["warc_date"] for r in warc.read_archives(files).collect()} == {1: "2008-04-30T20:48:25Z", 2: "1970-01-01T00:00:00Z"}


def test_many_blocks_of_items_are_one_stage(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(10)]
    docs = spark.createDataFrame([(1, items[3][1] + " and " + items[7][1]), (2, "none of it"), (3, None), (None, items[0][1]), (2, items[9][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.find_overlaps(docs, bench)
    many = decontaminate.find_overlaps(docs, bench, index_words=20)
    key = lambda r: (r["doc_id"] or 0, r["text"] or "")
    got = sorted(map(tuple, many.select("doc_id", "text", "items", "overlap").collect()), key=lambda r: (r[0] or 0, r[1] or ""))
    assert got == [tuple(r) for r in sorted(one.select("doc_id", "text", "items", "overlap").collect(), key=key)] and got[1][2] == [3, 7]
    assert "MapInArrow" not in many._jdf.queryExecution().executedPlan().toString()
