import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from orebed.llm import components, lines, naming, near, substrings  # noqa: E402
from orebed.llm.common import stored  # noqa: E402


@pytest.fixture(scope="module")
def data():
    return cases.rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return cases.frame(spark, data).cache()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups(docs, data, percent):
    got = near.near_groups(docs, percent).select("doc_id", "n_shingles", "component_id", "kept").toPandas()
    cases.same(got, cases.near(data, percent))


@pytest.mark.parametrize("large", [1, 3, 64])
def test_near_groups_in_blocks(docs, data, monkeypatch, large):
    monkeypatch.setattr(near, "BLOCK", 2)
    monkeypatch.setattr(near, "LARGE", large)
    cases.same(near.near_groups(docs, 30).toPandas(), cases.near(data, 30))


def test_near_crowd(spark):
    # Many edits of one text: some near it, some near each other, most near nothing.
    import random

    r = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    data = []
    for i in range(220):
        w = list(words)
        for k in r.sample(range(150), r.randrange(0, 14)):
            w[k] = f"e{i}_{k}"
        data.append((i, " ".join(w)))
    cases.same(near.near_groups(cases.frame(spark, data), 85).toPandas(), cases.near(data, 85))


def test_near_buckets_of_unlinked_texts_move_no_sets(spark, monkeypatch):
    # A family that shares a long passage and is not linked: signatures rule all of its pairs out.
    monkeypatch.setattr(near, "LARGE", 8)
    sizes = {}

    def held(df, name):
        out = stored(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near, "stored", held)
    shared = [f"s{k}" for k in range(60)]
    data = [(i, " ".join([*shared, *(f"o{i}_{k}" for k in range(22))])) for i in range(300)]
    cases.same(near.near_groups(cases.frame(spark, data), 85).toPandas(), [(i, 78, i, True) for i in range(300)])
    assert sizes["blocks"] > 300 and sizes["open"] == 0


def test_near_chain(spark):
    # A chain: each text shares most with the next, the ends share little.
    words = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(60)]
    cases.same(near.near_groups(cases.frame(spark, data), 85).toPandas(), cases.near(data, 85))


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for keep in (0.95, 0.8, 0.5, 0.0):
        b = a.copy()
        n = int(len(a) * (1 - keep))
        b[:n] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        j = (len(a) - n) / (len(a) + n)
        _, low = near.signatures([a, b])
        bits = low.view(np.uint64)
        assert abs(near.estimated(bits[:1], bits[1:])[0] - j) < 0.2


@pytest.mark.parametrize(("window", "bits"), [(50, None), (12, None), (12, 8)])
def test_substrings(docs, data, window, bits):
    got = substrings.remove_repeats(docs, window, bits=bits).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).toPandas()
    cases.same(got, cases.repeats(data, window))


@pytest.mark.parametrize("block", [8192, 64, 7])
def test_exact(docs, data, block):
    data = [d for d in data if len(d[1] or "") < 50_000] if block == 7 else data
    if block == 7:
        docs = docs.filter("text IS NULL OR length(text) < 50000")
    cases.same(naming.exact_groups(docs, block_bytes=block).toPandas(), cases.exact(data))


def test_exact_names_do_not_depend_on_partitions(docs):
    def names(df):
        return {(x["doc_id"], x["sha256"].hex(), x["name"]) for x in naming.names_of_texts(df, block_bytes=64).filter("length(sha256) > 0 AND blocks < 100").collect()}

    one = names(docs.repartition(1))
    assert one == names(docs.repartition(5)) and len({n for *_, n in one}) > 50


def test_exact_with_colliding_hashes(docs, data):
    def weak(block, seed):
        return [F.lit(0).cast("long"), F.lit(0).cast("long")] if seed < 2 else naming.block_hashes(block, seed)

    cases.same(naming.exact_groups(docs, hashes=weak).toPandas(), cases.exact(data))


@pytest.mark.parametrize(("min_docs", "similarity"), [(10, 0.8), (2, 0.8), (2, 0.5)])
def test_lines(docs, data, min_docs, similarity):
    got = lines.drop_recurring(docs, min_docs, similarity).select("doc_id", "n_lines", "n_dropped", "text").toPandas()
    cases.same(got, cases.recurring(data, min_docs, similarity))


@pytest.mark.parametrize("names", [7, 1000])
def test_lines_of_many_templates_in_a_leaf(spark, names):
    # Three templates of 14 words with word fields, and prose, in one leaf; a template of 9 words with two fields.
    import random

    r = random.Random(3)

    def name():
        return "N" + "".join(chr(97 + int(c)) for c in str(r.randrange(names)))

    def varied(i):
        return "".join(chr(97 + int(c)) for c in str(i))

    data = []
    for i in range(50):
        rows = [
            f"This page was written by {name()} for the {varied(i)} club in our old town",
            f"This page was last seen near {varied(i)} when {name()} came with all of them",
            f"This page was {name()} made at home while {varied(i)} slept under a green tree",
            f"Posted in category {varied(i)} and read by {name()} twice",
            "This page was " + " ".join(f"{varied(i)}q{varied(k)}" for k in range(11)),
        ]
        data += [(5 * i + k, f"own {varied(i)}\n{t}") for k, t in enumerate(rows)]
    out = lines.drop_recurring(cases.frame(spark, data)).select("doc_id", "n_dropped").collect()
    dropped = [sum(x["n_dropped"] for x in out if x["doc_id"] % 5 == k) for k in range(5)]
    # Where a name is common, lines with it are the leaf's first template, with a keeper of its own.
    assert all(49 - (names == 7) <= n <= 49 for n in dropped[:4]) and dropped[4] == 0, dropped


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_further_templates_against_the_rule(spark, seed):
    # Templates with fields of few and many words in a few leaves, lines away from all, repeated rows and nulls.
    import random

    r = random.Random(seed)

    def word(n):
        return "v" + "abcdefghijklmnopqrstuvwxyz"[r.randrange(n)]

    shapes = [[None if r.random() < 0.35 else f"c{'xyz'[r.randrange(3)]}{'abcdefgh'[r.randrange(8)]}" for _ in range(8)] for _ in range(7)]
    data = []
    for i in range(170):
        own = []
        for _ in range(r.randrange(1, 4)):
            shape = r.choice(shapes)
            own.append("all lines begin " + " ".join(word(r.choice([2, 26])) if w is None or r.random() < 0.03 else w for w in shape))
        data.append((i % 160, "\n".join(own)))
    data += [(None, data[3][1]), (900, None), data[5], (901, "")]
    for min_docs in (4, 10):
        got = lines.drop_recurring(cases.frame(spark, data), min_docs).select("doc_id", "n_lines", "n_dropped", "text").toPandas()
        want = cases.recurring(data, min_docs, 0.8)
        cases.same(got, want)
    assert sum(x[2] for x in cases.recurring(data, 4, 0.8)) > 60


@pytest.mark.parametrize("places", [8, 40])
def test_rounds_do_not_follow_the_words(spark, monkeypatch, places):
    # A leaf in which 12 lines share a word at each place, and nothing else.
    made = []
    monkeypatch.setattr(lines, "stored", lambda df, name: made.append(name) or stored(df, name))
    data = []
    for p in range(places):
        for k in range(12):
            tail = [f"u{p}x{k}y{q}".translate(str.maketrans("0123456789", "abcdefghij")) for q in range(places)]
            tail[p] = "same" + "abcdefghij"[p % 10] + "abcdefghij"[p // 10]
            data.append((p * 12 + k, "one two three " + " ".join(tail)))
    out = lines.drop_recurring(cases.frame(spark, data))
    assert out.filter("n_dropped > 0").isEmpty()
    assert made.count("words-of-parts") == 2


def test_texts_of_many_lines(spark):
    import time

    text = "\n".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'abcdefghij'[i // 1000 % 10]}{'abcdefghij'[i // 10000]}" for i in range(40_000))
    docs = spark.createDataFrame([(i, text + f"\nown line of {'abcdefghijkl'[i]}") for i in range(12)], "doc_id long, text string")
    began = time.time()
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.drop_recurring(docs).collect()}
    assert out[0][1] == 0 and all(out[i] == (40_001, 40_000, f"own line of {'abcdefghijkl'[i]}") for i in range(1, 12))
    assert time.time() - began < 120


def test_lines_keep_columns(docs):
    clash = docs.withColumn("n_lines", F.lit("mine"))
    out = lines.drop_recurring(clash)
    assert out.columns == [*clash.columns, "n_lines_", "n_dropped"]
    assert out.filter("n_lines <> 'mine'").isEmpty()


def test_empty_tables(docs):
    none = docs.limit(0)
    for out in (near.near_groups(none), substrings.remove_repeats(none), naming.exact_groups(none), lines.drop_recurring(none)):
        assert out.count() == 0


def test_components(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1080)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {v: find(v) for e in edges for v in e if e[0] != e[1]}
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
