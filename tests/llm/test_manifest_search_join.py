"""The Merkle manifest, the lexical search and the n-gram join against brute force."""

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from orebed.llm import lexical, merkle, near, ngram_join  # noqa: E402

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def trees(rows):
    """Leaf, subroot, root and path of each row, the whole tree level by level."""

    def climb(leaves):
        paths, nodes = [[] for _ in leaves], list(leaves)
        of = list(range(len(leaves)))
        while len(nodes) > 1:
            for i in range(len(leaves)):
                run = of[i] // 16 * 16
                paths[i].append(("".join(nodes[run : of[i]]), "".join(nodes[of[i] + 1 : run + 16])))
            nodes = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
            of = [x // 16 for x in of]
        return nodes[0], paths

    leaf = [digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r]) for r in rows]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[1]].append(i)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots, found = [], {}
    for s in order:
        own = sorted(groups[s], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        root, paths = climb([leaf[i] for i in own])
        roots.append(root)
        found |= {i: (root, p) for i, p in zip(own, paths, strict=True)}
    root, tops = climb(roots)
    top = dict(zip(order, tops, strict=True))
    return [(rows[i][0], leaf[i], found[i][0], root, tuple(found[i][1] + top[rows[i][1]])) for i in range(len(rows))]


def documents(spark, n=300):
    r = random.Random(4)
    rows = [(i * 3, f"src{min(r.randrange(12), 4)}", r.choice(["en", None, ""]), r.choice([7, None]), f"Text {i} é") for i in range(n)]
    rows += [(None, "src1", "en", 1, "no id"), (5, None, "en", 1, None), (6, None, "en", 1, ""), (7, "", "en", 1, "x" * 70_000), (6, "lone", "en", 1, "a"), (9, "ünï", "en", 1, "B"), (3, "src4", "en", 1, "same"), (3, "src4", "en", 1, "same"), (3, "src4", "en", 2, "same")]
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf string, LEAF_ int, grp string, part int"
    return rows, spark.createDataFrame([(*x, "mine", 1, "g", 2) for x in rows], schema)


@pytest.mark.parametrize("held", [11, 64, 50_000])
def test_manifest(spark, monkeypatch, held):
    monkeypatch.setattr(merkle, "RANGE_ROWS", held)
    rows, docs = documents(spark)
    got = merkle.merkle_manifest(docs.repartition(5), COLUMNS)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    out = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["proof"])) for r in got.collect()]
    assert sorted(out, key=repr) == sorted(trees(rows), key=repr)
    assert got.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
    # A proof finds out any other leaf.
    assert got.filter(merkle.folded(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root")).isEmpty()


def test_manifest_of_few_rows(spark):
    rows, docs = documents(spark, 0)
    assert merkle.merkle_manifest(docs.limit(0), COLUMNS).count() == 0
    one = merkle.merkle_manifest(docs.filter("source = 'lone'"), COLUMNS).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 273])
def test_levels_meet(n):
    # Ranges of any cut have the same nodes where both are whole, and their ragged nodes make up the rest.
    leaves = [digest(str(i)) for i in range(n)]
    whole = merkle.Levels(0, n, leaves)
    assert whole.root() and not whole.ragged
    for cut in {1, 5, 16, 31, n // 2} & set(range(1, n)):
        parts = merkle.Levels(0, n, leaves[:cut]), merkle.Levels(cut, n, leaves[cut:])
        for p in parts:
            for level, (lo, size, nodes) in enumerate(p.levels):
                assert nodes == whole.levels[level][2][lo : lo + len(nodes)] and size == whole.levels[level][1]
        runs = defaultdict(list)
        for p in parts:
            for level, at, _ in p.ragged:
                runs[level, at // 16].append(at)
        for (level, run), found in runs.items():
            # What neither range has of a run is made from a ragged run of the level below.
            made = [a for a in range(16 * run, min(16 * run + 16, whole.levels[level][1])) if a not in found]
            assert all((level - 1, a) in runs for a in made)


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(data, items, k):
    bags = [terms(t) for _, t in data]
    n_docs, total = sum(bool(b) for b in bags), sum(map(len, bags))
    df = Counter(w for b in bags for w in set(b))
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for (doc, _), b in zip(data, bags, strict=True):
            tf = Counter(b)
            m = 50 + (50 * len(b) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in words if tf[w])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize(("chunk", "shard", "visits"), [(8192, 256, (4, 32)), (40, 4, (1,)), (60, 2, (2, 5, 9))])
def test_search(spark, monkeypatch, chunk, shard, visits):
    monkeypatch.setattr(lexical, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    data = [*cases.rows(120), (9300, "A-b_c\x00d\x7fe"), (9301, "a b c D e!"), (9301, "a b c D e!"), (9302, "été ÉTÉ")]
    items = [(1, "a b c"), (2, None), (3, " .. "), (None, "a b"), (4, data[1][1]), (5, "order number day"), (5, "Same line"), (6, "été"), (7, " ".join(t for _, t in data[:6]))]
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = lexical.search(lexical.build_index(cases.frame(spark, data)), queries, 20, visits=visits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    cases.same(got.toPandas(), ranked(data, items, 20))


def test_search_of_nothing(spark):
    none, some = cases.frame(spark, cases.rows(4)).limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), some).count() == 0
    assert lexical.search(lexical.build_index(cases.frame(spark, [(1, None), (2, "")])), some).count() == 0
    assert lexical.search(lexical.build_index(cases.frame(spark, [(1, "a"), (2, "b")])), some.limit(0)).count() == 0


def test_bisection_brings_like_documents_together():
    r = np.random.default_rng(2)
    topic = r.permutation(np.repeat(np.arange(4), 64))
    pairs = sorted({(d, int(t)) for d in range(256) for t in r.integers(0, 50, 30) + 50 * topic[d]} | {(d, 200 + int(t)) for d in range(256) for t in r.integers(0, 20, 4)})
    doc, term = np.array(pairs).T
    part, seen = lexical.bisect(doc, term, 256, 220, 2)
    assert np.bincount(part).tolist() == [64] * 4 and len(seen) == 2
    assert all(np.bincount(topic[part == p], minlength=4).max() >= 60 for p in range(4))
    router = lexical.learn([term[doc == d].astype(np.int64) for d in range(256)], 2)
    again = router.clusters([term[doc == d].astype(np.int64) for d in range(256)])
    assert sum(np.bincount(topic[again == p], minlength=4).max() for p in range(4)) >= 230
    assert lexical.learn([], 2).clusters([np.array([1])]).tolist() == [0]


def grams(text):
    w = cases.words_of(text, lower=True)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def joined(data, percent, monkeypatch):
    monkeypatch.setattr(cases, "shingles", grams)
    return [r[:3] for r in cases.near(data, percent)]


@pytest.mark.parametrize(("percent", "large", "block"), [(85, 64, 1024), (80, 64, 1024), (30, 1, 2), (30, 3, 4)])
def test_join(spark, monkeypatch, percent, large, block):
    monkeypatch.setattr(near, "LARGE", large)
    monkeypatch.setattr(near, "BLOCK", block)
    data = cases.rows()
    cases.same(ngram_join.similar_groups(cases.frame(spark, data), percent).toPandas(), joined(data, percent, monkeypatch))


@pytest.mark.parametrize("large", [4, 64])
def test_join_of_crowd_and_chain(spark, monkeypatch, large):
    monkeypatch.setattr(near, "LARGE", large)
    r = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    data = []
    for i in range(160):
        w = list(words)
        for k in r.sample(range(150), r.randrange(0, 10)):
            w[k] = f"e{i}_{k}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 120))) for i in range(40)]
    # One passage in all of a group of texts that are alike in nothing else, some of them short.
    passage = " ".join(f"p{k}" for k in range(60))
    data += [(2000 + i, f"{passage} " + " ".join(f"o{i}_{k}" for k in range(i))) for i in range(60)]
    cases.same(ngram_join.similar_groups(cases.frame(spark, data), 85).toPandas(), joined(data, 85, monkeypatch))


def test_prefix_is_long_enough():
    for percent in (50, 80, 85, 99, 100):
        for n in range(1, 400):
            least = -(-percent * n // 100)
            assert ngram_join.prefix_length(n, percent) == n - least + 1
            # The smallest set that can be linked with one of n has all of its members in it.
            assert ngram_join._needed(np.array([n]), np.array([least]), percent)[0] <= least


def test_join_of_nothing(spark):
    docs = cases.frame(spark, cases.rows(4))
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0
    alone = ngram_join.similar_groups(cases.frame(spark, [(1, None), (2, " "), (None, "a b c d e")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in alone) == [(0, 2, None), (1, 0, 1), (2, 0, 2)]
