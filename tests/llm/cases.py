"""Rows with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "DOC_ID_ int, Text_ string, doc_id long, text string, n_tokens string, kept int, marks string"


def rows(n: int = 160) -> list[tuple[int | None, str | None]]:
    """Driver documents with nulls, empty, very long and repeated texts, ties and repeated rows."""
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").head(n)
    own = list(zip(d["doc_id"].tolist(), d["text"].tolist(), strict=True))
    a, b = own[1][1], own[3][1]
    words = a.split()
    edited = " ".join("x" if i == 17 else w for i, w in enumerate(words))
    own += [(9001, None), (9002, ""), (9003, " \n\t "), (None, a), (None, "no id here"), (9004, a.upper()), (9005, a), (9006, edited)]
    own += [(9007, b + " tail of it"), (9008, "one two"), (9009, "One  two"), (9010, (a + " " + b + "\n") * 300), (9011, "Été     x"), (9012, "<|endoftext|> a")]
    own += [(9005, a), (9013, "lone"), (9013, b), (9014, "w" * 70_000)]
    # Two Thue-Morse words, and texts of two words in the order of one: sums of products of either kind cancel out.
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = "".join("ab"[k] for k in thue), "".join("ba"[k] for k in thue)
    own += [(9015, one), (9016, other), (9017, " ".join("ab"[k] for k in thue)), (9018, " ".join("ba"[k] for k in thue))]
    own += [(9019, " ".join([one] * 50)), (9020, " ".join([other] * 50)), (9021, " ".join(("ab"[k] for k in thue[:64]))), (9022, " ".join("ba"[k] for k in thue[:64]))]
    own += [(9100 + i, f"Order {i} of the day is number {i} and then it ends\nunlike {i * 7919} others\nSame line here for all") for i in range(14)]
    return own


def frame(spark: SparkSession, data: list[tuple], parts: int = 3) -> DataFrame:
    """The rows with extra columns whose names clash with names the operators use."""
    out = spark.createDataFrame([(1, "t", i, t, "x", 2, "m") for i, t in data], SCHEMA)
    return out.withColumnsRenamed({"DOC_ID_": "component_id", "Text_": "digest"}).repartition(parts)


def words_of(text: str | None, lower: bool) -> list[bytes]:
    data = (text or "").encode()
    return WORD.findall(data.lower() if lower else data)


def shingles(text: str | None) -> set[tuple]:
    w = words_of(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(data: list[tuple], percent: int) -> list[tuple]:
    sets = [shingles(t) for _, t in data]
    real = [i for i in range(len(data)) if sets[i] and data[i][0] is not None]
    root = {i: i for i in real}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for x in real:
        for y in real:
            if x < y:
                both = len(sets[x] & sets[y])
                if data[x][0] == data[y][0] or 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    root[find(x)] = find(y)
    least: dict[int, int] = {}
    for i in real:
        least[find(i)] = min(least.get(find(i), data[i][0]), data[i][0])
    out = []
    for i, (doc, _) in enumerate(data):
        c = least[find(i)] if i in root else doc
        out.append((doc, len(sets[i]), c, doc is None or doc == c))
    return out


def repeats(data: list[tuple], window: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    for doc, t in data:
        w = words_of(t, lower=False)
        if doc is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, t in data:
        w = words_of(t, lower=False)
        gone = [False] * len(w)
        if doc is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < doc:
                    gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def plain_words(text: str | None) -> list[bytes]:
    """Words of decontamination: runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return re.findall(rb"[0-9a-z\x00-\x08\x0e-\x1f\x7f-\xff]+", (text or "").encode().lower())


def overlaps(data: list[tuple], items: list[tuple], min_words: int, similarity: float) -> list[tuple]:
    """By laying every item at every place of every text, and trying every stretch there."""
    out = []
    for doc, t in data:
        w, found = plain_words(t), {}
        for item, text in items:
            own = plain_words(text)
            least = min(min_words, len(own))
            for at in range(1 - len(own), len(w)) if own else ():
                lo, hi = max(0, -at), min(len(own), len(w) - at)
                same = [0]
                for j in range(lo, hi):
                    same.append(same[-1] + (own[j] == w[at + j]))
                n = hi - lo
                if same[-1] < similarity * least - 1e-9:
                    continue
                best = max((b - a for a in range(n) for b in range(a + least, n + 1) if same[b] - same[a] >= similarity * (b - a) - 1e-9), default=0)
                if best > found.get(item, 0):
                    found[item] = best
        out.append((doc, " ".join(map(str, sorted(found))), max(found.values(), default=0)))
    return out


def lower_ascii(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact(data: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for doc, t in data:
        groups[lower_ascii(t)].append(doc)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        stay = True
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, keep, len(ids), stay, sha))
            stay = False
    return out


def masked_lines(t: str | None) -> list[str]:
    return re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", t or "", flags=re.ASCII).split("\n")


def further(pool: dict[str, int], min_docs: int, similarity: float) -> dict[str, tuple]:
    """Template of lines (with the number of their documents) of one leaf that share one, by the rule, part by part."""
    found: dict[str, tuple] = {}
    parts = [((), list(pool))]
    while parts:
        path, own = parts.pop()
        if not own or sum(pool[x] for x in own) < min_docs:
            continue
        tokens = {x: x.split(" ") for x in own}
        size, total = len(tokens[own[0]]), sum(pool[x] for x in own)
        counts = [Counter() for _ in range(size)]
        for x in own:
            for p in range(3, size):
                counts[p][tokens[x][p]] += pool[x]
        tops = {p: max(c.items(), key=lambda v: (v[1], v[0].encode())) for p, c in enumerate(counts) if p >= 3}
        constants = {p: w for p, (w, n) in tops.items() if n >= similarity * total}
        if len(constants) >= 0.5 * (size - 3):
            rest = []
            for x in own:
                if sum(tokens[x][p] == w for p, w in constants.items()) + 3 >= similarity * (len(constants) + 3):
                    found[x] = path
                else:
                    rest.append(x)
            parts.append(((*path, "rest"), rest))
            continue
        ranks = sorted((-sum(n for n in counts[p].values() if n >= min_docs), len(counts[p]), p) for p in tops if p not in constants and any(n >= min_docs for n in counts[p].values()))
        split = defaultdict(list)
        for x in own:
            for *_, p in ranks:
                if counts[p][tokens[x][p]] >= min_docs:
                    split[p, tokens[x][p]].append(x)
                    break
        parts += [((*path, k), v) for k, v in split.items()]
    return found


def recurring(data: list[tuple], min_docs: int, similarity: float) -> list[tuple]:
    """The whole rule: first templates of leaves, lines by themselves, and further templates of what does not recur so."""
    distinct = list(dict.fromkeys(data))
    leaves: dict[tuple, Counter] = defaultdict(Counter)
    of_line = defaultdict(set)
    for row in distinct:
        for line in masked_lines(row[1]):
            if line.strip(" "):
                w = line.split(" ")
                leaves[len(w), " ".join(w[:3])][line] += 1
                of_line[line].add(row)
    most = {}
    for k, c in leaves.items():
        if len(c) > 1:
            at = [Counter() for _ in range(k[0])]
            for line, n in c.items():
                for p, w in enumerate(line.split(" ")):
                    at[p][w] += n
            most[k] = [max(x.items(), key=lambda v: (v[1], v[0].encode()))[0] for x in at]

    def first(line: str) -> tuple:
        w = line.split(" ")
        k = len(w), " ".join(w[:3])
        if k in most and sum(a == b for a, b in zip(w, most[k], strict=True)) >= similarity * len(w):
            return ("leaf", *k)
        return ("line", line)

    docs = defaultdict(set)
    for line, rows_ in of_line.items():
        docs[first(line)] |= rows_
    named = {line: first(line) for line in of_line}
    for k, c in leaves.items():
        rest = {x: len(of_line[x]) for x in c if len(docs[named[x]]) < min_docs}
        if k[0] > 3 and k in most and len(rest) > 1 and sum(c[x] for x in rest) >= min_docs:
            for line, path in further(rest, min_docs, similarity).items():
                named[line] = ("further", *k, path)
    docs = defaultdict(set)
    for line, rows_ in of_line.items():
        docs[named[line]] |= rows_
    out = []
    for doc, t in data:
        kept, gone = [], 0
        for line, shown in zip((t or "").split("\n"), masked_lines(t), strict=True):
            held = docs[named[shown]] if shown.strip(" ") else set()
            keeper = min((d for d, _ in held if d is not None), default=None)
            if len(held) >= min_docs and keeper is not None and doc != keeper:
                gone += 1
            else:
                kept.append(line)
        out.append((doc, 0 if t is None else len(kept) + gone, gone, t if not gone else "\n".join(kept)))
    return out


def same(df: pd.DataFrame, expected: list[tuple]) -> None:
    def key(r: tuple) -> str:
        return repr(tuple(None if x is None or x != x else (x if isinstance(x, str) else int(x)) for x in r))

    got, want = sorted(map(key, df.astype(object).itertuples(index=False, name=None))), sorted(map(key, expected))
    assert got == want, [(g, w) for g, w in zip(got, want, strict=False) if g != w][:3]
