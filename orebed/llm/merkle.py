"""Merkle manifest of a table: a tree for each group, a root over the groups, and a proof for each row."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, stored, table

#: Nodes that become one node of the next level.
FAN = 16
#: Rows of a sorted range, which one task holds.
RANGE_ROWS = 50_000
PATH = "array<struct<before:string,after:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRUCT = pa.struct([("before", pa.string()), ("after", pa.string())])


def _above(n: int) -> int:
    return -(-n // FAN)


def _joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 over the values, each as its number of UTF-8 bytes, a colon and itself, or ``-`` if null."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, one after the other."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


class Levels:
    """What a range can build of a group's tree: level by level the nodes from ``lo`` on, of ``n`` in all."""

    def __init__(self, lo: int, total: int, leaves: list[str]):
        self.levels: list[tuple[int, int, list[str]]] = []
        #: (level, index, digest) of nodes whose run is not whole here.
        self.ragged: list[tuple[int, int, str]] = []
        n, nodes = total, leaves
        while nodes:
            self.levels.append((lo, n, nodes))
            if n == 1:
                break
            hi = lo + len(nodes)
            first, last = _above(lo), _above(n) if hi == n else hi // FAN
            inside = range(FAN * first - lo, min(FAN * last, n) - lo) if last > first else range(0)
            self.ragged += [(len(self.levels) - 1, lo + i, nodes[i]) for i in range(len(nodes)) if i not in inside]
            nodes = [_joined(nodes[FAN * k - lo : min(FAN * (k + 1), n) - lo]) for k in range(first, last)]
            lo, n = first, _above(n)

    def root(self) -> str | None:
        lo, n, nodes = self.levels[-1]
        return nodes[0] if n == 1 else None

    def proofs(self, known: dict[tuple[int, int], list], top: list) -> list[list]:
        """For each leaf the pairs of what comes before and after it in its run, up to the group's root, and then ``top``."""
        above: list[list] = []
        for level in range(len(self.levels) - 1, -1, -1):
            lo, n, nodes = self.levels[level]
            upper = self.levels[level + 1][0] if level + 1 < len(self.levels) else 0
            here, last_run, text = [], -1, ""
            for i in range(len(nodes)):
                at = lo + i
                if n == 1:
                    here.append(top)
                elif (level, at) in known:
                    here.append(known[level, at] + top)
                else:
                    run = at // FAN
                    if run != last_run:
                        last_run, text = run, "".join(nodes[FAN * run - lo : min(FAN * (run + 1), n) - lo])
                    j = 64 * (at % FAN)
                    here.append([(text[:j], text[j + 64 :]), *above[run - upper]])
            above = here
        return above


def _by_part(work: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """Calls with all rows of one range, which arrive next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            start = 0
            while start < len(part):
                end = start + int((part[start:] == part[start]).argmin() or len(part) - start)
                if held and held[0].column("part")[0].as_py() != part[start]:
                    yield from work(int(held[0].column("part")[0].as_py()), pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from work(int(held[0].column("part")[0].as_py()), pa.Table.from_batches(held))

    return run


def _groups(leaves: pa.Table) -> Iterator[tuple[str, int, int]]:
    """The groups of sorted rows, with the first row and the one after the last."""
    names = leaves.column("grp").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    codes, start = names.indices.to_numpy(), 0
    while start < len(codes):
        end = start + int((codes[start:] == codes[start]).argmin() or len(codes) - start)
        yield names.dictionary[int(codes[start])].as_py(), start, end
        start = end


def _notes(t: pa.Table) -> tuple[dict[str, tuple[int, int]], pa.Table]:
    """Offset and total of groups that other ranges share, and the leaves."""
    kind = t.column("kind").to_numpy()
    spans = t.slice(0, int((kind == 0).sum()))
    out = {g: (a, b) for g, a, b in zip(*(spans.column(c).to_pylist() for c in ("grp", "a", "b")), strict=True)}
    return out, t.slice(int((kind < 3).sum()))


def _up(part: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
    spans, leaves = _notes(t)
    digests = leaves.column("leaf").to_pylist()
    rows = []
    for grp, start, end in _groups(leaves):
        lo, total = spans.get(grp, (0, end - start))
        built = Levels(lo, total, digests[start:end])
        if total == end - start:
            rows.append((part, grp, -1, 0, built.root(), total))
        else:
            rows += [(part, grp, level, at, digest, total) for level, at, digest in built.ragged]
    yield pa.RecordBatch.from_pylist([dict(zip(("part", "grp", "level", "idx", "digest", "total"), r, strict=True)) for r in rows], schema=_RAGGED)


_RAGGED = pa.schema([("part", pa.int32()), ("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("total", pa.int64())])


def _down(extra: list[str]) -> Callable:
    def work(part: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        spans, leaves = _notes(t)
        kind = t.column("kind").to_numpy()
        notes = t.slice(len(spans), int(((kind == 1) | (kind == 2)).sum())).to_pylist()
        steps = lambda path: [(s["before"], s["after"]) for s in path]
        known: dict[str, dict] = {}
        tops = {}
        for r in notes:
            if r["kind"] == 1:
                known.setdefault(r["grp"], {})[r["a"], r["b"]] = steps(r["path"])
            else:
                tops[r["grp"]] = (r["subroot"], r["root"], steps(r["path"]))
        digests = leaves.column("leaf").to_pylist()
        for grp, start, end in _groups(leaves):
            lo, total = spans.get(grp, (0, end - start))
            subroot, root, top = tops[grp]
            proofs = Levels(lo, total, digests[start:end]).proofs(known.get(grp, {}), top)
            for a in range(start, end, 2000):
                own = proofs[a - start : min(a + 2000, end) - start]
                n = len(own)
                flat = [s for p in own for s in p]
                offsets = [0]
                for p in own:
                    offsets.append(offsets[-1] + len(p))
                pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], fields=list(_STRUCT))
                rows = leaves.slice(a, n).combine_chunks()
                columns = [rows.column(c).combine_chunks() for c in ("grp", "ord", "leaf", *extra)]
                columns += [pa.array([subroot] * n), pa.array([root] * n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)]
                yield pa.record_batch(columns, names=["grp", "ord", "leaf", *extra, "subroot", "root", "proof"])

    return work


@dataclasses.dataclass
class Forest:
    """Rows in sorted ranges, and what more than one range is needed for."""

    rows: DataFrame
    ranges: int
    spans: DataFrame
    members: DataFrame
    paths: DataFrame | None
    roots: DataFrame

    def dealt(self, *notes: DataFrame) -> DataFrame:
        """The rows of each range together, after the notes for it."""
        both = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [self.rows.withColumn("kind", F.lit(3)), *notes])
        return both.repartition(self.ranges, "part").sortWithinPartitions("part", "kind", "grp", "ord", "leaf", "tie")

    def proofs(self, tops: DataFrame, extra: list[str]) -> DataFrame:
        """Rows ``grp, ord, leaf, subroot, root, proof`` and ``extra``; ``tops`` has ``grp, subroot, root, path`` of each group."""
        top = self.members.join(tops, "grp").select("part", F.lit(2).alias("kind"), "grp", "subroot", "root", "path")
        notes = [top] if self.paths is None else [self.paths.withColumn("kind", F.lit(1)), top]
        kinds = dict(self.rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("grp", "ord", "leaf", *extra)) + f", subroot string, root string, proof {PATH}"
        return self.dealt(self.spans, *notes).mapInArrow(_by_part(_down(extra)), schema)


def forest(rows: DataFrame) -> Forest:
    """The trees of rows ``grp, ord, leaf, tie``, one for each ``grp``, leaves ascending by ``ord``, then ``leaf``.

    Rows are sorted into ranges, which are stored.  Counts by range and group
    give each range its offset in the groups that it shares with others: at
    most two a range.  A range builds all aligned runs that are whole in it;
    the nodes at its ragged ends (at most 2 * 15 a level for such a group) are
    dealt by their coordinate, and the levels above are finished from them.
    """
    n = rows.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    keys = ["grp", "ord", "leaf", "tie"]
    held = stored(rows.repartitionByRange(ranges, *keys).withColumn("part", F.spark_partition_id()), "ranges")
    members = stored(held.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n")), "range-groups")
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = members.select("part", "grp", "n", F.coalesce(before, F.lit(0)).alias("a"), F.sum("n").over(group).alias("b")).filter("n < b")
    spans = stored(spans.select("part", F.lit(0).alias("kind"), "grp", "a", "b"), "spans")
    out = Forest(held, ranges, spans, members.select("part", "grp"), None, members)
    nodes = stored(out.dealt(spans).mapInArrow(_by_part(_up), "part int, grp string, level int, idx long, digest string, total long"), "ragged")
    out.roots = nodes.filter("level = -1").select("grp", F.col("digest").alias("root"))
    ragged = nodes.filter("level >= 0")
    most = ragged.agg(F.max("total")).first()[0]
    if most is None:
        return out

    runs, carried, depth = [], None, 0
    while most > 1:
        n_here = functools.reduce(lambda x, _: F.ceil(x / FAN).cast("long"), range(depth), F.col("total"))
        own = ragged.filter(F.col("level") == depth).select("grp", "idx", "digest", n_here.alias("n"))
        here = own if carried is None else own.unionByName(carried)
        run = here.filter("n > 1").groupBy("grp", "n", F.floor(F.col("idx") / FAN).cast("long").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("nodes"))
        run = stored(run.withColumn("nodes", F.transform("nodes", lambda x: x["digest"])), "runs")
        runs.append(run)
        carried = run.select("grp", F.col("run").alias("idx"), F.sha2(F.array_join("nodes", ""), 256).alias("digest"), F.ceil(F.col("n") / FAN).cast("long").alias("n"))
        out.roots = out.roots.unionByName(carried.filter("n = 1").select("grp", F.col("digest").alias("root")))
        most, depth = _above(most), depth + 1
    out.roots = stored(out.roots, "roots")

    step = lambda a, b: F.array_join(F.slice("nodes", a, b), "")
    paths, above = [], None
    for level in range(depth - 1, -1, -1):
        each = runs[level].select("grp", "run", "nodes", F.posexplode("nodes").alias("j", "digest"))
        pair = F.array(F.struct(step(F.lit(1), F.col("j")).alias("before"), step(F.col("j") + 2, F.lit(FAN)).alias("after")))
        each = each.select("grp", "run", (F.col("run") * FAN + F.col("j")).alias("idx"), pair.alias("path"))
        if above is not None:
            each = each.join(above.select("grp", F.col("idx").alias("run"), F.col("path").alias("rest")), ["grp", "run"], "left")
            each = each.withColumn("path", F.concat("path", F.coalesce("rest", F.array().cast(PATH))))
        above = stored(each.select(F.lit(level).alias("level"), "grp", "idx", F.col("path").cast(PATH).alias("path")), "paths")
        paths.append(above)
    known = functools.reduce(DataFrame.unionByName, paths)
    out.paths = stored(ragged.select("part", "grp", "level", "idx").join(known, ["grp", "level", "idx"]).select("part", "grp", F.col("level").cast("long").alias("a"), F.col("idx").alias("b"), "path"), "ragged-paths")
    return out


def manifest(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Rows ``grp, ord, leaf, subroot, root, proof`` and ``extra`` for leaves ``grp, ord, leaf, tie``:
    the trees of groups, and one over their roots in the order of ``grp``."""
    trees = forest(rows)
    tops = trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), F.col("root").alias("leaf"), F.lit(0).cast("long").alias("tie"))
    upper = forest(stored(tops, "subroots"))
    whole = upper.roots.select("grp", F.col("root").alias("subroot"), "root", F.array().cast(PATH).alias("path"))
    tops = stored(upper.proofs(whole, []).select(F.col("ord").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("path")), "tops")
    return trees.proofs(tops, extra)


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_column: str = "source", id_column: str = "doc_id", altered: dict[str, Column] | None = None) -> DataFrame:
    """Rows ``doc_id, leaf, subroot, root, proof`` (and the names of ``altered``), one for each input row.

    ``leaf`` digests the named columns; ``subroot`` is the root of the group's
    tree, ``root`` that over all groups, null group first, then by UTF-8 bytes.
    ``proof`` holds for each level what comes before and after the node in its
    run, up to the root: ``folded(leaf, proof)`` gives ``root``.  ``altered``
    names further leaves to take along: expressions over ``_<column>``.

    Leaves ascend by id, a null id first; rows that repeat an id by their leaf;
    equal rows are as many leaves.  Null values differ from empty ones, a null
    group from any other.  Texts of any length are taken whole.  An empty table
    has no rows and no root.  Other columns are ignored.
    """
    altered = altered or {}
    rows = pick(docs, **{f"_{c}": c for c in columns}, _group=group_column, _id=id_column)
    # One letter before each name, so that no group is first.
    grp = F.when(F.col("_group").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("_group").cast("string")))
    digests = {"leaf": leaf_digest([F.col(f"_{c}") for c in columns])} | altered
    light = rows.select(grp.alias("grp"), F.col("_id").cast("long").alias("ord"), *[c.alias(n) for n, c in digests.items()], F.monotonically_increasing_id().alias("tie"))
    out = manifest(stored(light, "leaves"), list(altered))
    return out.select(F.col("ord").alias("doc_id"), "leaf", *altered, "subroot", "root", "proof")


def lower_case(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the digest of its proof, and whether the proof finds the tampered ones out."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    plain = {c: F.col(f"_{c}") for c in columns}
    touched = leaf_digest(list((plain | {"text": lower_case(F.col("_text"))}).values()))
    chosen = F.crc32(F.col("_doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle_manifest(table(spark, sf_dir, "documents"), columns, altered={"tampered": F.when(chosen, touched)})
    found = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
