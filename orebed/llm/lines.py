"""Line deduplication by log templates: DataFrame operations only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, pick, stored, table

#: Leading words that lead to a leaf of the tree, below the number of words.
DEPTH = 3
#: Share of a template's words that a line has to have to fall under it: of all words for a leaf's
#: first template, of the constant ones for further templates.
SIMILARITY = 0.8
#: Share of the words after the first DEPTH that have to be constant in a further template.
CONSTANT = 0.5
#: A template in so many documents or more recurs.
MIN_DOCS = 10


def masked(text: Column) -> Column:
    """Words with a digit become ``<*>``: the fields that vary on sight."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*", "<*>")).otherwise(text)


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def _sized(lines: DataFrame) -> DataFrame:
    """The two upper levels of the tree: number of words, and the leading words."""
    words = (F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int")
    return lines.withColumns({"words": words, "lead": F.substring_index("line", " ", DEPTH)})


def _recurring(lines: DataFrame, min_docs: int) -> DataFrame:
    """Templates in so many documents or more, their documents, and the smallest id among these."""
    recur = lines.select("template", "doc_id", "key").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("keeper"))
    return recur.filter(F.col("docs") >= min_docs).select(F.concat("template", F.lit(b"")).alias("template"), "docs", "keeper")


def _further(pool: DataFrame, min_docs: int, similarity: float) -> DataFrame | None:
    """``line_id, template`` of distinct lines ``line_id, part, words, tokens, docs`` that share a template.

    A part starts as a leaf.  Its constant places are those where one word has
    ``similarity`` of the lines.  If they are CONSTANT of all, the lines near
    them are a template.  Otherwise the part is split, at all places in one
    round: places are ranked by the lines that have a word there which
    ``min_docs`` lines or more have (then by fewest words, then by place), and a
    line goes to the part of the first such word that it has; lines without
    any are done.  As no word that splits a part has ``similarity`` of it, parts
    shrink by that with every round: the number of rounds follows the logarithm
    of the largest leaf, not the words of its lines.
    """
    found = []
    while not pool.isEmpty():
        words = pool.select("part", "words", "docs", F.posexplode("tokens").alias("place", "word")).filter(F.col("place") >= DEPTH)
        words = stored(words.groupBy("part", "words", "place", "word").agg(F.sum("docs").alias("n")), "words-of-parts")
        often = F.col("n") >= min_docs
        places = words.groupBy("part", "words", "place").agg(F.max(F.struct("n", "word")).alias("top"), F.sum("n").alias("total"), F.sum(F.when(often, F.col("n")).otherwise(0)).alias("often"), F.count(F.lit(1)).alias("kinds"))
        constant = F.col("top.n") >= similarity * F.col("total")
        parts = places.groupBy("part", "words").agg(
            F.max("total").alias("total"),
            F.collect_list(F.when(constant, F.struct("place", "top.word"))).alias("constants"),
            F.array_sort(F.collect_list(F.when(~constant & (F.col("often") > 0), F.struct((-F.col("often")).alias("often"), "kinds", "place")))).alias("ranks"),
        )
        enough = F.size("constants") >= CONSTANT * (F.col("words") - DEPTH)
        parts = parts.withColumn("enough", enough).filter((F.col("total") >= min_docs) & (F.col("enough") | (F.size("ranks") > 0)))
        parts = stored(parts.select(F.concat("part", F.lit(b"")).alias("part"), "constants", "enough", F.transform("ranks", lambda r: r["place"]).alias("ranks")), "open-parts")
        same = F.size(F.filter("constants", lambda c: F.get("tokens", c["place"]) == c["word"])) + DEPTH
        under = F.col("enough") & (same >= similarity * (F.size("constants") + DEPTH))
        lines = pool.join(parts.select("part", "constants", "enough"), "part").select("line_id", "part", "words", "tokens", "docs", "enough", under.alias("under"))
        lines = stored(lines, "parted")
        found.append(lines.filter("under").select("line_id", F.col("part").alias("template")))
        # Lines away from a template are a part of their own; those of a mixed part go by their words.
        rest = lines.filter("enough AND NOT under").select("line_id", _digest(F.hex("part"), F.lit("rest")).alias("part"), "words", "tokens", "docs")
        mixed = lines.filter("NOT enough")
        split = parts.filter("NOT enough").select("part", F.posexplode("ranks").alias("rank", "place"))
        split = words.filter(often).join(split, ["part", "place"]).select(F.concat("part", F.lit(b"")).alias("part"), "place", "word", "rank")
        has = mixed.select("line_id", "part", F.posexplode("tokens").alias("place", "word")).join(split, ["part", "place", "word"])
        first = has.groupBy("line_id").agg(F.min(F.struct("rank", "place", "word")).alias("first"))
        first = mixed.join(first.select(F.concat("line_id", F.lit(b"")).alias("line_id"), "first"), "line_id")
        part = _digest(F.hex("part"), F.col("first.place").cast("string"), F.concat(F.lit("="), F.col("first.word")))
        pool = stored(first.select("line_id", part.alias("part"), "words", "tokens", "docs").unionByName(rest), "parts")
    return functools.reduce(DataFrame.unionAll, found) if found else None


def line_templates(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A stored table ``doc_id, key, no, template, docs, keeper`` of the lines whose template recurs.

    ``key`` is a hash of the document's text and ``no`` the place of the line,
    from 0; ``docs`` counts the documents of the template and ``keeper`` is the
    smallest id among them.

    The tree has fixed depth: words in the line, then its first DEPTH words
    (words with digits masked).  A leaf's template has at each place the word
    most of its lines have there (of equals the greatest); lines that share
    ``similarity`` of its words or more fall under it, and where they differ is
    a variable field.  Any other line is a template by itself.

    A leaf has further templates among the lines whose template does not recur
    so: see ``_further``.  Each has a keeper of its own.
    """
    rows = pick(docs, doc_id=id_column, text=text_column)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split(masked(F.col("text")), "\n", -1)).alias("no", "line"))
    lines = _sized(lines.filter(F.trim("line") != "")).select("doc_id", "key", "no", "line", F.xxhash64("words", "lead").alias("leaf"))
    # A template cannot recur where its whole leaf does not: most lines go here, on eight bytes each.
    per_doc = rows.select(F.split(masked(F.col("text")), "\n", -1).alias("lines"))
    leaf = F.transform("lines", lambda x: F.when(F.trim(x) != "", F.xxhash64((F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int"), F.substring_index(x, " ", DEPTH))))
    busy = per_doc.select(F.explode(F.array_distinct(leaf)).alias("leaf")).filter(F.col("leaf").isNotNull())
    busy = busy.groupBy("leaf").count().filter(F.col("count") >= min_docs).select(again("leaf").alias("leaf"))
    # Busy leaves grow with the corpus: the same plan at every size, and it moves each line once.
    found = _sized(lines.join(busy.hint("merge"), "leaf", "left_semi")).withColumn("line_id", _digest(F.lit("line"), "line"))
    found = stored(found.select("doc_id", "key", "no", "words", "lead", "line", "line_id"), "lines")
    # Rows that repeat an id and a text count once: only where there are any are their lines moved again.
    again_there = rows.groupBy("doc_id", F.xxhash64("text").alias("key")).count().filter("count > 1").select("doc_id", "key")
    if not again_there.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key"))
        twice = stored(again_there.select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key")), "repeated-rows")
        found = stored(found.join(twice, same, "left_anti").unionByName(found.join(twice, same, "left_semi").distinct()), "lines")

    kinds = stored(found.groupBy("words", "lead", "line", "line_id").agg(F.count(F.lit(1)).alias("n")), "distinct-lines")
    several = kinds.groupBy("words", "lead").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    several = several.select((F.col("words") + F.lit(0) * F.length("lead")).alias("words"), "lead")
    kinds = kinds.join(several, ["words", "lead"], "left_semi")
    tokens = kinds.select("words", "lead", "n", F.posexplode(F.split("line", " ", -1)).alias("place", "word"))
    tokens = tokens.groupBy("words", "lead", "place", "word").agg(F.sum("n").alias("n"))
    most = tokens.groupBy("words", "lead", "place").agg(F.max(F.struct("n", "word")).alias("top"))
    most = most.groupBy("words", "lead").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "top.word"))), lambda x: x["word"]).alias("most"))
    most = most.select((F.col("words") + F.lit(0) * F.length("lead")).alias("words"), "lead", "most")
    same = F.size(F.filter(F.zip_with(F.split("line", " ", -1), "most", lambda a, b: a == b), lambda x: x))
    under = kinds.join(most, ["words", "lead"]).filter(same >= similarity * F.col("words"))
    under = under.select("line_id", _digest(F.lit("leaf"), F.col("words").cast("string"), "lead").alias("leaf_id"))

    lines = found.select("doc_id", "key", "no", "line_id").join(under, "line_id", "left")
    lines = stored(lines.select("doc_id", "key", "no", F.coalesce("leaf_id", "line_id").alias("template")), "templated")
    recur = stored(_recurring(lines, min_docs), "recurring-templates")
    out = stored(lines.join(recur, "template"), "recurring")

    rest = kinds.filter(F.col("words") > DEPTH).join(under, "line_id", "left")
    rest = rest.select("line_id", "words", "lead", "line", "n", F.coalesce("leaf_id", "line_id").alias("template")).join(recur.select("template"), "template", "left_anti")
    roomy = rest.groupBy("words", "lead").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).filter((F.col("kinds") > 1) & (F.col("n") >= min_docs))
    roomy = roomy.select((F.col("words") + F.lit(0) * F.length("lead")).alias("words"), "lead")
    rest = stored(rest.join(roomy, ["words", "lead"], "left_semi").select("line_id", "words", "lead", F.split("line", " ", -1).alias("tokens")), "unfolded")
    if rest.isEmpty():
        return out
    lines = found.select("doc_id", "key", "no", "line_id")
    docs_of = lines.join(rest.select("line_id"), "line_id", "left_semi").select("line_id", "doc_id", "key").distinct().groupBy("line_id").agg(F.count(F.lit(1)).alias("docs"))
    part = _digest(F.lit("part"), F.col("words").cast("string"), "lead")
    further = _further(stored(rest.join(docs_of, "line_id").select("line_id", part.alias("part"), "words", "tokens", "docs"), "parts"), min_docs, similarity)
    if further is None:
        return out
    lines = stored(lines.join(further, "line_id").select("doc_id", "key", "no", "template"), "further")
    return out.unionByName(stored(lines.join(_recurring(lines, min_docs), "template"), "recurring-further"))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input with recurring lines dropped from the text, and ``n_lines, n_dropped`` added.

    A line whose template (see ``line_templates``) is in ``min_docs`` documents
    or more stays in the document with the smallest id and goes from all
    others.  Blank lines stay.  Line feeds part lines; words are parted by
    single blanks.

    All input columns come back, the text changed; two whose names clash with
    the added ones are not replaced: the added ones then end in ``_``.  Null
    texts stay null, with 0 lines.  Rows that repeat an id and a text count
    once and are treated alike.  Of rows with a null id a recurring line goes,
    unless no row with an id has it.  Very long texts and lines are taken whole.
    Empty tables give empty results.
    """
    names = docs.columns
    drops = line_templates(docs, min_docs, similarity, id_column, text_column)
    drops = drops.filter(~F.col("keeper").isNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = drops.groupBy(F.col("doc_id").alias("to_doc"), F.col("key").alias("to_key")).agg(F.collect_set("no").alias("gone"))
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    doc, text = F.col(f"_{names.index(id_column)}").cast("long"), F.col(f"_{names.index(text_column)}")
    # Dropped lines grow with the corpus: by merge at every size, as above.
    joined = plain.join(drops.hint("merge"), doc.eqNullSafe(F.col("to_doc")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("to_key")), "left")
    gone = F.col("gone")
    # The lines are bound to a variable and the kept places taken by one hash lookup each: linear in the text.
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n"))[0]
    taken = {n.lower() for n in names}
    added = [n + "_" if n in taken else n for n in ("n_lines", "n_dropped")]
    columns = [F.when(gone.isNull(), text).otherwise(left).alias(n) if n == text_column else F.col(f"_{i}").alias(n) for i, n in enumerate(names)]
    total = F.when(text.isNull(), F.lit(0)).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return joined.select(*columns, total.cast("long").alias(added[0]), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(added[1]))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    out = drop_recurring(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), "text")
