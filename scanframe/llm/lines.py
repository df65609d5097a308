"""Repeated line runs by a suffix array over line-ID sequences [native].

A document is the sequence of its lines that have a word; blank lines are passed over and kept. Lines found only once in
the corpus end a run. The suffixes of all sequences are ranked by prefix doubling: after round k the rank of a position
orders, and names, the 2^k lines that start there. A block is the fewest lines from a position on, or up to one, that
have ``min_words`` words; positions whose blocks are equal form an interval of the suffix array whose longest common prefix
is at least that block, told by its size and two overlapping ranks of the largest power of two in it. Overlapping blocks add up to the
maximal repeated runs: of a run's lines, those with ``min_words`` words from them to its end start a block in it, and the
last ones lie in the block that ends with it. The first occurrence in order of (doc_id, text hash, line) stays; the lines of later ones go.

Documents are keyed by (doc_id, hash of the text): rows that repeat both are one document and are cut alike; null ids
are a key like any other and come last. A null or empty text has no lines. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.llm.common import cut, few, same, text_of, without_spaces, words_of

MIN_WORDS = 50
DOC = ["doc_id", "text_key"]
_AT = [*DOC, "pos"]


def _key() -> Column:
    return F.xxhash64(text_of())


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, pos, h1, h2, words): line counts all lines of the text, pos those with a word."""
    split = F.transform(F.split(text_of(), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    full = F.filter(split, lambda s: without_spaces(s["x"]) != "")
    rows = docs.select("doc_id", _key().alias("text_key"), F.posexplode(full).alias("pos", "s"))
    x = F.col("s.x")
    return rows.select(*DOC, F.col("s.line").alias("line"), "pos", F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"),
                       F.size(words_of(x)).cast("bigint").alias("words"))


def _ranks(rows: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """(a, b, next) of the different pairs of ``n`` rows: ranks rise with the pair. Ordered by range, numbered in place, stored."""
    ordered = few(rows.select(a, b).distinct(), n).repartitionByRange(a, b).sortWithinPartitions(a, b)
    return cut(ordered.withColumn("next", F.monotonically_increasing_id()))


def positions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Positions of lines found twice or more: rank 0, and ``size`` and ``back``, the lines of the blocks that start and end here (or null)."""
    every = cut(sequences(docs))
    often = cut(every.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"))
    ranks = _ranks(often, "h1", "h2", often.count())
    active = every.join(ranks, ["h1", "h2"]).select(*_AT, "line", "words", F.col("next").alias("rank")).dropDuplicates(_AT)
    doc = Window.partitionBy(*DOC).orderBy("pos")  # bounded by the lines of one text
    runs = (active.withColumn("run", F.col("pos") - F.row_number().over(doc))
            .withColumn("total", F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, 0))).withColumn("upto", F.col("total") - F.col("words")))
    run = Window.partitionBy(*DOC, "run")
    blocks = {"size": run.orderBy("upto").rangeBetween(0, min_words - 1), "back": run.orderBy("total").rangeBetween(1 - min_words, 0)}
    sized = runs.withColumns({name: F.when(F.sum("words").over(block) >= min_words, F.count(F.lit(1)).over(block).cast("int")) for name, block in blocks.items()})
    return cut(sized.select(*_AT, "line", "rank", "size", "back"))


def _ahead(rows: DataFrame, ranks: DataFrame, by: Column) -> DataFrame:
    """Adds ``second``, the rank ``by`` positions ahead, -1 where the run has ended."""
    there = ranks.select(F.col("doc_id").alias("d2"), F.col("text_key").alias("t2"), F.col("pos").alias("p2"), F.col("rank").alias("second"))
    on = rows["doc_id"].eqNullSafe(there["d2"]) & (rows["text_key"] == there["t2"]) & ((rows["pos"] + by) == there["p2"])
    return rows.join(there, on, "left").drop("d2", "t2", "p2").withColumn("second", F.coalesce("second", F.lit(-1)))


def suffixes(start: DataFrame) -> list[DataFrame]:
    """The positions with their ranks of 1, 2, 4, ... lines, up to the largest power of two in any block."""
    largest, n = start.agg(F.max(F.greatest("size", "back")), F.count(F.lit(1))).first()
    levels, lines = [few(start, n)], 1
    while 2 * lines <= (largest or 1):
        pairs = few(cut(few(_ahead(levels[-1], levels[-1], F.lit(lines)), n)), n)
        named = few(_ranks(pairs, "rank", "second", n), n)
        levels.append(few(cut(few(pairs.join(named, ["rank", "second"]).select(*_AT, F.col("next").alias("rank")), n)), n))
        lines *= 2
    return levels


def intervals(levels: list[DataFrame]) -> DataFrame:
    """(doc_id, text_key, pos, size, first, second): equal last three mean equal blocks, neighbours in the suffix array."""
    out, start = None, levels[0]
    ending = start.select(*DOC, (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("size"))
    sizes = cut(start.select(*_AT, "size").unionByName(ending).filter("size is not null").distinct())
    found = {r["level"]: r["n"] for r in sizes.groupBy((F.length(F.bin("size")) - 1).alias("level")).agg(F.count(F.lit(1)).alias("n")).coalesce(1).collect()}
    sizes = few(sizes, sum(found.values()))
    for level, ranks in enumerate(levels):
        n = found.get(level, 0)
        fit = sizes.filter((F.col("size") >= 1 << level) & (F.col("size") < 2 << level))
        fit = few(_ahead(fit, ranks, F.lit(0)).withColumnRenamed("second", "first"), n)
        named = few(_ahead(fit, ranks, F.col("size") - (1 << level)).select(*_AT, "size", "first", "second"), n)
        out = named if out is None else out.unionByName(named)
    return cut(out)


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, deleted): the sorted numbers of the lines that lie in a later copy of a repeated run."""
    start = positions(docs, min_words)
    blocks = intervals(suffixes(start))
    n = blocks.count()
    blocks = few(blocks, n)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "pos")
    firsts = few(cut(few(blocks.groupBy("size", "first", "second").agg(F.min(order).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), n)), n)
    later = blocks.join(firsts, ["size", "first", "second"]).filter(order != F.col("origin"))
    covered = later.select(*DOC, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()
    lines = start.select(*_AT, "line")
    found = lines.join(covered, same(lines, covered, _AT), "left_semi")
    return found.groupBy(*DOC).agg(F.sort_array(F.collect_list("line")).alias("deleted"))  # bounded by one text


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies of repeated runs deleted: (own, text, n_lines, deleted).

    ``own`` holds the columns as they were, ``deleted`` the line numbers (null if there are none).
    """
    gone = cut(later_copies(docs, min_words)).withColumnRenamed("doc_id", "__doc").withColumnRenamed("text_key", "__key")
    split = docs.select(F.struct(*docs.columns).alias("own"), "doc_id", F.split(text_of(), "\n").alias("lines"), _key().alias("text_key"))
    joined = split.join(gone, split["doc_id"].eqNullSafe(gone["__doc"]) & (split["text_key"] == gone["__key"]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("deleted"))
    text = F.when(F.col("deleted").isNull(), F.col("own.text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n"))
    return joined.select("own", text.alias("text"), F.size("lines").alias("n_lines"), "deleted")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For the pipeline: the documents' own columns, ``n_chars`` following the text. Emptied documents stay, empty."""
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("deleted").isNull(), F.col("own.n_chars")).otherwise(F.length("text").cast("bigint"))}
    return without_copies(docs, min_words).select(*[changed.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns])
