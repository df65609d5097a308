"""Connected components of a table of links, and links that are asked for in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanframe.llm.common import Scratch, cut, few, freed

BITMAP = 1 << 24


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Links (u, v) with u > v. Large star: neighbours above a node go to its least neighbour; small star: those below.
    ``n``: how many links there were at first, which sets the number of tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # stored, so that both sides of the join are plain exchanges and Spark can split a node with very many links
    least = cut(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n))
    moved = both.join(least, "u")
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return few(few(moved.filter(F.col("u") != F.col("v")), n).distinct(), n)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v) but the least of its component, which is the root.

    A node of any degree is aggregated before the shuffle and joined back by a join that Spark can split. Rounds go on
    until the links are stars; each is written to the shared folder, and has as many tasks as the links need.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    n = edges.count()
    edges, before = few(edges, n), None
    while True:
        edges = cut(_stars(_stars(edges, True, n), False, n))
        freed(edges.sparkSession)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def merged_in_rounds(nearest: Callable[[DataFrame, DataFrame | None, int], DataFrame], verified: Callable[[DataFrame], DataFrame], roots: DataFrame, scratch: Scratch, most: int = 16) -> DataFrame:
    """``roots`` (node, root) merged along verified links until ``nearest`` finds no pair between two groups.

    ``nearest(roots, after, most)`` gives (u, v, d): for every u that asks, its ``most`` first pairs in order of (d, v)
    whose ends lie in two groups and that come after u's place in ``after`` (u, after_d, after_v). So a round holds few
    pairs per node, a rejected pair is never asked again, and none is remembered. ``verified`` gives the linked pairs.
    In the first round (``after`` is None) all ask, then those only that had as many pairs as they could be given: groups
    only grow, so the others have no pair left. A round that links nothing leaves the groups as they are.
    """
    after = None
    while True:
        asked = scratch.store(nearest(roots, after, most))
        n = asked.count()
        if not n:
            return roots
        more = asked.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("d", "v")).alias("m")).filter(F.col("n") >= most)
        last = scratch.store(few(more.select("u", F.col("m.d").alias("after_d"), F.col("m.v").alias("after_v")), n))
        good = verified(few(asked.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n))
        gone = [asked, good] + [after] * (after is not None)
        if not good.isEmpty():
            found = scratch.store(good.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
            gone += [found, roots]
            roots = scratch.store(components(found))
        done = last.isEmpty()
        scratch.drop(*gone)
        if done:
            return roots
        after, most = last, 4 * most


def asking(rows: DataFrame, after: DataFrame | None, name: str = "u") -> DataFrame:
    """Of ``rows`` those that ask in this round, with the place where they stopped."""
    if after is None:
        return rows.withColumns({"after_d": F.lit(-1), "after_v": F.lit(-1).cast("long")})
    return rows.join(after.withColumnRenamed("u", name), name)


def crossing(pairs: DataFrame, roots: DataFrame, after: DataFrame | None, most: int) -> DataFrame:
    """Of given pairs (u, v, d), for each u the ``most`` nearest between two groups after what it asked before."""
    ends = roots.select(F.col("node").alias("u"), F.col("root").alias("gu")), roots.select(F.col("node").alias("v"), F.col("root").alias("gv"))
    left = asking(pairs, after).join(ends[0], "u", "left").join(ends[1], "v", "left").filter(F.coalesce("gu", "u") != F.coalesce("gv", "v"))
    left = left.filter(F.struct("d", "v") > F.struct(F.col("after_d").alias("d"), F.col("after_v").alias("v"))).select("u", "v", "d")
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return left.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def maybe_in(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Adds ``maybe``: whether the key in column ``name`` may be among those of ``keys``, by a bitmap made in Spark.

    It never says no to a key that is there. The bitmap has 2^18 words of 64 bits at most, whatever the number of keys, so it
    can be broadcast. It spares all other rows a shuffle; what passes is joined exactly.
    """
    at = F.pmod(F.xxhash64(name), F.lit(BITMAP))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("__bits"))
    flagged = rows.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(words), "__word", "left")
    bit = F.expr("shiftright(__bits, cast(__at % 64 as int)) & 1L") == 1
    return flagged.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("__word", "__bits", "__at")
