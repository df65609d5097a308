"""How filters interact: what every filter removes in every order, from path counts over the lattice of filter subsets.

A state of the lattice is the set of filters applied so far; an edge applies one more. What an edge removes depends on its
state only, not on the order in which that was reached, so every (part, edge) is counted once: documents that fail the
edge's filter and none of the state's. Forward counts say how many orders reach a state, backward counts how many ways
lead from one to the end; their product is the number of orders that pass an edge. The Shapley value of a filter is the
sum of its edges' removals, each as often as orders pass it, and the steps of any order are read from the same edges.

The documents are reduced to (part, failed filters) counts first. Rows of one text are joined into one row per part and
label before anything is compared, so a text that holds any share of the table is no hot key; texts travel as 32-byte
digests.

Defined results: a null text is empty (no words; it fails A, not B, C or D); a null ``lang`` is the part ''; a null
``doc_id`` is no smaller than any and has no smaller one, so it never fails E; rows that repeat a doc_id and a text count
each and are no copies of one another; a document is good or toxic if any of its label rows says so; an empty table gives
an empty result. Only doc_id, text and lang are read, whatever other columns are called.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.llm.common import text_of, words_of

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
UPPER, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[#$%&*|]"


# ---- path counts over the lattice (2^n states: bounded by the number of filters) --------------------------------------

def forward(n: int) -> list[int]:
    """For every state, a number whose bits are filters, the orders of its filters: paths from the empty state to it."""
    paths = [1] + [0] * ((1 << n) - 1)
    for state in range(1 << n):
        for f in range(n):
            if not state >> f & 1:
                paths[state | 1 << f] += paths[state]
    return paths


def backward(n: int) -> list[int]:
    """For every state, the paths from it to the full one."""
    paths = [0] * ((1 << n) - 1) + [1]
    for state in reversed(range(1 << n)):
        paths[state] += sum(paths[state | 1 << f] for f in range(n) if not state >> f & 1)
    return paths


def _at(values: list[int], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), place + 1)


def edges(counts: DataFrame, n: int) -> DataFrame:
    """(part, state, f, removed, redundant, kept, good_lost, toxic_lost, orders) of (part, mask, n, good, toxic).

    Every part has all its edges, zeros included; ``orders`` is the number of orders that pass the edge.
    """
    each = counts.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit((n << n) - 1))))
    each = each.withColumn("state", F.floor(F.col("edge") / n).cast("int")).withColumn("f", (F.col("edge") % n).cast("int"))
    each = each.withColumn("bit", F.expr("shiftleft(1, f)")).filter(F.col("state").bitwiseAND(F.col("bit")) == 0)
    before, here = F.col("mask").bitwiseAND(F.col("state")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column, column: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    found = each.groupBy("part", "state", "f").agg(
        total(here & ~before).alias("removed"), total(here & before).alias("redundant"), total(~here & ~before).alias("kept"),
        total(here & ~before, "good").alias("good_lost"), total(here & ~before, "toxic").alias("toxic_lost"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"))
    return found.withColumn("orders", _at(forward(n), F.col("state")) * _at(backward(n), F.col("state") + F.expr("shiftleft(1, f)")))


def report(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, n, good, toxic); n! orders of n filters."""
    n = len(filters)
    lattice = edges(counts, n)
    shapley = lattice.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    valued = lattice.join(shapley, ["part", "f"])
    steps = [("".join(filters[f] for f in order), step + 1, sum(1 << f for f in order[:step]), order[step])
             for order in itertools.permutations(range(n)) for step in range(n)]
    # n! x n rows, whatever the data
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, f int")
    return valued.join(F.broadcast(orders), ["state", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# ---- the five filters --------------------------------------------------------------------------------------------------

def failed(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = words_of(text)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    rules = [F.size(words) < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
             100 * upper > MAX_UPPER_PERCENT * F.length(text), text.rlike(MARKS)]
    mask = F.lit(0)
    for bit, rule in enumerate(rules):
        mask = mask + F.when(rule, 1 << bit).otherwise(0)
    return mask


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of all documents; bit 4 of the mask, E, says that a smaller doc_id has the same text."""
    thin = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_of().alias("text"))
    thin = thin.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed(F.col("text")).alias("mask"))
    # repeated rows become one, so that no doc_id is hot in the join with the labels
    rows = thin.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = rows.join(marks.filter("doc_id is not null"), "doc_id", "left").na.fill(0, ["good", "toxic"])
    # of a text's rows with one part and label, only those with the least id can be its first: the rest is a number
    alike = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = F.min("least").over(Window.partitionBy("digest"))  # bounded: a row per part and label
    firsts = F.col("n_null") + F.when(F.col("least") == F.col("__first"), F.col("n_least")).otherwise(0)
    split = alike.withColumn("__first", least).withColumn("firsts", firsts).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("s"))
    return split.groupBy("part", "s.mask").agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return report(counts(docs, labels), FILTERS)
