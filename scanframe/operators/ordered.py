"""Ordered computations inside groups of any size.

A plain ``Window.partitionBy(group)`` sends a whole group to one task. Here every group is cut into chunks along
its order, windows run inside ``(group, chunk)``, and what has to cross a chunk border is either copied there
(``halo``: bounded look-back and look-ahead) or carried as one summary row per chunk (``running``, ``dense_index``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.session import cut_lineage

CHUNK = "__chunk"
CHUNK_ROWS = 4096


def chunk_of(order: Column, width: int = CHUNK_ROWS) -> Column:
    """Chunk number of a whole-number order key."""
    return F.floor(order / width).cast("bigint")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def halo(df: DataFrame, group: Sequence[str], index: str, before: int = 0, after: int = 0,
         width: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``__chunk`` and ``__home``; rows next to a border are also copied, as context, into the next chunk.

    ``index`` counts 0, 1, 2, ... in every group. Windows over ``(group, __chunk)`` that look at most ``before``
    rows back and ``after`` rows ahead are then exact on the rows with ``__home``.
    """
    i = F.col(index)
    chunks = F.array_distinct(F.array(chunk_of(i, width), chunk_of(i + before, width), chunk_of(i - after, width)))
    return (df.withColumn(CHUNK, F.explode(chunks))
            .withColumn("__home", F.col(CHUNK) == chunk_of(i, width)))


def with_neighbours(df: DataFrame, group: Sequence[str], index: str, columns: Callable[[Window], dict[str, Column]],
                    before: int = 0, after: int = 0, width: int = CHUNK_ROWS) -> DataFrame:
    """Adds window columns that look a bounded number of rows back and ahead. ``columns`` maps a window to columns."""
    window = Window.partitionBy(*group, CHUNK).orderBy(index)
    return (halo(df, group, index, before, after, width).withColumns(columns(window))
            .filter("__home").drop(CHUNK, "__home"))


def dense_index(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], chunk: Column,
                name: str = "idx") -> DataFrame:
    """Adds 0, 1, 2, ... in the given order inside each group.

    ``chunk`` must not decrease along ``order``; it bounds how many rows one task sorts.
    """
    keyed = df.withColumn(CHUNK, chunk)
    local = F.row_number().over(Window.partitionBy(*group, CHUNK).orderBy(*order)) - 1
    per_chunk = keyed.groupBy(*group, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select(*group, CHUNK, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    ranked = keyed.withColumn("__local", local)
    joined = ranked.join(base, [*group, CHUNK])
    return (joined.withColumn(name, (F.col("__base") + F.col("__local")).cast("bigint"))
            .drop(CHUNK, "__local", "__base"))


def range_index(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "idx",
                size: str | None = None) -> DataFrame:
    """Adds 0, 1, 2, ... in the given order inside each group, however the values are spread, and the group's ``size`` if named.

    Rows are split by ranges of (group, order), numbered in place and stored; a group that spans several ranges gets an
    offset per range. No task holds a group, and ranges are as even as the rows allow.
    """
    keys = [*group, *order]
    row = F.monotonically_increasing_id()
    placed = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__row", row).withColumn("__range", F.shiftright("__row", 33)))
    per = placed.groupBy(*group, "__range").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = per.select(*group, "__range", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
                      *([F.sum("__n").over(Window.partitionBy(*group)).alias(size)] if size else []))
    right = base.select(*[F.col(c).alias(f"__of_{c}") for c in group], F.col("__range").alias("__at"), "__shift", *([size] if size else []))
    same = F.col("__range") == F.col("__at")
    for c in group:
        same = same & placed[c].eqNullSafe(right[f"__of_{c}"])
    return placed.join(right, same).withColumn(name, F.col("__row") + F.col("__shift")).drop(
        "__row", "__range", "__at", "__shift", *[f"__of_{c}" for c in group])


def running(df: DataFrame, group: Sequence[str], order: str, specs: dict[str, tuple[str, Column]],
            inclusive: bool = True, width: int = CHUNK_ROWS) -> DataFrame:
    """Adds running values along a whole-number ``order`` that is unique in its group.

    ``specs`` maps a new column to ``(kind, column)`` with kind ``sum``, ``max``, ``min`` or ``last`` (last value
    that is not NULL). With ``inclusive=False`` the row itself does not count.
    """
    keyed = df.withColumn(CHUNK, chunk_of(F.col(order), width))
    inputs = {f"__in_{name}": column for name, (_, column) in specs.items()}
    keyed = keyed.withColumns(inputs)
    end = 0 if inclusive else -1
    here = Window.partitionBy(*group, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    scan = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}

    def summary(kind: str, column: str) -> Column:
        if kind == "last":
            return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))
        return scan[kind](column)

    local = keyed.withColumns({f"__here_{n}": scan[k](f"__in_{n}").over(here) for n, (k, _) in specs.items()})
    totals = keyed.groupBy(*group, CHUNK).agg(*[summary(k, f"__in_{n}").alias(f"__sum_{n}")
                                               for n, (k, _) in specs.items()])
    carried = totals.select(*group, CHUNK, *[scan[k](f"__sum_{n}").over(before).alias(f"__carry_{n}")
                                            for n, (k, _) in specs.items()])
    joined = local.join(carried, [*group, CHUNK])

    def combine(name: str, kind: str) -> Column:
        mine, carry = F.col(f"__here_{name}"), F.col(f"__carry_{name}")
        if kind == "sum":
            return F.when(mine.isNull(), carry).when(carry.isNull(), mine).otherwise(mine + carry)
        if kind == "max":
            return F.greatest(mine, carry)
        if kind == "min":
            return F.least(mine, carry)
        return F.coalesce(mine, carry)

    joined = joined.withColumns({name: combine(name, kind) for name, (kind, _) in specs.items()})
    helpers = [f"__{part}_{n}" for n in specs for part in ("in", "here", "carry")]
    return joined.drop(CHUNK, *helpers)
