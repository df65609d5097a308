"""Alignment results of consecutive frames: ``sample_id, pair_idx, x_overlap, y_offset, score, coarse_score``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions import bands
from scanframe.operators import ordered

SAMPLE = "sample_id"


def exact_std(n: Column, s1: Column, s2: Column) -> Column:
    """Population deviation from whole-number sums; exactly 0 for equal values."""
    return F.sqrt(F.greatest(F.lit(0).cast("bigint"), n * s2 - s1 * s1).cast("double")) / n


def _history(window: Window, rows: int, column: str) -> tuple[Column, Column, Column]:
    back = window.rowsBetween(-rows, -1)
    v = F.col(column).cast("bigint")
    n = F.count(v).over(back)
    return n, F.sum(v).over(back) / n, exact_std(n, F.sum(v).over(back), F.sum(v * v).over(back))


def flag_outliers(pairs: DataFrame) -> DataFrame:
    """Adds ``flags`` and ``confidence``: absolute checks plus the deviation from up to five earlier pairs."""
    def columns(w: Window) -> dict[str, Column]:
        n, mean, std = _history(w, 5, "x_overlap")
        recent = F.avg("score").over(w.rowsBetween(-5, -1))
        return {"__z": F.when((n >= 3) & (std > 0), F.abs(F.col("x_overlap") - mean) / std),
                "__recent": F.when(n >= 2, recent)}

    seen = ordered.with_neighbours(pairs, [SAMPLE], "pair_idx", columns, before=5)
    flagged = seen.withColumn("flags", bands.outlier_flags(F.col("score"), F.col("coarse_score"), F.col("__z"),
                                                           F.col("__recent"))).drop("__z", "__recent")
    return flagged.withColumn("confidence", bands.confidence(F.size("flags"), F.col("score")))


def search_plan(pairs: DataFrame, default_min: Column, default_max: Column) -> DataFrame:
    """Adds the overlap bounds and the y centre and radius that up to three earlier results suggest."""
    coarse = F.col("coarse_score")

    def columns(w: Window) -> dict[str, Column]:
        n, mean, std = _history(w, 3, "x_overlap")
        buffer = F.greatest(F.lit(100.0), 2 * std)
        yn, y_mean, y_std = _history(w, 3, "y_offset")
        by_tier = lambda a, b, c, d: F.when(coarse > 0.98, a).when(coarse > 0.96, b).when(coarse > 0.94, c).otherwise(d)
        reach = lambda floor, k, extra: F.greatest(F.lit(floor), (k * y_std + extra).cast("int"))
        known = by_tier(reach(5, 1.5, 3), reach(6, 2.0, 4), reach(8, 2.5, 5), reach(10, 3.0, 6))
        fresh = by_tier(F.lit(5), F.lit(8), F.lit(12), F.lit(15))
        return {
            "overlap_min": F.when(n >= 2, F.greatest(default_min, (mean - buffer).cast("int"))).otherwise(default_min),
            "overlap_max": F.when(n >= 2, F.least(default_max, (mean + buffer).cast("int"))).otherwise(default_max),
            "y_center": F.when(yn >= 3, F.bround(y_mean).cast("int")).otherwise(F.lit(0)),
            "y_radius": F.when(yn >= 3, F.least(known, F.lit(15))).otherwise(fresh)}

    return ordered.with_neighbours(pairs, [SAMPLE], "pair_idx", columns, before=3)


def accepted_prefix(pairs: DataFrame, min_acceptable: float = 0.7) -> DataFrame:
    """Pairs before the first failed one of their sample; ``complete`` says whether none failed."""
    failed = F.when(~F.coalesce(bands.accepted(F.col("score"), min_acceptable), F.lit(False)), F.col("pair_idx"))
    first = pairs.groupBy(SAMPLE).agg(F.min(failed).alias("__failed"))
    return (pairs.join(first, SAMPLE)
            .filter(F.col("__failed").isNull() | (F.col("pair_idx") < F.col("__failed")))
            .withColumn("complete", F.col("__failed").isNull()).drop("__failed"))


def recent_scores(pairs: DataFrame, size: int = 50) -> DataFrame:
    """Adds the last ``size`` scores up to and with the pair itself."""
    return ordered.with_neighbours(pairs, [SAMPLE], "pair_idx", lambda w: {
        "history": F.collect_list("score").over(w.rowsBetween(-(size - 1), 0))}, before=size - 1)


def typical_gap(pairs: DataFrame) -> DataFrame:
    """Whole median of the positive coordinate steps per sample, 1 if there is none.

    The percentile keeps counts per distinct step; steps of a sample add up to its length, so they are few.
    """
    step = F.col("next_coord") - F.col("coord")
    return pairs.groupBy(SAMPLE).agg(
        F.coalesce(F.percentile(F.when(step > 0, step), 0.5).cast("int"), F.lit(1)).alias("typical_gap"))


def position_gaps(pairs: DataFrame) -> DataFrame:
    """Adds the step of every pair compared with the usual one: multiplier and skip / overlap / normal."""
    gap, typical = F.coalesce(F.col("next_coord") - F.col("coord"), F.lit(1)), F.col("typical_gap")
    return pairs.join(typical_gap(pairs), SAMPLE).withColumns({
        "gap_size": gap, "has_gap": gap != typical,
        "gap_multiplier": F.when(typical > 0, gap / typical).otherwise(F.lit(1.0)),
        "gap_type": F.when(gap > typical, "skip").when(gap < typical, "overlap").otherwise("normal")})


def neighbour_constraints(pairs: DataFrame, window: int = 4) -> DataFrame:
    """Adds what the HIGH pairs within ``window`` positions say about overlap and y offset, scaled for the gap.

    ``n_neighbours`` is 0 and the bounds are NULL where no such pair exists.
    """
    high = F.col("confidence") == "HIGH"
    one = F.when(high, 1).otherwise(0).cast("bigint")
    v = lambda c: F.when(high, F.col(c)).otherwise(0).cast("bigint")

    def columns(w: Window) -> dict[str, Column]:
        around = w.rowsBetween(-window, window)
        others = lambda c: F.sum(c).over(around) - c
        return {"__n": others(one), "__o1": others(v("x_overlap")), "__o2": others(v("x_overlap") * v("x_overlap")),
                "__y1": others(v("y_offset")), "__y2": others(v("y_offset") * v("y_offset"))}

    near = ordered.with_neighbours(position_gaps(pairs), [SAMPLE], "pair_idx", columns, before=window, after=window)
    n = F.nullif(F.col("__n"), F.lit(0))
    mean_o, mean_y = F.col("__o1") / n, F.col("__y1") / n
    std_o = F.when(n > 1, exact_std(n, F.col("__o1"), F.col("__o2"))).otherwise(F.lit(25.0))
    std_y = F.when(n > 1, exact_std(n, F.col("__y1"), F.col("__y2"))).otherwise(F.lit(3.0))
    gapped = F.col("has_gap") & (F.col("gap_multiplier") != 1.0)
    predicted = F.when(gapped, mean_o * bands.overlap_scale(F.col("gap_multiplier"))).otherwise(mean_o)
    unsure = F.when(gapped, F.greatest(std_o * 1.5, F.lit(50.0))).otherwise(std_o)
    return near.withColumns({
        "n_neighbours": F.col("__n"),
        "overlap_min": F.when(n.isNotNull(), F.greatest(F.lit(100), (predicted - 2.5 * unsure - 40).cast("int"))),
        "overlap_max": (predicted + 2.5 * unsure + 40).cast("int"), "overlap_predicted": predicted.cast("int"),
        "y_predicted": F.bround(mean_y).cast("int"),
        "y_range": F.when(n.isNotNull(), F.greatest(F.lit(8), (2.5 * std_y + 6).cast("int"))),
    }).drop("__n", "__o1", "__o2", "__y1", "__y2")


def refinement_plan(constrained: DataFrame, threshold: str = "MEDIUM") -> DataFrame:
    """Weak pairs with the window and steps of their second search."""
    weak = constrained.filter(F.col("confidence").isin(threshold, "LOW"))
    known = F.col("n_neighbours") > 0
    gap = F.when(known, F.col("has_gap")).otherwise(F.lit(True))
    mult = F.when(known, F.col("gap_multiplier")).otherwise(F.lit(1.0))
    shifted = known & F.col("has_gap") & (F.abs("y_offset") > 5)
    wide, some = gap & (mult > 1.2), gap
    pick = lambda a, b, c: F.when(wide, F.lit(a)).when(some, F.lit(b)).otherwise(F.lit(c))
    return weak.withColumns({
        "search_center": F.when(known, F.col("overlap_predicted")).otherwise(F.col("x_overlap")),
        "search_min": F.when(known, F.col("overlap_min")).otherwise((F.col("x_overlap") * 0.5).cast("int")),
        "search_max": F.when(known, F.col("overlap_max")).otherwise((F.col("x_overlap") * 1.5).cast("int")),
        "search_y": F.when(known & ~shifted, F.col("y_predicted")).otherwise(F.col("y_offset")),
        "search_y_range": F.when(shifted, F.greatest(F.lit(12), F.col("y_range") + 5)).when(known, F.col("y_range"))
        .otherwise(F.lit(20)),
        "coarse_x_radius": pick(120, 70, 40), "coarse_x_step": pick(10, 7, 5), "coarse_y_step": pick(4, 3, 2),
        "fine_x_radius": pick(15, 10, 8), "fine_y_radius": pick(8, 6, 4)})


def judge_refinement(refined: DataFrame) -> DataFrame:
    """Adds whether the second search (``new_*`` columns) replaces the first result, why, and the counter it adds to."""
    change = F.col("new_score") - F.col("score")
    known = F.col("n_neighbours") > 0
    gap_case = known & F.col("has_gap")
    large_y = (F.abs("new_y_offset") > 5) | (F.abs("y_offset") > 5)
    lenient = gap_case & (F.col("new_score") > 0.85) & (change > -0.05)
    very_lenient = gap_case & (F.col("new_score") > 0.80) & (change > -0.03) & large_y
    better = change > 0.002
    accept = F.coalesce(better | lenient | very_lenient, F.lit(False))
    reason = (F.when(F.col("new_score").isNull(), "refinement failed").when(better, "score improved")
              .when(lenient & large_y, "gap case with physical misalignment (y-shift)")
              .when(lenient, "gap case with acceptable score")
              .when(very_lenient, "gap case with large y-shift (best possible)")
              .when(gap_case, "gap case but score too low").when(change < -0.005, "score degraded significantly")
              .otherwise("no significant change"))
    counter = (F.when(F.col("new_score").isNull(), "failed").when(accept, "improved").when(change < -0.001, "degraded")
               .otherwise("unchanged"))
    return refined.withColumns({
        "accepted": accept, "reason": reason, "counter": counter, "is_gap_case": gap_case,
        "new_confidence": bands.refined_confidence(F.col("new_score")),
        "new_flags": bands.refinement_flags(change, F.when(known, F.col("gap_type")), F.col("gap_multiplier"))})


def refinement_counters(judged: DataFrame, keys: list[str]) -> DataFrame:
    kind = lambda k: F.count_if(F.col("counter") == k).alias(k)
    return judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"), kind("improved"), kind("degraded"),
                                     kind("unchanged"), F.count_if("is_gap_case").alias("gap_cases"))


def confidence_distribution(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and share per grade. The group totals are a small aggregate of the counts, not of the pairs."""
    counts = pairs.groupBy(*keys, "confidence").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) * 100.0)


def offset_exceedance(pairs: DataFrame, keys: list[str], limits: tuple[int, ...] = (2, 5, 10, 15, 20)) -> DataFrame:
    """How many pairs shift by more than each limit, and their share."""
    shift, n = F.abs("y_offset"), F.count(F.lit(1))
    counted = pairs.groupBy(*keys).agg(n.alias("n"), *[F.count_if(shift > k).alias(f"over_{k}") for k in limits])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("limit_px"), F.col(f"over_{k}").alias("n_over")) for k in limits]))
    return counted.select(*keys, "n", rows.alias("r")).select(
        *keys, "r.limit_px", "r.n_over", (F.col("r.n_over") / F.col("n") * 100.0).alias("pct"))
