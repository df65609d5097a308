"""Jobs on stage logs and sweeps: scan plans, best focus, sample bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions import bands, geometry
from scanframe.operators import ordered, settings
from scanframe.session import cut_lineage


def enabled_positions(enabled: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions (ticks) of enabled samples (0-based row_idx, name) and the samples whose slot is missing or incomplete."""
    whole = settings.slot_ticks(slots.filter("x_mm is not null and y_mm is not null and z_mm is not null"))
    keyed = enabled.withColumn("slot", (F.col("row_idx") + 1).cast("int"))
    return keyed.join(whole, "slot"), keyed.join(whole.select("slot"), "slot", "left_anti")


def scan_plan(enabled: DataFrame, slots: DataFrame) -> DataFrame:
    """Ordered steps: per sample home, move, scan; at the end home and a status line.

    Sample lists are as long as the stage has slots, so one ordered numbering is small.
    """
    found, _ = enabled_positions(enabled, slots)
    order = Window.partitionBy(F.lit(1)).orderBy("row_idx")
    numbered = found.withColumns({"k": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Sample "), F.col("slot").cast("string")))
    folder = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("sample_"), F.col("slot").cast("string")))
    pct = F.bround((F.col("k") - 1) / F.col("n") * 100.0).cast("int")
    scan_text = F.format_string("[%d/%d %d%%] Scanning %s", F.col("k"), F.col("n"), pct, name)
    step = lambda at, kind, value, message: F.struct(
        at.cast("int").alias("step"), F.lit(kind).alias("kind"), value.alias("value"), message.alias("message"))
    k = F.col("k")
    home = F.lit("Homing Printer. . .")
    per_sample = numbered.select(F.explode(F.array(
        step((k - 1) * 3 + 1, "PRINTER", F.lit("G28"), home),
        step((k - 1) * 3 + 2, "PRINTER", geometry.gcode_move(F.col("x"), F.col("y"), F.col("z")),
             F.concat(F.lit("Moving to sample "), F.col("slot").cast("string"), F.lit(" ("), F.col("name"), F.lit(")"))),
        step((k - 1) * 3 + 3, "SCAN_SAMPLE_BOUNDS", folder, scan_text))).alias("s"))
    done = F.format_string("Scanning Complete : %d Samples Scanned", F.col("n"))
    closing = numbered.agg(F.max("n").alias("n")).filter("n is not null").select(F.explode(F.array(
        step(F.col("n") * 3 + 1, "PRINTER", F.lit("G28"), home), step(F.col("n") * 3 + 2, "STATUS", done, done))).alias("s"))
    return per_sample.unionByName(closing).select("s.step", "s.kind", "s.value", "s.message")


@dataclass(frozen=True)
class FocusSearch:
    """Stopping rules of a focus search on a recorded sweep; heights in ticks."""
    coarse_step: int = 20
    fine_step: int = 4
    reach: int = 560
    peak_drop: float = 5000.0
    base_drop: float = 3000.0
    no_improve: int = 2
    preview_below: float = 90000.0


def sweep_cache(sweep: DataFrame, start: Column, kind: str, scorer: Column | None = None) -> DataFrame:
    """First score per stack and quantised height inside the reach: at most a few hundred rows per stack.

    ``scorer`` is the score of a row (its ``score`` by default); a row that says ``is_black`` scores minus infinity.
    ``preview_score``, where the sweep has it, goes along for the coarse march.
    """
    z, score = geometry.quantize_floor(F.col("z")), F.col("score") if scorer is None else scorer
    gate = lambda s: F.when(F.col("is_black"), F.lit(float("-inf"))).otherwise(s) if "is_black" in sweep.columns else s
    preview = [F.min_by(gate(F.col("preview_score")), "seq").alias("preview_score")] if "preview_score" in sweep.columns else []
    return (sweep.withColumn("start", geometry.quantize_floor(start)).withColumn("z", z)
            .filter(geometry.in_envelope(F.col("z"), F.col("start"), kind))
            .groupBy("stack_id", "start", "z").agg(F.min_by(gate(score), "seq").alias("score"), *preview))


def coarse_march(cache: DataFrame, search: FocusSearch = FocusSearch()) -> DataFrame:
    """Downward march in coarse steps: probes in order with Δbase, running best, and where it stops and why.

    The first probe is a still; where it scores below ``preview_below`` and there are previews, the others are previews.
    """
    probes = cache.withColumn("k", ((F.col("start") - F.col("z")) / search.coarse_step).cast("int")).filter(
        (F.col("start") - F.col("z")) % search.coarse_step == 0)
    order = Window.partitionBy("stack_id").orderBy("k")     # bounded: reach / coarse step rows per stack
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("score").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    based = probes.withColumn("baseline", first)
    if "preview_score" in cache.columns:
        take = (F.col("k") > 0) & (F.col("baseline") < search.preview_below)
        based = based.withColumn("score", F.when(take, F.coalesce("preview_score", "score")).otherwise(F.col("score")))
    seen = based.withColumn("peak", F.max("score").over(so_far))
    base_stop = (F.col("peak") <= F.col("baseline")) & (F.col("baseline") - F.col("score") >= search.base_drop)
    peak_stop = F.col("peak") - F.col("score") >= search.peak_drop
    reason = F.when(F.col("k") > 0, F.when(base_stop, "baseline-drop").when(peak_stop, "peak-drop"))
    marked = seen.withColumns({"delta_base": F.col("score") - F.col("baseline"), "stop_reason": reason})
    stops = F.min(F.when(F.col("stop_reason").isNotNull(), F.col("k"))).over(Window.partitionBy("stack_id"))
    return marked.withColumn("stop_k", stops).filter(F.col("stop_k").isNull() | (F.col("k") <= F.col("stop_k")))


def climb(cache: DataFrame, centers: DataFrame, direction: int, search: FocusSearch) -> DataFrame:
    """Best height when stepping from each centre one way until ``no_improve`` steps in a row bring nothing.

    ``centers``: stack_id, center, center_score.
    """
    steps = ((F.col("z") - F.col("center")) * direction / search.fine_step).cast("int")
    on_way = (cache.join(centers, "stack_id").withColumn("n", steps)
              .filter(((F.col("z") - F.col("center")) * direction >= 0) & ((F.col("z") - F.col("center")) % search.fine_step == 0)))
    order = Window.partitionBy("stack_id").orderBy("n")     # bounded: reach / fine step rows per stack
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    best_before = F.greatest(F.max("score").over(before), F.col("center_score"))
    walk = on_way.withColumn("improved", F.col("n").isin(0) | (F.col("score") > best_before + 1e-6))
    walk = walk.withColumn("streak", F.col("n") - F.max(F.when(F.col("improved"), F.col("n"))).over(upto))
    walk = walk.withColumn("gap", F.col("n") - F.row_number().over(order) + 1)   # a height never recorded ends the walk
    end = F.min(F.when(F.col("streak") >= search.no_improve, F.col("n"))).over(Window.partitionBy("stack_id"))
    kept = walk.withColumn("end", end).filter((F.col("gap") == 0) & (F.col("end").isNull() | (F.col("n") <= F.col("end"))))
    return kept.filter("improved").groupBy("stack_id").agg(F.max_by("z", "n").alias("z"), F.max_by("score", "n").alias("score"))


def refine_around(cache: DataFrame, centers: DataFrame, search: FocusSearch = FocusSearch()) -> DataFrame:
    """Best of climbing up and down; up wins a tie."""
    up, down = climb(cache, centers, 1, search), climb(cache, centers, -1, search)
    both = up.select("stack_id", F.col("z").alias("up_z"), F.col("score").alias("up_s")).join(
        down.select("stack_id", F.col("z").alias("down_z"), F.col("score").alias("down_s")), "stack_id")
    take_up = F.col("up_s") >= F.col("down_s")
    return both.select("stack_id", F.when(take_up, F.col("up_z")).otherwise(F.col("down_z")).alias("z"),
                       F.when(take_up, F.col("up_s")).otherwise(F.col("down_s")).alias("score"))


def best_focus(sweep: DataFrame, start: Column, search: FocusSearch = FocusSearch(), scorer: Column | None = None) -> DataFrame:
    """Descent search on recorded sweeps (stack_id, seq, z, score and, if known, preview_score and is_black): best height
    and score, Δbase and why it stopped."""
    cache = cut_lineage(sweep_cache(sweep, start, "descent", scorer))      # small, read by the march and both climbs
    march = coarse_march(cache, search)
    coarse = march.groupBy("stack_id").agg(
        F.max_by("z", F.struct("score", -F.col("k"))).alias("center"), F.max("score").alias("center_score"),
        F.first("baseline").alias("baseline"), F.coalesce(F.max("stop_reason"), F.lit("end of range")).alias("stop_reason"),
        F.count(F.lit(1)).alias("probes"))
    fine = refine_around(cache, coarse.select("stack_id", "center", "center_score"), search)
    better = F.col("score") > F.col("center_score")
    return coarse.join(fine, "stack_id", "left").select(
        "stack_id", F.when(better, F.col("z")).otherwise(F.col("center")).alias("best_z"),
        F.when(better, F.col("score")).otherwise(F.col("center_score")).alias("best_score"), "baseline",
        (F.when(better, F.col("score")).otherwise(F.col("center_score")) - F.col("baseline")).alias("delta_base"),
        "stop_reason", "probes")


def fine_focus(sweep: DataFrame, center: Column, search: FocusSearch = FocusSearch(no_improve=1)) -> DataFrame:
    """Fine search in the small window around a centre height (half-even quantised)."""
    quantised = geometry.quantize_even(center)
    cache = cut_lineage(sweep_cache(sweep.withColumn("__c", quantised), F.col("__c"), "fine"))
    centers = cache.filter(F.col("z") == F.col("start")).select("stack_id", F.col("start").alias("center"), F.col("score").alias("center_score"))
    return refine_around(cache, centers, search).join(centers, "stack_id").select(
        "stack_id", "z", "score", (F.col("score") - F.col("center_score")).alias("delta_base"))


def alternating_focus(sweep: DataFrame, start: Column, improve: float = 1000.0,
                      search: FocusSearch = FocusSearch(peak_drop=2000.0)) -> DataFrame:
    """Coarse search on both sides, right first, with bias to the first side that gains ``improve``; then fine polish.

    The alternating order is a function of side and step, so the search is a prefix of a sorted sweep: probes before the
    bias alternate, probes after it stay on the biased side (and turn to the other one when that side is used up).
    """
    cache = cut_lineage(sweep_cache(sweep, start, "alternating"))  # small, read by every stage
    offset = F.col("z") - F.col("start")
    grid = cache.filter(offset % search.coarse_step == 0).withColumns({
        "k": F.abs(offset / search.coarse_step).cast("int"), "side": F.when(offset > 0, "right").when(offset < 0, "left").otherwise("start")})
    base = grid.filter("side = 'start'").select("stack_id", F.col("score").alias("baseline"))
    probes = grid.filter("side <> 'start'").join(base, "stack_id")
    stack = Window.partitionBy("stack_id")                  # bounded: twice reach / coarse step rows per stack
    # unbiased turn order: right 1, left 1, right 2, left 2, ... and the longer side alone once the other has ended
    turn = F.row_number().over(stack.orderBy("k", F.when(F.col("side") == "right", 0).otherwise(1)))
    turned = probes.withColumn("turn", turn)
    gained = turned.filter(F.col("score") - F.col("baseline") >= improve).groupBy("stack_id").agg(
        F.min("turn").alias("bias_turn"), F.min_by("side", "turn").alias("bias_side"), F.min_by("k", "turn").alias("bias_k"))
    biased = turned.join(gained, "stack_id", "left")
    after = F.col("bias_turn").isNotNull() & (F.col("turn") > F.col("bias_turn"))
    # after the bias only its side is probed; a left march that ends early at the floor goes on to the right
    other = after & (F.col("side") != F.col("bias_side"))
    floored = (F.col("bias_side") == "left") & (F.col("start") < search.reach)
    kept = biased.filter(~F.coalesce(other, F.lit(False)) | floored).withColumn(
        "turn", F.when(F.coalesce(other, F.lit(False)), F.col("turn") + 10_000).otherwise(F.col("turn")))
    order = stack.orderBy("turn")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    on_bias = (F.col("side") == F.col("bias_side")) & (F.col("turn") >= F.col("bias_turn"))
    kept = kept.withColumns({"best": F.max("score").over(upto), "bias_peak": F.max(F.when(on_bias, F.col("score"))).over(upto)})
    base_stop = (F.col("best") <= F.col("baseline")) & (F.col("baseline") - F.col("score") >= search.base_drop)
    peak_stop = on_bias & (F.col("bias_peak") - F.col("score") >= search.peak_drop)
    kept = kept.withColumn("stop_reason", F.when(base_stop, "baseline-drop").when(peak_stop, "peak-drop"))
    stop = F.min(F.when(F.col("stop_reason").isNotNull(), F.col("turn"))).over(stack)
    walked = kept.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("turn") <= F.col("stop")))
    coarse = walked.groupBy("stack_id").agg(
        F.max_by("z", F.struct("score", -F.col("turn"))).alias("z"), F.max("score").alias("score"), F.first("baseline").alias("baseline"),
        F.first("bias_side").alias("bias_side"), F.max("stop_reason").alias("stop_reason"), F.count(F.lit(1)).alias("probes"))
    starts = sweep.select("stack_id", geometry.quantize_floor(start).alias("start")).distinct()
    above = F.col("score") > F.col("baseline")
    centers = cut_lineage(coarse.join(starts, "stack_id")).select(
        "stack_id", F.when(above, F.col("z")).otherwise(F.col("start")).alias("center"),
        F.greatest("score", "baseline").alias("center_score"), "baseline", "bias_side", "stop_reason", "probes")
    middle = refine_march(cache, centers.select("stack_id", "center", "center_score"), 12)
    step2 = centers.join(middle, "stack_id", "left").withColumns({
        "center": F.when(F.col("score") > F.col("center_score"), F.col("z")).otherwise(F.col("center")),
        "center_score": F.greatest("center_score", F.coalesce("score", "center_score"))}).drop("z", "score")
    fine = refine_fine_latest(cache, step2.select("stack_id", "center", "center_score"), search)
    better = F.col("score") > F.col("center_score")
    return step2.join(fine, "stack_id", "left").select(
        "stack_id", F.when(better, F.col("z")).otherwise(F.col("center")).alias("best_z"),
        F.when(better, F.col("score")).otherwise(F.col("center_score")).alias("best_score"), "baseline", "bias_side",
        F.coalesce("stop_reason", F.lit("end of range")).alias("stop_reason"), "probes")


def refine_march(cache: DataFrame, centers: DataFrame, step: int) -> DataFrame:
    """Middle march: probe one step up and down, go on in the better direction (up on a tie) while scores do not fall."""
    way = (cache.join(centers, "stack_id").withColumn("n", (F.col("z") - F.col("center")) / step)
           .filter(((F.col("z") - F.col("center")) % step == 0) & (F.col("z") != F.col("center"))))
    side = F.when(F.col("n") > 0, 1).otherwise(-1)
    probes = way.withColumn("side", side).withColumn("n", F.abs("n").cast("int"))
    chosen = probes.filter("n = 1").groupBy("stack_id").agg(F.max_by("side", F.struct("score", "side")).alias("chosen"))
    line = probes.join(chosen, "stack_id").filter("side = chosen")
    order = Window.partitionBy("stack_id").orderBy("n")     # bounded: reach / step rows per stack
    stepped = line.withColumns({"fell": (F.col("score") + 1e-6 < F.lag("score").over(order)), "row": F.row_number().over(order)})
    end = F.min(F.when(F.col("fell") | (F.col("row") != F.col("n")), F.col("n"))).over(Window.partitionBy("stack_id"))
    # the probe that fell was scored too, so it may still be the best one seen
    seen = stepped.withColumn("end", end).filter((F.col("end").isNull() | (F.col("n") <= F.col("end"))) & (F.col("row") == F.col("n")))
    return seen.groupBy("stack_id").agg(F.max_by("z", F.struct("score", -F.col("n"))).alias("z"), F.max("score").alias("score"))


def refine_fine_latest(cache: DataFrame, centers: DataFrame, search: FocusSearch) -> DataFrame:
    """Fine polish of the alternating search: the higher (score, height) of both climbs."""
    both = climb(cache, centers, 1, search).unionByName(climb(cache, centers, -1, search))
    return both.groupBy("stack_id").agg(F.max(F.struct("score", "z")).alias("b")).select("stack_id", "b.z", "b.score")


def segments(series: DataFrame, group: str = "sample_id", order: str = "seq", is_break: str = "is_break") -> DataFrame:
    """Adds ``segment``: it rises at every break marker."""
    out = ordered.running(series, [group], order, {"segment": ("sum", F.col(is_break).cast("bigint"))})
    return out


def elapsed(series: DataFrame, group: str = "sample_id", ts: str = "ts") -> DataFrame:
    """Adds seconds since the group's first row; the start is an aggregate joined back."""
    start = series.groupBy(group).agg(F.min(ts).alias("__start"))
    return series.join(start, group).withColumn(
        "elapsed_s", (F.unix_micros(ts) - F.unix_micros("__start")) / F.lit(1e6)).drop("__start")


def sample_bounds(series: DataFrame, group: str = "sample_id", order: str = "seq", y: str = "y") -> DataFrame:
    """Extent of every sample from its recorded sweep.

    Segment 0 is the forward sweep and counts whole. The first segment after a break is the way back: it counts up to,
    not including, the first end-of-sample row. Later segments belong to no sweep.
    """
    cut = segments(series, group, order).filter("segment <= 1")
    is_end = (F.col("segment") == 1) & bands.end_of_sample(F.col("hard"), F.col("soft"), F.col("ylum"))
    end = cut.groupBy(group).agg(F.min(F.when(is_end, F.col(order))).alias("end_seq"))
    kept = cut.join(end, group).filter(
        (F.col("segment") == 0) | F.col("end_seq").isNull() | (F.col(order) < F.col("end_seq")))
    worth = bands.worth_fine_focus(F.col("hard"), F.col("soft"))
    return kept.groupBy(group).agg(
        F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.count(F.lit(1)).alias("positions"),
        F.count_if(worth).alias("captured"), F.max("end_seq").isNotNull().alias("end_found"))


def sweep_positions(starts: DataFrame, step: float = 1.0, y_max: float = 224.0) -> DataFrame:
    """Positions of the forward and the backward sweep from ``start_y`` (mm), both ends clamped."""
    s = F.col("start_y")
    count = lambda distance: F.greatest(F.lit(0), F.ceil(F.round(distance / step, 9)).cast("int"))
    forward = F.transform(F.sequence(F.lit(0), count(y_max - s)), lambda i: F.struct(
        F.lit("forward").alias("direction"), i.alias("i"), F.least(s + i * step, F.lit(y_max)).alias("y")))
    backward = F.transform(F.sequence(F.lit(0), count(s)), lambda i: F.struct(
        F.lit("backward").alias("direction"), i.alias("i"), F.greatest(s - i * step, F.lit(0.0)).alias("y")))
    return starts.select("*", F.explode(F.concat(forward, backward)).alias("p")).select(*starts.columns, "p.direction", "p.i", "p.y")


def progress(steps: DataFrame, group: str, order: str) -> DataFrame:
    """Adds k, the total and the whole percentage done before step k."""
    numbered = ordered.dense_index(steps, [group], [order], ordered.chunk_of(F.col(order)), "k0")
    total = steps.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return numbered.join(total, group).withColumns({
        "k": F.col("k0") + 1, "pct": F.bround(F.col("k0") / F.col("total") * 100.0).cast("int")}).drop("k0")
