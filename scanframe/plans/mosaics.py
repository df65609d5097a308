"""Jobs from frames to mosaics: alignment, refinement, assembly, reports, documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions import bands, geometry, names
from scanframe.operators import align, canvas, frames as frame_ops, layers as layer_ops, ordered, pairs as pair_ops, select, sequence
from scanframe.session import cut_lineage

SAMPLE = "sample_id"


def frame_sequence(listing: DataFrame, axis: str = "y", max_gap: int = 2) -> DataFrame:
    """Frames to stitch: best per coordinate, numbered; samples with a hole above ``max_gap`` are left out.

    Works on names only; pixels are joined afterwards. The numbered listing is stored once: the gap check and everything
    that follows read it again.
    """
    seq = cut_lineage(sequence.numbered(sequence.best_per_coordinate(sequence.with_coordinates(listing, axis))))
    blocked = sequence.blocked_samples(sequence.gaps(seq), max_gap)
    return seq.join(blocked.select(SAMPLE), SAMPLE, "left_anti")


def search_errors(min_overlap: float, max_overlap: float, min_score: float, rotate: tuple[bool, bool, bool]) -> list[str]:
    """What is wrong with alignment parameters."""
    found = []
    if not 0.0 < min_overlap < 1.0:
        found.append("min_overlap must be between 0 and 1")
    if not 0.0 < max_overlap <= 1.0:
        found.append("max_overlap must be above 0 and at most 1")
    if min_overlap >= max_overlap:
        found.append("min_overlap must be below max_overlap")
    if not 0.0 < min_score <= 1.0:
        found.append("min_score must be above 0 and at most 1")
    if sum(rotate) > 1:
        found.append("only one rotation at a time")
    return found


def align_pairs(frames: DataFrame, axis: str = "x", rotate: int = 0, search: align.Search = align.Search(),
                min_acceptable: float = 0.7, history: bool = False) -> DataFrame:
    """Alignment of consecutive frames (sample_id, seq, pixels) with flags and confidence, up to the first failure."""
    cut = align.strips(frames, axis, rotate, search.max_overlap)
    # the search is the costly part and its few rows are read twice below: store them
    found = align.align_with_history(cut, search) if history else cut_lineage(align.find_alignments(cut, search))
    return pair_ops.accepted_prefix(pair_ops.flag_outliers(found), min_acceptable)


def refine_pairs(pairs: DataFrame, frames: DataFrame, axis: str = "x", rotate: int = 0, max_overlap: float = 0.95,
                 min_overlap_px: int = 50, min_height: int = 50) -> tuple[DataFrame, DataFrame]:
    """Second, neighbour-guided search of weak pairs. ``pairs`` also carry coord and next_coord.

    Only weak pairs reach the pixels: their frames are picked first, then decoded and searched.
    Returns all pairs with accepted replacements, and the judged weak pairs.
    """
    pairs = cut_lineage(pairs)
    plan = cut_lineage(pair_ops.refinement_plan(pair_ops.neighbour_constraints(pairs)))
    needed = plan.select(SAMPLE, F.explode(F.array(F.col("pair_idx"), F.col("pair_idx") + 1)).alias("seq")).distinct()
    cut = align.strips(frames.join(needed, [SAMPLE, "seq"], "left_semi"), axis, rotate, max_overlap)
    judged = cut_lineage(pair_ops.judge_refinement(
        plan.join(align.refine(cut, plan, min_overlap_px, min_height), align.PAIR, "left")))
    taken = judged.filter("accepted").select(*align.PAIR, "new_overlap", "new_y_offset", "new_score", "new_confidence", "new_flags")
    merged = pairs.join(taken, align.PAIR, "left")
    new = lambda c, n: F.coalesce(F.col(n), F.col(c)).alias(c)
    replaced = {"x_overlap": "new_overlap", "y_offset": "new_y_offset", "score": "new_score", "confidence": "new_confidence",
                "flags": "new_flags"}
    return merged.select(*[new(c, replaced[c]) if c in replaced else F.col(c) for c in pairs.columns]), judged


def assemble(frames: DataFrame, pairs: DataFrame, tile: int = 1024, center_rule: bool = True) -> DataFrame:
    """Canvas tiles of every sample. Without the centre rule later frames simply cover earlier ones."""
    placed = canvas.placements(frames.select(SAMPLE, "seq", "width", "height"), pairs)
    return canvas.compose(canvas.cut_pieces(frames, placed, tile, center_rule), tile)


@dataclass(frozen=True)
class GridMosaic:
    """A grid of frames put together in two levels; keys are those of the frames given."""
    frame_pairs: DataFrame    # (sample_id, layer, pair_idx, x_overlap, y_offset, score) inside the layers
    layer_tiles: DataFrame    # canvas tiles of every layer (sample_id, seq, tile_col, ...)
    layer_pairs: DataFrame    # (sample_id, pair_idx, overlap, shift, score, ...) between the layers
    placed: DataFrame         # (sample_id, seq, width, height, x_pos, y_pos) of the layers
    tiles: DataFrame          # canvas tiles of the whole


def grid_mosaic(frames: DataFrame, by: str = "y", search: align.Search = align.Search(), layer_search: align.Search | None = None,
                tile: int = 1024, center_rule: bool = False, at_least: int = 2) -> GridMosaic:
    """Rows (``by="y"``) or columns (``by="x"``) of frames (sample_id, layer, seq, pixels), then the panorama of these.

    Frames of a layer are aligned along it and assembled; layers are numbered 0, 1, ... by ``layer``, those of fewer than
    ``at_least`` frames left out, aligned by their edges and assembled again. Neither level holds a layer in one task.
    Columns are rows of the transposed frames. Every level is stored once.
    """
    if by == "x":
        frames = frame_ops.transpose(frames, [SAMPLE, "layer", "seq"])
    count = frames.groupBy(SAMPLE, "layer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    numbered = cut_lineage(ordered.range_index(count.drop("n"), [SAMPLE], ["layer"], "place"))
    rows = cut_lineage(numbered.withColumn("__row", F.monotonically_increasing_id()))  # stored: the number of a layer in this table
    own = frames.join(rows, [SAMPLE, "layer"]).select(F.col("__row").alias(SAMPLE), "seq", "width", "height", "n_channels", "data")
    found = cut_lineage(align.find_alignments(align.strips(own, max_overlap=search.max_overlap), search))
    placed = cut_lineage(canvas.placements(own.select(SAMPLE, "seq", "width", "height"), found))
    tiles = cut_lineage(canvas.compose(canvas.cut_pieces(own, placed, tile, center_rule), tile))
    back = rows.withColumnRenamed(SAMPLE, "__sample")
    home = lambda df: df.join(back, df[SAMPLE] == back["__row"]).drop(SAMPLE, "__row").withColumnRenamed("__sample", SAMPLE)
    layer_tiles = cut_lineage(home(tiles).drop("layer").withColumnRenamed("place", "seq"))
    meta = cut_lineage(home(canvas.extents(placed)).select(SAMPLE, F.col("place").alias("seq"), F.col("canvas_w").cast("int").alias("width"), F.col("canvas_h").cast("int").alias("height")))
    layer_pairs = cut_lineage(layer_ops.align_layers(layer_tiles, meta, layer_search or search, tile))
    stacked = cut_lineage(layer_ops.place_layers(meta, layer_pairs))
    whole = layer_ops.compose_layers(layer_tiles, stacked, tile)
    frame_pairs = home(found).drop("place").select(SAMPLE, "layer", "pair_idx", "x_overlap", "y_offset", "score")
    return GridMosaic(frame_pairs, layer_tiles, layer_pairs, stacked, layer_ops.transposed_tiles(whole) if by == "x" else whole)


@dataclass(frozen=True)
class TreeMosaic:
    plan: DataFrame           # (sample_id, level, node, left, right, x_overlap, y_offset, score, action); left and right are the frames that meet
    placed: DataFrame         # (sample_id, seq, width, height, x_pos, y_pos) of the frames that are in the picture
    tiles: DataFrame          # its canvas tiles


def merge_by_tree(frames: DataFrame, search: align.Search = align.Search(), min_score: float = 0.1, axis: str = "x", rotate: int = 0, tile: int = 1024,
                  center_rule: bool = False) -> TreeMosaic:
    """Neighbours are merged two by two, level by level, until a sample is one picture; where a merge fails its right half is left out.

    What two halves have in common lies between the last frame that is left in one and the first of the other, so a merge
    looks at the edges of these two, which are cut and stored once. A level has half the pairs of the one before; their number
    of rounds is the logarithm of the longest sample. The final positions are running sums over the frames that are left.
    """
    edges = cut_lineage(align.edge_strips(frames, axis, rotate, search.max_overlap))
    nodes = cut_lineage(frames.select(SAMPLE, F.col("seq").alias("node"), F.col("seq").alias("first"), F.col("seq").alias("last")))
    longest, plan, level = nodes.agg(F.max("node")).first()[0] or 0, None, 0
    while longest >> level:
        level += 1
        half = lambda side: F.max(F.when(F.col("node") % 2 == side, F.struct("first", "last")))
        both = cut_lineage(nodes.groupBy(SAMPLE, F.floor(F.col("node") / 2).cast("bigint").alias("pair_idx")).agg(half(0).alias("l"), half(1).alias("r")))
        meet = both.filter("r is not null").select(*align.PAIR, F.explode(F.array(
            F.struct(F.col("l.last").alias("seq"), F.lit(0).alias("side")), F.struct(F.col("r.first").alias("seq"), F.lit(1).alias("side")))).alias("m"))
        cut = edges.join(meet.select(*align.PAIR, "m.seq", "m.side"), [SAMPLE, "seq", "side"])
        found = align.find_alignments(align.paired(cut), search).select(*align.PAIR, "x_overlap", "y_offset", "score")
        good = F.coalesce(F.col("score") >= min_score, F.lit(False))
        action = F.when(F.col("r").isNull(), "carry").when(good, "merge").otherwise("keep_left")
        merged = cut_lineage(both.join(found, align.PAIR, "left").withColumn("action", action))
        rows = merged.select(SAMPLE, F.lit(level).alias("level"), F.col("pair_idx").alias("node"), F.col("l.last").alias("left"), F.col("r.first").alias("right"),
                             "x_overlap", "y_offset", "score", "action")
        plan = rows if plan is None else plan.unionByName(rows)
        nodes = merged.select(SAMPLE, F.col("pair_idx").alias("node"), F.col("l.first").alias("first"),
                              F.when(F.col("action") == "merge", F.col("r.last")).otherwise(F.col("l.last")).alias("last"))
    members = frames.select(SAMPLE, "seq", "width", "height")
    if plan is None:  # samples of one frame, or none
        plan = nodes.select(SAMPLE, *[F.lit(None).cast(k).alias(c) for c, k in (
            ("level", "int"), ("node", "long"), ("left", "long"), ("right", "long"), ("x_overlap", "int"), ("y_offset", "int"), ("score", "double"), ("action", "string"))]).limit(0)
    plan = cut_lineage(plan)
    # frames that are left, numbered anew; a frame's merge says where it lies against the one before
    left = cut_lineage(ordered.range_index(select.tree_survivors(members, SAMPLE, "seq", plan), [SAMPLE], ["seq"], "place"))
    steps = plan.filter("action = 'merge'").select(SAMPLE, F.col("right").alias("seq"), "x_overlap", "y_offset").join(left.select(SAMPLE, "seq", "place"), [SAMPLE, "seq"])
    turn = turned_meta(left, axis, rotate).withColumn("was", F.col("seq")).withColumn("seq", F.col("place"))
    placed = cut_lineage(canvas.placements(turn.select(SAMPLE, "seq", "was", "width", "height"), steps.select(
        SAMPLE, (F.col("place") - 1).alias("pair_idx"), "x_overlap", "y_offset"), accumulate_y=True))
    turned = frames if not geometry.rotations(axis, rotate) else frame_ops.rotate(frames, [SAMPLE, "seq"], geometry.rotations(axis, rotate))
    kept = turned.join(placed.select(SAMPLE, F.col("was").alias("seq"), F.col("seq").alias("place")), [SAMPLE, "seq"])
    pieces = canvas.cut_pieces(kept.select(SAMPLE, F.col("place").alias("seq"), "width", "height", "n_channels", "data"), placed, tile, center_rule)
    return TreeMosaic(plan, placed.select(SAMPLE, F.col("was").alias("seq"), "width", "height", "x_pos", "y_pos"), canvas.compose(pieces, tile))


def gap_report(gaps: DataFrame) -> DataFrame:
    """Every gap with its sample's gap statistics and whether it is unusual."""
    return sequence.unusual(gaps, "gap_size", [SAMPLE])


def offset_report(pairs: DataFrame) -> DataFrame:
    return sequence.unusual(pairs.withColumn("shift", F.abs("y_offset")), "shift", [SAMPLE])


def alignment_document(frames_meta: DataFrame, pairs: DataFrame, axis: str, rotate: int, created: Column,
                       timings: DataFrame | None = None) -> DataFrame:
    """Alignment documents as rows of JSON: (sample_id, part, number, document), the same form at every size.

    A sample has one ``header`` (metadata, parameters, timing, final canvas), one ``image`` per frame and one ``pair`` per
    alignment, numbered along the scan. Sizes are given after the turn of the scan axis. ``timings``: sample_id,
    category, seconds.
    """
    w, h = (F.col("height"), F.col("width")) if axis == "y" else (F.col("width"), F.col("height"))
    meta = frames_meta.withColumns({"__w": w, "__h": h}).withColumns({"width": F.col("__w"), "height": F.col("__h")}).drop("__w", "__h")
    placed = cut_lineage(canvas.placements(meta, pairs))
    rows = lambda df, part, number, what: df.select(
        SAMPLE, F.lit(part).alias("part"), number.cast("bigint").alias("number"), F.to_json(what).alias("document"))
    images = rows(placed, "image", F.col("seq"), F.struct(
        F.col("seq").alias("index"), F.col("name").alias("filename"), "path", "width", "height",
        F.col("x_pos").alias("final_x_position"), F.col("y_pos").alias("final_y_position")))
    named = (pairs.join(placed.select(SAMPLE, F.col("seq").alias("pair_idx"), F.col("name").alias("image1")), [SAMPLE, "pair_idx"])
             .join(placed.select(SAMPLE, (F.col("seq") - 1).alias("pair_idx"), F.col("name").alias("image2")), [SAMPLE, "pair_idx"]))
    aligned = rows(named, "pair", F.col("pair_idx"), F.struct(
        F.col("pair_idx").alias("pair_index"), F.col("pair_idx").alias("image1_index"), (F.col("pair_idx") + 1).alias("image2_index"),
        F.col("image1").alias("image1_filename"), F.col("image2").alias("image2_filename"), "x_overlap", "y_offset", "score", "confidence",
        F.col("flags").alias("outlier_flags")))
    header = canvas.extents(placed).join(placed.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("num_images")), SAMPLE)
    timing = None
    if timings is not None:  # a sample has few categories
        sums = timings.groupBy(SAMPLE, "category").agg(F.count(F.lit(1)).alias("count"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"),
                                                       F.min("seconds").alias("min"), F.max("seconds").alias("max"))
        per = sums.groupBy(SAMPLE).agg(F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("category", F.struct("count", "total", "mean", "min", "max"))))).alias("timing"))
        header, timing = header.join(per, SAMPLE, "left"), F.col("timing")
    turn = lambda k: F.lit(rotate == k)
    heads = rows(header, "header", F.lit(0), F.struct(
        F.struct(created.alias("created"), F.lit("1.0").alias("version")).alias("metadata"),
        F.struct(F.lit(axis).alias("axis"), turn(180).alias("rotate_180"), turn(90).alias("rotate_90"),
                 turn(270).alias("rotate_270"), "num_images").alias("parameters"),
        *([] if timing is None else [timing.alias("timing")]),
        F.struct(F.col("canvas_w").alias("width"), F.col("canvas_h").alias("height"), F.col("min_y").alias("min_y_offset"))
        .alias("final_canvas")))
    return heads.unionByName(images).unionByName(aligned)


def annotations(placed: DataFrame, pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """Boxes of the debug picture as rows: a boundary per frame and an overlap per pair, with labels and colour class."""
    low_y = canvas.extents(placed).select(SAMPLE, "min_y")
    box = lambda v: (v * F.lit(float(scale))).cast("int")
    with_y = placed.join(low_y, SAMPLE)
    s = names.stem(F.col("name"))
    short = F.coalesce(F.nullif(F.regexp_extract(s, r"(?i)[YX]\d+", 0), F.lit("")), F.substring(s, 1, 12))
    top = F.col("y_pos") - F.col("min_y")
    frames = with_y.select(
        SAMPLE, F.lit("boundary").alias("kind"), F.col("seq").alias("number"), box(F.col("x_pos")).alias("x1"),
        box(F.col("x_pos") + F.col("width")).alias("x2"), box(top).alias("y1"), box(top + F.col("height")).alias("y2"),
        F.concat(F.lit("#"), F.col("seq").cast("string"), F.lit(" "), short).alias("label"), F.lit("boundary").alias("color_class"))
    both = ordered.with_neighbours(with_y, [SAMPLE], "seq", lambda win: {
        "nx": F.lead("x_pos").over(win), "ny": F.lead("y_pos").over(win), "nh": F.lead("height").over(win)}, after=1)
    end = F.col("x_pos") + F.col("width")
    overlap = both.drop("x_overlap", "y_offset").join(
        pairs.select(SAMPLE, F.col("pair_idx").alias("seq"), "x_overlap", "y_offset", "score", "confidence"), [SAMPLE, "seq"]
    ).filter((F.col("x_overlap") > 0) & (F.col("nx") < end))
    label = F.concat_ws(" ", F.concat(F.lit("P"), (F.col("seq") + 1).cast("string")),
                        F.concat(F.col("x_overlap").cast("string"), F.lit("px")),
                        F.concat(F.lit("y="), F.col("y_offset").cast("string")), bands.fixed(F.col("score"), 3),
                        F.substring("confidence", 1, 1))
    colour = F.when(F.col("confidence") == "HIGH", "high").when(F.col("confidence") == "MEDIUM", "medium").otherwise("low")
    pair_boxes = overlap.select(
        SAMPLE, F.lit("overlap").alias("kind"), F.col("seq").alias("number"), box(F.col("nx")).alias("x1"), box(end).alias("x2"),
        box(F.greatest("y_pos", "ny") - F.col("min_y")).alias("y1"),
        box(F.least(F.col("y_pos") + F.col("height"), F.col("ny") + F.col("nh")) - F.col("min_y")).alias("y2"),
        label.alias("label"), colour.alias("color_class"))
    return frames.unionByName(pair_boxes)


def manual_score(frames: DataFrame, offsets: DataFrame, axis: str = "x", rotate: int = 0, min_height: int = 10) -> DataFrame:
    """Correlation at user-given offsets with its band."""
    scored = align.score_at(align.strips(frames, axis, rotate, 1.0), offsets, min_height)
    return scored.withColumn("band", bands.manual_band(F.col("score")))


def turned_meta(meta: DataFrame, axis: str, rotate: int) -> DataFrame:
    """Widths and heights as they are once frames stand upright."""
    w, h = turned_size(F.col("width"), F.col("height"), axis, rotate)
    return meta.withColumns({"__w": w, "__h": h}).withColumns({"width": F.col("__w"), "height": F.col("__h")}).drop("__w", "__h")


def turned_size(width: Column, height: Column, axis: str, rotate: int) -> tuple[Column, Column]:
    _, _, w, h = geometry.rotate_point(F.lit(0), F.lit(0), width, height, geometry.rotations(axis, rotate))
    return w, h
