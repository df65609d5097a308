"""Pixels: focus, channels, colour, marks, hot tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanframe.functions import color
from scanframe.operators import channels, components, focus, frames as frame_ops, hot, marks
from scanframe.plans import imaging
from suite import fixtures as fx
from suite.registry import query
from suite.views import sql

KEY = ["frame_id"]
REFLECT = "CASE WHEN {v} < 0 THEN -({v}) WHEN {v} >= {n} THEN 2 * ({n} - 1) - ({v}) ELSE {v} END"


def _mirror(v: str, n: str) -> str:
    return REFLECT.format(v=v, n=n)


def blur_cte(src: str) -> str:
    """Blurred plane of regions (frame_id, rid, y, x, h, w, g)."""
    return f"""SELECT a.frame_id, a.rid, a.y, a.x, a.h, a.w, ((sum(k.wt * b.g) + 8) // 16)::INTEGER AS g
      FROM {src} a, (SELECT dy, dx, (2 - abs(dy)) * (2 - abs(dx)) AS wt FROM (SELECT unnest(range(-1, 2)) AS dy),
        (SELECT unnest(range(-1, 2)) AS dx)) k, {src} b
      WHERE b.frame_id = a.frame_id AND b.rid = a.rid AND b.y = {_mirror('a.y + k.dy', 'a.h')}
        AND b.x = {_mirror('a.x + k.dx', 'a.w')} GROUP BY ALL"""


def lap_cte(src: str, ksize: int) -> str:
    if ksize == 3:
        kernel = """SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN -8 WHEN dy <> 0 AND dx <> 0 THEN 2 ELSE 0 END AS wt
          FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)"""
    else:
        kernel = """SELECT dy, dx, ([1, 2, -1, -4, -1, 2, 1])[dx + 4] * ([1, 6, 15, 20, 15, 6, 1])[dy + 4]
          + ([1, 6, 15, 20, 15, 6, 1])[dx + 4] * ([1, 2, -1, -4, -1, 2, 1])[dy + 4] AS wt
          FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)"""
    return f"""SELECT a.frame_id, a.rid, a.y, a.x, abs(sum(k.wt * b.g))::BIGINT AS v FROM {src} a, ({kernel}) k, {src} b
      WHERE b.frame_id = a.frame_id AND b.rid = a.rid AND b.y = {_mirror('a.y + k.dy', 'a.h')}
        AND b.x = {_mirror('a.x + k.dx', 'a.w')} GROUP BY ALL"""


SCORE = "0.5 * ((sum(v * v)::DOUBLE / count(*) - (sum(v)::DOUBLE / count(*)) ^ 2) + quantile_cont(v, 0.9))"
WHOLE = "SELECT frame_id, 0 AS rid, y, x, 8 AS h, 8 AS w, g FROM fx_px"
TILE4 = "SELECT frame_id, (y // 4) * 2 + x // 4 AS rid, y % 4 AS y, x % 4 AS x, 4 AS h, 4 AS w, g FROM blurred"
QUAD = "SELECT frame_id, (y // 4) * 2 + x // 4 AS rid, y % 4 AS y, x % 4 AS x, 4 AS h, 4 AS w, g FROM fx_px"
QNAME = "(['Top Left', 'Top Right', 'Bottom Left', 'Bottom Right'])[rid + 1]"
TILE_CTES = {"whole": WHOLE, "blurred": blur_cte("whole"), "cut": TILE4, "lap": lap_cte("cut", 3),
             "scored": f"SELECT frame_id, rid, (rid % 2 * 4)::INTEGER AS x, (rid // 2 * 4)::INTEGER AS y, {SCORE} AS score FROM lap GROUP BY 1, 2"}
GRAY = "((9798 * r + 19235 * g + 3735 * b + 16384) >> 15)::INTEGER"


def quad_ctes(source: str = QUAD, ksize: int = 7) -> dict[str, str]:
    return {"whole": source, "blurred": blur_cte("whole"), "lap": lap_cte("blurred", ksize),
            "scored": f"SELECT frame_id, rid, {QNAME} AS quadrant, {SCORE} AS score FROM lap GROUP BY 1, 2"}


@query("focus_tiles_top", "A1 K1 J8 P18 C1 F6", sql("""
SELECT frame_id, x, y, 'hard' AS band, round(score, 6) AS score FROM (SELECT *,
  row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, y, x) AS rk FROM scored) WHERE rk <= 2""",
  "fx_px", **TILE_CTES))
def focus_tiles_top(spark, sf):
    tiles = imaging.focus_tiles(fx.frames_gray(spark, sf), KEY, tile=4, stride=4, top_percent=0.5, min_score=None,
                                soft_min=None)
    return tiles.select("frame_id", "x", "y", "band", F.round("score", 6).alias("score"))


@query("tile_scores_whole", "A1", sql(f"SELECT frame_id, count(*) AS n, sum(v)::BIGINT AS s1, sum(v * v)::BIGINT AS s2, "
                                      f"quantile_cont(v, 0.9) AS p90, round({SCORE} * 81920) AS score_x81920 FROM lap GROUP BY 1",
                                      "fx_px", whole=WHOLE, blurred=blur_cte("whole"), lap=lap_cte("blurred", 3)))
def tile_scores_whole(spark, sf):
    return focus.tile_scores(fx.frames_gray(spark, sf), KEY, 8, 8).select(
        # 64 pixels and a percentile in tenths: times 81920 the score is whole, so rounding meets no ties
        "frame_id", "n", "s1", "s2", "p90", F.round(F.col("score") * 81920).alias("score_x81920"))


@query("focus_tiles_bands", "P32 P33 P16 P14 J4 A13", sql("""
SELECT frame_id, x, y, CASE WHEN score >= 900 THEN 'hard' ELSE 'soft' END AS band, round(score, 6) AS score
FROM scored WHERE score >= 400 AND x >= 2 AND NOT (x = 4 AND y = 4)""", "fx_px", **TILE_CTES))
def focus_tiles_bands(spark, sf):
    gray = fx.frames_gray(spark, sf)
    bad = gray.select(F.col("width").alias("grid_w"), F.col("height").alias("grid_h")).distinct().select(
        "*", F.lit(1).alias("col"), F.lit(1).alias("row"))
    tiles = imaging.focus_tiles(gray, KEY, tile=4, stride=4, min_score=900.0, soft_min=400.0,
                                margins=(0.25, 0.0, 0.0, 0.0), hot_tiles=bad)
    return tiles.select("frame_id", "x", "y", "band", F.round("score", 6).alias("score"))


@query("focus_counts", "A13 P33", sql("""
SELECT frame_id, count(*) FILTER (score < 400) AS hard, count(*) FILTER (score >= 400) AS soft FROM (SELECT *,
  row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, y, x) AS rk FROM scored) WHERE rk <= 3 GROUP BY 1""",
  "fx_px", **TILE_CTES))
def focus_counts(spark, sf):
    # without a hard threshold the second split turns every tile from the soft threshold up into a soft one
    tiles = imaging.focus_tiles(fx.frames_gray(spark, sf), KEY, tile=4, stride=4, min_score=None, soft_min=400.0,
                                top_percent=0.75)
    return imaging.focus_counts(tiles, KEY)


@query("frame_focus", "A2 K11 C2 P36", sql("""
SELECT frame_id, round(avg(score), 6) AS score, first(quadrant ORDER BY score DESC, rid) AS best_quadrant,
  round(max(score), 6) AS best_score, round(max(score) FILTER (rid = 0), 6) AS top_left FROM scored GROUP BY 1""",
  "fx_px", **quad_ctes()))
def frame_focus(spark, sf):
    return imaging.frame_focus(fx.frames_gray(spark, sf), KEY).select(
        "frame_id", F.round("score", 6).alias("score"), F.col("best.quadrant").alias("best_quadrant"),
        F.round("best.score", 6).alias("best_score"), F.round(F.col("quadrants")["Top Left"], 6).alias("top_left"))


@query("quadrant_focus_color", "A2 P21", sql("""
SELECT frame_id, quadrant, round(score, 6) AS score FROM scored""", "fx_rgb",
  **quad_ctes(f"SELECT frame_id, (y // 4) * 2 + x // 4 AS rid, y % 4 AS y, x % 4 AS x, 4 AS h, 4 AS w, {GRAY} AS g FROM fx_rgb", 3)))
def quadrant_focus_color(spark, sf):
    return focus.quadrant_scores(fx.frames_rgb(spark, sf), KEY, 3).select("frame_id", "quadrant",
                                                                         F.round("score", 6).alias("score"))


@query("compare_focus", "C32 A34", sql("""
SELECT pair, quadrant, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, CASE WHEN best_a > best_b THEN 'a'
  WHEN best_b > best_a THEN 'b' ELSE 'same' END AS sharper,
  round((greatest(best_a, best_b) - least(best_a, best_b)) / least(best_a, best_b) * 100, 6) AS difference_pct
FROM (SELECT frame_id // 2 AS pair, quadrant, max(score) FILTER (frame_id % 2 = 0) AS score_a,
  max(score) FILTER (frame_id % 2 = 1) AS score_b FROM scored GROUP BY 1, 2)
JOIN (SELECT frame_id // 2 AS pair, max(score) FILTER (frame_id % 2 = 0) AS best_a,
  max(score) FILTER (frame_id % 2 = 1) AS best_b FROM scored GROUP BY 1) USING (pair)""", "fx_px", **quad_ctes(QUAD, 3)))
def compare_focus(spark, sf):
    f = F.col("frame_id")
    both = imaging.compare_focus(fx.frames_gray(spark, sf), f % 2 == 0, f % 2 == 1, F.floor(f / 2).cast("bigint"), KEY)
    return both.select("pair", "quadrant", "sharper", *[F.round(c, 6).alias(c) for c in ("score_a", "score_b", "difference_pct")])


@query("laplacian_histogram", "A5", sql(f"""
SELECT frame_id, {QNAME} AS quadrant, least(v, 255)::INTEGER AS bin, count(*) AS n FROM lap WHERE v <= 256 GROUP BY 1, 2, 3""",
  "fx_px", **{k: v for k, v in quad_ctes(QUAD, 3).items() if k != "scored"}))
def laplacian_histogram(spark, sf):
    return focus.laplacian_histogram(fx.frames_gray(spark, sf), KEY)


CHANNELS = ("SELECT frame_id, y, x, c.channel, CASE c.channel WHEN 'r' THEN r WHEN 'g' THEN g ELSE b END AS v FROM fx_rgb, "
            "(SELECT unnest(['r', 'g', 'b']) AS channel) c")


@query("channel_stats", "A3 A10", sql("""
SELECT frame_id, channel, round(avg(v), 6) AS mean, quantile_cont(v, 0.5)::DOUBLE AS median, round(stddev_pop(v), 6) AS std,
  min(v) AS min, max(v) AS max FROM ch GROUP BY 1, 2""", "fx_rgb", ch=CHANNELS))
def channel_stats(spark, sf):
    stats = channels.channel_stats(fx.frames_rgb(spark, sf), KEY)
    return stats.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("channel_histogram", "A4", sql("""
SELECT f.frame_id, f.channel, v.v AS value, count(ch.v) AS n FROM (SELECT DISTINCT frame_id, channel FROM ch) f
CROSS JOIN (SELECT unnest(range(256))::INTEGER AS v) v LEFT JOIN ch ON ch.frame_id = f.frame_id AND ch.channel = f.channel
  AND ch.v = v.v GROUP BY 1, 2, 3""", "fx_rgb", ch=CHANNELS))
def channel_histogram(spark, sf):
    return channels.channel_histogram(fx.frames_rgb(spark, sf), KEY)


@query("black_frames", "P36 A10 P14", sql("""
SELECT frame_id, round(stddev_pop(r), 6) AS std_r, round(stddev_pop(g), 6) AS std_g, round(stddev_pop(b), 6) AS std_b,
  least(stddev_pop(r), stddev_pop(g), stddev_pop(b)) < 15 AS is_black FROM fx_rgb
WHERE x >= 1 AND x < 6 AND y < 6 GROUP BY 1""", "fx_rgb"))
def black_frames(spark, sf):
    # margins .1/.3/.05/.2 of 8 pixels round to 1, 2, 0 and 2
    out = channels.black_frames(fx.frames_rgb(spark, sf), KEY, (0.1, 0.3, 0.05, 0.2), 15.0)
    return out.withColumns({c: F.round(c, 6) for c in ("std_r", "std_g", "std_b")})


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


REL_Y = f"(0.2126 * {_lin('r')} + 0.7152 * {_lin('g')} + 0.0722 * {_lin('b')})"
LSTAR = f"(116.0 * (CASE WHEN {REL_Y} > 216.0::DOUBLE / 24389 THEN cbrt({REL_Y}) ELSE {REL_Y} * (841.0::DOUBLE / 108) + 4.0::DOUBLE / 29 END) - 16)"
HSV = """SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h FROM (SELECT *, mx AS v,
  floor(((mx - mn) * CASE WHEN mx = 0 THEN 0 ELSE round_even(1044480.0::DOUBLE / mx, 0) END + 2048) / 4096.0::DOUBLE)::INTEGER AS s,
  floor(((CASE WHEN mx = r THEN g - b WHEN mx = g THEN b - r + 2 * (mx - mn) ELSE r - g + 4 * (mx - mn) END)
    * CASE WHEN mx = mn THEN 0 ELSE round_even(737280.0::DOUBLE / (6 * (mx - mn)), 0) END + 2048) / 4096.0::DOUBLE)::INTEGER AS h0
  FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM fx_rgb))"""


@query("pixel_colors", "P21 P22 P24", sql(f"""
SELECT frame_id, y, x, trunc(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::INTEGER AS gray, {GRAY} AS gray_rounded,
  h, s, v, round({REL_Y}, 6) AS rel_y, round({LSTAR}, 6) AS lstar FROM hsv""", "fx_rgb", hsv=HSV))
def pixel_colors(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    h, s, v = color.hsv(r, g, b)
    rel = color.relative_luminance(r, g, b)
    return fx.rgb(spark, sf).select(
        "frame_id", "y", "x", color.gray_truncated(r, g, b).alias("gray"), color.gray_rounded(r, g, b).alias("gray_rounded"),
        h.alias("h"), s.alias("s"), v.alias("v"), F.round(rel, 6).alias("rel_y"), F.round(color.lightness(rel), 6).alias("lstar"))


@query("average_color", "A6 A9 P23 C3", sql("""
SELECT frame_id, round_even(avg(r), 0)::INTEGER AS r, round_even(avg(g), 0)::INTEGER AS g, round_even(avg(b), 0)::INTEGER AS b,
  round_even(0.299 * avg(r) + 0.587 * avg(g) + 0.114 * avg(b), 0)::INTEGER AS ylum FROM fx_rgb
WHERE x >= 2 AND x < 8 AND y < 5 GROUP BY 1""", "fx_rgb"))
def average_color(spark, sf):
    return imaging.frame_color(fx.frames_rgb(spark, sf), KEY, roi=(2, -3, 40, 8))


@query("average_color_luma709", "A6 P23", sql("""
SELECT frame_id, round(avg(b), 6) AS b, round(avg(g), 6) AS g, round(avg(r), 6) AS r,
  round((0.2126 * avg(r) + 0.7152 * avg(g) + 0.0722 * avg(b)) * 64, 4) AS ylum_x64 FROM fx_rgb GROUP BY 1""", "fx_rgb"))
def average_color_luma709(spark, sf):
    out = imaging.frame_color(fx.frames_rgb(spark, sf), KEY, space="BGR", y_method="luma709", as_int=False)
    # 64 pixels and 4-decimal weights: times 64 the value has 4 decimals, so rounding meets no ties
    return out.select("frame_id", *[F.round(c, 6).alias(c) for c in ("r", "g", "b")],
                      F.round(F.col("ylum") * 64, 4).alias("ylum_x64"))


@query("average_color_hsv", "A7 A8 P24", sql(f"""
SELECT frame_id, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END * 180 / (2 * pi()), 5) AS h, round(s, 6) AS s,
  round(v, 6) AS v, round(y, 6) AS ylum FROM (SELECT frame_id, atan2(avg(sin(h * (2 * pi() / 180))), avg(cos(h * (2 * pi() / 180)))) AS a,
  avg(s) AS s, avg(v) AS v, avg({REL_Y}) AS y FROM hsv GROUP BY 1)""", "fx_rgb", hsv=HSV))
def average_color_hsv(spark, sf):
    out = imaging.frame_color(fx.frames_rgb(spark, sf), KEY, space="HSV", y_method="relY_linear", as_int=False)
    return out.select("frame_id", F.round("h", 5).alias("h"), *[F.round(c, 6).alias(c) for c in ("s", "v", "ylum")])


@query("average_color_lab", "A8 A9 P22", sql(f"""
SELECT frame_id, round_even(avg(r), 0)::INTEGER AS r, round_even(avg(g), 0)::INTEGER AS g, round_even(avg(b), 0)::INTEGER AS b,
  round_even(avg({LSTAR}) * (255.0::DOUBLE / 100), 0)::INTEGER AS ylum FROM fx_rgb GROUP BY 1""", "fx_rgb"))
def average_color_lab(spark, sf):
    return imaging.frame_color(fx.frames_rgb(spark, sf), KEY, y_method="LabLstar")


@query("resize_half", "C27 P19", sql("""
SELECT frame_id, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, round_even(avg(g), 0)::INTEGER AS g FROM fx_px GROUP BY 1, 2, 3""", "fx_px"))
def resize_half(spark, sf):
    small = frame_ops.resize(fx.frames_gray(spark, sf), KEY, 0.5)
    return frame_ops.pixels(small, KEY).select("frame_id", "y", "x", "g")


@query("resize_double", "C27", sql("""
SELECT frame_id, oy AS y, ox AS x, round_even(round(sum(g * wy * wx), 9), 0)::INTEGER AS g FROM (
  SELECT p.frame_id, o.o AS oy, q.o AS ox, p.g, greatest(0, 1 - abs(least(greatest(o.o / 2.0::DOUBLE - 0.25, 0), 7) - p.y)) AS wy,
    greatest(0, 1 - abs(least(greatest(q.o / 2.0::DOUBLE - 0.25, 0), 7) - p.x)) AS wx
  FROM fx_px p, (SELECT unnest(range(16))::INTEGER AS o) o, (SELECT unnest(range(16))::INTEGER AS o) q
  WHERE abs(o.o / 2.0 - 0.25 - p.y) <= 1 AND abs(q.o / 2.0 - 0.25 - p.x) <= 1) WHERE wy * wx > 0 GROUP BY 1, 2, 3""", "fx_px"))
def resize_double(spark, sf):
    large = frame_ops.resize(fx.frames_gray(spark, sf), KEY, 2.0)
    return frame_ops.pixels(large, KEY).select("frame_id", "y", "x", "g")


RED = {
    "iso": "SELECT frame_id, y, x, greatest(0, least(255, r - greatest(g, b))) AS v FROM fx_rgb",
    "scaled": """SELECT frame_id, y, x, CASE WHEN m > 0 THEN trunc(v / m::DOUBLE * 255.0::DOUBLE)::INTEGER ELSE v END AS v
      FROM (SELECT *, max(v) OVER (PARTITION BY frame_id) AS m FROM iso)""",
    "cross5": "SELECT unnest([0, 1, -1, 0, 0]) AS dy, unnest([0, 0, 0, 1, -1]) AS dx",
    "dilated": """SELECT a.frame_id, a.y, a.x, max(b.v) AS v FROM scaled a, cross5 k, scaled b WHERE b.frame_id = a.frame_id
      AND b.y = a.y + k.dy AND b.x = a.x + k.dx GROUP BY 1, 2, 3""",
    "closed": """SELECT a.frame_id, a.y, a.x, min(b.v) AS v FROM dilated a, cross5 k, dilated b WHERE b.frame_id = a.frame_id
      AND b.y = a.y + k.dy AND b.x = a.x + k.dx GROUP BY 1, 2, 3""",
    "limits": """SELECT frame_id, coalesce(quantile_cont(v, 0.75) FILTER (v > 0), 50)::DOUBLE AS threshold,
      count(*) FILTER (v > 0) AS n_positive FROM closed GROUP BY 1""",
}
COMPONENTS = {
    **RED,
    "masked": "SELECT c.frame_id, c.y, c.x, c.y * 8 + c.x AS p FROM closed c JOIN limits l USING (frame_id) WHERE c.v > l.threshold",
    "reach": """SELECT frame_id, p, p AS q FROM masked UNION SELECT r.frame_id, r.p, n.p FROM reach r
      JOIN masked m ON m.frame_id = r.frame_id AND m.p = r.q JOIN masked n ON n.frame_id = r.frame_id
      AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1""",
    "labelled": "SELECT frame_id, p, min(q)::BIGINT AS component FROM reach GROUP BY 1, 2",
    "comps": """SELECT frame_id, component, count(*) AS area, min(x)::INTEGER AS x, min(y)::INTEGER AS y,
      (max(x) - min(x) + 1)::INTEGER AS w, (max(y) - min(y) + 1)::INTEGER AS h, avg(x) AS cx, avg(y) AS cy
      FROM labelled JOIN masked USING (frame_id, p) GROUP BY 1, 2""",
}
COMPS_OUT = "SELECT frame_id, component, area, x, y, w, h, round(cx, 6) AS cx, round(cy, 6) AS cy FROM comps"


@query("red_isolation", "P25 C9", sql("SELECT frame_id, y, x, v FROM closed", "fx_rgb", **{k: RED[k] for k in list(RED)[:5]}))
def red_isolation(spark, sf):
    plane = frame_ops.map_frames(fx.frames_rgb(spark, sf), KEY, "width int, height int, n_channels int, data binary",
                                 lambda img, _: [(img.shape[1], img.shape[0], 1, marks.red_plane(img).tobytes())])
    return frame_ops.pixels(plane, KEY).select("frame_id", "y", "x", F.col("r").alias("v"))


@query("red_pixels", "P25 P26", sql("""
SELECT frame_id, y, x, v AS isolated, red, CASE WHEN lo = hi THEN 0 ELSE trunc((red - lo) / (hi - lo)::DOUBLE * 255.0::DOUBLE)::INTEGER END AS norm
FROM (SELECT *, min(red) OVER (PARTITION BY frame_id) AS lo, max(red) OVER (PARTITION BY frame_id) AS hi FROM (
  SELECT s.frame_id, s.y, s.x, s.v, greatest(0, r - (g + b)) AS red FROM scaled s JOIN fx_rgb USING (frame_id, y, x)))""",
  "fx_rgb", iso=RED["iso"], scaled=RED["scaled"]))
def red_pixels(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    cells = fx.rgb(spark, sf).select("frame_id", "y", "x", color.red_isolation(r, g, b).alias("iso"),
                                     color.red_dominance(r, g, b).alias("red"))
    limits = cells.groupBy("frame_id").agg(F.max("iso").alias("m"), F.min("red").alias("lo"), F.max("red").alias("hi"))
    return cells.join(limits, "frame_id").select(
        "frame_id", "y", "x", color.red_scaled(F.col("iso"), F.col("m")).alias("isolated"), "red",
        color.min_max_255(F.col("red"), F.col("lo"), F.col("hi")).alias("norm"))


@query("red_threshold", "A17", sql("SELECT frame_id, round(threshold, 6) AS threshold, n_positive FROM limits", "fx_rgb", **RED))
def red_threshold(spark, sf):
    return marks.red_thresholds(fx.frames_rgb(spark, sf), KEY).withColumn("threshold", F.round("threshold", 6))


@query("components_tiled", "C10 A18", sql(COMPS_OUT, "fx_rgb", recursive=True, **COMPONENTS))
def components_tiled(spark, sf):
    # 3-pixel tiles: most components cross several tile borders
    out = components.components(marks.red_masks(fx.frames_rgb(spark, sf), KEY, tile=3), KEY)
    return out.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


MARKS = {**COMPONENTS, "shaped": """SELECT *, cy >= 4 AS lower FROM comps WHERE area > 1 AND area < 10000
  AND least(w, h) > 0 AND greatest(w, h) < 3.0 * least(w, h)""",
         "graded": """SELECT *, CASE WHEN NOT lower THEN 'upper_half' WHEN n > 3 AND NOT (cx BETWEEN q1 - 1.5 * (q3 - q1)
  AND q3 + 1.5 * (q3 - q1)) THEN 'outlier' ELSE 'valid' END AS status FROM (SELECT *,
  quantile_cont(cx, 0.25) FILTER (lower) OVER (PARTITION BY frame_id) AS q1,
  quantile_cont(cx, 0.75) FILTER (lower) OVER (PARTITION BY frame_id) AS q3,
  count(*) FILTER (lower) OVER (PARTITION BY frame_id) AS n FROM shaped)"""}


def _marks(spark, sf):
    return imaging.registration_marks(fx.frames_rgb(spark, sf), KEY, min_area=1)


@query("registration_marks", "C8 P37 P38 A18 A20", sql("""
SELECT frame_id, component, area, x, y, w, h, round(cx, 6) AS cx, round(cy, 6) AS cy, status FROM graded""", "fx_rgb",
  recursive=True, **MARKS))
def registration_marks(spark, sf):
    return _marks(spark, sf).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query("mark_summary", "A19 U5", sql("""
SELECT frame_id, count(*) FILTER (status = 'valid') AS n_valid, count(*) FILTER (status <> 'valid') AS n_rejected,
  round(avg(cx) FILTER (status = 'valid'), 6) AS mean_x FROM graded GROUP BY 1""", "fx_rgb", recursive=True, **MARKS))
def mark_summary(spark, sf):
    found = _marks(spark, sf)
    everything = marks.rejected(found).unionByName(found.filter("status = 'valid'"))
    return marks.summary(everything, KEY).withColumn("mean_x", F.round("mean_x", 6))


@query("detection_lines", "S11", sql(r"""
SELECT 'frame_' || frame_id || ':' || chr(10) || string_agg('  Mark ' || i || ': (' || printf('%.2f', cx) || ', ' || printf('%.2f', cy) || ')',
  chr(10) ORDER BY i) || chr(10) || '  Mean center X: ' || printf('%.2f', avg(cx)) AS value FROM (SELECT *, row_number() OVER
  (PARTITION BY frame_id ORDER BY component) AS i FROM graded WHERE status = 'valid') GROUP BY frame_id""", "fx_rgb",
  recursive=True, **MARKS))
def detection_lines(spark, sf):
    from scanframe.sources import sinks
    found = _marks(spark, sf).filter("status = 'valid'")
    return sinks.detection_text(found, F.concat(F.lit("frame_"), F.col("frame_id")), ["frame_id"], "component")


@query("red_dominance", "C11 A16 P26", sql("""
SELECT frame_id, min(r - (g + b)) AS diff_min, max(r - (g + b)) AS diff_max, count(*) FILTER (r > g + b) AS positive,
  round(count(*) FILTER (r > g + b) / 64.0::DOUBLE * 100, 6) AS positive_pct FROM fx_rgb GROUP BY 1""", "fx_rgb"))
def red_dominance(spark, sf):
    return imaging.red_dominance(fx.frames_rgb(spark, sf), KEY).select(
        "frame_id", "diff_min", "diff_max", "positive", F.round("positive_pct", 6).alias("positive_pct"))


@query("red_projections", "A14", sql("""
SELECT frame_id, 'x' AS axis, x AS position, sum(greatest(0, r - (g + b)))::BIGINT AS total FROM fx_rgb GROUP BY 1, 2, 3
UNION ALL SELECT frame_id, 'y', y, sum(greatest(0, r - (g + b)))::BIGINT FROM fx_rgb GROUP BY 1, 2, 3""", "fx_rgb"))
def red_projections(spark, sf):
    return marks.projections(marks.red_measure(fx.frames_rgb(spark, sf), KEY), KEY)


@query("projection_quartiles", "A15", sql("""
SELECT frame_id, axis, round(quantile_cont(total, 0.25), 6) AS p25, round(quantile_cont(total, 0.5), 6) AS p50,
  round(quantile_cont(total, 0.75), 6) AS p75 FROM (
  SELECT frame_id, 'x' AS axis, x, sum(v) AS total FROM closed GROUP BY 1, 2, 3
  UNION ALL SELECT frame_id, 'y', y, sum(v) FROM closed GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max(total) > 0""",
  "fx_rgb", **{k: RED[k] for k in list(RED)[:5]}))
def projection_quartiles(spark, sf):
    def one(img, _):
        plane = marks.red_plane(img).astype("int64")
        yield plane.sum(0).tolist(), plane.sum(1).tolist()
    sums = frame_ops.map_frames(fx.frames_rgb(spark, sf), KEY, "per_x array<long>, per_y array<long>", one)
    return marks.projection_quartiles(marks.projections(sums, KEY), KEY)


OLD = "SELECT DISTINCT grid_w, grid_h, col, \"row\" FROM fx_tilehits WHERE frame_id % 7 = 0 AND col < 5"
CAND = "SELECT grid_w, grid_h, col, \"row\", count(*) AS hits FROM fx_tilehits GROUP BY ALL HAVING count(*) >= {n}"


def _hot(spark, sf, n=None):
    hits = fx.tile_hits(spark, sf)
    old = hits.filter("frame_id % 7 = 0 and col < 5").select(*hot.TILE).distinct()
    total = hot.candidates(hits, 1 if n is None else n)
    return hits, old, total


@query("hot_candidates", "A11", sql(CAND.format(n=45), "fx_tilehits"))
def hot_candidates(spark, sf):
    return _hot(spark, sf, 45)[2]


@query("hot_update", "U1 U2 U3", sql("""
SELECT grid_w, grid_h, col, "row", bool_and(o = 0) AS is_new FROM (
  SELECT *, 1 AS o FROM old UNION ALL SELECT *, 0 FROM grown) GROUP BY ALL""", "fx_tilehits", old=OLD, cand=CAND.format(n=50),
  grown="""SELECT DISTINCT grid_w, grid_h, col + c AS col, "row" + r AS "row" FROM cand, (SELECT unnest(range(-1, 2))::INTEGER AS c),
  (SELECT unnest(range(-1, 2))::INTEGER AS r)"""))
def hot_update(spark, sf):
    _, old, cand = _hot(spark, sf, 50)
    grown = hot.dilate(cand, 1)
    fresh = hot.newly_marked(old, grown).withColumn("fresh", F.lit(True))
    return hot.update(old, grown).join(fresh, hot.TILE, "left").select(*hot.TILE, F.coalesce("fresh", F.lit(False)).alias("is_new"))


@query("hot_report", "A12", sql("""
SELECT grid_w, grid_h, any_value(f.frames) AS frames, count(*) FILTER (c) AS candidates, count(*) FILTER (c AND NOT o) AS newly_marked,
  count(*) AS total_invalid FROM (SELECT grid_w, grid_h, col, "row", bool_or(o) AS o, bool_or(c) AS c FROM (
  SELECT *, true AS o, false AS c FROM old UNION ALL SELECT grid_w, grid_h, col, "row", false, true FROM cand) GROUP BY ALL)
JOIN (SELECT grid_w, grid_h, count(DISTINCT frame_id) AS frames FROM fx_tilehits GROUP BY ALL) f USING (grid_w, grid_h)
GROUP BY 1, 2""", "fx_tilehits", old=OLD, cand=CAND.format(n=45)))
def hot_report(spark, sf):
    hits, old, _ = _hot(spark, sf)
    return hot.build_report(hits, old, 45, 0)


@query("hot_clear", "U4 A36 J4", sql("""
SELECT grid_w, grid_h, count(*) AS kept, (SELECT count(DISTINCT (col, "row")) FROM old) AS n_positions FROM old
WHERE grid_w <> 1792 GROUP BY 1, 2""", "fx_tilehits", old=OLD))
def hot_clear(spark, sf):
    _, old, _ = _hot(spark, sf)
    kept = hot.clear(old, old.select(*hot.GRID).filter("grid_w = 1792").distinct())
    # the union size is one row by construction, so joining it on a constant is a broadcast of one number
    size = hot.union_size(old).withColumn("one", F.lit(1))
    return (kept.groupBy(*hot.GRID).agg(F.count(F.lit(1)).alias("kept")).withColumn("one", F.lit(1))
            .join(F.broadcast(size), "one").drop("one"))


BGRA = """SELECT frame_id // 4 AS frame_id, y, x, max(g) FILTER (frame_id % 4 = 0) AS b, max(g) FILTER (frame_id % 4 = 1) AS g,
  max(g) FILTER (frame_id % 4 = 2) AS r, greatest(0, least(255, (max(g) FILTER (frame_id % 4 = 3) - 96) * 4)) AS a FROM fx_px GROUP BY 1, 2, 3 HAVING count(*) = 4"""


@query("flatten_alpha", "P27", sql("""
SELECT frame_id, y, x, ((r * a + 255 * (255 - a) + 127) // 255)::INTEGER AS r, ((g * a + 255 * (255 - a) + 127) // 255)::INTEGER AS g,
  ((b * a + 255 * (255 - a) + 127) // 255)::INTEGER AS b FROM bgra""", "fx_px", bgra=BGRA))
def flatten_alpha(spark, sf):
    from scanframe.sources import images
    return frame_ops.pixels(images.flatten_alpha(fx.frames_bgra(spark, sf), KEY), KEY)


@query("frame_tile_store", "S9 P49", sql("""
SELECT kind, sample_id, frame_id, count(*) AS n_pixels, sum(r)::BIGINT AS sum_r, sum(b)::BIGINT AS sum_b FROM (
  SELECT 'gray' AS kind, sample_id, frame_id, g AS r, g AS b FROM fx_px UNION ALL SELECT 'alpha', (frame_id % 5)::INTEGER, frame_id, r, b FROM bgra)
GROUP BY 1, 2, 3""", "fx_px", bgra=BGRA))
def frame_tile_store(spark, sf):
    # gray and alpha frames are brought to storage form, written as tiles per sample, and read back
    from scanframe.sources import sinks
    from scanframe.streaming.live import shared_folder
    columns = ["kind", "sample_id", "frame_id", "width", "height", "n_channels", "data"]
    every = fx.frames_gray(spark, sf).withColumn("kind", F.lit("gray")).select(*columns).unionByName(
        fx.frames_bgra(spark, sf).withColumn("kind", F.lit("alpha")).select(*columns))
    good, _ = frame_ops.normalise_for_storage(every)
    path = shared_folder(spark, "tiles")
    sinks.write_frame_tiles(frame_ops.cut_tiles(good, ["kind", "sample_id", "frame_id"], 5), path)
    back = spark.read.parquet(path).withColumnsRenamed({"w": "width", "h": "height"})
    px = frame_ops.pixels(back, ["kind", "sample_id", "frame_id"])
    return px.groupBy("kind", "sample_id", "frame_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("r").alias("sum_r"), F.sum("b").alias("sum_b"))
