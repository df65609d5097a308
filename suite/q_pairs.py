"""Sequences, pairs, alignment, refinement, mosaics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scanframe.operators import align, canvas, frames as frame_ops, layers, ordered, pairs as pair_ops, sequence
from scanframe.plans import mosaics
from suite import fixtures as fx
from suite.registry import query
from suite.views import sql

STD = "sqrt(greatest(0, count({v}) OVER {w} * sum({v} * {v}) OVER {w} - sum({v}) OVER {w} * sum({v}) OVER {w})::DOUBLE) / count({v}) OVER {w}"


def std(v: str, w: str) -> str:
    return STD.format(v=v, w=w)


@query("dedupe_coordinates", "W2 P1", sql("""
SELECT sample_id, y AS coord, count(*) - 1 AS rejected, first(path ORDER BY f DESC, path) AS path, max(f) AS f FROM (
  SELECT *, regexp_extract(name, 'Y(\\d+)', 1)::BIGINT AS y, regexp_extract(name, 'F(\\d+)', 1)::BIGINT AS f FROM fx_frames)
GROUP BY 1, 2""", "fx_frames"))
def dedupe_coordinates(spark, sf):
    rows = sequence.with_coordinates(fx.frames(spark, sf).select("sample_id", "name", "path"), "Y")
    return sequence.best_per_coordinate(rows).select("sample_id", "coord", "rejected", "path", "f")


def _sequence(spark, sf):
    return fx.first_frames(spark, sf).withColumnRenamed("y", "coord")


def _gaps(spark, sf):
    """Gaps need no more of the frames than their coordinates."""
    return sequence.coordinate_gaps(fx.coordinates(spark, sf).withColumnRenamed("y", "coord"))


GAPS = """SELECT sample_id, seq AS after_index, y AS after_coord, ny AS before_coord, ny - y - 1 AS gap_size FROM (
  SELECT *, lead(y) OVER (PARTITION BY sample_id ORDER BY y) AS ny FROM fx_seq) WHERE ny - y > 1"""


@query("sequence_gaps", "W1", sql("""SELECT *, array_to_string(range(after_coord + 1, before_coord), ',') AS missing FROM gaps""",
                                  "fx_seq", gaps=GAPS))
def sequence_gaps(spark, sf):
    return _gaps(spark, sf).withColumn("missing", F.array_join("missing", ","))


@query("blocked_samples", "W1 C12", sql("""
SELECT sample_id, max(gap_size) AS largest, count(*) FILTER (gap_size > 20) AS n_large FROM gaps GROUP BY 1 HAVING max(gap_size) > 20""",
  "fx_seq", gaps=GAPS))
def blocked_samples(spark, sf):
    return sequence.blocked_samples(_gaps(spark, sf), 20)


@query("frame_sequence", "C12 W1 W2", sql("""
SELECT sample_id, y AS coord, seq, path FROM (SELECT sample_id, y, seq, path, max(gap) OVER (PARTITION BY sample_id) AS worst FROM (
  SELECT sample_id, y, seq, path, lead(y) OVER (PARTITION BY sample_id ORDER BY y) - y - 1 AS gap FROM fx_seq)) WHERE coalesce(worst, 0) <= 20""", "fx_seq"))
def frame_sequence(spark, sf):
    listing = fx.frames(spark, sf).select("sample_id", "name", "path")
    return mosaics.frame_sequence(listing, "Y", 20).select("sample_id", "coord", "seq", "path")


@query("consecutive_pairs", "J5", sql("""
SELECT sample_id, pair_idx, y AS coord, next_y AS next_coord, name, next_name FROM fx_pairs""", "fx_pairs"))
def consecutive_pairs(spark, sf):
    seq = _sequence(spark, sf).select("sample_id", "seq", "coord", "name")
    return sequence.consecutive(seq, ["coord", "name"])


@query("gap_report", "A24 C16", sql("""
SELECT sample_id, after_index, gap_size, n, round(mean, 6) AS mean, round(std, 6) AS std, gap_size > mean + 2 * std AS is_unusual
FROM gaps JOIN (SELECT sample_id, count(*) AS n, sum(gap_size)::BIGINT / count(*) AS mean, sqrt((count(*) * sum(gap_size * gap_size)
  - sum(gap_size) * sum(gap_size))::DOUBLE) / count(*) AS std FROM gaps GROUP BY 1) USING (sample_id)""", "fx_seq", gaps=GAPS))
def gap_report(spark, sf):
    out = mosaics.gap_report(sequence.gaps(_sequence(spark, sf)))
    return out.select("sample_id", "after_index", "gap_size", "n", F.round("mean", 6).alias("mean"),
                      F.round("std", 6).alias("std"), "is_unusual")


@query("offset_report", "A25 C16", sql("""
SELECT p.sample_id, pair_idx, abs(y_offset) AS shift, round(mean, 6) AS mean, abs(y_offset) > mean + 2 * std AS is_unusual
FROM fx_pairs p JOIN (SELECT sample_id, sum(abs(y_offset))::BIGINT / count(*) AS mean, sqrt((count(*) * sum(y_offset * y_offset)
  - sum(abs(y_offset)) * sum(abs(y_offset)))::DOUBLE) / count(*) AS std FROM fx_pairs GROUP BY 1) s USING (sample_id)""", "fx_pairs"))
def offset_report(spark, sf):
    return mosaics.offset_report(fx.pairs(spark, sf)).select("sample_id", "pair_idx", "shift", F.round("mean", 6).alias("mean"),
                                                             "is_unusual")


@query("offset_exceedance", "A25", sql("""
SELECT sample_id, k::INTEGER AS limit_px, count(*) FILTER (abs(y_offset) > k) AS n_over,
  round(count(*) FILTER (abs(y_offset) > k) / count(*)::DOUBLE * 100, 6) AS pct
FROM fx_pairs, (SELECT unnest([2, 5, 10, 15, 20]) AS k) GROUP BY 1, 2""", "fx_pairs"))
def offset_exceedance(spark, sf):
    return pair_ops.offset_exceedance(fx.pairs(spark, sf), ["sample_id"]).withColumn("pct", F.round("pct", 6))


FLAGS = f"""SELECT *, CASE WHEN score < 0.95 THEN 1 ELSE 0 END AS a, CASE WHEN coarse_score < 0.93 THEN 1 ELSE 0 END AS b,
  CASE WHEN score - coarse_score > 0.10 THEN 1 ELSE 0 END AS c, CASE WHEN z > 3 THEN 1 ELSE 0 END AS d,
  CASE WHEN score < recent - 0.05::DOUBLE THEN 1 ELSE 0 END AS e FROM (
  SELECT *, CASE WHEN pair_idx >= 3 AND sd > 0 THEN abs(x_overlap - mean) / sd END AS z, CASE WHEN pair_idx >= 2 THEN r END AS recent FROM (
    SELECT *, sum(x_overlap) OVER w / (count(*) OVER w)::DOUBLE AS mean, {std('x_overlap', 'w')} AS sd, avg(score) OVER w AS r
    FROM fx_pairs WINDOW w AS (PARTITION BY sample_id ORDER BY pair_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)))"""
CONF = """SELECT *, CASE WHEN a + b + c + d + e = 0 THEN 'HIGH' WHEN a + b + c + d + e = 1 OR (a + b + c + d + e = 2 AND score > 0.97)
  THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM flags"""


@query("outlier_flags", "W3 W4 W5 P29 P47", sql("""
SELECT sample_id, pair_idx, confidence, concat_ws('+', CASE WHEN a = 1 THEN 'LOW_FINAL_SCORE' END, CASE WHEN b = 1 THEN 'LOW_COARSE_SCORE' END,
  CASE WHEN c = 1 THEN 'LARGE_SCORE_JUMP' END, CASE WHEN d = 1 THEN 'OVERLAP_DEVIATION' END, CASE WHEN e = 1 THEN 'SCORE_DROP' END) AS flags,
  CASE WHEN a = 1 THEN 'LOW_FINAL_SCORE(' || printf('%.4f', score) || ')' END AS first_flag FROM conf""", "fx_pairs", flags=FLAGS, conf=CONF))
def outlier_flags(spark, sf):
    out = pair_ops.flag_outliers(fx.pairs(spark, sf))
    labels = F.transform("flags", lambda f: F.substring_index(f, "(", 1))
    first = F.get("flags", F.lit(0))
    return out.select("sample_id", "pair_idx", "confidence", F.array_join(labels, "+").alias("flags"),
                      F.when(first.startswith("LOW_FINAL"), first).alias("first_flag"))


@query("confidence_distribution", "A26 C16", sql("""
SELECT sample_id, confidence, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sample_id)::DOUBLE * 100, 6) AS pct
FROM conf GROUP BY 1, 2""", "fx_pairs", flags=FLAGS, conf=CONF))
def confidence_distribution(spark, sf):
    out = pair_ops.confidence_distribution(pair_ops.flag_outliers(fx.pairs(spark, sf)), ["sample_id"])
    return out.withColumn("pct", F.round("pct", 6))


@query("search_plan", "W6 W7", sql(f"""
SELECT sample_id, pair_idx, CASE WHEN n >= 2 THEN greatest(400, trunc(om - greatest(100, 2 * osd))::INTEGER) ELSE 400 END AS overlap_min,
  CASE WHEN n >= 2 THEN least(1600, trunc(om + greatest(100, 2 * osd))::INTEGER) ELSE 1600 END AS overlap_max,
  CASE WHEN n >= 3 THEN round_even(ym, 0)::INTEGER ELSE 0 END AS y_center, CASE WHEN n >= 3 THEN least(15,
    CASE WHEN coarse_score > 0.98 THEN greatest(5, trunc(1.5 * ysd + 3)::INTEGER) WHEN coarse_score > 0.96 THEN greatest(6, trunc(2 * ysd + 4)::INTEGER)
    WHEN coarse_score > 0.94 THEN greatest(8, trunc(2.5 * ysd + 5)::INTEGER) ELSE greatest(10, trunc(3 * ysd + 6)::INTEGER) END)
  ELSE CASE WHEN coarse_score > 0.98 THEN 5 WHEN coarse_score > 0.96 THEN 8 WHEN coarse_score > 0.94 THEN 12 ELSE 15 END END AS y_radius
FROM (SELECT *, count(*) OVER w AS n, sum(x_overlap) OVER w / (count(*) OVER w)::DOUBLE AS om, {std('x_overlap', 'w')} AS osd,
  sum(y_offset) OVER w / (count(*) OVER w)::DOUBLE AS ym, {std('y_offset', 'w')} AS ysd FROM fx_pairs
  WINDOW w AS (PARTITION BY sample_id ORDER BY pair_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))""", "fx_pairs"))
def search_plan(spark, sf):
    out = pair_ops.search_plan(fx.pairs(spark, sf), F.lit(400), F.lit(1600))
    return out.select("sample_id", "pair_idx", "overlap_min", "overlap_max", "y_center", "y_radius")


@query("accepted_prefix", "W9 P39", sql("""
SELECT sample_id, pair_idx, bool_and(score > 0.8815) OVER (PARTITION BY sample_id) AS complete FROM fx_pairs
QUALIFY bool_and(score > 0.8815) OVER (PARTITION BY sample_id ORDER BY pair_idx)""", "fx_pairs"))
def accepted_prefix(spark, sf):
    return pair_ops.accepted_prefix(fx.pairs(spark, sf), 0.8815).select("sample_id", "pair_idx", "complete")


@query("score_history", "W16", sql("""
SELECT sample_id, pair_idx, len(list(score) OVER w) AS n, round(list_sum(list(score) OVER w), 6) AS total,
  (list(score) OVER w)[1] AS oldest FROM fx_pairs
WINDOW w AS (PARTITION BY sample_id ORDER BY pair_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""", "fx_pairs"))
def score_history(spark, sf):
    out = pair_ops.recent_scores(fx.pairs(spark, sf))
    return out.select("sample_id", "pair_idx", F.size("history").cast("bigint").alias("n"),
                      F.round(F.aggregate("history", F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
                      F.get("history", F.lit(0)).alias("oldest"))


TYPICAL = """SELECT sample_id, trunc(quantile_cont(next_y - y, 0.5))::INTEGER AS typical_gap FROM fx_pairs GROUP BY 1"""
POSGAP = """SELECT p.*, typical_gap, next_y - y AS gap_size, next_y - y <> typical_gap AS has_gap,
  (next_y - y) / typical_gap::DOUBLE AS gap_multiplier, CASE WHEN next_y - y > typical_gap THEN 'skip'
  WHEN next_y - y < typical_gap THEN 'overlap' ELSE 'normal' END AS gap_type FROM conf p JOIN typical USING (sample_id)"""


def _coord_pairs(spark, sf):
    return fx.pairs(spark, sf).withColumnsRenamed({"y": "coord", "next_y": "next_coord"})


@query("position_gaps", "W20 A27", sql("""
SELECT sample_id, pair_idx, typical_gap, gap_size, has_gap, round(gap_multiplier, 6) AS gap_multiplier, gap_type FROM posgap""",
  "fx_pairs", flags=FLAGS, conf=CONF, typical=TYPICAL, posgap=POSGAP))
def position_gaps(spark, sf):
    return pair_ops.position_gaps(_coord_pairs(spark, sf)).select(
        "sample_id", "pair_idx", "typical_gap", "gap_size", "has_gap", F.round("gap_multiplier", 6).alias("gap_multiplier"), "gap_type")


_AROUND = "list_filter(hood, h -> h.i <> pair_idx AND h.c = 'HIGH')"
CONSTRAINTS = """SELECT *, CASE WHEN n > 0 THEN greatest(100, trunc(pred - 2.5 * unc - 40)::INTEGER) END AS overlap_min,
  trunc(pred + 2.5 * unc + 40)::INTEGER AS overlap_max, trunc(pred)::INTEGER AS overlap_predicted,
  round_even(my, 0)::INTEGER AS y_predicted, CASE WHEN n > 0 THEN greatest(8, trunc(2.5 * sy + 6)::INTEGER) END AS y_range FROM (
  SELECT *, CASE WHEN has_gap THEN mo * (CASE WHEN gap_multiplier >= 2 THEN 0.59 WHEN gap_multiplier >= 1.5 THEN 0.75
      WHEN gap_multiplier > 1 THEN 1 - (gap_multiplier - 1) * 0.5 ELSE 1 + (1 - gap_multiplier) END)::DOUBLE ELSE mo END AS pred,
    CASE WHEN has_gap THEN greatest(so * 1.5, 50) ELSE so END AS unc FROM (
    SELECT *, so1 / nn AS mo, sy1 / nn AS my, CASE WHEN n > 1 THEN sqrt(greatest(0, n * so2 - so1 * so1)::DOUBLE) / n ELSE 25 END AS so,
      CASE WHEN n > 1 THEN sqrt(greatest(0, n * sy2 - sy1 * sy1)::DOUBLE) / n ELSE 3 END AS sy FROM (
      SELECT a.*, count(b.pair_idx) AS n, nullif(count(b.pair_idx), 0)::DOUBLE AS nn, sum(b.x_overlap)::BIGINT AS so1,
        sum(b.x_overlap * b.x_overlap)::BIGINT AS so2, sum(b.y_offset)::BIGINT AS sy1, sum(b.y_offset * b.y_offset)::BIGINT AS sy2
      FROM posgap a LEFT JOIN posgap b ON b.sample_id = a.sample_id AND b.pair_idx BETWEEN a.pair_idx - 4 AND a.pair_idx + 4
        AND b.pair_idx <> a.pair_idx AND b.confidence = 'HIGH' GROUP BY ALL)))"""
_CTES = dict(flags=FLAGS, conf=CONF, typical=TYPICAL, posgap=POSGAP)


@query("neighbour_constraints", "J6 C13", sql("""
SELECT sample_id, pair_idx, n AS n_neighbours, coalesce(overlap_min, 0) AS overlap_min, coalesce(overlap_max, 0) AS overlap_max,
  coalesce(overlap_predicted, 0) AS overlap_predicted, coalesce(y_predicted, 0) AS y_predicted, coalesce(y_range, 0) AS y_range
FROM constraints""", "fx_pairs", **_CTES, constraints=CONSTRAINTS))
def neighbour_constraints(spark, sf):
    out = pair_ops.neighbour_constraints(pair_ops.flag_outliers(_coord_pairs(spark, sf)))
    bounds = ("overlap_min", "overlap_max", "overlap_predicted", "y_predicted", "y_range")
    return out.select("sample_id", "pair_idx", "n_neighbours", *[F.coalesce(c, F.lit(0)).alias(c) for c in bounds])


@query("refinement_plan", "C13", sql("""
SELECT sample_id, pair_idx, CASE WHEN n > 0 THEN overlap_predicted ELSE x_overlap END AS search_center,
  CASE WHEN n > 0 THEN overlap_min ELSE trunc(x_overlap * 0.5)::INTEGER END AS search_min,
  CASE WHEN n > 0 AND NOT (has_gap AND abs(y_offset) > 5) THEN y_predicted ELSE y_offset END AS search_y,
  CASE WHEN n = 0 THEN 20 WHEN has_gap AND abs(y_offset) > 5 THEN greatest(12, y_range + 5) ELSE y_range END AS search_y_range,
  CASE WHEN (n = 0 OR has_gap) AND CASE WHEN n > 0 THEN gap_multiplier ELSE 1 END > 1.2 THEN 120 WHEN n = 0 OR has_gap THEN 70 ELSE 40 END AS coarse_x_radius
FROM constraints WHERE confidence <> 'HIGH'""", "fx_pairs", **_CTES, constraints=CONSTRAINTS))
def refinement_plan(spark, sf):
    out = pair_ops.refinement_plan(pair_ops.neighbour_constraints(pair_ops.flag_outliers(_coord_pairs(spark, sf))))
    return out.select("sample_id", "pair_idx", "search_center", "search_min", "search_y", "search_y_range", "coarse_x_radius")


JUDGED = """SELECT *, CASE WHEN ch > 0.002 THEN true WHEN n > 0 AND has_gap AND ns > 0.85 AND ch > -0.05 THEN true
    WHEN n > 0 AND has_gap AND ns > 0.80 AND ch > -0.03 AND (abs(ny) > 5 OR abs(y_offset) > 5) THEN true ELSE false END AS accepted FROM (
  SELECT *, ns - score AS ch FROM (SELECT *, round(score + ((pair_idx * 7) % 41 - 20) / 400.0::DOUBLE, 4) AS ns,
    (y_offset + 1)::INTEGER AS ny FROM constraints WHERE confidence <> 'HIGH'))"""


def _judged(spark, sf):
    plan = pair_ops.refinement_plan(pair_ops.neighbour_constraints(pair_ops.flag_outliers(_coord_pairs(spark, sf))))
    new = plan.withColumns({"new_score": F.round(F.col("score") + ((F.col("pair_idx") * 7) % 41 - 20) / 400.0, 4),
                            "new_y_offset": (F.col("y_offset") + 1).cast("int")})
    return pair_ops.judge_refinement(new)


@query("refinement_verdicts", "C13 P30 P48", sql("""
SELECT sample_id, pair_idx, accepted, CASE WHEN ns > 0.99 THEN 'HIGH' WHEN ns > 0.97 THEN 'MEDIUM' ELSE 'LOW' END AS new_confidence,
  concat_ws('+', CASE WHEN ch > 0.001 THEN 'REFINED(+' || printf('%.4f', ch) || ')' WHEN ch < -0.001 THEN 'REFINED(' || printf('%.4f', ch) || ')' END,
    CASE WHEN n > 0 AND gap_type = 'skip' THEN 'GAP_SKIP(×' || printf('%.1f', gap_multiplier) || ')' END) AS new_flags
FROM judged""", "fx_pairs", **_CTES, constraints=CONSTRAINTS, judged=JUDGED))
def refinement_verdicts(spark, sf):
    return _judged(spark, sf).select("sample_id", "pair_idx", "accepted", "new_confidence",
                                     F.array_join("new_flags", "+").alias("new_flags"))


@query("refinement_counters", "A28", sql("""
SELECT sample_id, count(*) AS processed, count(*) FILTER (accepted) AS improved, count(*) FILTER (NOT accepted AND ch < -0.001) AS degraded,
  count(*) FILTER (NOT accepted AND NOT ch < -0.001) AS unchanged, count(*) FILTER (n > 0 AND has_gap) AS gap_cases
FROM judged GROUP BY 1""", "fx_pairs", **_CTES, constraints=CONSTRAINTS, judged=JUDGED))
def refinement_counters(spark, sf):
    return pair_ops.refinement_counters(_judged(spark, sf), ["sample_id"])


# ---- alignment on pixels -------------------------------------------------------------------------------------------

def _gray_sequence(spark, sf):
    gray = fx.frames_gray(spark, sf)
    order = gray.select("sample_id", "frame_id")
    seq = ordered.dense_index(order, ["sample_id"], ["frame_id"], ordered.chunk_of(F.col("frame_id")), "seq")
    return gray.join(seq, ["sample_id", "frame_id"])


SEQ = "SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY frame_id) - 1 AS seq FROM fx_px"
CANDIDATES = """SELECT a.sample_id, a.seq AS pair_idx, o.ov, d.dy, count(*) AS n, sum(a.g)::BIGINT AS sa, sum(b.g)::BIGINT AS sb,
  sum(a.g * a.g)::BIGINT AS saa, sum(b.g * b.g)::BIGINT AS sbb, sum(a.g * b.g)::BIGINT AS sab
  FROM px a, (SELECT unnest(range(1, 9)) AS ov) o, (SELECT unnest(range(-3, 4)) AS dy) d, px b
  WHERE b.sample_id = a.sample_id AND b.seq = a.seq + 1 AND b.x = a.x - (8 - o.ov) AND b.y = a.y - d.dy GROUP BY 1, 2, 3, 4"""
NCC = """SELECT *, CASE WHEN n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0 THEN (n * sab - sa * sb)::DOUBLE
  / (sqrt((n * saa - sa * sa)::DOUBLE) * sqrt((n * sbb - sb * sb)::DOUBLE)) END AS s FROM cand"""
ALIGN = {
    "px": SEQ, "cand": CANDIDATES, "ncc": NCC,
    "coarse": """SELECT sample_id, pair_idx, ov AS co, s AS cs FROM ncc WHERE dy = 0 AND ov BETWEEN 2 AND 5 AND s IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY sample_id, pair_idx ORDER BY s DESC, ov) = 1""",
    "bounds": """SELECT *, greatest(2, co - 2) AS lo, least(6, co + 2) AS hi, CASE WHEN cs > 0.96 THEN 1 ELSE 2 END AS r FROM coarse""",
    "grid": """SELECT sample_id, pair_idx, b.co, b.cs, b.lo, b.hi, b.r, first(ov ORDER BY s DESC, ov, dy) AS gx,
      first(dy ORDER BY s DESC, ov, dy) AS gy, max(s) AS gs, count(*) AS gn FROM bounds b JOIN ncc USING (sample_id, pair_idx)
      WHERE (ov - lo) % 2 = 0 AND ov BETWEEN lo AND hi AND abs(dy) <= r AND s IS NOT NULL GROUP BY ALL""",
    "fine": """SELECT sample_id, pair_idx, g.co, g.cs, g.gx, g.gy, g.gs, g.gn, first(ov ORDER BY s DESC, ov, dy) AS fx,
      first(dy ORDER BY s DESC, ov, dy) AS fy, max(s) AS fs, count(*) AS fn FROM grid g JOIN ncc USING (sample_id, pair_idx)
      WHERE abs(ov - gx) <= 1 AND abs(dy - gy) <= 1 AND ov BETWEEN lo AND hi AND abs(dy) <= r AND s IS NOT NULL GROUP BY ALL""",
    "found": """SELECT sample_id, pair_idx, CASE WHEN fs > gs THEN fx ELSE gx END::INTEGER AS x_overlap,
      CASE WHEN fs > gs THEN fy ELSE gy END::INTEGER AS y_offset, greatest(fs, gs) AS score, co, cs, gn + fn AS tried FROM fine""",
}


@query("align_pairs", "C12 K6 K7 J7 A21 A35", sql("""
SELECT sample_id, pair_idx, x_overlap, y_offset, round(score, 6) AS score, co::INTEGER AS coarse_overlap, round(cs, 6) AS coarse_score,
  tried::INTEGER AS fine_tried FROM found""", "fx_px", **ALIGN))
def align_pairs(spark, sf):
    found = align.find_alignments(align.strips(_gray_sequence(spark, sf)), align.small_search())
    return found.select("sample_id", "pair_idx", "x_overlap", "y_offset", F.round("score", 6).alias("score"), "coarse_overlap",
                        F.round("coarse_score", 6).alias("coarse_score"), "fine_tried")


@query("align_pairs_accepted", "C12 W9", sql("""
SELECT sample_id, pair_idx, x_overlap, y_offset FROM found QUALIFY bool_and(score > 0.2) OVER (PARTITION BY sample_id ORDER BY pair_idx)""",
  "fx_px", **ALIGN))
def align_pairs_accepted(spark, sf):
    out = mosaics.align_pairs(_gray_sequence(spark, sf), search=align.small_search(), min_acceptable=0.2)
    return out.select("sample_id", "pair_idx", "x_overlap", "y_offset")


@query("manual_score", "C33 P31 J7 A21", sql("""
SELECT p.sample_id, p.pair_idx, p.x_overlap, p.y_offset, round(s, 6) AS score, CASE WHEN p.x_overlap > 8 THEN 'No overlap'
  WHEN 8 - abs(p.y_offset) <= 4 THEN 'Insufficient height' ELSE 'OK' END AS status,
  CASE WHEN s IS NULL THEN 'N/A' WHEN s >= 0.99 THEN 'VERY HIGH' WHEN s >= 0.97 THEN 'HIGH' WHEN s >= 0.85 THEN 'MEDIUM'
    WHEN s >= 0.70 THEN 'LOW' ELSE 'VERY LOW' END AS band
FROM (SELECT DISTINCT sample_id, seq AS pair_idx, (seq % 9 + 1)::INTEGER AS x_overlap, (seq % 10 - 5)::INTEGER AS y_offset FROM px
  QUALIFY seq < max(seq) OVER (PARTITION BY sample_id)) p
LEFT JOIN ncc c ON c.sample_id = p.sample_id AND c.pair_idx = p.pair_idx AND c.ov = p.x_overlap AND c.dy = p.y_offset""", "fx_px",
  px=SEQ, cand=CANDIDATES, ncc=NCC))
def manual_score(spark, sf):
    frames = _gray_sequence(spark, sf)
    offsets = frames.select("sample_id", F.col("seq").alias("pair_idx"), (F.col("seq") % 9 + 1).cast("int").alias("x_overlap"),
                            (F.col("seq") % 10 - 5).cast("int").alias("y_offset"))
    out = mosaics.manual_score(frames, offsets, min_height=4)
    return out.withColumn("score", F.round("score", 6))


# ---- mosaics -------------------------------------------------------------------------------------------------------

def _fixed_pairs(frames):
    return frames.filter("seq > 0").select("sample_id", (F.col("seq") - 1).alias("pair_idx"),
                                           (2 + F.col("frame_id") % 5).cast("int").alias("x_overlap"),
                                           (F.col("frame_id") % 5 - 2).cast("int").alias("y_offset"))


PLACED = """SELECT sample_id, frame_id, seq, sum(CASE WHEN seq > 0 THEN 8 - (2 + frame_id % 5) ELSE 0 END) OVER (PARTITION BY sample_id
  ORDER BY seq)::BIGINT AS x_pos, CASE WHEN seq > 0 THEN frame_id % 5 - 2 ELSE 0 END::BIGINT AS y_pos
  FROM (SELECT DISTINCT sample_id, frame_id, seq FROM px)"""
LOW = "SELECT sample_id, min(y_pos) AS min_y FROM placed GROUP BY 1"
WRITES = """SELECT p.sample_id, p.x_pos + x.x AS canvas_x, p.y_pos - min_y + x.y AS canvas_y, x.g, p.seq AS o FROM placed p
  JOIN px x USING (sample_id, frame_id) JOIN low USING (sample_id)"""
NEAR = """SELECT a.sample_id, a.seq AS pair, a.x_pos AS x1, b.x_pos AS x2, b.seq FROM placed a JOIN placed b ON b.sample_id = a.sample_id
  AND b.seq = a.seq + 1"""
SECOND = """SELECT w.sample_id, canvas_x, canvas_y, g, 1000000 + pair AS o FROM writes w JOIN near n ON n.sample_id = w.sample_id
  AND w.canvas_x >= x2 AND w.canvas_x < x1 + 8 AND w.o = CASE WHEN abs(canvas_x - (x1 + 4)) < abs(canvas_x - (x2 + 4)) THEN pair ELSE pair + 1 END"""
_MOSAIC = dict(px=SEQ, placed=PLACED, low=LOW, writes=WRITES)


def _mosaic(spark, sf, center_rule):
    frames = _gray_sequence(spark, sf)
    tiles = mosaics.assemble(frames, _fixed_pairs(frames), tile=16, center_rule=center_rule)
    return canvas.canvas_pixels(tiles, ["sample_id"])


@query("placements", "W8 A29", sql("""
SELECT sample_id, seq, x_pos, y_pos, max(x_pos + 8) OVER (PARTITION BY sample_id) AS canvas_w,
  max(y_pos + 8) OVER (PARTITION BY sample_id) - min(y_pos) OVER (PARTITION BY sample_id) AS canvas_h FROM placed""", "fx_px", px=SEQ, placed=PLACED))
def placements(spark, sf):
    frames = _gray_sequence(spark, sf)
    placed = canvas.placements(frames.select("sample_id", "seq", "width", "height"), _fixed_pairs(frames))
    return placed.join(canvas.extents(placed), "sample_id").select("sample_id", "seq", "x_pos", "y_pos", "canvas_w", "canvas_h")


@query("mosaic_plain", "C14 J11", sql("""
SELECT sample_id, canvas_y::INTEGER AS canvas_y, canvas_x::INTEGER AS canvas_x, arg_max(g, o) AS v FROM writes GROUP BY 1, 2, 3""",
  "fx_px", **_MOSAIC))
def mosaic_plain(spark, sf):
    return _mosaic(spark, sf, False)


@query("mosaic_centered", "C15 J11", sql("""
SELECT sample_id, canvas_y::INTEGER AS canvas_y, canvas_x::INTEGER AS canvas_x, arg_max(g, o) AS v FROM (
  SELECT * FROM writes UNION ALL SELECT * FROM second) GROUP BY 1, 2, 3""", "fx_px", **_MOSAIC, near=NEAR, second=SECOND))
def mosaic_centered(spark, sf):
    return _mosaic(spark, sf, True)


def _meta(frames):
    return frames.select("sample_id", "seq", "width", "height", F.concat(F.lit("Y"), F.col("frame_id"), F.lit(" F1.tiff")).alias("name"),
                         F.concat(F.lit("/scan/"), F.col("frame_id")).alias("path"))


def _graded(pairs):
    return pairs.withColumns({"score": F.lit(0.9) + F.col("pair_idx") % 10 / 100.0,
                              "confidence": F.when(F.col("pair_idx") % 3 == 0, "HIGH").when(F.col("pair_idx") % 3 == 1, "MEDIUM").otherwise("LOW"),
                              "flags": F.array().cast("array<string>")})


@query("alignment_document", "S10 C17 J14", sql("""
SELECT sample_id, count(*) AS n_images, count(*) - 1 AS n_pairs, max(x_pos + 8) AS width, max(y_pos + 8) - min(y_pos) AS height,
  min(y_pos) AS min_y_offset, first('Y' || frame_id || ' F1.tiff' ORDER BY seq) AS first_name, last(x_pos ORDER BY seq) AS last_x
FROM placed GROUP BY 1""", "fx_px", px=SEQ, placed=PLACED))
def alignment_document(spark, sf):
    frames = _gray_sequence(spark, sf)
    docs = mosaics.alignment_document(_meta(frames), _graded(_fixed_pairs(frames)), "x", 0, F.lit("2024-01-01T00:00:00"))
    at = lambda p, kind="bigint": F.get_json_object("document", p).cast(kind)
    head = lambda p: F.max(F.when(F.col("part") == "header", at(p)))
    image = F.when(F.col("part") == "image", F.col("number"))
    return docs.groupBy("sample_id").agg(
        head("$.parameters.num_images").alias("n_images"), F.count(F.when(F.col("part") == "pair", 1)).alias("n_pairs"),
        head("$.final_canvas.width").alias("width"), head("$.final_canvas.height").alias("height"),
        head("$.final_canvas.min_y_offset").alias("min_y_offset"), F.min_by(at("$.filename", "string"), image).alias("first_name"),
        F.max_by(at("$.final_x_position"), image).alias("last_x"))


@query("annotations", "C18", sql("""
SELECT sample_id, 'boundary' AS kind, seq AS number, trunc(x_pos * 2.5)::INTEGER AS x1, trunc((x_pos + 8) * 2.5)::INTEGER AS x2,
  trunc((y_pos - min_y) * 2.5)::INTEGER AS y1, '#' || seq || ' Y' || frame_id AS label, 'boundary' AS color_class FROM placed JOIN low USING (sample_id)
UNION ALL SELECT a.sample_id, 'overlap', a.seq, trunc(b.x_pos * 2.5)::INTEGER, trunc((a.x_pos + 8) * 2.5)::INTEGER,
  trunc((greatest(a.y_pos, b.y_pos) - min_y) * 2.5)::INTEGER, 'P' || (a.seq + 1) || ' ' || (2 + b.frame_id % 5) || 'px y=' || b.y_pos || ' '
  || printf('%.3f', 0.9 + (a.seq % 10) / 100.0::DOUBLE) || ' ' || (['H', 'M', 'L'])[a.seq % 3 + 1], (['high', 'medium', 'low'])[a.seq % 3 + 1]
FROM placed a JOIN placed b ON b.sample_id = a.sample_id AND b.seq = a.seq + 1 JOIN low ON low.sample_id = a.sample_id
WHERE b.x_pos < a.x_pos + 8""", "fx_px", px=SEQ, placed=PLACED, low=LOW))
def annotations(spark, sf):
    frames = _gray_sequence(spark, sf)
    pairs = _graded(_fixed_pairs(frames))
    placed = canvas.placements(_meta(frames), pairs)
    return mosaics.annotations(placed, pairs, 2.5).select("sample_id", "kind", "number", "x1", "x2", "y1", "label", "color_class")


LAP8 = """SELECT a.frame_id, a.y, a.x, abs(sum(k.wt * b.g))::BIGINT AS v FROM blurred a, (SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN -8
  WHEN dy <> 0 AND dx <> 0 THEN 2 ELSE 0 END AS wt FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)) k, blurred b
  WHERE b.frame_id = a.frame_id AND b.y = {y} AND b.x = {x} GROUP BY ALL"""


def _register_stack():
    from suite.q_pixels import WHOLE, _mirror, blur_cte

    @query("focus_stack", "C22 J8", sql("""
SELECT sample_id, y, x, first(g ORDER BY v DESC, seq) AS v, first(seq ORDER BY v DESC, seq) AS source_seq FROM px JOIN lap USING (frame_id, y, x)
GROUP BY 1, 2, 3""", "fx_px", px=SEQ, whole=WHOLE, blurred=blur_cte("whole"),
      lap=LAP8.format(y=_mirror("a.y + k.dy", "8"), x=_mirror("a.x + k.dx", "8"))))
    def focus_stack(spark, sf):
        return canvas.stacked_pixels(canvas.focus_stack(_gray_sequence(spark, sf), tile=5), "sample_id", 5)


_register_stack()


@query("rotated_frames", "P28", sql("""
SELECT frame_id, x AS y, y AS x, g FROM fx_px""", "fx_px"))
def rotated_frames(spark, sf):
    # one counter-clockwise turn of the pixels; flipping its rows is the transpose the SQL states
    from scanframe.functions import geometry
    turned = frame_ops.rotate(fx.frames_gray(spark, sf), ["frame_id"], geometry.rotations("y"))
    return frame_ops.pixels(turned, ["frame_id"]).select("frame_id", (F.lit(7) - F.col("y")).alias("y"), "x", "g")


@query("overlap_ncc_relational", "J7 A21 F7", sql("""
SELECT sample_id, pair_idx, ov::INTEGER AS overlap, dy::INTEGER AS dy, n, coalesce(round(s, 6), -2) AS score FROM ncc WHERE ov BETWEEN 3 AND 8 AND abs(dy) <= 1""",
  "fx_px", px=SEQ, cand=CANDIDATES, ncc=NCC))
def overlap_ncc_relational(spark, sf):
    px = frame_ops.pixels(_gray_sequence(spark, sf), ["sample_id", "seq"])
    sums = align.overlap_sums(px, F.sequence(F.lit(3), F.lit(8)), F.sequence(F.lit(-1), F.lit(1)), 8)
    score = align.correlation_of(*[F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    return sums.select("sample_id", "pair_idx", "overlap", "dy", "n", F.coalesce(F.round(score, 6), F.lit(-2.0)).alias("score"))


# ---- rows of frames, and the panorama of the rows ------------------------------------------------------------------

def _grid(spark, sf, by, per_layer=5):
    """Frames of a sample as a grid: ``per_layer`` in every row (or column), in order."""
    frames = _gray_sequence(spark, sf)
    cells = frames.withColumns({"layer": F.floor(F.col("seq") / per_layer).cast("bigint"), "seq": F.col("seq") % per_layer})
    return mosaics.grid_mosaic(cells, by, align.small_search(), align.small_search(), tile=16)


def _grid_sql(by: str, per_layer: int = 5) -> dict[str, str]:
    """The two levels on pixels; the transposed grid swaps x and y of every frame."""
    x, y = ("x", "y") if by == "y" else ("y", "x")
    level = lambda text, names: re.sub(r"\b(cand|ncc|coarse|bounds|grid|fine|found|px)\b", lambda m: names + m[0], text)
    first = {"a_" + k: level(v, "a_") for k, v in ALIGN.items() if k != "px"}
    cells = f"""SELECT sample_id * 100000 + seq // {per_layer} AS sample_id, seq % {per_layer} AS seq, frame_id, {x} AS x, {y} AS y, g
      FROM (SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY frame_id) - 1 AS seq FROM fx_px)"""
    pixels = "SELECT * FROM a_cells QUALIFY max(seq) OVER (PARTITION BY sample_id) >= 1"
    placed = """SELECT f.sample_id, seq, sum(coalesce(8 - x_overlap, 0)) OVER (PARTITION BY f.sample_id ORDER BY seq)::BIGINT AS x_pos, coalesce(y_offset, 0)::BIGINT AS y_pos
      FROM (SELECT DISTINCT sample_id, seq FROM a_px) f LEFT JOIN a_found a ON a.sample_id = f.sample_id AND a.pair_idx + 1 = f.seq"""
    rows = """SELECT sample_id, x_pos + x AS x, y_pos - low + y AS y, arg_max(g, seq) AS g FROM a_placed JOIN a_px USING (sample_id, seq)
      JOIN (SELECT sample_id, min(y_pos) AS low FROM a_placed GROUP BY 1) USING (sample_id) GROUP BY 1, 2, 3"""
    size = """SELECT layer // 100000 AS sample_id, (row_number() OVER (PARTITION BY layer // 100000 ORDER BY layer) - 1)::BIGINT AS seq, layer, w, h
      FROM (SELECT sample_id AS layer, max(x) + 1 AS w, max(y) + 1 AS h FROM row_px GROUP BY 1)"""
    full = """SELECT s.sample_id, s.seq, s.w, s.h, c.x, c.y, coalesce(p.g, 0) AS g FROM sizes s JOIN (SELECT sample_id AS layer, a.x, b.y
      FROM (SELECT sample_id, unnest(range(w)) AS x, h FROM (SELECT layer AS sample_id, w, h FROM sizes)) a, LATERAL (SELECT unnest(range(a.h)) AS y) b) c USING (layer)
      LEFT JOIN row_px p ON p.sample_id = s.layer AND p.x = c.x AND p.y = c.y"""
    pairs = """SELECT a.sample_id, a.seq AS pair_idx, a.h AS ha, a.w AS wa, b.w AS wb, (least(a.h, b.h) * 0.3::DOUBLE)::DOUBLE AS l0, (least(a.h, b.h) * 0.95::DOUBLE)::DOUBLE AS h0
      FROM sizes a JOIN sizes b ON b.sample_id = a.sample_id AND b.seq = a.seq + 1"""
    cand = """SELECT p.sample_id, p.pair_idx, ov, dy, count(*) AS n, sum(a.g)::BIGINT AS sa, sum(b.g)::BIGINT AS sb, sum(a.g * a.g)::BIGINT AS saa,
      sum(b.g * b.g)::BIGINT AS sbb, sum(a.g * b.g)::BIGINT AS sab, any_value(p.lo0) AS lo0, any_value(p.hi0) AS hi0 FROM (SELECT sample_id, pair_idx, ha, wa, wb,
      trunc(l0)::INTEGER AS lo0, trunc(h0)::INTEGER AS hi0 FROM row_pairs) p JOIN full_px a ON a.sample_id = p.sample_id AND a.seq = p.pair_idx,
      LATERAL (SELECT unnest(range(1, p.hi0 + 1)) AS ov) o, (SELECT unnest(range(-3, 4)) AS dy) d JOIN full_px b
      ON b.sample_id = p.sample_id AND b.seq = p.pair_idx + 1 AND b.y = a.y - (p.ha - ov) AND b.x = a.x - dy GROUP BY 1, 2, 3, 4 HAVING count(*) > ov * 3"""
    second = {"b_" + k: level(v, "b_") for k, v in ALIGN.items() if k not in ("px", "cand")} | {"b_cand": cand}
    second["b_coarse"] = """SELECT sample_id, pair_idx, ov AS co, s AS cs, lo0, hi0 FROM b_ncc WHERE dy = 0 AND ov >= lo0 AND ov < hi0 AND s IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY sample_id, pair_idx ORDER BY s DESC, ov) = 1"""
    second["b_bounds"] = """SELECT sample_id, pair_idx, co, cs, greatest(lo0, co - 2) AS lo, least(hi0, co + 2) AS hi, CASE WHEN cs > 0.96 THEN 1 ELSE 2 END AS r FROM b_coarse"""
    order = ["cand", "ncc", "coarse", "bounds", "grid", "fine", "found"]
    return {"a_cells": cells, "a_px": pixels, **{f"a_{k}": first[f"a_{k}"] for k in order}, "a_placed": placed, "row_px": rows, "sizes": size, "full_px": full, "row_pairs": pairs,
            **{f"b_{k}": second[f"b_{k}"] for k in order},
            "stacked": """SELECT s.sample_id, s.seq, s.layer, sum(coalesce(prev_h - x_overlap, 0)) OVER w::BIGINT AS y_pos, sum(coalesce(y_offset, 0)) OVER w::BIGINT AS x_pos FROM (
              SELECT *, lag(h) OVER (PARTITION BY sample_id ORDER BY seq) AS prev_h FROM sizes) s LEFT JOIN b_found f ON f.sample_id = s.sample_id AND f.pair_idx + 1 = s.seq
              WINDOW w AS (PARTITION BY s.sample_id ORDER BY s.seq)"""}


@query("layer_alignment", "C20", sql("""
SELECT sample_id, pair_idx, x_overlap AS overlap, y_offset AS shift, round(score, 6) AS score, co::INTEGER AS coarse_overlap, round(cs, 6) AS coarse_score FROM b_found""",
  "fx_px", **_grid_sql("y")))
def layer_alignment(spark, sf):
    return _grid(spark, sf, "y").layer_pairs.select("sample_id", "pair_idx", "overlap", "shift", F.round("score", 6).alias("score"), "coarse_overlap", F.round("coarse_score", 6).alias("coarse_score"))


def _grid_tiles(by: str) -> str:
    x, y = ("cx", "cy") if by == "y" else ("cy", "cx")
    return sql(f"""SELECT sample_id, ({x} // 16)::INTEGER AS tile_col, ({y} // 16)::INTEGER AS tile_row, count(*) AS n_covered, sum(g)::BIGINT AS total,
      sum(g * (({y} % 16) * 16 + {x} % 16 + 1))::BIGINT AS weighted FROM (SELECT s.sample_id, s.x_pos - low + p.x AS cx, s.y_pos + p.y AS cy, arg_max(p.g, s.seq) AS g FROM stacked s
      JOIN (SELECT sample_id, min(x_pos) AS low FROM stacked GROUP BY 1) USING (sample_id) JOIN row_px p ON p.sample_id = s.layer GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
               "fx_px", **_grid_sql(by))


@query("row_panorama", "C20 C14", _grid_tiles("y"))
def row_panorama(spark, sf):
    return layers.tile_checksums(_grid(spark, sf, "y").tiles, ["sample_id"])


@query("column_panorama", "C20 C14", _grid_tiles("x"))
def column_panorama(spark, sf):
    return layers.tile_checksums(_grid(spark, sf, "x").tiles, ["sample_id"])


# ---- neighbours merged two by two ----------------------------------------------------------------------------------

TREE_SCORE, TREE_LEVELS = 0.3, 11


def _tree_sql() -> dict[str, str]:
    """One set of CTEs per level, enough for 2,048 frames of a sample."""
    out = {"px": SEQ, "n0": "SELECT DISTINCT sample_id, seq AS node, seq AS first, seq AS last FROM px"}
    for k in range(1, TREE_LEVELS + 1):
        named = lambda text, k=k: re.sub(r"\b(cand|ncc|coarse|bounds|grid|fine|found)\b", lambda m: f"t{k}_{m[0]}", text)
        out[f"t{k}_pair"] = f"""SELECT l.sample_id, l.node // 2 AS pair_idx, l.last AS fa, r.first AS fb FROM n{k - 1} l JOIN n{k - 1} r
          ON r.sample_id = l.sample_id AND r.node = l.node + 1 WHERE l.node % 2 = 0"""
        cand = CANDIDATES.replace("SELECT a.sample_id, a.seq AS pair_idx", "SELECT p.sample_id, p.pair_idx").replace("FROM px a,", f"FROM t{k}_pair p JOIN px a ON a.sample_id = p.sample_id AND a.seq = p.fa,")
        cand = cand.replace("b.seq = a.seq + 1", "b.seq = p.fb")
        out |= {f"t{k}_cand": cand} | {f"t{k}_{name}": named(text) for name, text in ALIGN.items() if name not in ("px", "cand")}
        out[f"m{k}"] = f"""SELECT l.sample_id, {k} AS level, l.node // 2 AS node, l.last AS "left", r.first AS "right", f.x_overlap, f.y_offset, f.score,
          CASE WHEN r.node IS NULL THEN 'carry' WHEN f.score >= {TREE_SCORE} THEN 'merge' ELSE 'keep_left' END AS action, l.first AS l_first, l.last AS l_last, r.last AS r_last
          FROM n{k - 1} l LEFT JOIN n{k - 1} r ON r.sample_id = l.sample_id AND r.node = l.node + 1
          LEFT JOIN t{k}_found f ON f.sample_id = l.sample_id AND f.pair_idx = l.node // 2 WHERE l.node % 2 = 0"""
        out[f"n{k}"] = f"SELECT sample_id, node, l_first AS first, CASE WHEN action = 'merge' THEN r_last ELSE l_last END AS last FROM m{k}"
    out["merges"] = " UNION ALL ".join(f"SELECT sample_id, level, node, \"left\", \"right\", x_overlap, y_offset, score, action FROM m{k}" for k in range(1, TREE_LEVELS + 1))
    out["lost"] = """SELECT DISTINCT sample_id, unnest(range(node * (1 << level) + (1 << (level - 1)), (node + 1) * (1 << level))) AS seq FROM merges WHERE action = 'keep_left'"""
    out["kept"] = """SELECT p.sample_id, p.seq, sum(coalesce(8 - x_overlap, 0)) OVER w::BIGINT AS x_pos, sum(coalesce(y_offset, 0)) OVER w::BIGINT AS y_pos
      FROM (SELECT DISTINCT sample_id, seq FROM px ANTI JOIN lost USING (sample_id, seq)) p
      LEFT JOIN merges m ON m.sample_id = p.sample_id AND m."right" = p.seq AND m.action = 'merge' WINDOW w AS (PARTITION BY p.sample_id ORDER BY p.seq)"""
    return out


def _tree_of(spark, sf):
    return mosaics.merge_by_tree(_gray_sequence(spark, sf), align.small_search(), TREE_SCORE, tile=16)


@query("tree_merges", "C21 J17", sql("""
SELECT sample_id, level::INTEGER AS level, node, "left", "right", x_overlap, y_offset, round(score, 6) AS score, action FROM merges WHERE action <> 'carry'""", "fx_px", **_tree_sql()))
def tree_merges(spark, sf):
    return _tree_of(spark, sf).plan.filter("action <> 'carry'").withColumn("score", F.round("score", 6))


@query("tree_positions", "C21 W8", sql("SELECT sample_id, seq, x_pos, y_pos FROM kept", "fx_px", **_tree_sql()))
def tree_positions(spark, sf):
    return _tree_of(spark, sf).placed.select("sample_id", "seq", "x_pos", "y_pos")


@query("tree_mosaic", "C21 C14", sql("""
SELECT sample_id, (cx // 16)::INTEGER AS tile_col, (cy // 16)::INTEGER AS tile_row, count(*) AS n_covered, sum(g)::BIGINT AS total,
  sum(g * ((cy % 16) * 16 + cx % 16 + 1))::BIGINT AS weighted FROM (SELECT k.sample_id, k.x_pos + p.x AS cx, k.y_pos - low + p.y AS cy, arg_max(p.g, k.seq) AS g FROM kept k
  JOIN (SELECT sample_id, min(y_pos) AS low FROM kept GROUP BY 1) USING (sample_id) JOIN px p USING (sample_id, seq) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
  "fx_px", **_tree_sql()))
def tree_mosaic(spark, sf):
    return layers.tile_checksums(_tree_of(spark, sf).tiles, ["sample_id"])
