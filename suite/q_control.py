"""Command logs, sweeps, series, captures; batch twins of the streams; descriptors and warps."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanframe.operators import canvas, control as ctl, frames as frame_ops, layers, match, ordered
from scanframe.plans import control, panorama
from scanframe.sources import logs
from scanframe.streaming import twins
from suite import fixtures as fx
from suite.q_pairs import SEQ, _gray_sequence
from suite.registry import query
from suite.views import sql

AXIS = "TRY_CAST(nullif(regexp_extract(line, '{A}([0-9.]+)', 1), '') AS DOUBLE)"


def _axis(a: str) -> str:
    return f"CASE WHEN line = 'G28' THEN 0 WHEN starts_with(line, 'G') THEN trunc({AXIS.format(A=a)} * 100)::INTEGER END"


TRACK = ("SELECT device, seq, line, " + ", ".join(
    f"coalesce(last_value({_axis(a.upper())} IGNORE NULLS) OVER w, 0) AS {a}" for a in "xyz")
    + " FROM fx_cmdlog WINDOW w AS (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@query("position_track", "W14 C29 S6 P9 R8", sql(f"SELECT device, seq, x, y, z FROM ({TRACK})", "fx_cmdlog"))
def position_track(spark, sf):
    return ctl.position_track(fx.commands(spark, sf)).select("device", "seq", "x", "y", "z")


@query("gcode_round_trip", "P51 W14", sql(f"""
SELECT device, seq, 'X' || (x / 100.0::DOUBLE) || ' Y' || (y / 100.0::DOUBLE) || ' Z' || (z / 100.0::DOUBLE) AS gcode FROM ({TRACK}) WHERE x < 100000""", "fx_cmdlog"))
def gcode_round_trip(spark, sf):
    from scanframe.functions.geometry import gcode_position
    t = ctl.position_track(fx.commands(spark, sf))
    return t.select("device", "seq", gcode_position(F.col("x"), F.col("y"), F.col("z")).alias("gcode"))


@query("key_value_tokens", "P41", sql("""
SELECT device, seq, CASE WHEN contains(line, '=') THEN 'rate' ELSE '' END AS keys, coalesce(nullif(regexp_extract(line, 'rate=(\\d+)', 1), ''), '') AS rate FROM fx_cmdlog""", "fx_cmdlog"))
def key_value_tokens(spark, sf):
    kv = ctl.key_values(F.col("line"))
    return fx.commands(spark, sf).select("device", "seq", F.array_join(F.map_keys(kv), ",").alias("keys"),
                                         F.coalesce(F.try_element_at(kv, F.lit("rate")), F.lit("")).alias("rate"))


@query("ack_outcomes", "J16 C31 P50 R5", sql("""
SELECT c.device, c.seq, coalesce(r.reply_seq, -1) AS reply_seq, coalesce(round((epoch_us(r.ts) - epoch_us(c.ts)) / 1e6::DOUBLE, 6), -1) AS latency_s,
  CASE WHEN r.reply IS NULL THEN 'timeout' WHEN starts_with(r.reply, 'error') THEN 'fault' ELSE 'acknowledged' END AS outcome
FROM fx_cmdlog c LEFT JOIN LATERAL (SELECT * FROM fx_replies p WHERE p.device = c.device AND p.ts > c.ts AND epoch_us(p.ts) - epoch_us(c.ts) <= 7200000000
  AND p.reply NOT LIKE 'echo%' ORDER BY p.ts, p.reply_seq LIMIT 1) r ON true""", "fx_cmdlog", "fx_replies"))
def ack_outcomes(spark, sf):
    out = ctl.ack_outcomes(fx.commands(spark, sf), fx.replies(spark, sf), 7200.0, 3600)
    return out.select("device", "seq", F.coalesce("reply_seq", F.lit(-1).cast("bigint")).alias("reply_seq"),
                      F.coalesce("latency_s", F.lit(-1.0)).alias("latency_s"), "outcome")


@query("response_classes", "P50", sql("""
SELECT reply_seq, CASE WHEN lower(reply) IN ('ok', 'processing') THEN lower(reply) WHEN starts_with(reply, 'error') THEN 'error' ELSE 'info' END AS class FROM fx_replies""", "fx_replies"))
def response_classes(spark, sf):
    from scanframe.functions.bands import response_class
    return fx.replies(spark, sf).select("reply_seq", response_class(F.col("reply")).alias("class"))


@query("freshest_capture", "J15 R2", sql("""
SELECT camera, first(event_id ORDER BY ts DESC, source, event_id DESC) AS latest, first(event_id ORDER BY source = 'still' DESC, ts DESC, event_id DESC) AS still,
  first(event_id ORDER BY source = 'stream' DESC, ts DESC, event_id DESC) AS stream FROM fx_captures GROUP BY 1""", "fx_captures"))
def freshest_capture(spark, sf):
    c = fx.captures(spark, sf)
    pick = lambda p: ctl.freshest(c, ["camera"], p).select("camera", F.col("event_id").alias(p))
    return pick("latest").join(pick("still"), "camera").join(pick("stream"), "camera")


@query("dispatch_commands", "F2", sql("""
SELECT device, seq, kind, CASE kind WHEN 'G28' THEN 'home' WHEN 'G0' THEN 'move ' || line WHEN 'G1' THEN 'feed' ELSE 'Unknown kind: ' || kind END AS result
FROM (SELECT *, split_part(line, ' ', 1) AS kind FROM fx_cmdlog)""", "fx_cmdlog"))
def dispatch_commands(spark, sf):
    rows = fx.commands(spark, sf).withColumn("kind", F.substring_index("line", " ", 1))
    done, unknown = ctl.dispatch(rows, {"G28": F.lit("home"), "G0": F.concat(F.lit("move "), "line"), "G1": F.lit("feed")})
    return done.select("device", "seq", "kind", "result").unionByName(
        unknown.select("device", "seq", "kind", F.col("message").alias("result")))


@query("status_log", "S7", sql("""
SELECT sample_id, seq, y::DOUBLE AS y_mm, (ylum / 2.0::DOUBLE) AS ylum, hard, soft FROM fx_series WHERE NOT is_break""", "fx_series"))
def status_log(spark, sf):
    c = F.col
    line = logs.bounds_line(c("y").cast("double"), c("hard").cast("double"), c("soft").cast("double"), c("ylum").cast("double"),
                            c("ylum") / 2.0, c("hard"), c("soft"))
    lines = fx.series(spark, sf).select("sample_id", "seq", F.when(c("is_break"), "[SCAN_SAMPLE_BOUNDS] Scan complete.").otherwise(line).alias("line"))
    return logs.parse_bounds(lines).select("sample_id", "seq", "y_mm", "ylum", "hard", "soft")


@query("focus_log", "S7 W10", sql("""
SELECT stack_id, seq, 'AF-Descent' AS phase, z / 100.0::DOUBLE AS z_mm, round_even(score, 1) AS score FROM fx_zsweep WHERE z >= 0""", "fx_zsweep"))
def focus_log(spark, sf):
    c = F.col
    text = F.concat(F.lit("[AF-Descent] ↓0.20mm  Z="), F.format_string("%.2f", c("z") / 100.0), F.when(c("z") == 0, " (FLOOR)").otherwise(""),
                    F.lit("  score="), F.bround("score", 1).cast("string"), F.lit("  Δbase=+1.5"))
    lines = fx.zsweep(spark, sf).filter("z >= 0").select("stack_id", "seq", text.alias("line"))
    return logs.parse_focus(lines).select("stack_id", "seq", "phase", "z_mm", "score")


# ---- focus sweeps --------------------------------------------------------------------------------------------------

COARSE = {
    "env": "SELECT stack_id, z, arg_min(score, seq) AS score FROM fx_zsweep WHERE z BETWEEN 1040 AND 1600 AND z >= 0 GROUP BY 1, 2",
    "march": """SELECT *, max(score) OVER w AS peak, first_value(score) OVER w AS base FROM (SELECT stack_id, (1600 - z) // 20 AS k, z, score FROM env WHERE (1600 - z) % 20 = 0)
      WINDOW w AS (PARTITION BY stack_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "stops": """SELECT *, CASE WHEN k > 0 AND peak <= base AND base - score >= 3000 THEN 'baseline-drop' WHEN k > 0 AND peak - score >= 5000 THEN 'peak-drop' END AS reason FROM march""",
    "kept": "SELECT * FROM stops QUALIFY k <= coalesce(min(CASE WHEN reason IS NOT NULL THEN k END) OVER (PARTITION BY stack_id), 1000000)",
}


@query("coarse_march", "W10 W11 P10", sql("""
SELECT stack_id, k::INTEGER AS k, z, round(score - base, 2) AS delta_base, peak, coalesce(reason, '') AS stop_reason FROM kept""", "fx_zsweep", **COARSE))
def coarse_march(spark, sf):
    out = control.coarse_march(control.sweep_cache(fx.zsweep(spark, sf), F.lit(1600), "descent"))
    return out.select("stack_id", "k", "z", F.round("delta_base", 2).alias("delta_base"), "peak", F.coalesce("stop_reason", F.lit("")).alias("stop_reason"))


def _climb(source: str, centers: str, d: int, limit: int) -> dict[str, str]:
    n = "up" if d > 0 else "dn"
    return {
        f"{n}0": f"""SELECT e.stack_id, e.z, e.score, c.cs, ((e.z - c.cz) * {d}) // 4 AS n FROM {source} e JOIN {centers} c USING (stack_id)
          WHERE (e.z - c.cz) * {d} >= 0 AND (e.z - c.cz) % 4 = 0""",
        f"{n}1": f"""SELECT *, n = 0 OR score > greatest(cs, max(score) OVER (PARTITION BY stack_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) + 1e-6 AS imp FROM {n}0""",
        f"{n}2": f"""SELECT *, n - max(CASE WHEN imp THEN n END) OVER (PARTITION BY stack_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS streak FROM {n}1""",
        f"{n}3": f"""SELECT stack_id, arg_max(z, n) AS z, arg_max(score, n) AS score FROM (SELECT * FROM {n}2 QUALIFY n <= coalesce(min(CASE WHEN streak >= {limit} THEN n END)
          OVER (PARTITION BY stack_id), 1000000)) WHERE imp GROUP BY 1""",
    }


BEST = {**COARSE, "cen": "SELECT stack_id, first(z ORDER BY score DESC, k) AS cz, max(score) AS cs, any_value(base) AS base, max(reason) AS reason, count(*) AS probes FROM kept GROUP BY 1",
        **_climb("env", "cen", 1, 2), **_climb("env", "cen", -1, 2),
        "fin": """SELECT u.stack_id, CASE WHEN u.score >= d.score THEN u.z ELSE d.z END AS z, greatest(u.score, d.score) AS score FROM up3 u JOIN dn3 d USING (stack_id)"""}


@query("best_focus", "C4 W11 W12 K8 P10 P11 F1", sql("""
SELECT stack_id, CASE WHEN score > cs THEN z ELSE cz END AS best_z, greatest(score, cs) AS best_score, base AS baseline, round(greatest(score, cs) - base, 2) AS delta_base,
  coalesce(reason, 'end of range') AS stop_reason, probes FROM cen JOIN fin USING (stack_id)""", "fx_zsweep", **BEST))
def best_focus(spark, sf):
    return control.best_focus(fx.zsweep(spark, sf), F.lit(1600)).withColumn("delta_base", F.round("delta_base", 2))


FINE = {"env": "SELECT stack_id, z, arg_min(score, seq) AS score FROM fx_zsweep WHERE z BETWEEN 1584 AND 1616 GROUP BY 1, 2",
        "cen": "SELECT stack_id, z AS cz, score AS cs FROM env WHERE z = 1600", **_climb("env", "cen", 1, 1), **_climb("env", "cen", -1, 1),
        "fin": BEST["fin"]}


@query("fine_focus", "W12 K8 C4", sql("SELECT stack_id, z, score, round(score - cs, 2) AS delta_base FROM fin JOIN cen USING (stack_id)", "fx_zsweep", **FINE))
def fine_focus(spark, sf):
    return control.fine_focus(fx.zsweep(spark, sf), F.lit(1601)).withColumn("delta_base", F.round("delta_base", 2))


ALT = {
    "env": "SELECT stack_id, z, arg_min(score, seq) AS score FROM fx_zsweep WHERE z BETWEEN 1040 AND 2160 AND z >= 0 GROUP BY 1, 2",
    "b": "SELECT stack_id, score AS base FROM env WHERE z = 1600",
    "pr": """SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY k, sd) AS t FROM (SELECT stack_id, z, score, base, abs(z - 1600) // 20 AS k, CASE WHEN z > 1600 THEN 0 ELSE 1 END AS sd
      FROM env JOIN b USING (stack_id) WHERE z <> 1600 AND (z - 1600) % 20 = 0)""",
    "bias": "SELECT stack_id, min(t) AS bt, arg_min(sd, t) AS bs FROM pr WHERE score - base >= 1000 GROUP BY 1",
    "w": "SELECT p.*, bt, bs FROM pr p LEFT JOIN bias USING (stack_id) WHERE bt IS NULL OR t <= bt OR sd = bs",
    "v": """SELECT *, max(score) OVER o AS best, max(CASE WHEN sd = bs AND t >= bt THEN score END) OVER o AS bp FROM w WINDOW o AS (PARTITION BY stack_id ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    "s": """SELECT *, CASE WHEN best <= base AND base - score >= 3000 THEN 'baseline-drop' WHEN sd = bs AND t >= bt AND bp - score >= 2000 THEN 'peak-drop' END AS reason FROM v""",
    "kp": "SELECT * FROM s QUALIFY t <= coalesce(min(CASE WHEN reason IS NOT NULL THEN t END) OVER (PARTITION BY stack_id), 1000000)",
    "co": "SELECT stack_id, first(z ORDER BY score DESC, t) AS z, max(score) AS sc, any_value(base) AS base, any_value(bs) AS bs, max(reason) AS reason, count(*) AS probes FROM kp GROUP BY 1",
}


@query("alternating_bias", "W13 C4 W11", sql("""
SELECT stack_id, base AS baseline, CASE bs WHEN 0 THEN 'right' WHEN 1 THEN 'left' ELSE 'none' END AS bias_side, coalesce(reason, 'end of range') AS stop_reason, probes FROM co""",
  "fx_zsweep", **ALT))
def alternating_bias(spark, sf):
    out = control.alternating_focus(fx.zsweep(spark, sf), F.lit(1600))
    return out.select("stack_id", "baseline", F.coalesce("bias_side", F.lit("none")).alias("bias_side"), "stop_reason", "probes")


ALT2 = {**ALT, "c1": "SELECT stack_id, CASE WHEN sc > base THEN z ELSE 1600 END AS cz, greatest(sc, base) AS cs FROM co",
        "r0": """SELECT e.stack_id, e.z, e.score, CASE WHEN e.z > cz THEN 1 ELSE -1 END AS d, abs(e.z - cz) // 12 AS n FROM env e JOIN c1 USING (stack_id) WHERE e.z <> cz AND (e.z - cz) % 12 = 0""",
        "r1": "SELECT stack_id, first(d ORDER BY score DESC, d DESC) AS dir FROM r0 WHERE n = 1 GROUP BY 1",
        "r2": "SELECT r0.*, score + 1e-6 < lag(score) OVER (PARTITION BY stack_id ORDER BY n) AS fell FROM r0 JOIN r1 USING (stack_id) WHERE d = dir",
        "r3": "SELECT * FROM r2 QUALIFY n <= coalesce(min(CASE WHEN fell THEN n END) OVER (PARTITION BY stack_id), 1000000)",
        "r4": "SELECT stack_id, first(z ORDER BY score DESC, n) AS rz, max(score) AS rs FROM r3 GROUP BY 1",
        "cen": "SELECT stack_id, CASE WHEN rs > cs THEN rz ELSE cz END AS cz, greatest(cs, coalesce(rs, cs)) AS cs FROM c1 LEFT JOIN r4 USING (stack_id)",
        **_climb("env", "cen", 1, 2), **_climb("env", "cen", -1, 2),
        "fin": "SELECT stack_id, first(z ORDER BY score DESC, z DESC) AS z, max(score) AS score FROM (SELECT * FROM up3 UNION ALL SELECT * FROM dn3) GROUP BY 1"}


@query("alternating_focus", "C4 K8 W12 W13", sql("""
SELECT stack_id, CASE WHEN score > cs THEN z ELSE cz END AS best_z, greatest(score, cs) AS best_score FROM cen JOIN fin USING (stack_id)""", "fx_zsweep", **ALT2))
def alternating_focus(spark, sf):
    return control.alternating_focus(fx.zsweep(spark, sf), F.lit(1600)).select("stack_id", "best_z", "best_score")


# ---- series --------------------------------------------------------------------------------------------------------

SEGMENTS = "SELECT *, sum(is_break::INTEGER) OVER (PARTITION BY sample_id ORDER BY seq)::BIGINT AS segment FROM fx_series"


@query("sweep_segments", "W19 R4", sql("SELECT sample_id, seq, segment FROM seg", "fx_series", seg=SEGMENTS))
def sweep_segments(spark, sf):
    return control.segments(fx.series(spark, sf)).select("sample_id", "seq", "segment")


@query("scan_elapsed", "W21", sql("""
SELECT sample_id, seq, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY sample_id)) / 1e6, 6) AS elapsed_s FROM fx_series""", "fx_series"))
def scan_elapsed(spark, sf):
    return control.elapsed(fx.series(spark, sf)).select("sample_id", "seq", F.round("elapsed_s", 6).alias("elapsed_s"))


@query("sample_bounds", "C6 R3 P34 P35", sql("""
SELECT sample_id, min(y) AS y_min, max(y) AS y_max, count(*) AS positions, count(*) FILTER (NOT (hard < 10 AND soft < 200)) AS captured, max(e) IS NOT NULL AS end_found
FROM (SELECT *, min(CASE WHEN segment = 1 AND hard < 10 AND soft < 15 AND ylum < 30 THEN seq END) OVER (PARTITION BY sample_id) AS e FROM seg WHERE segment <= 1)
WHERE segment = 0 OR e IS NULL OR seq < e GROUP BY 1""", "fx_series", seg=SEGMENTS))
def sample_bounds(spark, sf):
    return control.sample_bounds(fx.series(spark, sf))


@query("sweep_positions", "C7", sql("""
SELECT n_nationkey, 'forward' AS direction, i, least(s + i * 7.5, 224.0)::DOUBLE AS y FROM (SELECT n_nationkey, n_nationkey * 9.25::DOUBLE AS s, unnest(range(0, ceil(round((224 - n_nationkey * 9.25::DOUBLE) / 7.5, 9))::INTEGER + 1))::INTEGER AS i FROM nation)
UNION ALL SELECT n_nationkey, 'backward', i, greatest(s - i * 7.5, 0.0)::DOUBLE FROM (SELECT n_nationkey, n_nationkey * 9.25::DOUBLE AS s, unnest(range(0, ceil(round(n_nationkey * 9.25::DOUBLE / 7.5, 9))::INTEGER + 1))::INTEGER AS i FROM nation)"""))
def sweep_positions(spark, sf):
    starts = fx.table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 9.25).alias("start_y"))
    return control.sweep_positions(starts, 7.5).select("n_nationkey", "direction", "i", "y")


@query("scan_progress", "W18", sql("""
SELECT device, seq, round_even((k - 1) / n::DOUBLE * 100, 0)::INTEGER AS pct FROM (SELECT device, seq, row_number() OVER (PARTITION BY device ORDER BY seq) AS k,
  count(*) OVER (PARTITION BY device) AS n FROM fx_cmdlog)""", "fx_cmdlog"))
def scan_progress(spark, sf):
    from scanframe.plans.control import progress
    return progress(fx.commands(spark, sf).select("device", "seq"), "device", "seq").select("device", "seq", "pct")


# ---- batch twins of windowed streams -------------------------------------------------------------------------------

@query("hot_windows", "R1 A11", sql("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, grid_w, grid_h, col, "row", count(*) AS hits FROM fx_tilehits GROUP BY ALL HAVING count(*) >= 3""", "fx_tilehits"))
def hot_windows(spark, sf):
    return twins.hot_tile_windows(fx.tile_hits(spark, sf), "1 day", 3)


@query("throttled_frames", "R1", sql("""
SELECT grid_w, min(frame_id) AS frame_id FROM (SELECT DISTINCT grid_w, grid_h, frame_id, epoch_us(ts) // 600000000 AS b, ts FROM fx_tilehits) GROUP BY grid_w, grid_h, b""", "fx_tilehits"))
def throttled_frames(spark, sf):
    return twins.throttle(fx.tile_hits(spark, sf), ["grid_w", "grid_h"], 1 / 600.0).select("grid_w", "frame_id")


@query("scan_sessions", "R6", sql("""
SELECT sample_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY sample_id ORDER BY ts, seq) AS s FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM fx_series WINDOW w AS (PARTITION BY sample_id ORDER BY ts, seq)))
GROUP BY sample_id, s""", "fx_series"))
def scan_sessions(spark, sf):
    return twins.scan_sessions_of_table(fx.series(spark, sf), "6 hours")


@query("rolling_focus", "R7", sql("""
SELECT sample_id, time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * o AS window_start, round(avg(hard), 6) AS mean_hard, max(soft) AS max_soft, count(*) AS n
FROM fx_series, (SELECT unnest([0, 1]) AS o) GROUP BY ALL""", "fx_series"))
def rolling_focus(spark, sf):
    out = twins.rolling_focus(fx.series(spark, sf), "2 days", "1 day")
    return out.withColumn("mean_hard", F.round("mean_hard", 6))


# ---- descriptors, homographies, warps ------------------------------------------------------------------------------

def _descriptors(spark, sf):
    d = fx.descriptors(spark, sf)
    return d.select(F.lit(0).alias("sample_id"), F.col("image_id").cast("bigint").alias("seq"), "kp_id", "px", "py", "desc")


NEAREST = """SELECT a.image_id AS pair_idx, a.kp_id AS query, b.kp_id AS train, list_distance(a."desc"::DOUBLE[], b."desc"::DOUBLE[]) AS d,
  a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM fx_desc a JOIN fx_desc b ON b.image_id = a.image_id + 1"""
MATCHES = """SELECT pair_idx, query, first(train ORDER BY d, train) AS train, min(d) AS d, min(d, 2)[2] AS second, first(x1) AS x1, first(y1) AS y1,
  first(x2 ORDER BY d, train) AS x2, first(y2 ORDER BY d, train) AS y2 FROM near GROUP BY 1, 2"""


@query("nearest_descriptors", "J9 K9", sql("""
SELECT pair_idx::BIGINT AS pair_idx, query, train, round(d, 6) AS distance, rk::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pair_idx, query ORDER BY d, train) AS rk FROM near)
WHERE rk <= 2""", "fx_desc", near=NEAREST))
def nearest_descriptors(spark, sf):
    return match.two_nearest(_descriptors(spark, sf)).select("pair_idx", "query", "train", F.round("distance", 6).alias("distance"), "rank")


@query("match_descriptors", "C23 J10 K9", sql("""
SELECT pair_idx::BIGINT AS pair_idx, query, train, x1, y1, x2, y2 FROM m WHERE d < 0.97 * second""", "fx_desc", near=NEAREST, m=MATCHES))
def match_descriptors(spark, sf):
    return panorama.match_descriptors(_descriptors(spark, sf), 0.97).select("pair_idx", "query", "train", "x1", "y1", "x2", "y2")


def _number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _basis(x: str, y: str, p: str) -> str:
    """The nine numbers of a quadruple's basis matrix, and the least area of any three of its points."""
    at = lambda i: (f"{x}[{i}]", f"{y}[{i}]")
    area = lambda p, q, r: f"({p[0]} * ({q[1]} - {r[1]}) + {q[0]} * ({r[1]} - {p[1]}) + {r[0]} * ({p[1]} - {q[1]}))"
    a, b, c, d = (at(i) for i in (1, 2, 3, 4))
    f = [area(d, b, c), area(a, d, c), area(a, b, d)]
    cells = [f"{v} * {q[k]}" for k in (0, 1) for v, q in zip(f, (a, b, c), strict=True)] + f
    least = "least(" + ", ".join(f"abs({v})" for v in [*f, area(a, b, c)]) + ")"
    return ", ".join(f"{cell} AS {p}{i}" for i, cell in enumerate(cells)) + f", {least} AS {p}_least"


def _draws(points: str, trials: int) -> dict[str, str]:
    """Hypotheses hyp (pair_idx, number, h0 ... h8) from the matches ``points``."""
    listed = ", ".join(f"list({c} ORDER BY query, train) AS {c}" for c in ("query", "train", "x1", "y1", "x2", "y2"))
    pairs = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    minors = ", ".join(f"o{i} * o{j} - o{k} * o{n} AS g{at}" for at, (i, j, k, n) in enumerate(pairs))
    cells = ", ".join(f"t{3 * i} * g{j} + t{3 * i + 1} * g{3 + j} + t{3 * i + 2} * g{6 + j} AS c{3 * i + j}" for i in range(3) for j in range(3))
    return {
        "pts": points,
        "drawn": f"""SELECT DISTINCT pair_idx, query, train, x1, y1, x2, y2, {_number("query || ':' || train || ':' || deal")} % {trials} AS draw FROM (
          SELECT pts.*, unnest(range(1, ceil({8 * trials}::DOUBLE / n)::BIGINT + 1)) AS deal FROM pts JOIN (SELECT pair_idx, count(*) AS n FROM pts GROUP BY 1) USING (pair_idx))""",
        "fours": f"""SELECT pair_idx, draw, {listed} FROM (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY pair_idx, draw
          ORDER BY {_number("train || ':' || query || ':' || draw")}, query, train) <= 4) GROUP BY 1, 2 HAVING count(*) = 4""",
        "based": f"""SELECT pair_idx, number, {_basis('x1', 'y1', 't')}, {_basis('x2', 'y2', 'o')} FROM (SELECT pair_idx, min(draw) AS number, any_value(x1) AS x1, any_value(y1) AS y1,
          any_value(x2) AS x2, any_value(y2) AS y2 FROM fours GROUP BY pair_idx, query, train)""",
        "hyp": "SELECT pair_idx, number, " + ", ".join(f"c{i} / c8 AS h{i}" for i in range(9)) + f""" FROM (SELECT pair_idx, number, {cells} FROM (
          SELECT *, {minors} FROM based WHERE t_least > 1e-6 AND o_least > 1e-6)) WHERE abs(c8) > 0""",
    }


def _votes(reach: float) -> str:
    w = "nullif(h6 * x2 + h7 * y2 + h8, 0)"
    return f"""SELECT pair_idx, number, count(*) AS inliers FROM hyp JOIN pts USING (pair_idx) WHERE ((h0 * x2 + h1 * y2 + h2) / {w} - x1) * ((h0 * x2 + h1 * y2 + h2) / {w} - x1)
      + ((h3 * x2 + h4 * y2 + h5) / {w} - y1) * ((h3 * x2 + h4 * y2 + h5) / {w} - y1) <= {reach * reach} GROUP BY 1, 2"""


@query("homography_inliers", "C24", sql("""
SELECT pair_idx::BIGINT AS pair_idx, number::BIGINT AS number, inliers FROM votes""", "fx_desc", near=NEAREST, m=MATCHES,
  **_draws("SELECT * FROM m", 64), votes=_votes(40)))
def homography_inliers(spark, sf):
    points = panorama.match_descriptors(_descriptors(spark, sf), 1.1)
    return match.count_inliers(points, match.hypotheses(points, 64), 40.0).select("pair_idx", "number", "inliers")


@query("pair_homographies", "C24", sql("""
SELECT p.pair_idx::BIGINT AS pair_idx, coalesce(n, 0) AS n_matches, coalesce(inliers, 0) AS n_inliers,
  CASE WHEN h0 IS NOT NULL THEN 'fitted' WHEN coalesce(n, 0) < 8 THEN 'too few matches' ELSE 'nothing fits' END AS status, """ + ", ".join(
      f"round(coalesce(h{i}, {float(i % 4 == 0)}), 5) AS h{i}" for i in range(8)) + """
FROM (SELECT DISTINCT image_id - 1 AS pair_idx FROM fx_desc WHERE image_id > 0) p LEFT JOIN (SELECT pair_idx, count(*) AS n FROM m WHERE d < 0.99 * second GROUP BY 1) USING (pair_idx)
LEFT JOIN (SELECT * FROM votes JOIN hyp USING (pair_idx, number) QUALIFY row_number() OVER (PARTITION BY pair_idx ORDER BY inliers DESC, number) = 1) USING (pair_idx)""",
  "fx_desc", near=NEAREST, m=MATCHES, **_draws("SELECT * FROM m WHERE d < 0.99 * second QUALIFY count(*) OVER (PARTITION BY pair_idx) >= 8", 256), votes=_votes(5)))
def pair_homographies(spark, sf):
    out = _pair_maps(spark, sf, refit=False)
    return out.select("pair_idx", "n_matches", "n_inliers", "status", *[F.round(F.col("h")[i], 5).alias(f"h{i}") for i in range(8)])


def _pair_maps(spark, sf, refit):
    d = _descriptors(spark, sf)
    pairs = d.select("sample_id", (F.col("seq") - 1).alias("pair_idx")).filter("pair_idx >= 0").distinct()
    return match.pair_homographies(panorama.match_descriptors(d, 0.99), pairs, refit=refit)


@query("fitted_homographies", "C24")
def fitted_homographies(spark, sf):
    """The winners fitted to all their inliers, by an eigenvector that SQL has no function for."""
    out = _pair_maps(spark, sf, refit=True)
    return out.select("pair_idx", "n_matches", "n_inliers", "status", F.array_join(F.transform("h", lambda v: F.round(v, 4).cast("string")), " ").alias("h"))


def _shifts(frames):
    return frames.filter("seq > 0").select("sample_id", (F.col("seq") - 1).alias("pair_idx"), F.array(
        *[F.lit(v) for v in (1.0, 0.0)], (F.col("frame_id") % 5 - 1).cast("double"), *[F.lit(v) for v in (0.0, 1.0)],
        (F.col("frame_id") % 3 - 1).cast("double"), *[F.lit(v) for v in (0.0, 0.0, 1.0)]).alias("h"))


SHIFTED = """SELECT sample_id, frame_id, seq, sum(CASE WHEN seq > 0 THEN frame_id % 5 - 1 ELSE 0 END) OVER w::BIGINT AS tx,
  sum(CASE WHEN seq > 0 THEN frame_id % 3 - 1 ELSE 0 END) OVER w::BIGINT AS ty FROM (SELECT DISTINCT sample_id, frame_id, seq FROM px)
  WINDOW w AS (PARTITION BY sample_id ORDER BY seq)"""


@query("global_homographies", "C25", sql("SELECT sample_id, seq, tx::DOUBLE AS tx, ty::DOUBLE AS ty FROM sh", "fx_px", px=SEQ, sh=SHIFTED))
def global_homographies(spark, sf):
    g = match.global_homographies(_shifts(_gray_sequence(spark, sf)), width=8)
    return g.select("sample_id", "seq", F.round(F.col("h")[2], 6).alias("tx"), F.round(F.col("h")[5], 6).alias("ty"))


@query("warp_blend", "C26 A30 A31 J12 A29", sql("""
SELECT sample_id, (y - min(y) OVER (PARTITION BY sample_id))::INTEGER AS canvas_y, (x - min(x) OVER (PARTITION BY sample_id))::INTEGER AS canvas_x, v FROM (
  SELECT s.sample_id, p.x + tx AS x, p.y + ty AS y, (sum(g) // count(*))::INTEGER AS v FROM sh s JOIN px p USING (sample_id, frame_id) GROUP BY 1, 2, 3)""",
  "fx_px", px=SEQ, sh=SHIFTED))
def warp_blend(spark, sf):
    frames = _gray_sequence(spark, sf)
    tiles, box = panorama.warp_blend(frames, match.global_homographies(_shifts(frames)), tile=16)
    return panorama.crop(canvas.canvas_pixels(tiles, ["sample_id"]), box)


#: base, modulus, offset, divisor of the nine numbers of a frame's map: base + (frame_id % modulus - offset) / divisor.
PROJECTIVE = [(1, 7, 3, 50), (0, 5, 2, 40), (0, 11, 5, 2), (0, 3, 1, 30), (1, 9, 4, 60), (0, 13, 6, 3), (0, 3, 1, 200), (0, 5, 2, 300), (1, 1, 0, 1)]


def _projective(frames):
    """A map with all eight degrees of freedom for every frame."""
    return frames.select("sample_id", "seq", F.array(*[F.lit(float(b)) + (F.col("frame_id") % m - o).cast("double") / d for b, m, o, d in PROJECTIVE]).alias("h"))


_M = "SELECT DISTINCT sample_id, frame_id, seq, " + ", ".join(f"{b}::DOUBLE + (frame_id % {m} - {o})::DOUBLE / {d} AS m{i}" for i, (b, m, o, d) in enumerate(PROJECTIVE)) + " FROM px"
_BOX = """SELECT sample_id, floor(round(min(cx), 9))::INTEGER AS x_min, floor(round(min(cy), 9))::INTEGER AS y_min, ceil(round(max(cx), 9))::INTEGER AS x_max, ceil(round(max(cy), 9))::INTEGER AS y_max
  FROM (SELECT sample_id, (m0 * x + m1 * y + m2) / (m6 * x + m7 * y + m8) AS cx, (m3 * x + m4 * y + m5) / (m6 * x + m7 * y + m8) AS cy
    FROM maps, (SELECT unnest([0.0::DOUBLE, 8, 8, 0]) AS x, unnest([0.0::DOUBLE, 0, 8, 8]) AS y)) GROUP BY 1"""
_CANVAS = """SELECT m.sample_id, frame_id, seq, x_max - x_min AS cw, y_max - y_min AS ch, m0 + tx * m6 AS a, m1 + tx * m7 AS b, m2 + tx * m8 AS c, m3 + ty * m6 AS d, m4 + ty * m7 AS e,
  m5 + ty * m8 AS f, m6 AS g, m7 AS h, m8 AS i FROM maps m JOIN (SELECT *, greatest(0, -x_min)::DOUBLE AS tx, greatest(0, -y_min)::DOUBLE AS ty FROM box) USING (sample_id)"""
_BACK = """SELECT sample_id, frame_id, cw, ch, e * i - f * h AS b0, c * h - b * i AS b1, b * f - c * e AS b2, f * g - d * i AS b3, a * i - c * g AS b4, c * d - a * f AS b5,
  d * h - e * g AS b6, b * g - a * h AS b7, a * e - b * d AS b8 FROM onto"""
_SOURCE = """SELECT *, (px // 32)::BIGINT AS ix, (py // 32)::BIGINT AS iy, px % 32 AS ax, py % 32 AS ay FROM (SELECT sample_id, frame_id, x, y,
  floor((b0 * x + b1 * y + b2) / (b6 * x + b7 * y + b8) * 32 + 0.5) AS fx, floor((b3 * x + b4 * y + b5) / (b6 * x + b7 * y + b8) * 32 + 0.5) AS fy, (fx + 32000)::BIGINT AS px, (fy + 32000)::BIGINT AS py
  FROM (SELECT *, unnest(range(cw)) AS x FROM back), LATERAL (SELECT unnest(range(ch)) AS y) WHERE fx > -32 AND fx < 256 AND fy > -32 AND fy < 256)"""
_WARPED = """SELECT s.sample_id, s.frame_id, s.x, s.y, (sum(wt * g) + 512)::BIGINT // 1024 AS v FROM (SELECT *, unnest([0, 0, 1, 1]) AS oy, unnest([0, 1, 0, 1]) AS ox,
  unnest([(32 - ay) * (32 - ax), (32 - ay) * ax, ay * (32 - ax), ay * ax]) AS wt FROM source) s JOIN fx_px p ON p.frame_id = s.frame_id AND p.x = s.ix - 1000 + ox AND p.y = s.iy - 1000 + oy
  GROUP BY 1, 2, 3, 4 HAVING 2 * sum(wt) >= 1024"""


@query("warp_projective", "C26 J12 A30 A31", sql("""
SELECT sample_id, (x // 16)::INTEGER AS tile_col, (y // 16)::INTEGER AS tile_row, count(*) AS n_covered, sum(v)::BIGINT AS total, sum(v * ((y % 16) * 16 + x % 16 + 1))::BIGINT AS weighted
FROM (SELECT sample_id, x, y, (sum(v) // count(*))::BIGINT AS v FROM warped GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
  "fx_px", px=SEQ, maps=_M, box=_BOX, onto=_CANVAS, back=_BACK, source=_SOURCE, warped=_WARPED))
def warp_projective(spark, sf):
    frames = _gray_sequence(spark, sf)
    stored = frame_ops.cut_tiles(frames, ["sample_id", "seq"], 5)
    tiles, _ = panorama.warp_blend_tiles(stored, frames.select("sample_id", "seq", "width", "height"), _projective(frames), 5, tile=16)
    return layers.tile_checksums(tiles, ["sample_id"])
