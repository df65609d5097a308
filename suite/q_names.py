"""Names, keys, geometry and grades on scan-shaped rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanframe.functions import bands, geometry, names
from scanframe.operators import ordered
from suite import fixtures as fx
from suite.registry import query
from suite.views import sql


def _variant():
    return (F.when(F.col("k") % 4 == 0, F.col("name")).when(F.col("k") % 4 == 1, F.replace("name", F.lit("Y"), F.lit("y")))
            .when(F.col("k") % 4 == 2, F.replace("name", F.lit("F"), F.lit("F1.2.")))
            .otherwise(F.replace("name", F.lit("F"), F.lit("f"))))


@query("name_fields", "P1 P2 P3", sql(r"""
SELECT sample_id, k, v AS name, TRY_CAST(nullif(regexp_extract(s, '(?i)Y(\d+)', 1), '') AS BIGINT) AS y,
  TRY_CAST(nullif(regexp_extract(s, '(?i)X(\d+)', 1), '') AS BIGINT) AS x,
  coalesce(TRY_CAST(nullif(regexp_extract(s, '(?i)F(\d+)', 1), '') AS BIGINT), 0) AS f_number,
  TRY_CAST(nullif(regexp_extract(v, 'F([\d.]+)', 1), '') AS DOUBLE) AS f_score
FROM (SELECT *, regexp_replace(v, '\.[^./]*$', '') AS s FROM (SELECT sample_id, k, CASE k % 4 WHEN 0 THEN name
  WHEN 1 THEN replace(name, 'Y', 'y') WHEN 2 THEN replace(name, 'F', 'F1.2.') ELSE replace(name, 'F', 'f') END AS v
  FROM fx_frames))""", "fx_frames"))
def name_fields(spark, sf):
    v, s = F.col("v"), names.stem(F.col("v"))
    return fx.frames(spark, sf).select("sample_id", "k", _variant().alias("v")).select(
        "sample_id", "k", v.alias("name"), names.coordinate(s, "Y").alias("y"), names.coordinate(s, "X").alias("x"),
        names.f_number(s).alias("f_number"), names.f_score(v).alias("f_score"))


@query("folder_keys", "S3 P4 P5 S13", sql(r"""
SELECT sample_id, k, key, split_part(path, '/', 3) AS folder,
  TRY_CAST(nullif(regexp_extract(key, '^X(\d+)Y', 1), '') AS BIGINT) AS x,
  TRY_CAST(nullif(regexp_extract(key, 'Y(\d+)(_|$)', 1), '') AS BIGINT) AS y, s AS strategy,
  split_part(key, '_', 1) AS base, split_part(key, '_', 1) || '_' || coalesce(s, 'best_single') || '.tiff' AS result,
  split_part(key, '_', 1) || '_partial_' || l_linenumber || '_images.tiff' AS partial,
  split_part(key, '_', 1) || '_uncorrected.tiff' AS uncorrected
FROM (SELECT *, 'X' || l_linenumber || 'Y' || l_partkey || coalesce('_' || s, '') AS key FROM (SELECT *,
  CASE k % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'top5' WHEN 2 THEN 'thresh_auto' WHEN 3 THEN 'thresh_70pct' END AS s
  FROM fx_frames))""", "fx_frames"))
def folder_keys(spark, sf):
    tags = F.array(*[F.lit(s) for s in names.STRATEGIES])
    tag = F.get(tags, (F.col("k") % 5).cast("int"))
    key = F.concat(F.lit("X"), F.col("l_linenumber"), F.lit("Y"), F.col("l_partkey"),
                   F.coalesce(F.concat(F.lit("_"), tag), F.lit("")))
    k = F.col("key")
    sample_folder = names.parent_name(names.parent_path(F.col("path")))
    return (fx.frames(spark, sf).withColumn("key", key).withColumn("folder", sample_folder)
            .select("sample_id", "k", "key", "folder", names.folder_x(k).alias("x"), names.folder_y(k).alias("y"),
                    names.strategy_of(k).alias("strategy"), names.without_strategy(k).alias("base"),
                    names.result_name(names.without_strategy(k), F.coalesce(names.strategy_of(k), F.lit("best_single")))
                    .alias("result"),
                    names.partial_name(names.without_strategy(k), F.col("l_linenumber")).alias("partial"),
                    names.uncorrected_name(F.concat(names.without_strategy(k), F.lit(".tiff"))).alias("uncorrected")))


@query("name_render", "P6 P7 W17", sql(r"""
SELECT sample_id, seq, 'Y' || lpad(split_part(yt, '.', 1), 3, '0') || '-' || split_part(yt, '.', 2) || ' Z'
  || CASE WHEN z < 0 THEN '-' ELSE '' END || CASE WHEN length(split_part(zt, '.', 1)) < 3
       THEN lpad(split_part(zt, '.', 1), 3, '0') ELSE split_part(zt, '.', 1) END || '-' || split_part(zt, '.', 2)
  || ' F' || coalesce(round_even(f, 0)::BIGINT::VARCHAR, '-1') || ' #' || (seq + 7) || ' '
  || strftime(DATE '2024-01-01' + (y % 365)::INTEGER, '%d.%m.%Y') || ' {k} {other}' AS name
FROM (SELECT sample_id, seq, y, z, CASE WHEN l_discount > 0 THEN l_extendedprice / 8 END AS f,
  printf('%.2f', y / 100.0::DOUBLE) AS yt, printf('%.2f', abs(z)) AS zt FROM (SELECT *,
  (floor(l_extendedprice) - 30000) / 100 AS z FROM fx_seq))""", "fx_seq"))
def name_render(spark, sf):
    rows = fx.first_frames(spark, sf)
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("y") % 365).cast("int"))
    text = names.render_name(
        "Y{y} Z{z} F{f} #{i} {d:%d.%m.%Y} {{k}} {other}", y=geometry.ticks_to_mm(F.col("y")),
        z=geometry.ticks_to_mm(F.floor("l_extendedprice") - 30000), f=F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / 8),
        i=F.col("seq") + 7, now=date, delimiter="-", pad=True, axis_max_mm={"y": 220, "z": 360})
    return rows.select("sample_id", "seq", text.alias("name"))


TEMPLATES = ("Y{y} X{x} Z{z} F{f}", "{sample}_{i}", "Y{y", "y}x", "{d:%Y} {f:.2f}", "{{literal}} {d}", "plain", "{x}{x}{foo}",
             "{foo}_{foo}", "{ foo }_{foo}", "{x:1}_{foo}", "{d:%Y} {d} {d:%Q}", "{{}}{i}")


_TRUTH = {  # template number: valid, issues, recognized, unknown, positions, focus, index, date, default date
    0: (True, "", "y,x,z,f", "", 1, 1, 0, 0, 0), 1: (True, "Unknown placeholder {sample} at pos @.", "i", "sample", 0, 0, 1, 0, 0),
    2: (False, "Unbalanced braces detected.", "", "", 0, 0, 0, 0, 0),
    3: (False, "Unmatched '}' at position #. Unbalanced braces detected.", "", "", 0, 0, 0, 0, 0),
    4: (False, "Formatting is only supported for {d}. Found on {f:.2f}.", "d,f", "", 0, 1, 0, 1, 0),
    5: (False, "Unknown placeholder {literal} at pos +.", "d", "literal", 0, 0, 0, 1, 1), 6: (True, "", "", "", 0, 0, 0, 0, 0),
    7: (False, "Unknown placeholder {foo} at pos *.", "x", "foo", 1, 0, 0, 0, 0),
    8: (False, "Unknown placeholder {foo} at pos @. Unknown placeholder {foo} at pos *.", "", "foo", 0, 0, 0, 0, 0),
    9: (False, "Unknown placeholder {foo} at pos @. Unknown placeholder {foo} at pos =.", "", "foo", 0, 0, 0, 0, 0),
    10: (False, "Formatting is only supported for {d}. Found on {x:1}. Unknown placeholder {foo} at pos *.", "x", "foo", 1, 0, 0, 0, 0),
    11: (False, "Invalid date format in {d:%Q}: unsupported directive", "d", "", 0, 0, 0, 1, 1),
    12: (True, "", "i", "", 0, 0, 1, 0, 0)}
_DATES = {4: "d:%Y=%Y", 5: "d=%Y%m%d", 11: "d:%Y=%Y d=%Y%m%d d:%Q=%Q!"}


def _template_truth() -> str:
    q = lambda v: "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {q(TEMPLATES[k])}, {q(t[1])}, {q(t[2])}, {q(t[3])}, {', '.join(str(bool(b)) for b in t[4:])}, {q(_DATES.get(k, ''))})" for k, t in _TRUTH.items())
    spots = "i"
    for mark, ahead in {"@": 0, "#": 1, "+": 1, "*": 6, "=": 8}.items():
        spots = f"replace({spots}, 'pos {mark}', 'pos ' || (n + {ahead})::VARCHAR)"
    spots = f"replace({spots}, 'position #', 'position ' || (n + 1)::VARCHAR)"
    return f"""SELECT p_partkey, p_name || ' ' || t AS template, i = '' AS is_valid, {spots} AS issues, rec AS recognized, unk AS unknown,
  a AS needs_positions, b AS needs_focus, c AS needs_index, d AS needs_date, e AS uses_default_date, dates AS date_tokens FROM (SELECT *, length(p_name) + 1 AS n FROM part)
  JOIN (VALUES {rows}) v(k, t, i, rec, unk, a, b, c, d, e, dates) ON k = p_partkey % {len(TEMPLATES)}"""


@query("template_report", "P8", _template_truth())
def template_report(spark, sf):
    options = F.array(*[F.lit(t) for t in TEMPLATES])
    parts = fx.table(spark, sf, "part").select("p_partkey", "p_name")  # dealt out, because the file may be one row group
    rows = parts.repartition(spark.sparkContext.defaultParallelism * 4, "p_partkey").select(
        "p_partkey", F.concat("p_name", F.lit(" "), F.get(options, (F.col("p_partkey") % len(TEMPLATES)).cast("int"))).alias("template"))
    return rows.select("p_partkey", "template", names.template_report(F.col("template"), strict=True).alias("r")).select(
        "p_partkey", "template", "r.is_valid", F.array_join("r.issues", " ").alias("issues"),
        F.array_join("r.recognized", ",").alias("recognized"), F.array_join("r.unknown", ",").alias("unknown"),
        "r.needs_positions", "r.needs_focus", "r.needs_index", "r.needs_date", "r.uses_default_date",
        F.array_join(F.transform("r.date_tokens", lambda d: F.concat(d["raw"], F.lit("="), d["format"], F.when(d["valid"], "").otherwise("!"))), " ").alias("date_tokens"))


@query("stage_units", "P9 P10 P51", sql(r"""
SELECT k, l_linenumber, l_extendedprice, trunc(mm * 100)::INTEGER AS ticks,
  (round_even(trunc(mm * 100)::INTEGER / 4.0::DOUBLE, 0) * 4)::INTEGER AS z_even,
  (floor(trunc(mm * 100)::INTEGER / 4.0::DOUBLE) * 4)::INTEGER AS z_floor,
  floor(l_partkey / 100)::INTEGER AS axis_max_mm,
  printf('G0 X%.2f Y%.2f Z%.2f', l_partkey / 100.0::DOUBLE, k / 100.0::DOUBLE, l_linenumber / 100.0::DOUBLE) AS move
FROM (SELECT *, (l_extendedprice - 50000) / 1000 AS mm FROM fx_frames)""", "fx_frames"))
def stage_units(spark, sf):
    ticks = geometry.mm_to_ticks((F.col("l_extendedprice") - 50000) / 1000)
    return fx.frames(spark, sf).select(
        "k", "l_linenumber", "l_extendedprice", ticks.alias("ticks"), geometry.quantize_even(ticks).alias("z_even"),
        geometry.quantize_floor(ticks).alias("z_floor"), geometry.axis_max_mm(F.col("l_partkey")).alias("axis_max_mm"),
        geometry.gcode_move(F.col("l_partkey"), F.col("k"), F.col("l_linenumber")).alias("move"))


@query("envelopes", "P11", sql("""
SELECT stack_id, seq, z, z BETWEEN 1040 AND 1600 AND z >= 0 AS descent, z BETWEEN 1040 AND 2160 AND z >= 0 AS alternating,
  z BETWEEN 1584 AND 1616 AND z >= 0 AS fine FROM fx_zsweep WHERE z BETWEEN 1040 AND 2160 AND z >= 0""", "fx_zsweep"))
def envelopes(spark, sf):
    z, start = F.col("z"), F.lit(1600)
    return fx.zsweep(spark, sf).filter(geometry.in_envelope(z, start, "alternating")).select(
        "stack_id", "seq", "z", *[geometry.in_envelope(z, start, kind).alias(kind)
                                 for kind in ("descent", "alternating", "fine")])


@query("jog_requests", "P12", sql("""
SELECT event_id, axis, new_value, 'G1 ' || upper(axis) || (new_value / 100.0::DOUBLE) AS line FROM (
  SELECT event_id, ['x', 'y', 'z'][event_id % 3 + 1] AS axis,
    (k * 400 + trunc(value)::INTEGER * (CASE WHEN event_type = 'click' THEN -40 ELSE 40 END))::INTEGER AS new_value
  FROM fx_events) WHERE new_value BETWEEN 0 AND CASE WHEN axis = 'z' THEN 36000 ELSE 22000 END""", "fx_events"))
def jog_requests(spark, sf):
    from scanframe.operators import control
    ev = fx.events(spark, sf).select(
        "event_id", F.get(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("event_id") % 3).cast("int")).alias("axis"),
        (F.col("k") * 400).alias("current"), (F.col("value").cast("int") * 40).alias("speed"),
        F.when(F.col("event_type") == "click", -1).otherwise(1).alias("direction"))
    return control.jog_moves(ev, {"x": 22000, "y": 22000, "z": 36000}).select("event_id", "axis", "new_value", "line")


_MARGINS = "p_size / 200.0::DOUBLE"


@query("interior_geometry", "P13 P15", sql(f"""
SELECT p_partkey, w, h, l AS int_x, t AS int_y, greatest(0, w - l - r) AS int_w, greatest(0, h - t - b) AS int_h,
  trunc(w * m)::INTEGER AS crop_x, trunc(w * (1 - 0.55::DOUBLE))::INTEGER - trunc(w * m)::INTEGER AS crop_w,
  trunc(w * (1 - 0.55::DOUBLE)) > trunc(w * m) AS crop_ok FROM (
  SELECT p_partkey, w, h, m, round_even(w * m, 0)::INTEGER AS l, round_even(w * 0.1::DOUBLE, 0)::INTEGER AS r,
    round_even(h * least(1, m * 4), 0)::INTEGER AS t, 0 AS b FROM (
    SELECT p_partkey, (101 + p_size * 3)::INTEGER AS w, (77 + p_size)::INTEGER AS h, p_size / 100.0::DOUBLE AS m FROM part))"""))
def interior_geometry(spark, sf):
    rows = fx.table(spark, sf, "part").select(
        "p_partkey", (101 + F.col("p_size") * 3).cast("int").alias("w"), (77 + F.col("p_size")).cast("int").alias("h"),
        (F.col("p_size") / 100.0).alias("m"))
    w, h, m = F.col("w"), F.col("h"), F.col("m")
    rect = geometry.interior_rect(w, h, m, F.lit(0.1), m * 4, F.lit(-0.5))
    crop = geometry.focus_crop(w, h, m, F.lit(0.55), F.lit(0.0), F.lit(0.0))
    return rows.select("p_partkey", "w", "h", rect.alias("i"), crop.alias("c")).select(
        "p_partkey", "w", "h", F.col("i.x").alias("int_x"), F.col("i.y").alias("int_y"), F.col("i.w").alias("int_w"),
        F.col("i.h").alias("int_h"), F.col("c.x").alias("crop_x"), F.col("c.w").alias("crop_w"), F.col("c.ok").alias("crop_ok"))


@query("tile_grid", "P16 P17 P18 P19", sql("""
SELECT p_partkey, x, y, x // 40 AS col, y // 40 AS "row", x >= 10 AND y >= 8 AND x + 48 <= w - 10 AND y + 48 <= h - 8 AS inside,
  round_even(x * 2.5::DOUBLE, 0)::INTEGER AS back_x FROM (
  SELECT p_partkey, w, h, unnest(range(0, greatest(1, w - 48 + 1), 40))::INTEGER AS x, y FROM (
    SELECT p_partkey, w, h, unnest(range(0, greatest(1, h - 48 + 1), 40))::INTEGER AS y FROM (
      SELECT p_partkey, (30 + p_size * 5)::INTEGER AS w, (40 + p_size * 4)::INTEGER AS h FROM part)))"""))
def tile_grid(spark, sf):
    rows = fx.table(spark, sf, "part").select("p_partkey", (30 + F.col("p_size") * 5).cast("int").alias("w"),
                                              (40 + F.col("p_size") * 4).cast("int").alias("h"))
    x, y, size = F.col("x"), F.col("y"), geometry.scaled_tile(48, 40, 0.4)
    rect = F.struct(F.lit(10).alias("x"), F.lit(8).alias("y"), (F.col("w") - 20).alias("w"), (F.col("h") - 16).alias("h"))
    return (rows.withColumn("y", F.explode(geometry.tile_origins(F.col("h"), 48, 40)))
            .withColumn("x", F.explode(geometry.tile_origins(F.col("w"), 48, 40)))
            .select("p_partkey", "x", "y", geometry.tile_index(x, 40).alias("col"), geometry.tile_index(y, 40).alias("row"),
                    geometry.contains_tile(rect, x, y, F.lit(48), F.lit(48)).alias("inside"),
                    geometry.map_back(x, size["inv"]).alias("back_x")))


@query("quadrants_and_turns", "P20 P28", sql("""
SELECT frame_id, x, y, CASE WHEN y < 4 AND x < 4 THEN 'Top Left' WHEN y < 4 THEN 'Top Right' WHEN x < 4 THEN 'Bottom Left'
  ELSE 'Bottom Right' END AS quadrant, y AS ccw_x, 7 - x AS ccw_y, 7 - y AS cw_x, x AS cw_y, 7 - x AS half_x, 7 - y AS half_y,
  x AS scan_cw_x, y AS scan_cw_y FROM fx_px""", "fx_px"))
def quadrants_and_turns(spark, sf):
    x, y, w, h = F.col("x"), F.col("y"), F.lit(8), F.lit(8)
    turn = lambda *a: geometry.rotate_point(x, y, w, h, geometry.rotations(*a))
    ccw, cw, half, both = turn("y"), turn("x", 90), turn("x", 180), turn("y", 90)
    return fx.px(spark, sf).select(
        "frame_id", "x", "y", geometry.quadrant(x, y, w, h).alias("quadrant"), ccw[0].alias("ccw_x"),
        ccw[1].alias("ccw_y"), cw[0].alias("cw_x"), cw[1].alias("cw_y"), half[0].alias("half_x"),
        half[1].alias("half_y"), both[0].alias("scan_cw_x"), both[1].alias("scan_cw_y"))


@query("grades", "P29 P30 P31 P39", sql("""
SELECT sample_id, pair_idx, score, CASE n WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN
  CASE WHEN score > 0.97 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'LOW' END AS confidence,
  CASE WHEN score > 0.99 THEN 'HIGH' WHEN score > 0.97 THEN 'MEDIUM' ELSE 'LOW' END AS refined,
  CASE WHEN m IS NULL THEN 'N/A' WHEN m >= 0.99 THEN 'VERY HIGH' WHEN m >= 0.97 THEN 'HIGH' WHEN m >= 0.85 THEN 'MEDIUM'
    WHEN m >= 0.70 THEN 'LOW' ELSE 'VERY LOW' END AS manual, score > 0.93 AS accepted
FROM (SELECT *, pair_idx % 4 AS n, CASE WHEN pair_idx % 7 > 0 THEN score - (pair_idx % 3) * 0.15::DOUBLE END AS m
  FROM fx_pairs)""", "fx_pairs"))
def grades(spark, sf):
    p, score = F.col("pair_idx"), F.col("score")
    manual = F.when(p % 7 > 0, score - (p % 3) * 0.15)
    return fx.pairs(spark, sf).select(
        "sample_id", "pair_idx", "score", bands.confidence(p % 4, score).alias("confidence"),
        bands.refined_confidence(score).alias("refined"), bands.manual_band(manual).alias("manual"),
        bands.accepted(score, 0.93).alias("accepted"))


@query("series_gates", "P34 P35", sql("""
SELECT sample_id, seq, NOT (hard < 10 AND soft < 200) AS worth_fine, hard < 10 AND soft < 15 AND ylum < 30 AS is_end
FROM fx_series""", "fx_series"))
def series_gates(spark, sf):
    h, s = F.col("hard"), F.col("soft")
    return fx.series(spark, sf).select("sample_id", "seq", bands.worth_fine_focus(h, s).alias("worth_fine"),
                                       bands.end_of_sample(h, s, F.col("ylum")).alias("is_end"))


@query("reports_text", "P46 P47", sql(r"""
SELECT sample_id, pair_idx, CASE WHEN abs(d) < 0.01 THEN printf('%.4f', d) ELSE printf('%.2f', d) END AS small_aware,
  format('{:,}', (x_overlap * 1000 + y_offset)::BIGINT) AS thousands, printf('%.2f', score * 100) || '%' AS pct
FROM (SELECT *, y_offset / 1000.0::DOUBLE AS d FROM fx_pairs)""", "fx_pairs"))
def reports_text(spark, sf):
    return fx.pairs(spark, sf).select(
        "sample_id", "pair_idx", bands.small_aware_number(F.col("y_offset") / 1000.0).alias("small_aware"),
        F.format_number(F.col("x_overlap").cast("bigint") * 1000 + F.col("y_offset"), 0).alias("thousands"),
        F.concat(F.format_string("%.2f", F.col("score") * 100), F.lit("%")).alias("pct"))


@query("inclusive_ranges", "C7", sql("""
SELECT p_partkey, i, CASE WHEN a < b THEN a + i * s ELSE a - i * s END AS v FROM (
  SELECT p_partkey, a, b, s, unnest(range(0, ceil(abs(b - a) / s::DOUBLE)::INTEGER + 1))::INTEGER AS i FROM (
    SELECT p_partkey, p_size AS a, (p_partkey % 41)::INTEGER AS b, (1 + p_partkey % 6)::INTEGER AS s FROM part))"""))
def inclusive_ranges(spark, sf):
    rows = fx.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("a"),
                                              (F.col("p_partkey") % 41).cast("int").alias("b"),
                                              (1 + F.col("p_partkey") % 6).cast("int").alias("s"))
    return rows.select("p_partkey", F.posexplode(geometry.inclusive_range(F.col("a"), F.col("b"), F.col("s")))
                       .alias("i", "v"))
