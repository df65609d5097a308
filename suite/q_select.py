"""Frame selection, merge plans, settings, optics, timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanframe.functions import geometry, names, optics
from scanframe.operators import ordered, select, settings
from scanframe.plans import selection
from scanframe.sources import images, settings_files
from suite import fixtures as fx
from suite.registry import query
from suite.views import sql

FILES = """SELECT 'X' || l_linenumber || 'Y' || sample_id AS folder, path, CASE WHEN k % 11 = 0 OR sample_id % 20 = 7 THEN replace(name, 'F', 'q')
  ELSE name END AS name FROM (SELECT DISTINCT sample_id, k, name, path, l_linenumber FROM fx_frames)"""
SCORED = "SELECT *, TRY_CAST(nullif(regexp_extract(name, 'F([\\d.]+)', 1), '') AS DOUBLE) AS f FROM files WHERE contains(name, 'F')"
_CT = dict(files=FILES, scored=SCORED)


def _files(spark, sf):
    rows = fx.listing(spark, sf, "l_orderkey")
    name = F.when((F.col("l_orderkey") % 11 == 0) | (F.col("sample_id") % 20 == 7), F.replace("name", F.lit("F"), F.lit("q"))).otherwise(F.col("name"))
    return rows.select(F.concat(F.lit("X"), "l_linenumber", F.lit("Y"), "sample_id").alias("folder"), "path", name.alias("name"))


@query("unique_paths", "U7 S1", sql("SELECT count(*) AS n, count(DISTINCT path) AS n_paths FROM (SELECT DISTINCT path FROM fx_frames WHERE lower(path) LIKE '%.tiff')",
                                    "fx_frames"))
def unique_paths(spark, sf):
    found = fx.frames(spark, sf).select("path").filter(images.has_extension(F.col("path")))
    rows = images.unique_paths(found.repartition(fx.pieces(fx.table(spark, sf, "lineitem")), "path"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("n_paths"))


@query("score_stats", "A22", sql("""
SELECT folder, count(*) AS n, min(f) AS f_min, max(f) AS f_max, round(avg(f) + 0.5 * coalesce(stddev_samp(f), 0), 5) AS auto_absolute,
  round(max(f) * 0.7, 5) AS auto_relative FROM scored GROUP BY 1""", "fx_frames", **_CT))
def score_stats(spark, sf):
    out = select.score_stats(select.scored(_files(spark, sf)))
    return out.withColumns({c: F.round(c, 5) for c in ("auto_absolute", "auto_relative")})


@query("top_frames", "K2 A23", sql("""
SELECT folder, path, rk::INTEGER AS rank, f FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY f DESC, path) AS rk FROM scored)
WHERE rk <= 5""", "fx_frames", **_CT))
def top_frames(spark, sf):
    return select.top_n(select.scored(_files(spark, sf)), 5).select("folder", "path", "rank", "f")


@query("best_frames", "K5", sql("""SELECT folder, first(path ORDER BY f DESC, path) AS path, max(f) AS f FROM scored GROUP BY 1""", "fx_frames", **_CT))
def best_frames(spark, sf):
    return select.best_single(select.scored(_files(spark, sf))).select("folder", "path", "f")


@query("frames_above_threshold", "K4 A22", sql("""
SELECT folder, path, f FROM scored JOIN (SELECT folder, avg(f) + 0.5 * coalesce(stddev_samp(f), 0) AS t FROM scored GROUP BY 1) USING (folder) WHERE f >= t - 1e-6""",
  "fx_frames", **_CT))
def frames_above_threshold(spark, sf):
    return select.above_threshold(select.scored(_files(spark, sf))).select("folder", "path", "f")


@query("folders_without_scores", "J18", sql("SELECT DISTINCT folder FROM files ANTI JOIN scored USING (folder)", "fx_frames", **_CT))
def folders_without_scores(spark, sf):
    return select.without_scores(_files(spark, sf))


MARKED = """SELECT folder, path, f, CASE WHEN f IS NOT NULL THEN row_number() OVER (PARTITION BY folder, f IS NULL ORDER BY f DESC, path) END AS rk,
  avg(f) OVER (PARTITION BY folder) + 0.5 * coalesce(stddev_samp(f) OVER (PARTITION BY folder), 0) AS t, max(f) OVER (PARTITION BY folder) * 0.7 AS r
  FROM (SELECT folder, path, CASE WHEN contains(name, 'F') THEN TRY_CAST(nullif(regexp_extract(name, 'F([\\d.]+)', 1), '') AS DOUBLE) END AS f FROM files)"""


@query("selection_strategies", "C19 U6 K3 A23", sql(f"""
SELECT folder, path, strategy FROM (SELECT folder, path, unnest(['all', CASE WHEN rk <= 5 THEN 'top5' END, CASE WHEN f >= t - 1e-6 THEN 'thresh_auto' END,
  CASE WHEN f >= r - 1e-9 THEN 'thresh_70pct' END, CASE WHEN rk = 1 THEN 'best_single' END]) AS strategy FROM ({MARKED}))
WHERE strategy IS NOT NULL QUALIFY strategy = 'best_single' OR count(*) OVER (PARTITION BY folder, strategy) >= 2""", "fx_frames", files=FILES))
def selection_strategies(spark, sf):
    return selection.run_all_strategies(_files(spark, sf)).select("folder", "path", "strategy")


KEYS = """SELECT 'X' || l_linenumber || 'Y' || (l_partkey % 400) || CASE WHEN sample_id % 2 = 0 THEN '_all' ELSE '_top5' END || '.tiff' AS key, path,
  l_linenumber AS x, l_partkey % 400 AS y, CASE WHEN sample_id % 2 = 0 THEN 'all' ELSE 'top5' END AS strategy
  FROM (SELECT DISTINCT sample_id, l_partkey, l_linenumber, path FROM fx_frames)"""


def _results(spark, sf):
    rows = fx.listing(spark, sf, "l_partkey")
    tag = F.when(F.col("sample_id") % 2 == 0, "_all").otherwise("_top5")
    return rows.select(F.concat(F.lit("X"), "l_linenumber", F.lit("Y"), F.col("l_partkey") % 400, tag, F.lit(".tiff")).alias("key"), "path")


@query("row_groups", "C20 K10", sql("""
SELECT strategy, y, path, row_number() OVER (PARTITION BY strategy, y ORDER BY x, path) - 1 AS place, count(*) OVER (PARTITION BY strategy, y) AS group_size
FROM keys QUALIFY count(*) OVER (PARTITION BY strategy, y) >= 2""", "fx_frames", keys=KEYS))
def row_groups(spark, sf):
    return selection.mosaic_groups(_results(spark, sf), "y").select("strategy", "y", "path", "place", "group_size")


@query("column_groups", "C20 K10", sql("""
SELECT strategy, x, path, row_number() OVER (PARTITION BY strategy, x ORDER BY y, path) - 1 AS place, count(*) OVER (PARTITION BY strategy, x) AS group_size
FROM keys QUALIFY count(*) OVER (PARTITION BY strategy, x) >= 2""", "fx_frames", keys=KEYS))
def column_groups(spark, sf):
    return selection.mosaic_groups(_results(spark, sf), "x").select("strategy", "x", "path", "place", "group_size")


@query("panorama_groups", "C20 K10", sql("""
SELECT strategy, path, x, y, row_number() OVER (PARTITION BY strategy ORDER BY x, y, path) - 1 AS place, count(*) OVER (PARTITION BY strategy) AS group_size
FROM keys""", "fx_frames", keys=KEYS))
def panorama_groups(spark, sf):
    return selection.mosaic_groups(_results(spark, sf), "all").select("strategy", "path", "x", "y", "place", "group_size")


TREE = """SELECT sample_id, level::INTEGER AS level, seq // (1 << level) AS node, seq AS "left", CASE WHEN seq + (1 << (level - 1)) < n
  THEN seq + (1 << (level - 1)) ELSE -1 END AS "right", CASE WHEN seq + (1 << (level - 1)) >= n THEN 'carry'
  WHEN (seq // (1 << level) + level + sample_id) % 17 = 0 THEN 'keep_left' ELSE 'merge' END AS action FROM (
  SELECT sample_id, seq, n, unnest(range(1, ceil(log2(n))::INTEGER + 1)) AS level FROM (
    SELECT sample_id, seq, max(seq) OVER (PARTITION BY sample_id) + 1 AS n FROM fx_seq)) WHERE seq % (1 << level) = 0"""


def _tree(spark, sf):
    members = fx.first_frames(spark, sf).select("sample_id", "seq")
    plan = select.merge_tree(members, "sample_id", "seq")
    failed = plan.filter((F.col("node") + F.col("level") + F.col("sample_id")) % 17 == 0)
    return members, select.merge_tree(members, "sample_id", "seq", failed)


@query("merge_tree", "C21 J17", sql("SELECT * FROM tree", "fx_seq", tree=TREE))
def merge_tree(spark, sf):
    return _tree(spark, sf)[1].withColumn("right", F.coalesce("right", F.lit(-1).cast("bigint")))


@query("merge_survivors", "C21", sql("""
SELECT sample_id, seq FROM fx_seq WHERE len([k for k in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16] if (seq >> (k - 1)) % 2 = 1 AND ((seq >> k) + k + sample_id) % 17 = 0]) = 0""",
  "fx_seq"))
def merge_survivors(spark, sf):
    members, plan = _tree(spark, sf)
    return select.tree_survivors(members, "sample_id", "seq", plan)


@query("job_outcomes", "A33", sql("""
SELECT sample_id, count(*) FILTER (l_tax < 0.07) AS successful, count(*) FILTER (NOT l_tax < 0.07) AS failed, count(*) AS total FROM fx_frames GROUP BY 1""", "fx_frames"))
def job_outcomes(spark, sf):
    return select.job_outcomes(fx.frames(spark, sf), ["sample_id"], F.col("l_tax") < 0.07)


# ---- settings ------------------------------------------------------------------------------------------------------

FX_SETTINGS = """SELECT 'scope ' || s_suppkey AS scope, layer, key, CASE key WHEN 'tile_size' THEN (32 + s_nationkey + o)::VARCHAR
    WHEN 'inset_left_pct' THEN ((s_nationkey - 5) / 10.0::DOUBLE)::VARCHAR WHEN 'wbgain' THEN '[' || s_nationkey || ', 0, ' || (s_nationkey * 7 - 20) || ']'
    WHEN 'temp' THEN (s_nationkey * 800)::VARCHAR ELSE 'x' || s_nationkey END AS value
  FROM supplier, (SELECT unnest(['active', 'default']) AS layer, unnest([0, 100]) AS o), (SELECT unnest(['tile_size', 'inset_left_pct', 'wbgain', 'temp', 'foo']) AS key)
  WHERE (layer = 'default' AND s_nationkey % 5 <> 1) OR (layer = 'active' AND s_nationkey % 3 = 0 AND (key <> 'tile_size' OR s_nationkey % 2 = 0))
  UNION ALL SELECT 'scope ' || s_suppkey, 'none', 'none', 'none' FROM supplier"""


def _settings(spark, sf):
    layers = F.explode(F.array(F.struct(F.lit("active").alias("layer"), F.lit(0).alias("o")),
                               F.struct(F.lit("default").alias("layer"), F.lit(100).alias("o")))).alias("l")
    keys = F.explode(F.array(*[F.lit(k) for k in ("tile_size", "inset_left_pct", "wbgain", "temp", "foo")])).alias("key")
    n, k = F.col("s_nationkey"), F.col("key")
    value = (F.when(k == "tile_size", (32 + n + F.col("l.o")).cast("string"))
             .when(k == "inset_left_pct", ((n - 5) / 10.0).cast("string"))
             .when(k == "wbgain", F.concat(F.lit("["), n, F.lit(", 0, "), n * 7 - 20, F.lit("]")))
             .when(k == "temp", (n * 800).cast("string")).otherwise(F.concat(F.lit("x"), n)))
    rows = fx.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", layers).select("*", keys)
    keep = ((F.col("l.layer") == "default") & (n % 5 != 1)) | ((F.col("l.layer") == "active") & (n % 3 == 0) & ((k != "tile_size") | (n % 2 == 0)))
    scope = F.concat(F.lit("scope "), F.col("s_suppkey"))
    given = rows.filter(keep).select(scope.alias("scope"), F.col("l.layer").alias("layer"), "key", value.alias("value"))
    bare = fx.table(spark, sf, "supplier").select(scope.alias("scope"), *[F.lit("none").alias(c) for c in ("layer", "key", "value")])
    return given.unionByName(bare)


BUILTIN = {"tile_size": "48", "inset_left_pct": "0.1", "stride": "48"}
RESOLVED = """SELECT w.scope, w.key, coalesce(v.value, w.fallback) AS value, coalesce(v.layer, 'builtin') AS layer FROM (
  SELECT DISTINCT scope, b.key, b.fallback FROM st, (SELECT unnest(['tile_size', 'inset_left_pct', 'stride']) AS key, unnest(['48', '0.1', '48']) AS fallback) b) w
  LEFT JOIN (SELECT s.* FROM st s JOIN (SELECT scope, min(layer) AS layer FROM st WHERE layer <> 'none' GROUP BY 1) USING (scope, layer)) v USING (scope, key)"""


@query("settings_resolved", "J1 C30 S4", sql("SELECT * FROM resolved", st=FX_SETTINGS, resolved=RESOLVED))
def settings_resolved(spark, sf):
    return settings.resolve(_settings(spark, sf), BUILTIN)


@query("settings_override", "P52", sql("""
SELECT r.scope, r.key, CASE WHEN r.key = 'inset_left_pct' THEN greatest(0.0, least(1.0, coalesce(u.value, r.value)::DOUBLE))::VARCHAR ELSE coalesce(u.value, r.value) END AS value,
  CASE WHEN u.value IS NOT NULL THEN 'update' ELSE r.layer END AS layer FROM resolved r LEFT JOIN (
  SELECT 'scope ' || s_suppkey AS scope, 'inset_left_pct' AS key, (s_nationkey / 10.0::DOUBLE)::VARCHAR AS value FROM supplier WHERE s_nationkey > 7) u USING (scope, key)
UNION ALL SELECT 'scope ' || s_suppkey, 'bogus', 'Unknown setting ''bogus''', 'error' FROM supplier WHERE s_nationkey = 8""", st=FX_SETTINGS, resolved=RESOLVED))
def settings_override(spark, sf):
    supplier = fx.table(spark, sf, "supplier")
    scope = F.concat(F.lit("scope "), F.col("s_suppkey")).alias("scope")
    updates = supplier.filter("s_nationkey > 7").select(scope, F.lit("inset_left_pct").alias("key"), (F.col("s_nationkey") / 10.0).cast("string").alias("value"))
    updates = updates.unionByName(supplier.filter("s_nationkey = 8").select(scope, F.lit("bogus").alias("key"), F.lit("1").alias("value")))
    merged, errors = settings.override(settings.resolve(_settings(spark, sf), BUILTIN), updates, list(BUILTIN))
    return merged.unionByName(errors.select("scope", "key", F.col("reason").alias("value"), F.lit("error").alias("layer")))


@query("settings_violations", "P40 C30", sql("""
SELECT scope, layer, key, value FROM st WHERE (key = 'temp' AND TRY_CAST(value AS INTEGER) NOT BETWEEN 2000 AND 15000)
  OR (key = 'wbgain' AND TRY_CAST(regexp_extract(value, ', 0, (-?\\d+)', 1) AS INTEGER) NOT BETWEEN -127 AND 127)""", st=FX_SETTINGS))
def settings_violations(spark, sf):
    return settings.violations(_settings(spark, sf))


@query("expired_backups", "W15 C30", sql("""
SELECT scope, path, mtime FROM (SELECT o_custkey % 50 AS scope, 'settings.' || o_orderkey || '.yaml' AS path, o_orderdate AS mtime FROM orders)
QUALIFY row_number() OVER (PARTITION BY scope ORDER BY mtime DESC, path DESC) > 5"""))
def expired_backups(spark, sf):
    files = fx.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).alias("scope"), F.concat(F.lit("settings."), F.col("o_orderkey"), F.lit(".yaml")).alias("path"),
        F.col("o_orderdate").alias("mtime"))
    return settings.expired_backups(files)


SLOTS = "SELECT unnest(range(1, 21))::INTEGER AS slot, unnest([" + ", ".join(f"{x}::DOUBLE" for x in settings_files.SLOT_X_MM) + "]) AS x_mm"


@query("slot_positions", "J2 J3 S5 P9", sql("""
SELECT n_nationkey, n_name, coalesce(slot, -1) AS slot, coalesce(trunc(x_mm * 100)::INTEGER, -1) AS x, CASE WHEN slot IS NULL THEN 'missing slot' ELSE 'ok' END AS status
FROM nation LEFT JOIN slots ON slot = n_nationkey + 1""", slots=SLOTS))
def slot_positions(spark, sf):
    from scanframe.plans import control
    enabled = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("row_idx"), F.col("n_name").alias("name"))
    found, missing = control.enabled_positions(enabled, settings_files.slot_map(spark))
    return (found.select(F.col("row_idx").alias("n_nationkey"), F.col("name").alias("n_name"), "slot", "x", F.lit("ok").alias("status"))
            .unionByName(missing.select(F.col("row_idx").alias("n_nationkey"), F.col("name").alias("n_name"), F.lit(-1).alias("slot"),
                                        F.lit(-1).alias("x"), F.lit("missing slot").alias("status"))))


@query("scan_plan", "C5 W18 P51 F3", sql("""
SELECT step, kind, value FROM (
  SELECT (k - 1) * 3 + 1 AS step, 'PRINTER' AS kind, 'G28' AS value FROM e UNION ALL
  SELECT (k - 1) * 3 + 2, 'PRINTER', 'G0 X' || printf('%.2f', trunc(x_mm * 100) / 100) || ' Y200.00 Z29.00' FROM e UNION ALL
  SELECT (k - 1) * 3 + 3, 'SCAN_SAMPLE_BOUNDS', '[' || k || '/' || n || ' ' || round_even((k - 1) / n::DOUBLE * 100, 0)::INTEGER || '%] Scanning ' || n_name FROM e UNION ALL
  SELECT max(n) * 3 + 1, 'PRINTER', 'G28' FROM e UNION ALL SELECT max(n) * 3 + 2, 'STATUS', 'Scanning Complete : ' || max(n) || ' Samples Scanned' FROM e)""",
  slots=SLOTS, e="""SELECT n_name, x_mm, row_number() OVER (ORDER BY n_nationkey) AS k, count(*) OVER () AS n FROM nation JOIN slots ON slot = n_nationkey + 1"""))
def scan_plan(spark, sf):
    from scanframe.plans import control
    enabled = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("row_idx"), F.col("n_name").alias("name"))
    plan = control.scan_plan(enabled, settings_files.slot_map(spark))
    text = F.when(F.col("kind") == "SCAN_SAMPLE_BOUNDS", F.col("message")).otherwise(F.col("value"))
    return plan.select(F.col("step").cast("bigint").alias("step"), "kind", text.alias("value"))


# ---- optics --------------------------------------------------------------------------------------------------------

OPT = """SELECT *, lam / (4 * na) AS p_nyq, pixel_um / mag AS p_obj, (lam / (4 * na)) / (pixel_um / mag) AS s, 2 * na / lam AS fc,
  1 / (2 * (pixel_um / mag)) AS fn, 1.22 * lam / na AS airy FROM (SELECT *, 0.55::DOUBLE AS lam FROM fx_cameras, (SELECT unnest([4, 10, 40]) AS mag))"""
MTF = "CASE WHEN fn >= fc THEN 0 ELSE 2 / pi() * (acos(fn / fc) - fn / fc * sqrt(1 - (fn / fc) * (fn / fc))) END"


def _report(spark, sf):
    from scanframe.plans import reports
    return reports.sampling_report(fx.cameras(spark, sf), (4, 10, 40), optics.BINNINGS)


@query("sampling_report", "P42 P43 P44 J13 C28", sql(f"""
SELECT title, mag, round(p_nyq, 6) AS p_nyq_um, round(p_obj, 8) AS p_obj_um, round(s, 6) AS s, round(nx * p_obj, 6) AS fov_x_um, round(airy, 6) AS airy_um,
  round({MTF}, 6) AS mtf, round(airy / p_obj, 6) AS px_per_airy, CASE WHEN s <= 1 THEN 1 WHEN s <= 2 THEN 2 WHEN s <= 3 THEN 3 WHEN s <= 4 THEN 4 ELSE 8 END AS binning,
  round(25400 / p_obj, 4) AS dpi FROM opt""", "fx_cameras", opt=OPT))
def sampling_report(spark, sf):
    r = _report(spark, sf)
    six = lambda c, a=None: F.round(c, 6).alias(a or c)
    return r.select("title", "mag", six("p_nyq_um"), F.round("p_obj_um", 8).alias("p_obj_um"), six("s"), six("fov_x_um"), six("airy_um"),
                    six("mtf"), six("px_per_airy"), "binning", F.round("dpi", 4).alias("dpi"))


@query("binned_metrics", "P45 P46 C28", sql("""
SELECT title, mag, greatest(1, round_even(nx / s, 0)::INTEGER) AS ideal_nx, CASE WHEN s < 1 THEN 'Undersampling' ELSE '~' || greatest(1, round_even(nx / s, 0)::INTEGER)
  || '×' || greatest(1, round_even(ny / s, 0)::INTEGER) END AS ideal_label, format('{:,}', round_even(25400 / p_obj, 0)::BIGINT) AS dpi_text,
  greatest(1, round_even(nx / b::DOUBLE, 0)::INTEGER) AS bin_nx, round(lam / (4 * na) / (b * p_obj), 6) AS s_after
FROM (SELECT *, CASE WHEN s <= 1 THEN 1 WHEN s <= 2 THEN 2 WHEN s <= 3 THEN 3 WHEN s <= 4 THEN 4 ELSE 8 END AS b FROM opt)""", "fx_cameras", opt=OPT))
def binned_metrics(spark, sf):
    from scanframe.plans import reports
    t = reports.camera_table(_report(spark, sf))
    return t.select("title", "mag", F.col("ideal.nx").alias("ideal_nx"), "ideal_label", F.format_number(F.bround("dpi"), 0).alias("dpi_text"),
                    F.col("rounded.nx").alias("bin_nx"), F.round("rounded.s", 6).alias("s_after"))


@query("binning_modes", "P44", sql("""
SELECT title, mag, CASE WHEN s < 2 THEN 1 WHEN s < 3 THEN 2 WHEN s < 4 THEN 3 WHEN s < 8 THEN 4 ELSE 8 END AS floor_bin,
  (SELECT first(b ORDER BY abs(b - s), b) FROM (SELECT unnest([1, 2, 3, 4, 8]) AS b)) AS nearest_bin FROM opt""", "fx_cameras", opt=OPT))
def binning_modes(spark, sf):
    r = _report(spark, sf)
    s = F.col("s")
    return r.select("title", "mag", optics.ideal_binning(s, mode="floor").alias("floor_bin"), optics.ideal_binning(s, mode="nearest").alias("nearest_bin"))


@query("optics_errors", "P45", sql("""
SELECT title, CASE WHEN na <= 0 THEN 'na must be > 0' WHEN pixel_um <= 0 THEN 'sensor pixel and magnification must be > 0' END AS reason
FROM (SELECT title, na - 0.3 AS na, pixel_um - 2 AS pixel_um FROM fx_cameras) WHERE na <= 0 OR pixel_um <= 0""", "fx_cameras"))
def optics_errors(spark, sf):
    from scanframe.plans import reports
    off = fx.cameras(spark, sf).withColumns({"na": F.col("na") - 0.3, "pixel_um": F.col("pixel_um") - 2})
    return reports.optics_errors(off.withColumn("mag", F.lit(10))).select("title", "reason")


@query("timing_summary", "A32 C34", sql("""
SELECT run_id, category, count(*) AS n, sum(seconds) AS total, round(avg(seconds), 6) AS average, min(seconds) AS min, max(seconds) AS max,
  round(sum(seconds) / sum(sum(seconds)) OVER (PARTITION BY run_id) * 100, 6) AS pct FROM fx_timings GROUP BY 1, 2""", "fx_timings"))
def timing_summary(spark, sf):
    from scanframe.plans import reports
    t = fx.timings(spark, sf)
    totals = t.groupBy("run_id").agg(F.sum("seconds").alias("run_seconds"))
    out = reports.timing_summary(t, totals)
    return out.select("run_id", "category", "n", "total", F.round("average", 6).alias("average"), "min", "max", F.round("pct", 6).alias("pct"))
