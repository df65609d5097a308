import pytest
from pyspark.sql import functions as F

from scanframe.operators import control as ctl
from scanframe.plans import control
from scanframe.sources import settings_files, sinks


def sweep(spark, scores, start=1600):
    return spark.createDataFrame([(1, i, z, float(s)) for i, (z, s) in enumerate(scores.items())], "stack_id int, seq long, z int, score double")


def test_descent_stops_on_peak_drop_and_polishes(spark):
    scores = {1600: 10000, 1580: 12000, 1560: 16000, 1540: 10500, 1520: 99999, 1564: 16500, 1568: 16200, 1572: 16100, 1576: 99999, 1556: 1}
    r = control.best_focus(sweep(spark, scores), F.lit(1602)).first()
    # the march stops at 1540 (drop 5500 from 16000), so 1520 is never seen; up: 1564, two misses, stop before 1576
    assert (r.best_z, r.best_score, r.stop_reason, r.probes) == (1564, 16500.0, "peak-drop", 4)
    assert r.delta_base == 6500.0


def test_descent_stops_on_baseline_drop(spark):
    r = control.best_focus(sweep(spark, {1600: 9000, 1580: 8000, 1560: 6000, 1540: 50000}), F.lit(1600)).first()
    assert (r.best_z, r.stop_reason, r.probes) == (1600, "baseline-drop", 3)


def test_alternating_search_biases_to_the_first_gain(spark):
    scores = {1600: 1000, 1620: 1200, 1580: 2500, 1640: 9999, 1560: 3000, 1540: 900, 1572: 2900, 1584: 2600, 1548: 2999, 1556: 3100, 1564: 3050}
    r = control.alternating_focus(sweep(spark, scores), F.lit(1600)).first()
    assert (r.bias_side, r.stop_reason) == ("left", "peak-drop")
    assert (r.best_z, r.best_score) == (1556, 3100.0)


def test_left_bias_at_the_floor_goes_on_to_the_right(spark):
    scores = {40: 100, 60: 150, 20: 1200, 0: 1300, 80: 200, 100: 1500}
    r = control.alternating_focus(sweep(spark, scores), F.lit(40)).first()
    assert r.bias_side == "left" and (r.best_z, r.best_score) == (100, 1500.0)


def test_fine_search_prefers_up_on_a_tie(spark):
    r = control.fine_focus(sweep(spark, {1600: 5, 1604: 7, 1596: 7, 1608: 6, 1592: 9}), F.lit(1600)).first()
    assert (r.z, r.score, r.delta_base) == (1592, 9.0, 4.0)
    r = control.fine_focus(sweep(spark, {1600: 5, 1604: 7, 1596: 7, 1608: 6, 1592: 6}), F.lit(1600)).first()
    assert (r.z, r.score) == (1604, 7.0)


def test_pluggable_scorer(spark):
    base = sweep(spark, {1600: 5, 1580: 9, 1560: 7})
    assert control.best_focus(base, F.lit(1600)).first().best_z == 1580
    assert control.best_focus(base, F.lit(1600), scorer=-F.col("score")).first().best_z == 1600


def test_black_rows_and_previews(spark):
    base = sweep(spark, {1600: 5, 1580: 9, 1560: 7})
    black = base.withColumn("is_black", F.col("z") == 1580)
    got = control.best_focus(black, F.lit(1600)).first()
    assert (got.best_z, got.stop_reason) == (1600, "baseline-drop")
    previews = base.withColumn("preview_score", F.when(F.col("z") == 1560, 50.0).otherwise(1.0))
    assert control.best_focus(previews, F.lit(1600)).first().best_z == 1560       # the first still scores below 90,000
    stills = control.FocusSearch(preview_below=0.0)
    assert control.best_focus(previews, F.lit(1600), stills).first().best_z == 1580


def test_nested_macros_expand_in_order(spark):
    step = "struct<kind:string,value:string,message:string,log:boolean"
    inner = f"array<{step}>>"
    schema = f"macro_id int, wait boolean, steps array<{step},steps:{inner}>>"
    rows = [(1, True, [("PRINTER", "G28", "home", True, None), ("MACRO", None, None, False, [("PRINTER", "G0 X1", None, False), ("STATUS", "hi", "hi", True)]),
                       ("PRINTER", "G0 X2", None, False, None)])]
    got = ctl.expand_macros(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    assert [(r.position, r.value, r.then_wait) for r in got] == [(1, "G28", True), (2, "G0 X1", False), (3, "hi", False), (4, "G0 X2", True)]


def test_unknown_kinds_are_kept_apart(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "kind string")
    done, unknown = ctl.dispatch(df, {"A": F.lit("did a")})
    assert [r.result for r in done.collect()] == ["did a"]
    assert sorted(r.message for r in unknown.collect()) == ["Unknown kind: ", "Unknown kind: B"]


def test_position_resets_on_home_and_ignores_other_lines(spark):
    lines = ["G0 X1.50 Y2.00", "M114 X9", "G1 Z0.295", "G28 X", "G28", "g0 X3", "G0 X4..5"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "device int, seq long, line string")
    got = [(r.x, r.y, r.z) for r in ctl.position_track(df).orderBy("seq").collect()]
    # 0.295 mm is 29.49999... ticks and truncates; "G28 X" is no full homing and sets nothing; lower case moves count
    assert got == [(150, 200, 0), (150, 200, 0), (150, 200, 29), (150, 200, 29), (0, 0, 0), (300, 0, 0), (300, 0, 0)]


def test_key_values_last_wins(spark):
    m = spark.range(1).select(ctl.key_values(F.lit("a=1 b=2=3 c a=4")).alias("m")).first().m
    assert m == {"a": "4", "b": "2=3"}


def test_scan_plan_names_and_percent(spark):
    enabled = spark.createDataFrame([(0, "oak"), (2, " "), (30, "none")], "row_idx int, name string")
    plan = control.scan_plan(enabled, settings_files.slot_map(spark)).orderBy("step").collect()
    assert [p.value for p in plan] == ["G28", "G0 X22.12 Y200.00 Z29.00", "oak", "G28", "G0 X44.44 Y200.00 Z29.00", "sample_3", "G28",
                                       "Scanning Complete : 2 Samples Scanned"]
    assert plan[5].message == "[2/2 50%] Scanning Sample 3"


def test_failing_sink_does_not_stop_the_others(spark):
    seen, errors = [], []
    run = sinks.fan_out([lambda b, i: seen.append(("first", i)), lambda b, i: 1 / 0, lambda b, i: seen.append(("last", b.count()))],
                        lambda n, e: errors.append((n, type(e).__name__)))
    run(spark.range(3), 7)
    assert seen == [("first", 7), ("last", 3)] and errors == [(1, "ZeroDivisionError")]


@pytest.mark.parametrize("start,step,want", [(2.5, 1.0, [2.5, 1.5, 0.5, 0.0]), (0.0, 1.0, [0.0])])
def test_backward_sweep_is_clamped(spark, start, step, want):
    got = control.sweep_positions(spark.createDataFrame([(start,)], "start_y double"), step, 4.0)
    assert [r.y for r in got.filter("direction = 'backward'").orderBy("i").collect()] == want


def test_bounds_ignore_rows_after_the_end(spark):
    rows = [(1, 0, 10, 20, 50, 90, False), (1, 1, 11, 20, 50, 90, False), (1, 2, 10, 20, 50, 90, True), (1, 3, 9, 20, 50, 90, False),
            (1, 4, 8, 1, 2, 3, False), (1, 5, 7, 20, 50, 90, False)]
    df = spark.createDataFrame(rows, "sample_id int, seq long, y int, hard int, soft int, ylum int, is_break boolean")
    r = control.sample_bounds(df).first()
    assert (r.y_min, r.y_max, r.positions, r.end_found) == (9, 11, 4, True)
