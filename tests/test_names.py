import datetime

import pytest
from pyspark.sql import functions as F

from scanframe.functions import geometry, names


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_field_edges(spark):
    lit = F.lit
    assert one(spark, names.f_score(lit("Z1 F88..tiff"))) is None
    assert one(spark, names.f_score(lit("Z1 F88.tiff"))) == 88.0
    assert one(spark, names.f_score(lit("Z1 F1.2.3.tiff"))) is None
    assert one(spark, names.f_score(lit("z1 f88.tiff"))) is None
    assert one(spark, names.f_number(lit("z1 f88"))) == 88
    assert one(spark, names.f_number(lit("z1"))) == 0
    assert one(spark, names.coordinate(lit("img y0187"), "Y")) == 187
    assert one(spark, names.coordinate(lit("img"), "Y")) is None


@pytest.mark.parametrize("key,x,y", [("X12Y34_all", 12, 34), ("X12Y34", 12, 34), ("Y3X4", None, None), ("foo", None, None)])
def test_folder_key(spark, key, x, y):
    got = spark.range(1).select(names.folder_x(F.lit(key)).alias("x"), names.folder_y(F.lit(key)).alias("y")).first()
    assert got.x == x
    if x is not None:
        assert got.y == y


def test_render(spark):
    now = F.lit(datetime.datetime(2024, 3, 5, 7, 8, 9))
    render = lambda t, **k: one(spark, names.render_name(t, now=now, **k))
    assert render("{x} {{x}} {who} {d:%Y%m%d_%H%M%S}") == "0.00 {x} {who} 20240305_070809"
    assert render("{d}") == "20240305"
    assert render("{{{x}}}") == "{{x}}" and render("{x}}") == "{x}" and render("a{ b") == "a{ b" and render("{x}}}") == "{x}}"
    assert render("Y{y}", y=F.lit(-0.04), pad=True, axis_max_mm={"y": 220}) == "Y-000.04"
    assert render("Y{y}", y=F.lit(1234.5), pad=True, axis_max_mm={"y": 220}, delimiter="_") == "Y1234_50"
    assert render("{x}", x=F.lit(2.0), decimals=0) == "2"
    assert render("F{f}", f=F.lit(2.5)) == "F2"
    assert render("F{f}", f=F.lit(float("-inf"))) == "F-1"
    assert render("F{f}") == "F-1"
    with pytest.raises(ValueError):
        names.render_name("{d:%Q}")


@pytest.mark.parametrize("template,valid,unknown,issue", [
    ("Y{y} X{x} Z{z} F{f}", True, [], None), ("{sample}_{i}", True, ["sample"], None), ("Y{y", False, [], "Unbalanced"),
    ("y}x", False, [], "Unmatched '}' at position 1."), ("{f:.2f}", False, [], "Formatting is only supported"),
    ("{d:%Y}", True, [], None), ("{{ok}}", True, ["ok"], None), ("plain", True, [], None)])
def test_template_report(spark, template, valid, unknown, issue):
    r = one(spark, names.template_report(F.lit(template)))
    assert r.is_valid is valid and r.unknown == unknown
    if issue:
        assert any(issue in i for i in r.issues)


def test_template_report_requirements(spark):
    r = one(spark, names.template_report(F.lit("{y} {f} {d} {i} {y}")))
    assert (r.recognized, r.needs_positions, r.needs_focus, r.needs_index, r.needs_date, r.uses_default_date) == (
        ["y", "f", "d", "i"], True, True, True, True, True)
    strict = one(spark, names.template_report(F.lit("a{who}"), strict=True))
    assert strict.issues == ["Unknown placeholder {who} at pos 1."]
    assert r.date_tokens == [("d", "%Y%m%d", True)] and not r.padding.enabled
    padded = one(spark, names.template_report(F.lit("{y}"), pad=True, axis_max_mm={"y": 220}))
    assert padded.padding == (True, 1, 3, 1)
    assert one(spark, names.template_report(F.lit(""))).is_valid


def test_rotations_and_ranges(spark):
    assert geometry.rotations("y", 90) == ["ccw", "cw"] and geometry.rotations("x") == []
    r = lambda a, b, s: one(spark, geometry.inclusive_range(F.lit(a), F.lit(b), F.lit(s)))
    assert r(0, 10, 4) == [0, 4, 8, 12] and r(10, 0, 5) == [10, 5, 0] and r(3, 3, 2) == [3]


def test_report_of_a_long_template_takes_one_pass(spark):
    import time
    start = time.time()
    r = one(spark, names.template_report(F.lit("{x}" + "a" * 12000 + "}")))
    assert r.issues == ["Unmatched '}' at position 12003.", "Unbalanced braces detected."] and time.time() - start < 10
