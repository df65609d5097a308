"""What the physical plans must and must not contain."""

import re

from helpers import frame_row, frames_df, texture
from pyspark.sql import functions as F

from scanframe.operators import control, ordered, pairs, select, sequence
from scanframe.plans import imaging
from scanframe.sources import images
from suite import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_frame_jobs_do_not_shuffle(spark):
    frames = frames_df(spark, [frame_row(1, texture(60, 60))])
    for job in (imaging.focus_tiles(frames, ["frame_id"], top_percent=0.2, min_score=None, soft_min=None), imaging.focus_tiles(frames, ["frame_id"]),
                imaging.frame_focus(frames, ["frame_id"]), imaging.frame_color(frames, ["frame_id"])):
        assert "Exchange" not in plan(job)


def test_top_k_is_cut_before_the_shuffle(spark):
    files = spark.createDataFrame([("a", "F1.png", "a/1")], "folder string, name string, path string")
    text = plan(select.top_n(select.scored(files), 5))
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    assert "content" not in re.search(r"ReadSchema: [^\n]*", plan(images.list_images(spark, str(tmp_path)))).group(0)


def test_sequences_read_only_what_names_need(spark):
    listing = fx.frames(spark, SF).select("sample_id", "name", "path")
    text = plan(sequence.best_per_coordinate(sequence.with_coordinates(listing, "Y")))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_extendedprice" not in schema and "l_discount" not in schema


def test_windows_are_keyed_by_chunk(spark):
    """Every window over unbounded groups is partitioned by the chunk too, or runs on one summary row per chunk."""
    seq = spark.range(10).select(F.lit(1).alias("sample_id"), F.col("id").alias("pair_idx"), F.lit(5).alias("x_overlap"), F.lit(1).alias("y_offset"),
                                 F.lit(1.0).alias("score"), F.lit(1.0).alias("coarse_score"))
    for spec in re.findall(r"windowspecdefinition\(([^,]*, [^,]*),", plan(pairs.flag_outliers(seq))):
        assert ordered.CHUNK in spec


def test_acknowledgements_pair_nothing(spark):
    text = plan(control.ack_outcomes(fx.commands(spark, SF), fx.replies(spark, SF)))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1


def test_no_products(spark):
    from suite.all_queries import QUERIES
    for name in ("sampling_report", "match_descriptors", "overlap_ncc_relational", "neighbour_constraints", "hot_update", "manual_score"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_listings_get_more_tasks_with_more_rows(spark, monkeypatch):
    from suite import fixtures as fx
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 100)
    rows = fx.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    want = -(-rows // 100)
    for made in (fx.frames, fx.listing):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == want > 8


def test_gaps_carry_coordinates_only(spark):
    from suite.all_queries import QUERIES
    plan = QUERIES["sequence_gaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct" not in plan and "count(" in plan  # no frame is chosen


def test_mosaic_groups_are_not_joined_by_group(spark):
    from scanframe.plans import selection
    results = spark.createDataFrame([(f"X{i}Y1_all.tiff", f"p{i}") for i in range(6)], "key string, path string")
    out = selection.mosaic_groups(results, "all")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the ranges' offsets, which carry the sizes too
    assert sorted((r.place, r.group_size) for r in out.collect()) == [(i, 6) for i in range(6)]


def test_gaps_read_once_and_shuffle_stretches_only(spark):
    from pyspark.sql import functions as F
    from scanframe.operators import sequence
    from suite.all_queries import QUERIES
    text = plan(QUERIES["sequence_gaps"](spark, "/root/testdata/sf0.001"))
    assert text.count("FileScan") == 2 and "REPARTITION" not in text  # both branches begin with the same shuffle, which Spark reuses
    assert len({line.split("#")[0].split("- ")[-1] for line in text.splitlines() if "FileScan" in line}) == 1
    # repeats, NULLs, a NULL sample, holes inside stretches and over several of them: as numbering and pairing give them
    rows = [(1, c) for c in (5, 5, 6, 9, 4095, 4096, 4099, 20000, None)] + [(2, 7), (2, None), (3, None)] + [(None, c) for c in (3, 1, 1, 9000)]
    got = sequence.coordinate_gaps(spark.createDataFrame(rows, "sample_id int, coord long")).withColumn("missing", F.size("missing"))
    assert got.schema.simpleString() == "struct<sample_id:int,after_index:bigint,after_coord:bigint,before_coord:bigint,gap_size:bigint,missing:int>"
    want = []
    for sample in (1, 2, 3, None):
        there = sorted({c for s, c in rows if s == sample and c is not None})
        want += [(sample, i, a, b, b - a - 1, b - a - 1) for i, (a, b) in enumerate(zip(there, there[1:])) if b - a > 1]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
