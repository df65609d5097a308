import numpy as np
import pytest
from helpers import frame_row, frames_df, png, texture, tiff
from pyspark.sql import functions as F

from scanframe.operators import frames
from scanframe.sources import images, logs, settings_files, sinks
from scanframe.streaming import live


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("scan")
    rgb = np.dstack([texture(5, 7, s) for s in (1, 2, 3)])
    (root / "sample a").mkdir()
    (root / "focus_stacked").mkdir()
    (root / "sample a" / "Y1 F2+3.PNG").write_bytes(png(rgb))
    (root / "sample a" / "Y2.tiff").write_bytes(tiff(rgb))
    (root / "sample a" / "bad.png").write_bytes(b"not an image")
    (root / "sample a" / "notes.txt").write_text("x")
    (root / "focus_stacked" / "Y3.tif").write_bytes(tiff(rgb))
    return root, rgb


def test_discovery_is_case_insensitive_and_knows_folders(spark, folder):
    root, _ = folder
    got = images.list_images(spark, str(root)).orderBy("name").collect()
    assert [r.name for r in got] == ["Y1 F2+3.PNG", "Y2.tiff", "Y3.tif", "bad.png"]
    assert {r.folder for r in got} == {"sample a", "focus_stacked"}
    assert images.list_images(spark, str(root), images.EXTENSIONS["marks"]).count() == 3
    from scanframe.operators import select
    assert select.listed(images.list_images(spark, str(root)).select("path")).count() == 3


def test_decode_keeps_pixels_and_reports_bad_files(spark, folder):
    root, rgb = folder
    good, bad = images.read_frames(spark, str(root / "sample a"))
    rows = {r.name: r for r in good.collect()}
    assert set(rows) == {"Y1 F2+3.PNG", "Y2.tiff"}
    for r in rows.values():
        assert (np.frombuffer(bytes(r.data), np.uint8).reshape(5, 7, 3)[:, :, ::-1] == rgb).all()
    assert [r.reason for r in bad.filter("path like '%bad.png'").collect()] == ["cannot be decoded"]


def test_alpha_goes_over_white(spark):
    img = np.array([[[0, 0, 0, 0], [10, 20, 30, 255]], [[0, 100, 200, 128], [255, 255, 255, 7]]], np.uint8)
    flat = images.flatten_alpha(frames_df(spark, [frame_row(1, img)]), ["frame_id"]).first()
    got = np.frombuffer(bytes(flat.data), np.uint8).reshape(2, 2, 3).tolist()
    assert got[0] == [[255, 255, 255], [10, 20, 30]]
    assert got[1][0] == [127, 177, 227] and got[1][1] == [255, 255, 255]


def test_storage_round_trip(spark, tmp_path):
    rgb, gray, odd = np.dstack([texture(10, 13, s) for s in (4, 5, 6)]), texture(10, 13), np.zeros((4, 4, 2), np.uint8)
    rows = [frame_row(1, rgb, sample_id="a"), frame_row(2, gray, sample_id="b"), frame_row(3, odd, sample_id="b")]
    good, bad = frames.normalise_for_storage(frames_df(spark, rows, "frame_id long, sample_id string"))
    assert [(r.frame_id, r.reason) for r in bad.collect()] == [(3, "unsupported channel count 2")]
    sinks.write_frame_tiles(frames.cut_tiles(good, ["frame_id", "sample_id"], 6), str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles"))
    image = np.zeros((10, 13, 3), np.uint8)
    for t in back.filter("frame_id = 1").collect():
        image[t.y:t.y + t.h, t.x:t.x + t.w] = np.frombuffer(bytes(t.data), np.uint8).reshape(t.h, t.w, 3)
    assert (image == rgb).all()
    assert back.filter("frame_id = 2").select("n_channels").distinct().collect()[0][0] == 3


def test_arriving_files_are_decoded_per_batch(spark, folder, tmp_path):
    root, _ = folder
    seen = []

    def handle(good, bad, batch_id):
        seen.extend(r.name for r in good.select("name").collect())
        seen.extend("reject" for _ in bad.collect())

    stream = live.frame_arrivals(spark, str(root / "sample a"), 2).filter(images.has_extension(F.col("path")))
    q = (stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(live.decode_arrivals(handle))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(seen) == ["Y1 F2+3.PNG", "Y2.tiff", "reject"]


def test_settings_files(spark, tmp_path):
    (tmp_path / "rig").mkdir()
    (tmp_path / "rig" / "default_settings.yaml").write_text(
        '# head\nname: "first#second"\nmax_x: 22000  # steps\nlist: [0, 0, 0]\nempty:\nslots:\n  1: { x: 22.12, y: 200.00, z: 29.00 }\n  2: { x: 1.5, y: 2 }\n')
    (tmp_path / "rig" / "settings.yaml").write_text("max_x: 7\n")
    got = {(r.layer, r.key): r.value for r in settings_files.read_settings(spark, str(tmp_path)).collect()}
    assert got == {("default", "name"): "first#second", ("default", "max_x"): "22000", ("default", "list"): "[0, 0, 0]", ("active", "max_x"): "7"}
    upper = settings_files.read_settings(spark, str(tmp_path), F.upper)
    assert {r.scope for r in upper.collect()} == {"RIG"}
    slots = {r.slot: (r.x_mm, r.y_mm, r.z_mm) for r in settings_files.read_slots(spark, str(tmp_path)).collect()}
    assert slots == {1: (22.12, 200.0, 29.0), 2: (1.5, 2.0, None)}
    from scanframe.plans import control
    enabled = spark.createDataFrame([(0, "a"), (1, "b"), (4, "c")], "row_idx int, name string")
    found, missing = control.enabled_positions(enabled, settings_files.read_slots(spark, str(tmp_path)).drop("scope"))
    assert [(r.slot, r.x) for r in found.collect()] == [(1, 2212)]
    assert sorted(r.slot for r in missing.collect()) == [2, 5]


def test_log_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text("G28\nG0 X1.00\n")
    assert [r.line for r in logs.read_commands(spark, str(tmp_path / "log.txt")).collect()] == ["G28", "G0 X1.00"]
    lines = spark.createDataFrame([
        ("[AF-Coarse] side=right Z=16.20  score=812.5  Δbase=-3.0",), ("[AF-Fine] 0.04mm step up: Z=1.00  score=9.0",), ("noise",)], "line string")
    got = logs.parse_focus(lines).orderBy("phase").collect()
    assert [(r.phase, r.z_mm, r.score, r.delta_base) for r in got] == [("AF-Coarse", 16.2, 812.5, -3.0), ("AF-Fine", 1.0, 9.0, None)]
