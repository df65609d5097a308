import json

import numpy as np
import pytest
from helpers import frame_row, frames_df, smooth, texture
from pyspark.sql import functions as F

from scanframe.operators import align, canvas
from scanframe.plans import mosaics

W, H = 200, 150


def cut(picture, places):
    """Frames of a picture at (x, y)."""
    return [frame_row(i, picture[y:y + H, x:x + W], sample_id=1, seq=i) for i, (x, y) in enumerate(places)]


@pytest.fixture(scope="module")
def scan(spark):
    picture = smooth(H + 40, 700, 11)
    # frame i+1 starts 200 - overlap to the right and dy lower
    overlaps, dys = [120, 108, 132], [3, -2, 4]
    places, x, y = [(0, 20)], 0, 20
    for o, d in zip(overlaps, dys):
        x, y = x + W - o, y + d
        places.append((x, y))
    frames = frames_df(spark, cut(picture, places), "frame_id long, sample_id int, seq long").persist()
    return picture, places, overlaps, dys, frames


FULL = align.Search(coarse_step=4, grid=(2, 1), fine_radius=(2, 2), fine_step=(1, 1))


def test_known_shifts_are_found(scan):
    _, _, overlaps, dys, frames = scan
    got = mosaics.align_pairs(frames, search=FULL).orderBy("pair_idx").collect()
    assert [r.x_overlap for r in got] == overlaps
    assert [r.y_offset for r in got] == dys
    assert all(r.score > 0.999 and r.complete for r in got)


def test_reference_grid_comes_close(scan):
    _, _, overlaps, _, frames = scan
    got = align.find_alignments(align.strips(frames)).orderBy("pair_idx").collect()
    assert all(abs(r.x_overlap - o) <= 40 for r, o in zip(got, overlaps))
    assert all(r.coarse_tried > 0 and r.fine_tried > 0 for r in got)


def test_history_rounds_settle_on_the_same_pairs(scan):
    _, _, overlaps, dys, frames = scan
    got = align.align_with_history(align.strips(frames), FULL).orderBy("pair_idx").collect()
    assert [(r.x_overlap, r.y_offset) for r in got] == list(zip(overlaps, dys))


def test_scan_along_y_is_turned(spark, scan):
    _, _, overlaps, dys, _ = scan
    picture, places = scan[0], scan[1]
    rows = cut(picture, places)
    turned = [frame_row(r["frame_id"], np.rot90(np.frombuffer(bytes(r["data"]), np.uint8).reshape(H, W), -1), sample_id=1, seq=r["seq"]) for r in rows]
    got = mosaics.align_pairs(frames_df(spark, turned, "frame_id long, sample_id int, seq long"), axis="y", search=FULL).orderBy("pair_idx").collect()
    assert [r.x_overlap for r in got] == overlaps and [r.y_offset for r in got] == dys


def test_assembled_frames_restore_the_picture(spark):
    picture = texture(H, 500, 5)
    places = [(0, 0), (90, 0), (170, 0), (290, 0)]
    frames = frames_df(spark, cut(picture, places), "frame_id long, sample_id int, seq long")
    pairs = spark.createDataFrame([(1, i, W - (places[i + 1][0] - places[i][0]), 0) for i in range(3)],
                                  "sample_id int, pair_idx long, x_overlap int, y_offset int")
    for center in (False, True):
        pixels = canvas.canvas_pixels(mosaics.assemble(frames, pairs, 64, center), ["sample_id"]).collect()
        image = np.zeros((H, 490), np.uint8)
        for p in pixels:
            image[p.canvas_y, p.canvas_x] = p.v
        assert (image == picture[:, :490]).all()


def test_refinement_touches_weak_pairs_only(spark, scan):
    _, _, overlaps, dys, frames = scan
    rows = [(1, 0, 0, 1, overlaps[0], dys[0], 1.0, 0.99, "HIGH", []), (1, 1, 1, 2, 60, 9, 0.4, 0.4, "LOW", ["X"]),
            (1, 2, 2, 3, overlaps[2], dys[2], 1.0, 0.99, "HIGH", [])]
    pairs = spark.createDataFrame(rows, "sample_id int, pair_idx long, coord long, next_coord long, x_overlap int, y_offset int, "
                                        "score double, coarse_score double, confidence string, flags array<string>")
    out, judged = mosaics.refine_pairs(pairs, frames)
    got = {r.pair_idx: r for r in out.collect()}
    assert judged.count() == 1 and judged.first().reason == "score improved"
    assert got[0].x_overlap == overlaps[0] and got[0].flags == []
    assert abs(got[1].x_overlap - overlaps[1]) <= 1 and abs(got[1].y_offset - dys[1]) <= 1 and got[1].score > 0.4
    assert got[1].flags[0].startswith("REFINED(+")


def test_manual_scores(spark, scan):
    _, _, overlaps, dys, frames = scan
    offsets = spark.createDataFrame([(1, 0, overlaps[0], dys[0]), (1, 1, 500, 0), (1, 2, 100, 148)],
                                    "sample_id int, pair_idx long, x_overlap int, y_offset int")
    got = {r.pair_idx: r for r in mosaics.manual_score(frames, offsets).collect()}
    assert got[0].score == pytest.approx(1.0) and got[0].band == "VERY HIGH"
    assert (got[1].status, got[1].band) == ("No overlap", "N/A") and got[2].status == "Insufficient height"


def test_document(spark):
    frames = spark.createDataFrame([(1, i, 200, 150, f"Y{i}.tiff", f"/s/Y{i}.tiff") for i in range(3)],
                                   "sample_id int, seq long, width int, height int, name string, path string")
    pairs = spark.createDataFrame([(1, 0, 50, 3, .99, "HIGH", []), (1, 1, 60, -2, .9, "MEDIUM", ["LOW_FINAL_SCORE(0.9000)"])],
                                  "sample_id int, pair_idx long, x_overlap int, y_offset int, score double, confidence string, flags array<string>")
    timings = spark.createDataFrame([(1, "load", 1.0), (1, "load", 3.0)], "sample_id int, category string, seconds double")
    rows = mosaics.alignment_document(frames, pairs, "y", 90, F.lit("now"), timings).orderBy("part", "number").collect()
    assert [(r.part, r.number) for r in rows] == [("header", 0), ("image", 0), ("image", 1), ("image", 2), ("pair", 0), ("pair", 1)]
    doc = json.loads(rows[0].document)
    doc |= {"images": [json.loads(r.document) for r in rows[1:4]], "alignment_pairs": [json.loads(r.document) for r in rows[4:]]}
    assert doc["timing"] == {"load": {"count": 2, "total": 4.0, "mean": 2.0, "min": 1.0, "max": 3.0}}
    assert doc["parameters"] == {"axis": "y", "rotate_180": False, "rotate_90": True, "rotate_270": False, "num_images": 3}
    assert [i["final_x_position"] for i in doc["images"]] == [0, 100, 190] and doc["images"][0]["width"] == 150
    assert doc["final_canvas"] == {"width": 340, "height": 205, "min_y_offset": -2}
    assert doc["alignment_pairs"][1]["outlier_flags"] == ["LOW_FINAL_SCORE(0.9000)"]


def test_parameter_checks():
    assert mosaics.search_errors(0.3, 0.95, 0.7, (False, False, False)) == []
    assert len(mosaics.search_errors(0.0, 1.5, 2.0, (True, True, False))) == 4
    assert len(mosaics.search_errors(0.9, 0.5, 0.7, (False, False, False))) == 1


def test_unequal_heights_are_compared_in_the_middle(spark):
    picture = smooth(H, 400, 5)
    rows = [frame_row(0, picture[:, :W], sample_id=1, seq=0), frame_row(1, picture[20:H - 20, W - 80:2 * W - 80], sample_id=1, seq=1)]
    frames = frames_df(spark, rows, "frame_id long, sample_id int, seq long")
    got = align.find_alignments(align.strips(frames, "x", 0, 0.95), FULL).first()
    assert abs(got.coarse_overlap - 80) <= 4 and got.coarse_score > 0.9
