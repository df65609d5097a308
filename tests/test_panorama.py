import numpy as np
import pandas as pd
import pytest
from helpers import frame_row, frames_df, texture
from pyspark.sql import functions as F

from scanframe.functions import kernels
from scanframe.operators import canvas, match
from scanframe.plans import panorama


def test_four_matches_give_the_exact_map(spark):
    h = np.array([[1.1, 0.02, 30], [-0.01, 0.95, -12], [1e-4, -5e-5, 1]])
    rng = np.random.default_rng(1)
    rows = []
    for number in range(50):
        src = rng.uniform(0, 600, (4, 2))
        if number % 10 == 0:
            src[2] = 2 * src[1] - src[0]        # three on a line
        p = np.column_stack([src, np.ones(4)]) @ h.T
        rows.append((number, [(float(u / w), float(v / w), float(x), float(y)) for (u, v, w), (x, y) in zip(p, src)]))
    fours = spark.createDataFrame(rows, "number long, m array<struct<x1 double, y1 double, x2 double, y2 double>>")
    got = match.exact_map(fours).collect()
    assert sorted(r.number for r in got) == [n for n in range(50) if n % 10]
    assert all(np.allclose(np.array(r.h).reshape(3, 3), h, atol=1e-6) for r in got)


def test_tiles_and_frames_warp_alike(spark):
    """A projective map from storage tiles of any size gives the pieces that whole frames give."""
    from scanframe.operators import frames as frame_ops
    rows = [frame_row(0, texture(37, 53, 5), sample_id=1, seq=0), frame_row(1, np.dstack([texture(20, 31, k) for k in range(3)])[:, :, :1], sample_id=1, seq=1)]
    frames = frames_df(spark, rows, "sample_id long, seq long")
    maps = spark.createDataFrame([(1, 0, [1.1, 0.05, 3.3, -0.04, 0.93, 2.6, 0.002, -0.001, 1.0]), (1, 1, [0.8, -0.3, 20.2, 0.4, 0.9, -9.7, -0.001, 0.004, 1.0])],
                                 "sample_id long, seq long, h array<double>")
    whole, _ = panorama.warp_blend(frames, maps, 16)
    want = sorted(map(tuple, canvas.canvas_pixels(whole, ["sample_id"]).collect()))
    for source in (7, 64):
        stored = frame_ops.cut_tiles(frames, ["sample_id", "seq"], source)
        tiles, box = panorama.warp_blend_tiles(stored, frames.select("sample_id", "seq", "width", "height"), maps, source, 16)
        assert sorted(map(tuple, canvas.canvas_pixels(tiles, ["sample_id"]).collect())) == want and len(want) > 1500
        assert box.count() == 1


def test_gray_and_colour_tiles_warp_alike(spark):
    """Storage tiles of samples with one and three channels meet in one batch; a canvas tile that a frame only grazes is not covered either way."""
    from scanframe.operators import frames as frame_ops
    rows = [frame_row(n, texture(24, 19, n) if n % 2 else np.dstack([texture(24, 19, n + k) for k in range(3)]), sample_id=n % 2, seq=n // 2) for n in range(6)]
    frames = frames_df(spark, rows, "sample_id long, seq long")
    maps = spark.createDataFrame([(n % 2, n // 2, [1.0 + n / 20, 0.1, 4.5 - n, -0.2, 0.9, n * 1.3, 0.001, -0.002, 1.0]) for n in range(6)], "sample_id long, seq long, h array<double>")
    columns = ["sample_id", "tile_col", "tile_row", "n_channels", "data", "covered"]
    whole, _ = panorama.warp_blend(frames, maps, 16)
    tiles, _ = panorama.warp_blend_tiles(frame_ops.cut_tiles(frames, ["sample_id", "seq"], 7), frames.select("sample_id", "seq", "width", "height"), maps, 7, 16)
    got, want = (sorted(tuple(map(repr, r)) for r in t.select(*columns).collect()) for t in (tiles, whole))
    assert got == want and {r.n_channels for r in tiles.select("n_channels").distinct().collect()} == {1, 3}


@pytest.mark.parametrize("at_once", [1, 50, 1 << 16])
def test_pairs_are_weighed_together(monkeypatch, at_once):
    """Storage tiles of a frame, taken in stretches of any number of pixels, add up to what the whole frame gives."""
    monkeypatch.setattr(canvas, "AT_ONCE", at_once)
    img, back = np.dstack([texture(13, 17, k) for k in range(2)]), np.array([[0.9, 0.2, -3.1], [-0.1, 1.1, 0.7], [0.003, -0.002, 1.0]])
    pairs = pd.DataFrame([{"tile_col": x // 5, "tile_row": y // 5, "to_col": 1, "to_row": 0, "px": 2, "py": 3, "w": 6, "h": 5, "back": back.ravel(), "n_channels": 2,
                           "sh": len(img[y:y + 5]), "sw": img[y:y + 5, x:x + 5].shape[1], "data": img[y:y + 5, x:x + 5].tobytes()} for y in (0, 5, 10) for x in (0, 5, 10, 15)])
    total, weight = np.zeros((30, 2), np.int64), np.zeros(30, np.int64)
    for places, sums, weights in zip(*canvas._pair_sums(pairs, 5, 8), strict=True):
        at = np.frombuffer(places, "<i4")
        total[at] += np.frombuffer(sums, "<i4").reshape(-1, 2)
        weight[at] += np.frombuffer(weights, "<i2")
    want_total, want_weight = canvas.warp_sums(img, back, 3, 8, 10, 16)
    assert (total == want_total.reshape(30, 2)).all() and (weight == want_weight.ravel()).all() and weight.max() == 1024


def test_fold_streams_keys(spark):
    """Keys of one row and of thousands, one of them NULL, come out of one map; none is a pandas group of its own."""
    key = F.when(F.col("id") % 5 == 0, F.lit(7)).when(F.col("id") % 11 > 0, F.col("id"))
    rows = spark.range(20_000).select(key.alias("k"), F.col("id").alias("v"))

    def add(state, row):
        state[0] += 1
        state[1] += row.v

    folded = canvas.fold(rows, ["k"], "n int, total long", lambda row: [0, 0], add, tuple)
    want = {r.k: (r.n, r.total) for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).collect()}
    got = folded.collect()
    assert {r.k: (r.n, r.total) for r in got} == want and len(got) == len(want) and None in want
    assert "FlatMapGroups" not in folded._jdf.queryExecution().toString()


def test_pair_maps_ignore_wrong_matches(spark):
    h = np.array([[1.0, 0.02, 40.0], [-0.02, 1.0, 7.0], [0, 0, 1.0]])
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        x2, y2 = rng.uniform(0, 600, 2)
        u, v, w = h @ (x2, y2, 1)
        if i % 4 == 0:
            u, v = rng.uniform(0, 600, 2)       # a wrong match
        rows.append((0, 0, i, i, float(u / w), float(v / w), float(x2), float(y2)))
    rows += [(0, 1, i, i, 1.0 * i, 2.0 * i, 1.0 * i, 2.0 * i) for i in range(5)]
    points = spark.createDataFrame(rows, "sample_id int, pair_idx long, query long, train long, x1 double, y1 double, x2 double, y2 double")
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "sample_id int, pair_idx long")
    got = {r.pair_idx: r for r in match.pair_homographies(points, pairs).collect()}
    assert got[0].status == "fitted" and got[0].n_inliers >= 90
    assert np.allclose(np.array(got[0].h).reshape(3, 3), h, atol=1e-4)
    assert got[1].status == got[2].status == "too few matches" and got[1].h == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_two_nearest_does_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(0, s, int(1000 * s + k), 0.0, 0.0, rng.normal(size=8).astype(float).tolist()) for s in range(3) for k in range(40)]
    d = spark.createDataFrame(rows, "sample_id int, seq long, kp_id long, px double, py double, desc array<double>")
    columns = ["pair_idx", "query", "train", "rank"]
    one = sorted(map(tuple, match.two_nearest(d).select(*columns).collect()))
    monkeypatch.setattr(match, "BLOCK", 7)
    many = sorted(map(tuple, match.two_nearest(d).select(*columns).collect()))
    assert one == many and len(one) == 160


def test_two_nearest_skips_far_cells(spark, monkeypatch):
    """Descriptors that lie in clusters: most cells are never searched, and what is found is what all pairs give."""
    monkeypatch.setattr(match, "BLOCK", 10)
    rng = np.random.default_rng(6)
    middles = rng.normal(scale=10, size=(30, 6))
    points = {(s, 1000 * s + k): middles[k % 30] + rng.normal(scale=0.05, size=6) for s in range(2) for k in range(600)}
    points[0, 5000], points[1, 5001], points[1, 5002] = (np.full(6, 100.0),) * 3  # far from all, and a tie
    d = spark.createDataFrame([(0, s, k, 0.0, 0.0, v.tolist()) for (s, k), v in points.items()], "sample_id int, seq long, kp_id long, px double, py double, desc array<double>")
    found, first, more = match._two_nearest(d)
    got = {(r["query"], r["rank"]): (r["train"], r["distance"]) for r in found.collect()}
    for (s, k), v in points.items():
        if s == 0:
            want = sorted((float(np.sqrt(((v - w) ** 2).sum())), t) for (u, t), w in points.items() if u == 1)[:2]
            assert [got[k, r][0] for r in (1, 2)] == [t for _, t in want] and abs(got[k, 2][1] - want[1][0]) < 1e-9
    assert len(got) == 2 * 601
    assert first.count() + more.count() < 0.25 * 601 * 60


def test_few_key_points_fall_back_to_identity(spark):
    d = spark.createDataFrame([(0, 0, 1, 0., 0., [1., 2.]), (0, 1, 2, 0., 0., [1., 2.])],
                              "sample_id int, seq long, kp_id long, px double, py double, desc array<double>")
    images = spark.createDataFrame([(0, 0), (0, 1)], "sample_id int, seq long")
    maps = panorama.image_maps(d, images).collect()
    assert len(maps) == 2 and all(m.h == [1, 0, 0, 0, 1, 0, 0, 0, 1] for m in maps)


@pytest.mark.parametrize("width", [100, 4, 3, 2])
def test_prefix_products_match_numpy(spark, width):
    rng = np.random.default_rng(9)
    hs = [np.eye(3) + rng.normal(scale=0.05, size=(3, 3)) * [[1, 1, 20], [1, 1, 20], [1e-3, 1e-3, 0]] for _ in range(14)]
    df = spark.createDataFrame([(0, i, h.ravel().tolist()) for i, h in enumerate(hs)], "sample_id int, pair_idx long, h array<double>")
    got = {r.seq: np.array(r.h).reshape(3, 3) for r in match.global_homographies(df, width).collect()}
    want = np.eye(3)
    for i, h in enumerate([None, *hs]):
        want = want if h is None else want @ h
        assert np.allclose(got[i], want / want[2, 2], rtol=1e-9)


def test_grid_of_cuts_blends_back(spark):
    picture = texture(60, 90, 8)
    rows, maps = [], []
    for n, (x, y) in enumerate((x, y) for y in (0, 20, 40) for x in (0, 30, 60)):
        part = picture[y:y + 20, x:x + 30]
        rows.append(frame_row(n, part, sample_id=1, seq=n))
        maps.append((1, n, [1.0, 0.0, x - 10.0, 0.0, 1.0, y - 5.0, 0.0, 0.0, 1.0]))
    frames = frames_df(spark, rows, "frame_id long, sample_id int, seq long")
    tiles, box = panorama.warp_blend(frames, spark.createDataFrame(maps, "sample_id int, seq long, h array<double>"), tile=32)
    image = np.zeros((60, 90), np.uint8)
    for p in panorama.crop(canvas.canvas_pixels(tiles, ["sample_id"]), box).collect():
        image[p.canvas_y, p.canvas_x] = p.v
    assert (image == picture).all()


def test_half_pixel_shift_interpolates(spark):
    img = np.array([[0, 100], [0, 100]], np.uint8)
    frames = frames_df(spark, [frame_row(0, img, sample_id=1, seq=0)], "frame_id long, sample_id int, seq long")
    maps = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "sample_id int, seq long, h array<double>")
    tiles, _ = panorama.warp_blend(frames, maps, tile=4)
    got = {(p.canvas_y, p.canvas_x): p.v for p in canvas.canvas_pixels(tiles, ["sample_id"]).collect()}
    assert got[(0, 1)] == 50 and got[(0, 0)] == 0


def test_focus_stack_takes_the_sharp_frame(spark):
    sharp, flat = texture(20, 20, 1), np.full((20, 20), 90, np.uint8)
    left, right = flat.copy(), flat.copy()
    left[:, :10], right[:, 10:] = sharp[:, :10], sharp[:, 10:]
    rows = [frame_row(i, p, sample_id=1, seq=i) for i, p in enumerate((flat, left, right))]
    fused = canvas.focus_stack(frames_df(spark, rows, "frame_id long, sample_id int, seq long"), tile=8)
    px = {(p.y, p.x): (p.v, p.source_seq) for p in canvas.stacked_pixels(fused, "sample_id", 8).collect()}
    assert all(px[(y, x)] == (sharp[y, x], 1) for y in range(20) for x in range(8) if kernels.abs_laplacian(kernels.blur(left))[y, x] > 0)
    assert sum(px[(y, x)][1] == 2 for y in range(20) for x in range(12, 20)) > 150
