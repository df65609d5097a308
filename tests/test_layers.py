"""Mosaics of mosaics and merge trees: pictures cut into overlapping frames come back whole."""

import numpy as np
import pytest
from helpers import smooth

from scanframe.operators import align, layers
from scanframe.plans import mosaics

FRAMES = "sample_id long, layer long, seq long, width int, height int, n_channels int, data binary"


def texture(h, w, channels=1, seed=4):
    """Details some pixels wide, as a coarse scan without shift needs, and some noise."""
    noise = np.random.default_rng(seed).integers(0, 24, (h, w, channels))
    planes = np.dstack([smooth(h, w, seed + 100 * c, 8) for c in range(channels)]).astype(int)
    return np.clip(planes + noise, 0, 255).astype(np.uint8)


def noise(h, w, seed):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 1), dtype=np.uint8)


def frame(sample, layer, seq, img):
    return sample, layer, seq, img.shape[1], img.shape[0], img.shape[2], np.ascontiguousarray(img).tobytes()


def picture(tiles, sample):
    rows = [r for r in tiles.collect() if r["sample_id"] == sample]
    size = rows[0]["size"]
    out = np.zeros(((max(r["tile_row"] for r in rows) + 1) * size, (max(r["tile_col"] for r in rows) + 1) * size, rows[0]["n_channels"]), np.uint8)
    mask = np.zeros(out.shape[:2], np.uint8)
    for r in rows:
        at = (slice(r["tile_row"] * size, (r["tile_row"] + 1) * size), slice(r["tile_col"] * size, (r["tile_col"] + 1) * size))
        out[at] = np.frombuffer(r["data"], np.uint8).reshape(size, size, -1)
        mask[at] = np.frombuffer(r["covered"], np.uint8).reshape(size, size)
    ys, xs = np.nonzero(mask)
    box = (slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1))
    return out[box], mask[box]


SEARCH = align.small_search(min_overlap=0.2, x_range=6, grid=(1, 1), y_tiers=(2, 2, 3, 3))


@pytest.mark.parametrize(("by", "tile"), [("y", 16), ("x", 64)])
def test_grid_comes_back_whole(spark, by, tile):
    """Three layers of four frames of 24 x 20 pixels, each layer shifted along itself; single frames of a layer are left out."""
    rows, whole = [], {}
    for sample, channels in ((7, 1), (8, 3)):
        big = texture(60, 90, channels, sample)
        whole[sample] = big
        for layer in range(3):
            for seq in range(4):
                img = big[layer * 14:layer * 14 + 20, layer * 2 + seq * 17:layer * 2 + seq * 17 + 24]
                rows.append(frame(sample, layer * 10, seq, img if by == "y" else img.transpose(1, 0, 2)))
        rows.append(frame(sample, 99, 0, texture(20, 24, channels, 77)))
    found = mosaics.grid_mosaic(spark.createDataFrame(rows, FRAMES), by, SEARCH, SEARCH, tile=tile)
    assert {(r["sample_id"], r["pair_idx"]): (r["overlap"], r["shift"]) for r in found.layer_pairs.collect()} == {(s, p): (6, 2) for s in (7, 8) for p in (0, 1)}
    assert {(r["x_overlap"], r["y_offset"]) for r in found.frame_pairs.collect()} == {(7, 0)}
    for sample, big in whole.items():
        got, mask = picture(found.tiles, sample)
        want = big[:48, :79]
        if by == "x":
            want = want.transpose(1, 0, 2)
        assert got.shape == want.shape and (got[mask > 0] == want[mask > 0]).all()
        assert mask.sum() == 20 * 75 + 2 * 14 * 75 + 2 * 6 * 2  # three layers of 75 columns, each 2 further on


def test_layer_sums_do_not_depend_on_the_tiles(spark):
    """Edges compared in columns of any width give the same scores, and those of the plain correlation."""
    big = texture(40, 100, 1, 3)
    upper, lower = big[:22], big[15:37]
    rows = [frame(1, layer, seq, img[:, seq * 40:seq * 40 + 60]) for layer, img in ((0, upper), (1, lower)) for seq in range(2)]
    results = [mosaics.grid_mosaic(spark.createDataFrame(rows, FRAMES), "y", SEARCH, SEARCH, tile=t).layer_pairs.first() for t in (8, 32, 128)]
    assert all((r["overlap"], r["shift"]) == (7, 0) and abs(r["score"] - 1) < 1e-9 for r in results)
    assert len({r["coarse_score"] for r in results}) == 1


def test_tree_leaves_out_what_fails(spark):
    """Eleven frames of one strip; frame 5 shows something else: it stays out, and so does what lies behind the hole it leaves."""
    big = texture(20, 400, 1, 9)
    rows = [(3, s, 24, 20, 1, np.ascontiguousarray(noise(20, 24, 50) if s == 5 else big[:, s * 17:s * 17 + 24]).tobytes()) for s in range(11)]
    found = mosaics.merge_by_tree(spark.createDataFrame(rows, "sample_id long, seq long, width int, height int, n_channels int, data binary"), SEARCH, 0.999, tile=32)
    plan = {(r["level"], r["node"]): r for r in found.plan.collect()}
    assert plan[1, 2]["action"] == "keep_left" and plan[1, 5]["action"] == "carry"
    # frame 6 no longer meets its neighbour: with 5 lost, frame 4 is 34 columns away and the frames share nothing
    assert (plan[2, 1]["left"], plan[2, 1]["right"], plan[2, 1]["action"]) == (4, 6, "keep_left")
    assert (plan[3, 0]["left"], plan[3, 0]["right"], plan[3, 0]["action"]) == (3, 4, "merge")
    assert (plan[4, 0]["left"], plan[4, 0]["right"], plan[4, 0]["action"]) == (4, 8, "keep_left")
    assert [(r["seq"], r["x_pos"], r["y_pos"]) for r in found.placed.orderBy("seq").collect()] == [(s, 17 * s, 0) for s in range(5)]
    got, mask = picture(found.tiles, 3)
    assert mask.all() and (got == big[:, :92]).all()


def test_tree_of_single_frames(spark):
    rows = [(s, 0, 4, 4, 1, bytes(16)) for s in range(2)]
    frames = spark.createDataFrame(rows, "sample_id long, seq long, width int, height int, n_channels int, data binary")
    for df in (frames, frames.limit(0)):
        found = mosaics.merge_by_tree(df, SEARCH, tile=8)
        assert found.plan.count() == 0 and found.placed.count() == df.count() and found.tiles.count() == df.count()


def test_tile_checksums(spark):
    tiles = spark.createDataFrame([(1, 0, 2, 2, 1, bytes([5, 6, 7, 8]), bytes([1, 0, 1, 1]))], "sample_id long, tile_col int, tile_row int, size int, n_channels int, data binary, covered binary")
    assert tuple(layers.tile_checksums(tiles, ["sample_id"]).first()) == (1, 0, 2, 3, 20, 5 + 21 + 32)
    back = layers.transposed_tiles(tiles).first()
    assert (back["tile_col"], back["tile_row"], list(back["data"]), list(back["covered"])) == (2, 0, [5, 7, 6, 8], [1, 1, 0, 1])


def test_layer_columns_stream_through_small_batches(spark):
    """A column's pieces may come in several batches; no column is a group of its own to pandas."""
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 256, (6, 40)) for _ in range(2))
    pieces = [(1, 0, side, band + at, x, 0, w, 6, np.ascontiguousarray(img[:, c:c + w]).astype(np.uint8).tobytes())
              for side, img in ((0, a), (1, b)) for band in range(5) for at, x, c, w in [(0, 0, 8 * band, 8)] + ([(-1, 8, 8 * band, 2), (1, -2, 8 * band + 6, 2)] if side else []) if 0 <= band + at]
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        sums = layers.candidate_sums(spark.createDataFrame(pieces, f"sample_id long, {layers.PIECE}"), spark.createDataFrame([(1, 0, 40, 40, 6)], "sample_id long, pair_idx long, wa int, wb int, high int"),
                                     spark.createDataFrame([(1, 0, 2, 6, 2, -2, 2, 1)], "sample_id long, pair_idx long, " + ", ".join(f"{c} int" for c in layers.SPEC)), 8, 2, 3)
        got, plan = {(r["overlap"], r["shift"]): tuple(r[c] for c in layers.SUMS) for r in sums.collect()}, sums._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    expected = {}
    for o in (2, 4, 6):
        for s in range(-2, 3):
            x, y = a[6 - o:, max(0, s):40 + min(0, s)], b[:o, max(0, -s):40 - max(0, s)]
            expected[o, s] = (x.size, x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum())
    assert got == expected
    assert "FlatMapGroupsInPandas" not in plan
