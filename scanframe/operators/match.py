"""Descriptor matching and projective maps between consecutive images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.session import cut_lineage

PAIR = ["sample_id", "pair_idx"]
BLOCK = 2048


def _nearest_two(queries: np.ndarray, trains: np.ndarray, ids: np.ndarray) -> list[list[tuple[int, float]]]:
    """Two nearest trains (id, distance) per query, smaller id on a tie.

    A matrix product picks the few candidates that can be among the two (with a margin for its rounding); their distances
    are then taken exactly.
    """
    aa, bb = (queries ** 2).sum(1), (trains ** 2).sum(1)
    rough = aa[:, None] + bb[None] - 2.0 * (queries @ trains.T)
    second = np.partition(rough, min(1, len(trains) - 1), axis=1)[:, min(1, len(trains) - 1)]
    margin = 1e-9 * (aa + bb.max())
    found = []
    for i, line in enumerate(rough):
        near = np.flatnonzero(line <= second[i] + margin[i])
        exact = ((queries[i] - trains[near]) ** 2).sum(1)
        order = np.lexsort((ids[near], exact))[:2]
        found.append([(int(ids[near[j]]), float(np.sqrt(exact[j]))) for j in order])
    return found


def _cells(descriptors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every image as cells around centres: the descriptors with their ``cell``, and (image, centres, radii, counts) per image.

    About one centre to BLOCK descriptors, picked by hash; a descriptor goes to the nearest. Parts of an image are dealt to
    their cells in tasks of their own, each of which gets the image's centres.
    """
    image = ["sample_id", "seq"]
    n = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    sizes = descriptors.groupBy(*image).agg(n.alias("n_cells"))
    keyed = descriptors.join(sizes, image).withColumn("part", F.pmod(F.xxhash64("kp_id"), F.col("n_cells")).cast("int"))
    centres = keyed.groupBy(*image, "part").agg(F.min_by("desc", F.struct(F.xxhash64("kp_id", F.lit(7)), "kp_id")).alias("centre"))
    listed = cut_lineage(centres.groupBy(*image).agg(F.sort_array(F.collect_list(F.struct("part", "centre"))).alias("c")).select(
        *image, F.transform("c", lambda v: v["centre"]).alias("centres")))
    copies = listed.join(sizes, image).select(
        F.col("sample_id").alias("c_sample"), F.col("seq").alias("c_seq"), F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1)).alias("c_part"), "centres")
    kind = descriptors.schema["sample_id"].dataType.simpleString()

    def dealt(key: tuple, rows: pd.DataFrame, image_centres: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=["sample_id", "seq", "kp_id", "desc", "cell", "away"])
        c = np.stack(image_centres["centres"].iloc[0]).astype(np.float64)
        a = np.stack(rows["desc"].to_numpy()).astype(np.float64)
        rough = (a ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None] - 2.0 * (a @ c.T)
        cell = rough.argmin(1)
        return pd.DataFrame({"sample_id": key[0], "seq": key[1], "kp_id": rows["kp_id"], "desc": rows["desc"], "cell": cell, "away": np.sqrt(((a - c[cell]) ** 2).sum(1))})

    placed = cut_lineage(keyed.select(*image, "part", "kp_id", "desc").groupBy(*image, "part").cogroup(copies.groupBy("c_sample", "c_seq", "c_part")).applyInPandas(
        dealt, f"sample_id {kind}, seq long, kp_id long, desc array<double>, cell int, away double"))
    found = placed.groupBy(*image, "cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    cells = found.groupBy(*image).agg(F.sort_array(F.collect_list(F.struct("cell", "radius", "n"))).alias("cells"))
    return placed, cut_lineage(listed.join(cells, image))


#: A cell is searched if it may hold a nearer one; distances come with rounding of this relative size.
SLACK = 1e-9


def _asked(queries: DataFrame, cells: DataFrame, known: bool) -> DataFrame:
    """(pair, cell, kp_id, desc) of the cells of the next image that a query has to search.

    First the nearest cells that hold two descriptors together; once a query has a second nearest (``limit``), the others
    whose lower bound, distance to the centre less radius, doesn't exceed it.
    """
    kind = queries.schema["sample_id"].dataType.simpleString()
    spread = F.pmod(F.xxhash64("kp_id"), F.greatest("parts", F.lit(1))).cast("int")
    parts = queries.groupBy("sample_id", "pair_idx").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    rows = queries.join(parts, PAIR).withColumn("part", spread)
    targets = cells.select("sample_id", (F.col("seq") - 1).alias("pair_idx"), "centres", "cells").join(parts, PAIR).select(
        F.col("sample_id").alias("c_sample"), F.col("pair_idx").alias("c_pair"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c_part"), "centres", "cells")

    def plan(key: tuple, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(t):
            info = t["cells"].iloc[0]
            number, radius, n = (np.array([c[f] for c in info]) for f in ("cell", "radius", "n"))
            c = np.stack(t["centres"].iloc[0]).astype(np.float64)[number]
            a = np.stack(q["desc"].to_numpy()).astype(np.float64)
            for i, (kp, desc) in enumerate(zip(q["kp_id"], q["desc"], strict=True)):
                away = np.sqrt(((c - a[i]) ** 2).sum(1))
                order = np.argsort(away, kind="stable")
                first = order[:np.searchsorted(np.cumsum(n[order]), min(2, n.sum())) + 1]
                if known:
                    limit = q["limit"].iloc[i]
                    near = np.flatnonzero(away - radius <= limit + SLACK * (away + limit))
                    wanted = np.setdiff1d(near, first)
                else:
                    wanted = first
                out.extend((key[0], key[1], int(number[w]), kp, desc) for w in wanted)
        return pd.DataFrame(out, columns=["sample_id", "pair_idx", "cell", "query", "q_desc"])

    return rows.groupBy(*PAIR, "part").cogroup(targets.groupBy("c_sample", "c_pair", "c_part")).applyInPandas(
        plan, f"sample_id {kind}, pair_idx long, cell int, query long, q_desc array<double>")


def _searched(asked: DataFrame, placed: DataFrame) -> DataFrame:
    """The two nearest of every (query, cell) that is asked for. Queries of a busy cell are dealt out; each part reads the cell."""
    kind = placed.schema["sample_id"].dataType.simpleString()
    load = asked.groupBy(*PAIR, "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("loads"))
    trains = placed.select("sample_id", (F.col("seq") - 1).alias("pair_idx"), "cell", "kp_id", "desc").join(load, [*PAIR, "cell"]).select(
        F.col("sample_id").alias("c_sample"), F.col("pair_idx").alias("c_pair"), F.col("cell").alias("c_cell"), F.explode(F.sequence(F.lit(0), F.col("loads") - 1)).alias("c_part"),
        "kp_id", "desc")
    rows = asked.join(load, [*PAIR, "cell"]).withColumn("part", F.pmod(F.xxhash64("query"), F.col("loads")).cast("int")).drop("loads")

    def nearest(key: tuple, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(t):
            a, b = (np.stack(d.to_numpy()).astype(np.float64) for d in (q["q_desc"], t["desc"]))
            ids, who = t["kp_id"].to_numpy(), q["query"].to_numpy()
            for lo in range(0, len(a), 256):
                for i, pair in enumerate(_nearest_two(a[lo:lo + 256], b, ids)):
                    out.extend((key[0], key[1], who[lo + i], train, distance) for train, distance in pair)
        return pd.DataFrame(out, columns=["sample_id", "pair_idx", "query", "train", "distance"])

    keys = [*PAIR, "cell", "part"]
    return rows.groupBy(*keys).cogroup(trains.groupBy("c_sample", "c_pair", "c_cell", "c_part")).applyInPandas(nearest, f"sample_id {kind}, pair_idx long, query long, train long, distance double")


def two_nearest(descriptors: DataFrame) -> DataFrame:
    """Exact two nearest descriptors (L2) of the next image for every descriptor: query, train, distance, rank.

    ``descriptors``: sample_id, seq, kp_id, desc. Images are cut into cells of near descriptors. A query first searches the
    nearest cell or cells; with the second distance found there it skips every cell that lies further away altogether, so
    of two large images that look like anything most cells never meet. Results do not depend on the cut.
    """
    return _two_nearest(descriptors)[0]


def _two_nearest(descriptors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The result, and what the first and the second search asked for."""
    placed, cells = _cells(descriptors.select("sample_id", F.col("seq").cast("bigint").alias("seq"), F.col("kp_id").cast("bigint").alias("kp_id"), F.col("desc").cast("array<double>").alias("desc")))
    queries = placed.select("sample_id", F.col("seq").alias("pair_idx"), "kp_id", "desc")
    first = cut_lineage(_asked(queries, cells, False))
    near = cut_lineage(_searched(first, placed))
    # with fewer than two in the whole image there is nothing more to find; the bound is the second of those found
    place = F.row_number().over(Window.partitionBy(*PAIR, "query").orderBy("distance", "train"))  # two rows per cell
    second = near.withColumn("rank", place).filter("rank = 2").select(*PAIR, F.col("query").alias("kp_id"), F.col("distance").alias("limit"))
    more = cut_lineage(_asked(queries.join(second, [*PAIR, "kp_id"]), cells, True))
    every = near.unionByName(_searched(more, placed))
    return every.withColumn("rank", place).filter("rank <= 2"), first, more


def ratio_matches(nearest: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Matches whose nearest is clearly nearer than the second; a query without a second has none."""
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    both = nearest.groupBy(*PAIR, "query").agg(pick(1, "train").alias("train"), pick(1, "distance").alias("distance"),
                                               pick(2, "distance").alias("second"))
    return both.filter(F.col("distance") < ratio * F.col("second"))


def with_points(matches: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Adds the key-point coordinates: (x1, y1) of the first image, (x2, y2) of the next."""
    point = lambda shift, k, x, y: descriptors.select(
        "sample_id", (F.col("seq") - shift).alias("pair_idx"), F.col("kp_id").alias(k), F.col("px").alias(x), F.col("py").alias(y))
    return (matches.join(point(0, "query", "x1", "y1"), [*PAIR, "query"]).join(point(1, "train", "x2", "y2"), [*PAIR, "train"]))


def _reprojection(h: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    """Squared distance between the mapped (x, y) and (u, v)."""
    w = h[6] * x + h[7] * y + h[8]
    dx = F.try_divide(h[0] * x + h[1] * y + h[2], w) - u
    dy = F.try_divide(h[3] * x + h[4] * y + h[5], w) - v
    return dx * dx + dy * dy


def _number(*parts: Column) -> Column:
    """A whole number from the MD5 of some values: draws that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def _basis(m: Column, x: str, y: str) -> tuple[list[Column], Column]:
    """The 3x3 matrix (rows) that takes the unit triangle and the point (1, 1, 1) to four points; and the least area of any three."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((m[i][x], m[i][y]) for i in range(4))
    area = lambda px, py, qx, qy, rx, ry: px * (qy - ry) + qx * (ry - py) + rx * (py - qy)
    first, second, third = area(dx, dy, bx, by, cx, cy), area(ax, ay, dx, dy, cx, cy), area(ax, ay, bx, by, dx, dy)
    least = F.least(F.abs(first), F.abs(second), F.abs(third), F.abs(area(ax, ay, bx, by, cx, cy)))
    return [first * ax, second * bx, third * cx, first * ay, second * by, third * cy, first, second, third], least


def exact_map(fours: DataFrame) -> DataFrame:
    """Adds ``h``, the projective map that takes the second points of four matches (``m``: array of x1, y1, x2, y2) exactly to the first.

    Both quadruples are images of one basis, so the map is one basis matrix times the adjugate of the other: no equations
    are solved. Rows are left out where three points lie on a line.
    """
    to, wide = _basis(F.col("m"), "x1", "y1")
    of, narrow = _basis(F.col("m"), "x2", "y2")
    based = fours.withColumns({"__to": F.array(*to), "__of": F.array(*of), "__least": F.least(wide, narrow)}).filter("__least > 1e-6")
    t, o = (lambda i: F.col("__to")[i]), (lambda i: F.col("__of")[i])
    minor = lambda i, j, k, n: o(i) * o(j) - o(k) * o(n)
    adjugate = [minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5), minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3)]
    turned = based.withColumn("__adj", F.array(*adjugate))
    g = lambda i: F.col("__adj")[i]
    cells = [t(3 * i) * g(j) + t(3 * i + 1) * g(3 + j) + t(3 * i + 2) * g(6 + j) for i in range(3) for j in range(3)]
    made = turned.withColumn("__h", F.array(*cells)).filter("abs(__h[8]) > 0")
    return made.withColumn("h", F.transform("__h", lambda v: v / F.col("__h")[8])).drop("__to", "__of", "__least", "__adj", "__h")


def hypotheses(points: DataFrame, trials: int) -> DataFrame:
    """Candidate maps (sample_id, pair_idx, number, h), one from each of ``trials`` draws of four matches.

    All matches of a pair are dealt to the draws by hash, a pair of few matches several times over (about eight to a
    draw at least); a draw keeps the four of lowest hash, so no task sees a pair's matches together. Of draws that keep the
    same four the first counts.
    """
    counts = points.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("__n"))
    deals = points.join(counts, PAIR).withColumn("deal", F.explode(F.sequence(F.lit(1), F.ceil(8 * trials / F.col("__n")).cast("int"))))
    drawn = deals.withColumn("draw", F.pmod(_number(F.col("query"), F.col("train"), F.col("deal")), F.lit(trials))).dropDuplicates([*PAIR, "draw", "query", "train"])
    pick = F.row_number().over(Window.partitionBy(*PAIR, "draw").orderBy(_number(F.col("train"), F.col("query"), F.col("draw")), "query", "train"))
    sample = drawn.withColumn("pick", pick).filter(F.col("pick") <= 4)
    fours = sample.groupBy(*PAIR, "draw").agg(F.sort_array(F.collect_list(F.struct("query", "train", "x1", "y1", "x2", "y2"))).alias("m")).filter(F.size("m") == 4)
    same = fours.groupBy(*PAIR, F.transform("m", lambda v: F.struct(v["query"], v["train"])).alias("which")).agg(F.min(F.struct("draw", "m")).alias("d"))
    return exact_map(same.select(*PAIR, F.col("d.draw").alias("number"), F.col("d.m").alias("m"))).select(*PAIR, "number", "h")


def count_inliers(points: DataFrame, hyps: DataFrame, reach_px: float) -> DataFrame:
    """Matches within ``reach_px`` of every hypothesis (sample_id, pair_idx, number, h), counted before the shuffle.

    A pair's hypotheses, as many as there are draws, travel as one row.
    """
    error = _reprojection(F.col("v.h"), F.col("x2"), F.col("y2"), F.col("x1"), F.col("y1"))
    listed = hyps.groupBy(*PAIR).agg(F.collect_list(F.struct("number", "h")).alias("hs"))
    return (points.join(listed, PAIR).select(*PAIR, "x1", "y1", "x2", "y2", F.explode("hs").alias("v"))
            .filter(error <= reach_px * reach_px).groupBy(*PAIR, F.col("v.number").alias("number")).agg(F.count(F.lit(1)).alias("inliers")))


# rows of the direct linear transform as products: upper triangle of a symmetric 9x9 matrix
TRIANGLE = [(i, j) for i in range(9) for j in range(i, 9)]
SCALE = 1024.0


def _smallest_direction(sums: pd.Series) -> pd.Series:
    """Eigenvector of the smallest eigenvalue of the summed 9x9 matrix, back in pixels."""
    def solve(values) -> list[float] | None:
        if values is None:
            return None
        m = np.zeros((9, 9))
        for (i, j), v in zip(TRIANGLE, values):
            m[i, j] = m[j, i] = v
        h = np.linalg.eigh(m)[1][:, 0].reshape(3, 3)
        unit = np.diag([1 / SCALE, 1 / SCALE, 1.0])
        h = np.linalg.inv(unit) @ h @ unit
        return None if abs(h[2, 2]) < 1e-12 else (h / h[2, 2]).ravel().tolist()
    return sums.map(solve)


def _least_squares(inliers: DataFrame) -> DataFrame:
    """Map fitted to all inliers: 45 sums per pair in Spark, one 9x9 eigenvector per pair at the end."""
    x, y, u, v = (F.col(c) / SCALE for c in ("x2", "y2", "x1", "y1"))
    one, zero = F.lit(1.0), F.lit(0.0)
    first = (-x, -y, -one, zero, zero, zero, u * x, u * y, u)
    second = (zero, zero, zero, -x, -y, -one, v * x, v * y, v)
    sums = [F.sum(first[i] * first[j] + second[i] * second[j]).alias(f"m{i}{j}") for i, j in TRIANGLE]
    smallest = F.pandas_udf(_smallest_direction, "array<double>")
    return inliers.groupBy(*PAIR).agg(*sums).select(
        *PAIR, smallest(F.array(*[F.col(f"m{i}{j}") for i, j in TRIANGLE])).alias("fitted"))


def pair_homographies(points: DataFrame, every_pair: DataFrame, min_matches: int = 8, reach_px: float = 5.0, trials: int = 256,
                      refit: bool = True) -> DataFrame:
    """3x3 map (row-major, 9 numbers) from image ``pair_idx + 1`` to image ``pair_idx`` for every pair.

    ``trials`` is the number of hypotheses, as the wanted confidence asks for: with half of the matches right, 256 draws
    of four miss once in ten million. Every match can be drawn and every match votes: inliers are counted with map-side
    combine, the most supported hypothesis wins, then it is fitted to all its inliers. Identity where matches are too
    few or nothing fits; ``status`` says which.
    """
    points = cut_lineage(points)        # read four times below; matching again would cost far more than storing it
    counts = points.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_matches"))
    enough = points.join(counts.filter(F.col("n_matches") >= min_matches).select(*PAIR), PAIR, "left_semi")
    hyps = cut_lineage(hypotheses(enough, trials))
    error = _reprojection(F.col("h"), F.col("x2"), F.col("y2"), F.col("x1"), F.col("y1"))
    votes = count_inliers(enough, hyps, reach_px)
    winner = votes.groupBy(*PAIR).agg(F.max_by("number", F.struct("inliers", -F.col("number"))).alias("number"),
                                      F.max("inliers").alias("n_inliers"))
    best = winner.join(hyps, [*PAIR, "number"]).select(*PAIR, "n_inliers", "h")
    if refit:
        inliers = enough.join(best.select(*PAIR, "h"), PAIR).filter(error <= reach_px * reach_px)
        best = best.join(_least_squares(inliers), PAIR, "left").withColumn(
            "h", F.when(F.col("n_inliers") > 4, F.coalesce("fitted", "h")).otherwise(F.col("h"))).drop("fitted")
    identity = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    return (every_pair.select(*PAIR).join(counts, PAIR, "left").join(best, PAIR, "left").select(
        *PAIR, F.coalesce("n_matches", F.lit(0).cast("bigint")).alias("n_matches"),
        F.coalesce("n_inliers", F.lit(0).cast("bigint")).alias("n_inliers"), F.coalesce("h", identity).alias("h"),
        F.when(F.col("h").isNotNull(), "fitted").when(F.coalesce("n_matches", F.lit(0)) < min_matches, "too few matches")
        .otherwise("nothing fits").alias("status")))


def product(a: Column, b: Column) -> Column:
    """3x3 product of row-major arrays, scaled so that the last element is 1."""
    cells = [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]
    return F.transform(F.array(*cells), lambda v: v / cells[8])


def global_homographies(pair_maps: DataFrame, width: int = 32) -> DataFrame:
    """Map of every image to the first one of its sample: ordered prefix product of the pair maps.

    Products are associative: images are multiplied within chunks of ``width``, the chunk products the same way, and so
    on until one chunk is left, so no list is longer than ``width``.
    """
    identity = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    steps = pair_maps.select("sample_id", (F.col("pair_idx") + 1).alias("seq"), "h")
    first = steps.select("sample_id").distinct().select("sample_id", F.lit(0).cast("bigint").alias("seq"), identity.alias("h"))
    steps = cut_lineage(steps.unionByName(first))
    return _prefix(steps, width, steps.agg(F.max("seq")).first()[0] or 0)


def _prefix(steps: DataFrame, width: int, last: int) -> DataFrame:
    """``last`` is the largest ``seq`` of any sample."""
    identity = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    keyed = steps.withColumn("chunk", F.floor(F.col("seq") / width).cast("bigint"))
    window = Window.partitionBy("sample_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumn("h", F.aggregate(F.collect_list("h").over(window), identity, product))
    if last < width:
        return local.drop("chunk")
    local = cut_lineage(local)          # one small row per image, read for the chunk products and for the result
    totals = local.groupBy("sample_id", F.col("chunk").alias("seq")).agg(F.max_by("h", "seq").alias("h"))
    upto = _prefix(totals, width, last // width).select("sample_id", (F.col("seq") + 1).alias("chunk"), F.col("h").alias("carry"))
    return local.join(upto, ["sample_id", "chunk"], "left").select(
        "sample_id", "seq", product(F.coalesce("carry", identity), F.col("h")).alias("h"))
