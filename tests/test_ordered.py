import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanframe.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for g in range(4):
        keys = sorted(rng.sample(range(400), 120 if g else 300))     # group 0 is far larger than the others
        data += [(g, k, rng.choice([None, rng.randint(-9, 9)])) for k in keys]
    return spark.createDataFrame(data, "g int, k long, v int")


def test_dense_index_matches_row_number(rows):
    got = ordered.dense_index(rows, ["g"], ["k"], ordered.chunk_of(F.col("k"), 16), "i")
    want = rows.withColumn("i", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).cast("bigint"))
    assert sorted(got.select("g", "k", "i").collect()) == sorted(want.select("g", "k", "i").collect())


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values_match_plain_windows(rows, inclusive):
    v = F.col("v")
    specs = {"s": ("sum", v), "hi": ("max", v), "lo": ("min", v), "seen": ("last", v)}
    got = ordered.running(rows, ["g"], "k", specs, inclusive, width=16)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumns({"s": F.sum(v).over(w), "hi": F.max(v).over(w), "lo": F.min(v).over(w), "seen": F.last(v, True).over(w)})
    columns = ["g", "k", "s", "hi", "lo", "seen"]
    order = lambda d: d.select(*columns).orderBy("g", "k").collect()
    assert order(got) == order(want)


def test_halo_windows_match_plain_windows(rows):
    indexed = ordered.dense_index(rows, ["g"], ["k"], ordered.chunk_of(F.col("k"), 16), "i")

    def columns(w):
        return {"nxt": F.lead("k").over(w), "back": F.sum("v").over(w.rowsBetween(-5, -1)), "around": F.count("v").over(w.rowsBetween(-4, 4))}

    got = ordered.with_neighbours(indexed, ["g"], "i", columns, before=5, after=4, width=8)
    want = indexed.withColumns(columns(Window.partitionBy("g").orderBy("i")))
    order = lambda d: d.select("g", "i", "nxt", "back", "around").orderBy("g", "i").collect()
    assert order(got) == order(want)


def test_no_task_sees_a_whole_group(rows):
    chunks = ordered.halo(ordered.dense_index(rows, ["g"], ["k"], ordered.chunk_of(F.col("k"), 16), "i"), ["g"], "i", 2, 2, width=8)
    assert chunks.groupBy("g", ordered.CHUNK).count().agg(F.max("count")).first()[0] <= 8 + 4


def test_range_index_splits_a_group(spark):
    rows = [(g, (7 * i) % 501, f"p{i}") for g in ("a", None) for i in range(400)] + [("b", 1, "x")]
    df = spark.createDataFrame(rows, "g string, x long, path string")
    got = {(r.g, r.x, r.path): r.place for r in ordered.range_index(df, ["g"], ["x", "path"], "place").collect()}
    for g in ("a", None, "b"):
        mine = sorted((x, p) for k, x, p in rows if k == g)
        assert [got[g, x, p] for x, p in mine] == list(range(len(mine)))
