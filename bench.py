"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``align_fullsize`` searches real-sized pairs (1600 x 1600 pixels, enlarged from the embeddings) with the default candidate
grid; ``sec_per_pair`` is its time per pair on this machine, ``candidate_pixels_per_sec`` counts every tried overlap at the
winning size.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from scanframe.operators import align, frames as frame_ops  # noqa: E402
from scanframe.session import build_session  # noqa: E402
from suite import all_queries  # noqa: E402
from suite.q_pairs import _gray_sequence  # noqa: E402

HEADLINE = ["focus_tiles_top", "frame_focus", "channel_stats", "average_color", "registration_marks", "components_tiled", "hot_report",
            "frame_sequence", "outlier_flags", "search_plan", "neighbour_constraints", "align_pairs", "mosaic_centered", "focus_stack",
            "selection_strategies", "merge_tree", "match_descriptors", "warp_blend", "best_focus", "sample_bounds", "position_track",
            "ack_outcomes", "settings_resolved", "sampling_report", "timing_summary"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def align_fullsize(spark, sf: str) -> tuple[float, int, float]:
    small = _gray_sequence(spark, sf).filter("seq < 9 and sample_id < 2")
    large = frame_ops.resize(small, ["sample_id", "seq"], 200.0).repartition(8, "sample_id", "seq").persist()
    large.count()
    start = time.time()
    tried = (F.col("coarse_tried") + F.col("fine_tried")).cast("double") * F.col("x_overlap") * F.col("height")
    pairs, pixels = align.find_alignments(align.strips(large)).agg(F.count(F.lit(1)), F.sum(tried)).first()
    took = time.time() - start
    large.unpersist()
    return took, pairs, pixels


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
                                                      "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    run(all_queries.QUERIES["focus_tiles_top"](spark, sf))     # JVM and Python workers warm up
    times = {}
    for name in HEADLINE:
        start = time.time()
        run(all_queries.QUERIES[name](spark, sf))
        times[name] = round(time.time() - start, 3)
    took, pairs, pixels = align_fullsize(spark, sf)
    times["align_fullsize"] = round(took, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(sf).name, "fullsize_pairs": pairs, "sec_per_pair": round(took / max(pairs, 1), 3),
                      "candidate_pixels_per_sec": round(pixels / took)}))
    spark.stop()


if __name__ == "__main__":
    main()
