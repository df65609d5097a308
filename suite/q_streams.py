"""Real streams over the event table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanframe.streaming import live
from suite import fixtures as fx
import suite.q_control  # noqa: F401 - its SQL is reused
from suite.registry import ORACLES, query
from suite.views import sql


def _events(spark, sf):
    raw = live.read_table(spark, f"{sf}/events*.parquet")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
                      F.get_json_object("props", "$.k").cast("int").alias("k"))


def _run(stream, mode, name):
    return live.run_available(stream, mode, name, stream.sparkSession.sparkContext.defaultParallelism)


@query("stream_positions", "R8 S6", ORACLES["position_track"])
def stream_positions(spark, sf):
    out = _run(live.positions(fx.commands_of(_events(spark, sf))), "append", "positions")
    return out.drop("batch_id")


@query("stream_segments", "R4 S12", ORACLES["sweep_segments"])
def stream_segments(spark, sf):
    return _run(live.segments(fx.series_of(_events(spark, sf))), "append", "segments").drop("batch_id")


@query("stream_sample_bounds", "R3", ORACLES["sample_bounds"])
def stream_sample_bounds(spark, sf):
    out = _run(live.sample_bounds(fx.series_of(_events(spark, sf))), "update", "bounds")
    columns = ("y_min", "y_max", "positions", "captured", "end_found")
    return out.groupBy("sample_id").agg(*[F.max_by(c, "batch_id").alias(c) for c in columns])


@query("stream_latest_capture", "R2 S8", sql("""
SELECT camera, arg_max(event_id, (ts, source = 'still', event_id)) AS event_id FROM fx_captures GROUP BY 1""", "fx_captures"))
def stream_latest_capture(spark, sf):
    out = _run(live.latest_capture(fx.captures_of(_events(spark, sf)), ["camera"]), "update", "captures")
    return out.groupBy("camera").agg(F.max_by("event_id", "batch_id").alias("event_id"))


@query("stream_hot_windows", "R1", ORACLES["hot_windows"])
def stream_hot_windows(spark, sf):
    """Windows are given whenever they change, the open ones too; the last batch that has one has all of it."""
    out = _run(live.hot_tile_windows(fx.tile_hits_of(_events(spark, sf)), "1 day", 3, None), "update", "hot")
    return out.groupBy("window_start", "grid_w", "grid_h", "col", "row").agg(F.max_by("hits", "batch_id").alias("hits"))


@query("stream_scan_sessions", "R6", ORACLES["scan_sessions"])
def stream_scan_sessions(spark, sf):
    """All sessions, those still open at the end of the table too; a batch gives all of them and replaces the one before."""
    return _run(live.scan_sessions(fx.series_of(_events(spark, sf)), "6 hours", None), "complete", "sessions").drop("batch_id")


@query("stream_rolling_focus", "R7", ORACLES["rolling_focus"])
def stream_rolling_focus(spark, sf):
    """As ``stream_hot_windows``: every window, open or closed, as of the last batch that changed it."""
    out = _run(live.rolling_focus(fx.series_of(_events(spark, sf)), "2 days", "1 day", None), "update", "rolling")
    last = out.groupBy("sample_id", "window_start").agg(F.max_by(F.struct("mean_hard", "max_soft", "n"), "batch_id").alias("v"))
    return last.select("sample_id", "window_start", F.round("v.mean_hard", 6).alias("mean_hard"), "v.max_soft", "v.n")


def _replies(spark, sf):
    options = F.array(*[F.lit(r) for r in fx.ACK_REPLIES])
    return _events(spark, sf).filter(F.col("event_type").isin("view", "error")).select(
        F.col("user_id").alias("device"), "ts", F.col("event_id").alias("reply_seq"), F.get(options, (F.col("event_id") % 4).cast("int")).alias("reply"))


#: Commands whose hour, and the two hours in which it can be answered, lie before the watermark.
_DECIDED = f"""SELECT a.* FROM ({ORACLES["ack_outcomes"]}) a JOIN ({sql("SELECT device, seq, ts FROM fx_cmdlog", "fx_cmdlog")}) c USING (device, seq)
  WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000000 + 7200000000 <= ({sql("SELECT epoch_us(max(ts)) FROM fx_cmdlog", "fx_cmdlog")}) - 60000000"""


@query("stream_ack_alerts", "R5 P50", _DECIDED)
def stream_ack_alerts(spark, sf):
    out = _run(live.ack_alerts(fx.commands_of(_events(spark, sf)), _replies(spark, sf), 7200, 3600), "append", "alerts")
    return out.select("device", "seq", F.coalesce("reply_seq", F.lit(-1).cast("bigint")).alias("reply_seq"), F.coalesce("latency_s", F.lit(-1.0)).alias("latency_s"), "outcome")


@query("stream_ack_timeouts", "R5", f"""SELECT a.device, a.seq, a.outcome FROM ({ORACLES["ack_outcomes"]}) a JOIN ({sql("SELECT device, seq, ts FROM fx_cmdlog", "fx_cmdlog")}) c USING (device, seq)
  WHERE outcome = 'timeout' AND ts + INTERVAL 2 HOUR < (SELECT least((SELECT max(ts) FROM ({sql("SELECT * FROM fx_cmdlog", "fx_cmdlog")})),
    (SELECT max(ts) FROM ({sql("SELECT * FROM fx_replies WHERE reply NOT LIKE 'echo%'", "fx_replies")})))) - INTERVAL 2 HOUR""")
def stream_ack_timeouts(spark, sf):
    out = _run(live.ack_timeouts(fx.commands_of(_events(spark, sf)), _replies(spark, sf), "7200 seconds"), "append", "timeouts")
    return out.select("device", "seq", "outcome")
