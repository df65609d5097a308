"""Structured Streaming forms of the scan jobs.

Event time is the capture time ``ts``. Rows later than the watermark are dropped by Spark and counted in its progress
reports. Keyed states are small and fixed-size: a few numbers per sample, device or tile.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scanframe.functions import bands
from scanframe.operators import control
from scanframe.session import shared_dir
from scanframe.streaming import twins

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state_store(spark: SparkSession) -> None:
    """The keyed-state operators need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_table(spark: SparkSession, pattern: str, max_files: int = 64) -> DataFrame:
    """Stream of parquet files, ``max_files`` to a micro-batch; the schema is the one the files have now."""
    return spark.readStream.schema(spark.read.parquet(pattern).schema).option("maxFilesPerTrigger", max_files).parquet(pattern)


def on_event_time(stream: DataFrame, delay: str | None = "60 seconds", ts: str = "ts") -> DataFrame:
    """Watermark on ``ts``, which may come without a zone. Without a ``delay`` no row is ever late and every window stays open."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed if delay is None else timed.withWatermark(ts, delay)


def hot_tile_windows(hits: DataFrame, duration: str, min_hits: int, delay: str | None = "60 seconds") -> DataFrame:
    return twins.hot_tile_windows(on_event_time(hits, delay), duration, min_hits)


def latest_capture(captures: DataFrame, keys: list[str]) -> DataFrame:
    return twins.latest_capture(captures, keys)


def scan_sessions(events: DataFrame, idle: str, delay: str | None = "60 seconds") -> DataFrame:
    return twins.scan_sessions(on_event_time(events, delay), idle)


def rolling_focus(series: DataFrame, length: str, slide: str, delay: str | None = "60 seconds") -> DataFrame:
    return twins.rolling_focus(on_event_time(series, delay), length, slide)


def ack_timeouts(commands: DataFrame, replies: DataFrame, deadline: str = "60 seconds") -> DataFrame:
    """Commands no deciding reply came for within the deadline: emitted when the watermark has passed it."""
    deciding = replies.withColumn("kind", bands.response_class(F.col("reply"))).filter(
        F.col("kind").isin("ok", "processing", "error")).select(
        F.col("device").alias("r_device"), F.col("ts").alias("r_ts"), "reply_seq", "kind")
    left = on_event_time(commands, deadline).alias("c")
    right = on_event_time(deciding, deadline, "r_ts").alias("r")
    within = ((F.col("c.device") == F.col("r.r_device")) & (F.col("r.r_ts") > F.col("c.ts"))
              & (F.col("r.r_ts") <= F.col("c.ts") + F.expr(f"INTERVAL {deadline}")))
    return left.join(right, within, "left_outer").filter("r_device is null").select(
        "c.device", "c.seq", "c.ts", "c.line", F.lit("timeout").alias("outcome"))


def _decided(batches: Iterator[pa.RecordBatch], key_type: pa.DataType, deadline_us: int) -> Iterator[pa.RecordBatch]:
    """Outcome of every command of a device's time bucket, from its rows and the replies that can answer them, in one pass."""
    schema = pa.schema([("device", key_type), ("seq", pa.int64()), ("reply_seq", pa.int64()), ("latency_s", pa.float64()), ("outcome", pa.string())])
    for batch in batches:
        out: list[tuple] = []
        for device, held in zip(batch.column("device").to_pylist(), batch.column("held").to_pylist(), strict=True):
            replies = sorted((r["micros"], r["number"], r["kind"]) for r in held if r["is_reply"])
            times = [r[0] for r in replies]
            for micros, seq in ((r["micros"], r["number"]) for r in held if not r["is_reply"]):
                at = bisect.bisect_right(times, micros)  # the first that came later
                if at < len(times) and times[at] - micros <= deadline_us:
                    out.append((device, seq, replies[at][1], (times[at] - micros) / 1e6, "fault" if replies[at][2] == "error" else "acknowledged"))
                else:
                    out.append((device, seq, None, None, "timeout"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def ack_alerts(commands: DataFrame, replies: DataFrame, deadline_s: int = 60, bucket_s: int = 60, delay: str = "60 seconds") -> DataFrame:
    """Outcome (acknowledged, fault, timeout) of every command, from one stream, once its time bucket can get no more rows.

    The streaming form of ``control.ack_outcomes``: the same rules, keyed by device and a window of a time bucket and the
    deadline after it. Commands count in the window that starts with their bucket, replies in every window that has them.
    Spark's own aggregation keeps a window's rows until the watermark has passed its end, then they are decided in one pass
    and leave the state; so a key holds the rows of one window, however busy or long-lived its device is.
    """
    bucket_us, deadline_us = bucket_s * 1_000_000, deadline_s * 1_000_000
    reach = -(-deadline_s // bucket_s) * bucket_s  # whole buckets, so that windows start where buckets do
    sent = commands.select("device", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("number"), F.lit(False).alias("is_reply"), F.lit(None).cast("string").alias("kind"))
    heard = replies.withColumn("kind", bands.response_class(F.col("reply"))).filter(F.col("kind").isin("ok", "processing", "error")).select(
        "device", F.col("ts").cast("timestamp").alias("ts"), F.col("reply_seq").cast("bigint").alias("number"), F.lit(True).alias("is_reply"), "kind")
    rows = sent.unionByName(heard).withWatermark("ts", delay)
    windowed = rows.withColumn("w", F.window("ts", f"{bucket_s + reach} seconds", f"{bucket_s} seconds"))
    own = F.col("is_reply") | (F.unix_micros("ts") < F.unix_micros("w.start") + bucket_us)
    held = windowed.filter(own).groupBy("device", "w").agg(F.collect_list(F.struct(F.unix_micros("ts").alias("micros"), "is_reply", "number", "kind")).alias("held"))
    key = commands.schema["device"].dataType
    key_type = to_arrow_type(key)
    return held.select("device", "held").mapInArrow(lambda batches: _decided(batches, key_type, deadline_us),
                                                    f"device {key.simpleString()}, seq long, reply_seq long, latency_s double, outcome string")


class _Fold(StatefulProcessor):
    """Runs rows of a key in order through ``step(state, row)``; states are flat tuples.

    Rows of one key are ordered within a micro-batch, whose size the source's trigger limits bound.
    """

    state_fields = ""
    order = "seq"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_fields)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def result(self, key, state: tuple, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(self.order)
        state = tuple(self.state.get()) if self.state.exists() else self.start()
        out = []
        for row in batch.itertuples(index=False):
            state, emitted = self.step(state, row)
            if emitted is not None:
                out.append(emitted)
        self.state.update(state)
        yield self.result(key, state, out)

    def close(self) -> None:
        pass


class PositionState(_Fold):
    """Position after every command of a device."""
    state_fields = "x int, y int, z int"
    output = "device long, seq long, x int, y int, z int"

    def start(self):
        return 0, 0, 0

    def step(self, state, row):
        now = tuple(int(new) if new == new and new is not None else old
                    for old, new in zip(state, (row.set_x, row.set_y, row.set_z)))
        return now, (row.seq, *now)

    def result(self, key, state, rows):
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["device", "seq", "x", "y", "z"])


class SegmentState(_Fold):
    """Segment number of every series row of a sample."""
    state_fields = "segment long"
    output = "sample_id long, seq long, segment long"

    def start(self):
        return (0,)

    def step(self, state, row):
        now = (int(state[0]) + int(row.is_break),)
        return now, (row.seq, now[0])

    def result(self, key, state, rows):
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["sample_id", "seq", "segment"])


class BoundsState(_Fold):
    """Extent of a sample so far; the last update per sample is its result."""
    state_fields = "segment long, done boolean, positions long, captured long, y_min int, y_max int"
    output = "sample_id long, y_min int, y_max int, positions long, captured long, end_found boolean"

    def start(self):
        return 0, False, 0, 0, 1 << 30, -(1 << 30)

    def step(self, state, row):
        segment, done, positions, captured, low, high = state
        segment = int(segment) + int(row.is_break)
        if segment == 1 and not done and row.is_end:
            done = True
        if segment == 0 or (segment == 1 and not done):
            positions, captured = int(positions) + 1, int(captured) + int(row.worth)
            low, high = min(int(low), int(row.y)), max(int(high), int(row.y))
        return (segment, bool(done), int(positions), int(captured), int(low), int(high)), None

    def result(self, key, state, rows):
        _, done, positions, captured, low, high = state
        found = [(key[0], low, high, positions, captured, done)] if positions else []
        return pd.DataFrame(found, columns=["sample_id", "y_min", "y_max", "positions", "captured", "end_found"])


def _run_state(stream: DataFrame, key: str, processor: _Fold, mode: str) -> DataFrame:
    keyed_state_store(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(processor, processor.output, mode, "None")


def positions(commands: DataFrame) -> DataFrame:
    line = F.col("line")
    parsed = commands.select("device", "seq", *[control.axis_ticks(line, a).alias(f"set_{a}") for a in control.AXES])
    return _run_state(parsed, "device", PositionState(), "Append")


def segments(series: DataFrame) -> DataFrame:
    return _run_state(series.select("sample_id", "seq", "is_break"), "sample_id", SegmentState(), "Append")


def sample_bounds(series: DataFrame) -> DataFrame:
    h, s = F.col("hard"), F.col("soft")
    rows = series.select("sample_id", "seq", "y", "is_break", bands.end_of_sample(h, s, F.col("ylum")).alias("is_end"),
                         bands.worth_fine_focus(h, s).alias("worth"))
    return _run_state(rows, "sample_id", BoundsState(), "Update")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names for checkpoints."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream", partitions: int | None = None) -> DataFrame:
    """Runs a stream over everything that is there and returns what it wrote, with ``batch_id``.

    Every micro-batch replaces its own folder, so a batch that is run again after a failure leaves no doubles. In ``complete``
    mode a batch has the whole result, so it replaces the one before.
    ``partitions`` is the number of state partitions, which a stream keeps for its whole life; by default the session's.
    """
    spark = stream.sparkSession
    root = shared_folder(spark, name)
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def save(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{root}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions or before))
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
                 .foreachBatch(save).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(f"{root}/out")


def dashboards(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str,
               on_error: Callable[[int, Exception], None] | None = None, mode: str = "append"):
    """Starts a stream that feeds every sink; one failing sink does not stop the others."""
    from scanframe.sources.sinks import fan_out
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(fan_out(sinks, on_error)).trigger(availableNow=True).start())


def frame_arrivals(spark: SparkSession, folder: str, max_files: int = 256) -> DataFrame:
    """Stream of image files landing in a folder: path, arrival time, length; at most ``max_files`` per trigger."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files)
             .option("recursiveFileLookup", True).load(folder))
    return files.select("path", F.col("modificationTime").alias("ts"), "length")


def decode_arrivals(handle: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: decodes the batch's files with the image source and hands frames and rejects on.

    Only paths pass through the driver, as many as the stream's ``maxFilesPerTrigger`` allows.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        from scanframe.sources.images import read_frames
        paths = [r.path for r in batch.select("path").collect()]
        if paths:
            frames, rejects = read_frames(batch.sparkSession, paths)
            handle(frames, rejects, batch_id)
    return run
