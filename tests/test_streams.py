import datetime as dt

import pytest
from pyspark.sql import functions as F

from scanframe.plans import control
from scanframe.streaming import live, twins
from suite import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in five files, in time order, so that streams see several batches."""
    root = tmp_path_factory.mktemp("events")
    ev = fx.events(spark, SF).orderBy("event_id").toPandas()
    for i in range(5):
        part = ev.iloc[i * len(ev) // 5:(i + 1) * len(ev) // 5]
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, value double, k int").coalesce(1).write.parquet(
            str(root / f"p{i}"))
        (next((root / f"p{i}").glob("*.parquet"))).rename(root / f"{i}.parquet")
    return str(root / "*.parquet"), fx.events(spark, SF)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_state_runs_on_over_batches(spark, folder):
    path, batch = folder
    stream = live.read_table(spark, path, 1)
    got = live.run_available(live.segments(fx.series_of(stream)))
    assert got.select("batch_id").distinct().count() == 5
    assert rows(got, "sample_id", "seq", "segment") == rows(control.segments(fx.series_of(batch)), "sample_id", "seq", "segment")


def test_bounds_over_batches_equal_the_batch_job(spark, folder):
    path, batch = folder
    got = live.run_available(live.sample_bounds(fx.series_of(live.read_table(spark, path, 1))), "update")
    columns = ("y_min", "y_max", "positions", "captured", "end_found")
    last = got.groupBy("sample_id").agg(*[F.max_by(c, "batch_id").alias(c) for c in columns])
    assert rows(last, "sample_id", *columns) == rows(control.sample_bounds(fx.series_of(batch)), "sample_id", *columns)


def test_closed_windows_equal_the_batch_twin(spark, folder):
    path, batch = folder
    got = live.run_available(live.rolling_focus(fx.series_of(live.read_table(spark, path, 1)), "2 days", "1 day", "1 hour"))
    want = {(r.sample_id, r.window_start): r.n for r in twins.rolling_focus(fx.series_of(batch), "2 days", "1 day").collect()}
    seen = {(r.sample_id, r.window_start): r.n for r in got.collect()}
    assert seen and all(want[k] == n for k, n in seen.items())
    last = max(k[1] for k in want)
    assert all(k in seen for k in want if k[1] < last - dt.timedelta(days=4))


def test_closed_sessions_equal_the_batch_twin(spark, folder):
    path, batch = folder
    got = live.run_available(live.scan_sessions(fx.series_of(live.read_table(spark, path, 1)), "6 hours", "1 hour"))
    want = {(r.sample_id, r.session_start): r.n for r in twins.scan_sessions(fx.series_of(batch), "6 hours").collect()}
    seen = {(r.sample_id, r.session_start): r.n for r in got.collect()}
    assert len(seen) > 100 and all(want[k] == n for k, n in seen.items())


def test_latest_capture_over_batches(spark, folder):
    path, batch = folder
    got = live.run_available(live.latest_capture(fx.captures_of(live.read_table(spark, path, 2)), ["camera"]), "update")
    last = got.groupBy("camera").agg(F.max_by("event_id", "batch_id").alias("event_id"))
    assert rows(last, "camera", "event_id") == rows(twins.latest_capture(fx.captures_of(batch), ["camera"]), "camera", "event_id")


def test_timeouts_are_the_commands_without_an_answer(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    commands = [(1, 1, at(0), "G28"), (1, 2, at(100), "G0 X1"), (1, 3, at(200), "G0 X2"), (1, 4, at(5000), "M400")]
    replies = [(1, at(5), 1, "ok"), (1, at(130), 2, "echo: busy"), (1, at(259), 3, "processing"), (1, at(9000), 4, "ok")]
    spark.createDataFrame(commands, "device long, seq long, ts timestamp, line string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame(replies, "device long, ts timestamp, reply_seq long, reply string").write.parquet(str(tmp_path / "r"))
    out = live.run_available(live.ack_timeouts(live.read_table(spark, str(tmp_path / "c")), live.read_table(spark, str(tmp_path / "r"))))
    got = [r.seq for r in out.collect()]
    assert 2 in got and 1 not in got and 3 not in got


def test_dashboard_feeds_every_sink(spark, folder, tmp_path):
    path, _ = folder
    counts, errors = [], []
    q = live.dashboards(fx.series_of(live.read_table(spark, path, 1)), [lambda b, i: counts.append(b.count()), lambda b, i: 1 / 0],
                        str(tmp_path / "ck"), lambda n, e: errors.append(n))
    q.awaitTermination()
    assert sum(counts) == 1000 and errors == [1] * 5


@pytest.mark.parametrize("files", [1, 2])
def test_alerts_over_batches_equal_the_batch_job(spark, folder, files):
    """Commands are decided once, when their bucket's last deadline has passed, whatever the micro-batches are."""
    from scanframe.operators import control as ctl
    path, batch = folder

    def answers(ev):
        options = F.array(*[F.lit(r) for r in fx.ACK_REPLIES])
        return ev.filter(F.col("event_type").isin("view", "error")).select(F.col("user_id").alias("device"), "ts", F.col("event_id").alias("reply_seq"),
                                                                           F.get(options, (F.col("event_id") % 4).cast("int")).alias("reply"))

    stream = live.read_table(spark, path, files)
    got = live.run_available(live.ack_alerts(fx.commands_of(stream), answers(live.read_table(spark, path, files)), 7200, 3600, "1 hour"), name="alerts", partitions=4)
    end = batch.agg(F.max(F.unix_micros("ts"))).first()[0] - 3_600_000_000
    sent = fx.commands_of(batch)
    decided = sent.filter((F.floor(F.unix_micros("ts") / 3_600_000_000) + 1) * 3_600_000_000 + 7_200_000_000 <= end).select("device", "seq")
    want = ctl.ack_outcomes(sent, answers(batch), 7200.0, 3600).join(decided, ["device", "seq"])
    columns = ("device", "seq", "reply_seq", "outcome")
    order = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert order(got) == order(want) and {"timeout", "fault", "acknowledged"} == {r.outcome for r in got.select("outcome").distinct().collect()}


def test_table_sessions_equal_the_windows(spark, folder):
    _, batch = folder
    series = fx.series_of(batch)
    columns = ("sample_id", "session_start", "last_ts", "n")
    assert rows(twins.scan_sessions_of_table(series, "6 hours"), *columns) == rows(twins.scan_sessions(series, "6 hours"), *columns)


def test_alerts_call_no_python_per_key(spark, folder):
    """A device's hour is a key; at 0.1 GB a call into Python for each of them took longer than the limit."""
    path, _ = folder
    stream = live.read_table(spark, path, 1)
    heard = stream.select(F.col("user_id").alias("device"), "ts", F.col("event_id").alias("reply_seq"), F.lit("ok").alias("reply"))
    plan = live.ack_alerts(fx.commands_of(stream), heard, 7200, 3600)._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan and "Aggregate" in plan


def _backwards(folder, tmp_path):
    """The same five files, read newest first."""
    import os
    import shutil
    from pathlib import Path
    for i in range(5):
        file = tmp_path / f"{i}.parquet"
        shutil.copy(Path(folder[0]).parent / f"{4 - i}.parquet", file)
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "*.parquet")


@pytest.mark.parametrize("name", ["hot_windows", "rolling_focus", "scan_sessions"])
def test_windows_and_sessions_are_whole_over_batches_in_any_order(spark, folder, tmp_path, monkeypatch, name):
    """Open ones count and no file is late: the query over five batches, newest first, equals the batch query."""
    from suite import q_streams
    from suite.all_queries import QUERIES
    path = _backwards(folder, tmp_path)
    monkeypatch.setattr(q_streams, "_events", lambda s, sf: live.read_table(s, path, 1))
    got, want = QUERIES[f"stream_{name}"](spark, SF), QUERIES[name](spark, SF)
    assert rows(got, *sorted(want.columns)) == rows(want, *sorted(want.columns)) and want.count() > 0
