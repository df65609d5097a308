"""Command logs, replies and positions of the motion stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions import bands, geometry
from scanframe.operators import ordered

AXES = ("x", "y", "z")


def key_values(line: Column) -> Column:
    """Map of the ``key=value`` tokens of a line; the last one wins."""
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: F.contains(t, F.lit("=")))
    pairs = F.transform(tokens, lambda t: F.struct(
        F.substring_index(t, "=", 1).alias("key"), F.substring(t, F.instr(t, F.lit("=")) + 1, F.length(t)).alias("value")))
    last = F.filter(pairs, lambda p: ~F.lit(False))
    unique = F.aggregate(last, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")),
                         lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != p["key"]),
                                                     F.map_from_entries(F.array(p))))
    return unique


def tracked(line: Column) -> Column:
    return F.startswith(F.upper(F.trim(line)), F.lit("G"))


def is_home(line: Column) -> Column:
    return F.upper(F.trim(line)) == "G28"


def axis_ticks(line: Column, axis: str) -> Column:
    """Ticks a line sets for an axis (0 when homing); NULL where it leaves the axis alone."""
    number = F.nullif(F.regexp_extract(line, rf"{axis.upper()}([\d.]+)", 1), F.lit("")).try_cast("double")
    return F.when(tracked(line), F.when(is_home(line), F.lit(0)).otherwise(geometry.mm_to_ticks(number)))


def position_track(commands: DataFrame, device: str = "device", seq: str = "seq", line: str = "line") -> DataFrame:
    """Adds the position (ticks) after every command; every axis starts at 0."""
    text = F.col(line)
    tracked_ = ordered.running(commands, [device], seq, {a: ("last", axis_ticks(text, a)) for a in AXES})
    return tracked_.withColumns({a: F.coalesce(a, F.lit(0)) for a in AXES})


def jog_moves(requests: DataFrame, axis_max: dict[str, int]) -> DataFrame:
    """Requests (axis, current, speed, direction) that stay on the axis, with the new value and the command."""
    limit = F.coalesce(*[F.when(F.col("axis") == a, F.lit(m)) for a, m in axis_max.items()])
    moved = requests.withColumn("new_value", (F.col("current") + F.col("speed") * F.col("direction")).cast("int"))
    line = F.concat(F.lit("G1 "), F.upper("axis"), geometry.ticks_to_mm(F.col("new_value")).cast("string"))
    return moved.filter((F.col("new_value") >= 0) & (F.col("new_value") <= limit)).withColumn("line", line)


def ack_outcomes(commands: DataFrame, replies: DataFrame, deadline_s: float = 60.0,
                 bucket_s: int = 60) -> DataFrame:
    """Per command: first deciding reply (ok, processing or error) of its device within the deadline, else timeout.

    Commands and replies go together through one sort per (device, time bucket), newest first, in which every command
    sees the last reply passed; a reply is also copied to the buckets its deadline reaches back to. No command is paired
    with more than one reply, however busy a device is.
    """
    micros = F.unix_micros("ts")
    bucket = F.floor(micros / (bucket_s * 1_000_000)).cast("bigint")
    reach = int(-(-deadline_s // bucket_s))
    sent = commands.select("device", "ts", bucket.alias("bucket"), F.lit(0).alias("is_reply"), F.col("seq").alias("number"),
                           F.lit(None).cast("struct<ts:timestamp,reply_seq:bigint,kind:string>").alias("answer"),
                           F.struct(*commands.columns).alias("row"))
    answer = F.struct("ts", F.col("reply_seq").cast("bigint").alias("reply_seq"), "kind")
    heard = (replies.withColumn("kind", bands.response_class(F.col("reply"))).filter(F.col("kind").isin("ok", "processing", "error"))
             .select("device", "ts", F.explode(F.sequence(bucket - reach, bucket)).alias("bucket"), F.lit(1).alias("is_reply"),
                     F.col("reply_seq").alias("number"), answer.alias("answer"),
                     F.lit(None).cast(sent.schema["row"].dataType).alias("row")))
    newest_first = (Window.partitionBy("device", "bucket").orderBy(F.desc("ts"), "is_reply", F.desc("number"))
                    .rowsBetween(Window.unboundedPreceding, -1))
    seen = sent.unionByName(heard).withColumn("next", F.last("answer", ignorenulls=True).over(newest_first))
    waited = (F.unix_micros("next.ts") - micros) / F.lit(1e6)
    in_time = waited <= deadline_s
    outcome = (F.when(in_time & (F.col("next.kind") == "error"), "fault").when(in_time, "acknowledged").otherwise("timeout"))
    return seen.filter("is_reply = 0").select(
        *[F.col(f"row.{c}").alias(c) for c in commands.columns], F.when(in_time, F.col("next.reply_seq")).alias("reply_seq"),
        F.when(in_time, F.round(waited, 6)).alias("latency_s"), outcome.alias("outcome"))


def freshest(captures: DataFrame, keys: list[str], prefer: str = "latest") -> DataFrame:
    """Latest capture per key. ``latest``: newest, a still wins a tie; ``still``/``stream``: that source if it has any."""
    rank = {"latest": F.struct("ts", F.col("source") == "still", "event_id"),
            "still": F.struct(F.col("source") == "still", "ts", "event_id"),
            "stream": F.struct(F.col("source") == "stream", "ts", "event_id")}[prefer]
    return (captures.groupBy(*keys).agg(F.max_by(F.struct("source", "ts", "event_id"), rank).alias("c"))
            .select(*keys, "c.source", "c.ts", "c.event_id"))


def dispatch(commands: DataFrame, handlers: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Commands with the result of the handler of their kind, and those of unknown kinds."""
    known = F.col("kind").isin(*handlers)
    result = F.coalesce(*[F.when(F.col("kind") == k, h) for k, h in handlers.items()])
    return (commands.filter(known).withColumn("result", result),
            commands.filter(~F.coalesce(known, F.lit(False)))
            .withColumn("message", F.concat(F.lit("Unknown kind: "), F.coalesce("kind", F.lit("")))))


def expand_macros(macros: DataFrame, depth: int = 2) -> DataFrame:
    """Steps of nested macros in run order.

    ``macros`` has macro_id, wait and ``steps`` (array of struct(kind, value, message, log, steps...)), nested at most
    ``depth`` levels. ``position`` numbers the steps of a macro; moves of a waiting macro carry ``then_wait``.
    """
    level = macros.select("macro_id", "wait", F.array().cast("array<int>").alias("path"), F.col("steps"))
    done: DataFrame | None = None
    for remaining in range(depth, 0, -1):
        opened = level.select("macro_id", "wait", "path", F.posexplode("steps").alias("at", "step"))
        opened = opened.withColumn("path", F.concat("path", F.array("at")))
        nested = "steps" in opened.schema["step"].dataType.fieldNames()
        is_macro = F.col("step.kind").isin("MACRO", "MACRO_WAIT") if nested else F.lit(False)
        leaves = opened.filter(~is_macro).select("macro_id", "path", "step.kind", "step.value", "step.message", "step.log",
                                                 ((F.col("step.kind") == "PRINTER") & F.col("wait")).alias("then_wait"))
        done = leaves if done is None else done.unionByName(leaves)
        if not nested or remaining == 1:
            break
        level = opened.filter(is_macro).select("macro_id", (F.col("step.kind") == "MACRO_WAIT").alias("wait"), "path",
                                               F.col("step.steps").alias("steps"))
    order = Window.partitionBy("macro_id").orderBy("path")  # bounded: the steps of one macro
    return done.withColumn("position", F.row_number().over(order)).drop("path")
