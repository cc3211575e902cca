"""Structured Streaming jobs.

Streams carry content_id, text and ts (epoch seconds) like the batch frames. Every job takes
the folder for its sink and its checkpoint; all use `availableNow` unless told otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideguard.config import LOCAL_TTL_SECONDS, RETRAIN_LABELS
from tideguard.functions.text import content_key
from tideguard.operators import action
from tideguard.operators.monitoring import running_trigger


def event_time(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Adds `at`, the time of `ts`, with the watermark on it."""
    return stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", lateness)


def run(query_writer, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = query_writer.option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_log(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Appends the stream's rows to an event log, one folder per day, exactly once."""
    dated = stream.withColumn("event_date", F.to_date(F.timestamp_seconds("ts")))
    sink = dated.writeStream.format("parquet").option("path", path).partitionBy("event_date")
    return run(sink, checkpoint, available_now)


def moderate_stream(
    stream: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
):
    """Moderates every micro-batch and writes what follows from it under `path`.

    `judge` is the batch operator over stores prepared once, before the stream starts; it returns
    a decision per content_id. A micro-batch is judged once: its decisions are written with the
    text, time and source of their rows, and the other outputs are read off those files: `reviews`
    (rows decided "review") and `events` (one per row). Every output has a folder per micro-batch; one
    repeated after a failure replaces its own folders, so no row appears twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        def store(df: DataFrame, output: str) -> str:
            folder = f"{path}/{output}/batch={number}"
            df.write.mode("overwrite").parquet(folder)
            return folder

        kept = [c for c in ("content_id", "text", "ts", "source", "user_id") if c in batch.columns]
        # The batch is read twice, so it is stored first: a source may not give it again cheaply.
        rows = batch.sparkSession.read.schema(batch.schema).parquet(store(batch, "input"))
        judged = judge(rows)
        folder = store(judged.join(rows.select(*kept), "content_id"), "decisions")
        decided = batch.sparkSession.read.parquet(folder).withColumn("cache_hit", F.col("path") == "hot")
        outputs = action.outputs(decided, F.col("ts"))
        store(outputs["reviews"], "reviews")
        store(outputs["events"], "events")

    return run(stream.writeStream.foreachBatch(write), checkpoint, available_now)


def first_seen(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drops copies of a text that arrive within the watermark of the first one."""
    keyed = event_time(stream, lateness).withColumn("key", content_key(F.col("text")))
    return keyed.dropDuplicatesWithinWatermark(["key"])


def windowed_counts(
    stream: DataFrame, column: str, width: str = "1 hour", slide: str | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Counts per time window and value of `column`; late rows are dropped."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return (
        event_time(stream, lateness)
        .groupBy(window, column)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.unix_timestamp("window.start").alias("window_start"),
            F.unix_timestamp("window.end").alias("window_end"),
            column,
            "n",
        )
    )


def trigger_stream(
    labels: DataFrame,
    path: str,
    checkpoint: str,
    threshold: int = RETRAIN_LABELS,
    reset: bool = False,
    available_now: bool = True,
):
    """The running count of labels since the last reset, one row per micro-batch and day.

    A micro-batch is counted per day before anything else. The count so far is the state; it is
    kept with the output of each micro-batch, so one repeated after a failure starts again from
    what the one before it left. With `reset` the count starts anew where it suffices.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        daily = batch.groupBy("day").agg(F.sum("new_labels").alias("new_labels"))
        before = 0
        if number > 0:
            left = spark.read.parquet(f"{path}/state/batch={number - 1}").first()
            before = left["labels_since_reset"]
        # A few rows per day, computed once for the output and the state.
        folder = f"{path}/triggers/batch={number}"
        running_trigger(daily, before, threshold, reset).write.mode("overwrite").parquet(folder)
        done = spark.read.parquet(folder)
        last = done.agg(F.max_by("left_over", "day").alias("n")).select(
            F.coalesce("n", F.lit(before)).cast("long").alias("labels_since_reset")
        )
        last.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    return run(labels.writeStream.foreachBatch(write), checkpoint, available_now)


def daily_counts(stream: DataFrame, count: str | None = None) -> DataFrame:
    """(day, new_labels) of a stream of labels, or of counts in column `count`."""
    n = F.lit(1) if count is None else F.col(count)
    day = F.to_date(F.timestamp_seconds("ts")).cast("string").alias("day")
    return stream.select(day, n.cast("long").alias("new_labels"))


def daily_labels(stream: DataFrame) -> DataFrame:
    """Labels per day, the running input of the retrain trigger."""
    day = F.to_date(F.timestamp_seconds("ts")).cast("string")
    return stream.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("new_labels"))


def upsert_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    mode: str = "update",
) -> StreamingQuery:
    """Writes the changed rows of an aggregation per micro-batch; see `read_upserts`.

    Session windows know no "update": use "append" (closed ones) or "complete" there.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint, available_now)


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every row written by `upsert_sink`."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(
        *keys, "_r.*"
    )


def ttl_cache(
    stream: DataFrame, ttl: int = LOCAL_TTL_SECONDS, lateness: str = "1 hour"
) -> DataFrame:
    """Life of every cache entry: (key, started, requests, hits).

    Every request writes the entry anew, which restarts its time to live, so one life is a
    session of requests less than `ttl` seconds apart; all but its first are hits. The state
    holds one row per open session and the watermark closes it.
    """
    keyed = event_time(stream, lateness).withColumn("key", content_key(F.col("text")))
    # Sessions that touch are merged, so the gap ends just before the time to live does.
    gap = f"{ttl * 1000 - 1} milliseconds"
    lives = keyed.groupBy(F.session_window("at", gap).alias("life"), "key")
    return lives.agg(F.count(F.lit(1)).alias("requests")).select(
        "key",
        F.unix_timestamp("life.start").alias("started"),
        "requests",
        (F.col("requests") - 1).alias("hits"),
    )


ANSWER = ["decision", "confidence", "reason", "tier"]
ANSWER_TYPE = "decision string, confidence double, reason string, tier string"
# Groups of keys that share a state: calling Python costs more per group than per request.
CACHE_GROUPS = 1 << 12


def cached_answers(
    stream: DataFrame, ttl: int = LOCAL_TTL_SECONDS, lateness: str = "1 hour"
) -> DataFrame:
    """Every request with its answer: the cached one, or its own, which is then cached.

    `stream` has content_id, text, ts and the answer computed for the request (decision,
    confidence, reason, tier). Per text the state holds one entry: the first answer and the time up
    to which it is valid, `ttl` seconds after the last request that used it. Requests of a micro-batch
    are taken in the order of their times. Rows later than the watermark are dropped; once the
    watermark passes the end of an entry, its state is freed. Rows come out once (append mode).

    Texts lie in CACHE_GROUPS groups by the hash of their key, and the entries of a group are one
    state: Python is called once per group and micro-batch, however many texts there are.
    """
    keyed = event_time(stream, lateness).withColumn("key", content_key(F.col("text"))).select(
        "key", F.col("content_id").cast("string").alias("content_id"), F.col("ts").cast("double").alias("ts"), *ANSWER, "at",
        F.pmod(F.xxhash64("key"), F.lit(CACHE_GROUPS)).alias("group"),
    )

    def answer(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = {e[0]: tuple(e) for e in state.get[0]} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            # One group's requests of one micro-batch.
            rows = pd.concat(batches).sort_values(["ts", "content_id"])
            columns = [rows[c].tolist() for c in ("key", "content_id", "ts", *ANSWER)]
            for key, content_id, ts, *own in zip(*columns, strict=True):
                entry = entries.get(key)
                hit = entry is not None and entry[1] <= ts < entry[2]
                if hit:
                    entries[key] = (key, entry[1], max(entry[2], ts + ttl), *entry[3:])
                elif entry is None or ts >= entry[2]:
                    entries[key] = (key, ts, ts + ttl, content_id, *own)
                used = entry[3:] if hit else (content_id, *own)
                out.append((key, content_id, ts, hit, *used))
        # A row may be as late as the watermark allows, but no entry ends before it.
        now = state.getCurrentWatermarkMs()
        entries = [e for e in entries.values() if not e[2] * 1000 <= now]
        if entries:
            state.update((entries,))
            state.setTimeoutTimestamp(max(min(int(e[2] * 1000) for e in entries), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "content_id", "ts", "hit", "answered_by", *ANSWER])

    return keyed.groupBy("group").applyInPandasWithState(
        answer,
        f"key string, content_id string, ts double, hit boolean, answered_by string, {ANSWER_TYPE}",
        "entries array<struct<key:string,started:double,until:double,answered_by:string,"
        "decision:string,confidence:double,reason:string,tier:string>>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
