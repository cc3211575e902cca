"""Streaming jobs over several micro-batches: answers, running counts, outputs written once."""

import shutil

from pyspark.sql import functions as F

from tideguard.config import Combo, KeywordDictionary
from tideguard.operators import batch, monitoring
from tideguard.session import materialise, scratch_path
from tideguard.streaming import jobs

ANSWERED = "content_id long, text string, ts long, decision string, confidence double, reason string, tier string"


def feed(spark, folder, schema, parts):
    """A stream of one micro-batch per part."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp{n}")
        names = spark.read.parquet(f"{folder}/tmp{n}").inputFiles()
        shutil.copy(names[0].removeprefix("file://"), f"{folder}/{n:03d}.parquet")
        shutil.rmtree(f"{folder}/tmp{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/*.parquet")


def test_cache_answers_and_frees_its_state(spark, tmp_path):
    def row(i, text, ts):
        # From 1000 on: the first watermark is the epoch, and what is not after it is late.
        return (i, text, 1000 + ts, f"d{i}", i / 100, "", "L1")

    parts = [
        [row(1, "a", 0), row(2, "b", 10), row(3, "a", 99), row(4, "a", 250)],
        # 350 is the end of the life that 250 began; 349 is within it.
        [row(5, "a", 349), row(6, "a", 448), row(7, "a", 548), row(8, "b", 300)],
        [row(9, "c", 5000)],
        [row(10, "c", 5050), row(11, "a", 4000), row(12, "c", 12000)],
        [row(13, "d", 12001)],
    ]
    stream = feed(spark, str(tmp_path), ANSWERED, parts)
    out = scratch_path(spark, "answers")
    answers = jobs.cached_answers(stream, ttl=100, lateness="30 minutes")
    query = jobs.run(answers.writeStream.outputMode("append").format("parquet").option("path", out), scratch_path(spark, "cp"))
    got = {r["content_id"]: (r["hit"], r["answered_by"], r["decision"]) for r in spark.read.parquet(out).collect()}
    want = {
        1: (False, "1"), 2: (False, "2"), 3: (True, "1"), 4: (False, "4"), 5: (True, "4"), 6: (True, "4"), 7: (False, "7"),
        8: (False, "8"), 9: (False, "9"), 10: (True, "9"), 11: (False, "11"), 12: (False, "12"), 13: (False, "13"),
    }
    assert got == {str(i): (hit, by, f"d{by}") for i, (hit, by) in want.items()}
    # The entries of a and b ended long before the last watermark.
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 2


def test_texts_of_a_group_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "CACHE_GROUPS", 4)

    def row(i, text, ts):
        return (i, text, ts, f"d{i}", 0.5, "", "t")

    parts = [[row(i, f"t{i}", 1000 + i) for i in range(60)], [row(100 + i, f"t{i}", 1040 + i * 3) for i in range(60)]]
    answers = jobs.cached_answers(feed(spark, str(tmp_path), ANSWERED, parts), ttl=100, lateness="30 minutes")
    out = scratch_path(spark, "answers")
    query = jobs.run(answers.writeStream.outputMode("append").format("parquet").option("path", out), scratch_path(spark, "cp"))
    got = {int(r["content_id"]): r["decision"] for r in spark.read.parquet(out).collect()}
    # The second request of text i comes 40 + 2 i seconds after the first.
    again = {100 + i: f"d{i}" if 40 + 2 * i < 100 else f"d{100 + i}" for i in range(60)}
    assert got == {i: f"d{i}" for i in range(60)} | again
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_trigger_counts_over_micro_batches(spark, tmp_path):
    day = 86400
    parts = [
        [(i, day * (i % 2)) for i in range(7)],
        [(i, day * 2) for i in range(8)] + [(9, day * 3)],
        [(i, day * 3) for i in range(12)],
    ]
    stream = feed(spark, str(tmp_path), "id long, ts long", parts)
    path = scratch_path(spark, "trigger")
    jobs.trigger_stream(jobs.daily_counts(stream), path, scratch_path(spark, "cp"), threshold=10, reset=True)
    rows = spark.read.parquet(f"{path}/triggers").orderBy("batch", "day").collect()
    got = [(r["batch"], r["day"], r["new_labels"], r["labels_since_reset"], r["should_retrain"]) for r in rows]
    assert got == [
        (0, "1970-01-01", 4, 4, False), (0, "1970-01-02", 3, 7, False),
        (1, "1970-01-03", 8, 15, True), (1, "1970-01-04", 1, 1, False),
        (2, "1970-01-04", 12, 13, True),
    ]
    states = spark.read.parquet(f"{path}/state").orderBy("batch").collect()
    assert [r["labels_since_reset"] for r in states] == [7, 1, 0]
    assert spark.createDataFrame([], "day string, new_labels long").transform(monitoring.running_trigger).count() == 0


def test_moderated_stream_equals_batch(spark, tmp_path):
    words = KeywordDictionary({"toxic": ["idiot"], "violence": ["trash"]}, (Combo(("red", "blue"), "violence", ""),), ())
    schema = "content_id long, text string, source string, ts long"
    texts = ["idiot", "you idiot trash", "red and blue", "fine", "", "nothing here", "fine too"]
    rows = [(i, f"{texts[i % 7]} {i}" if texts[i % 7] else "", f"s{i % 3}", 1000 + 10 * i) for i in range(21)]
    stream = feed(spark, str(tmp_path), schema, [rows[:9], rows[9:15], rows[15:]])
    signals = spark.createDataFrame(
        [(i, "unsafe" if i % 2 else "safe", (i % 10) / 10, "toxic", 0.6, "why", None, None) for i in range(21)],
        "content_id long, score_label string, score_confidence double, audit_label string, audit_confidence double, "
        "audit_reason string, image_label string, image_confidence double",
    ).withColumn("second_label", F.col("score_label")).withColumn("second_confidence", F.col("score_confidence"))
    empty = spark.createDataFrame(
        [], "key string, decided_at long, entry_ord long, decision string, confidence double, reason string, tier string"
    )
    stores = {"local": empty, "shared": empty}

    def judge(df):
        return batch.moderate(df, signals, words, stores, cut=materialise)

    path, checkpoint = scratch_path(spark, "moderated"), scratch_path(spark, "cp")
    jobs.moderate_stream(stream, judge, path, checkpoint)
    jobs.moderate_stream(stream, judge, path, checkpoint)
    names = ["content_id", "decision", "confidence", "reason", "tier", "path"]
    want = judge(spark.createDataFrame(rows, schema)).select(*names).collect()
    got = spark.read.parquet(f"{path}/decisions").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    events = spark.read.parquet(f"{path}/events")
    assert events.count() == 21 and events.select("event_id").distinct().count() == 21
    waiting = {r["content_id"] for r in spark.read.parquet(f"{path}/reviews").collect()}
    assert waiting == {r["content_id"] for r in want if r["decision"] == "review"}
