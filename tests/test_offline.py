"""Feedback, monitoring, evaluation, classifier and streaming on small frames."""

import os
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideguard.config import KeywordDictionary
from tideguard.operators import classifier, evaluation, feedback, funnel, monitoring, scorers
from tideguard.plans import catalog
from tideguard.session import scratch_path
from tideguard.sources import readers, writers
from tideguard.streaming import jobs


def history(spark, values):
    rows = [(f"2024-01-{i + 1:02d}", float(a)) for i, a in enumerate(values)]
    return spark.createDataFrame(rows, "date string, accuracy double")


def test_drift(spark):
    few = monitoring.drift(history(spark, [0.9] * 6)).first()
    assert few["drift"] is False and few["drop"] is None
    seven = monitoring.drift(history(spark, [0.9] * 7)).first()
    assert (seven["drift"], seven["drop"], seven["baseline_avg"]) == (False, 0.0, 0.9)
    fallen = monitoring.drift(history(spark, [0.9] * 10 + [0.8] * 7)).first()
    assert (fallen["drift"], fallen["drop"]) == (True, 0.1)


@pytest.mark.parametrize(
    "events,rate,strict,high,grey",
    [
        (100, 0.0, False, 0.95, 0.7),
        (100, 0.0, True, 0.93, 0.7),
        (100, 0.01, False, 0.93, 0.7),
        (100, 0.3, False, 0.98, 0.75),
        (99, 0.3, False, 0.95, 0.7),
    ],
)
def test_calibration(spark, events, rate, strict, high, grey):
    report = spark.createDataFrame([(events, rate)], "total_events long, human_override_rate double")
    got = monitoring.calibrate(report, strict=strict).first()
    assert (got["bert_high"], got["grey_high"]) == (high, grey)


def test_latency_ranks(spark):
    values = [float(x) for x in (5, 1, 9, 3, 3, 3, 120, 7, 8, 2)]
    df = spark.createDataFrame([(v, "a") for v in values] + [(4.0, "b")], "latency_ms double, g string")
    got = {r["g"]: r for r in evaluation.latency(df, ["g"]).collect()}
    s = sorted(values)
    assert [got["a"][p] for p in ("p50", "p95", "p99")] == [s[5], s[9], s[9]]
    assert got["b"]["p50"] == 4.0
    assert evaluation.latency(df).first()["n"] == 11
    assert evaluation.latency(df, approximate=True).first()["max"] == 120.0


def test_empty_results_give_zeros(spark):
    empty = spark.createDataFrame(
        [], "expected string, decision string, tier string, path string, latency_ms double, confidence double"
    )
    row = evaluation.metrics(empty).first()
    assert row["total"] == 0 and row["f1"] == 0.0 and row["llm_call_rate"] == 0.0


def test_discovery_ranks_by_frequency_then_first_seen(spark):
    rows = [
        (1, "block", "says 'beta' and 'x'"),
        (2, "pass", "says 'beta'"),
        (3, "block", "「alpha」 or “beta”"),
        (4, "block", "'alpha' again, 'idiot' too"),
        (5, "block", "'gamma'"),
    ]
    events = spark.createDataFrame(rows, "event_id long, decision string, reason string").withColumn(
        "text", F.concat(F.lit("t"), "event_id")
    )
    got = feedback.discover_keywords(events, KeywordDictionary({"toxic": ["Idiot"]})).collect()
    assert [(r["term"], r["frequency"], r["example_text"]) for r in got] == [
        ("alpha", 2, "t3"), ("beta", 1, "t1"), ("gamma", 1, "t5"),
    ]


def test_discovery_reads_human_events_after_those_of_the_ai(spark):
    ai = [(5, 50, "t5", "block", "'alpha' and 'beta'"), (6, 60, "t6", "pass", "'delta'")]
    human = [
        (9, "t9", "reviewed", "block", "'beta' or 'gamma'"), (7, "t7", "reviewed", "block", "'gamma', 'omega'"),
        (2, "t2", "reviewed", "pass", "'alpha'"), (1, "t1", "pending", "block", "'alpha'"),
    ]
    views = SimpleNamespace(
        mod_events=spark.createDataFrame(ai, "event_id long, content_id long, text string, decision string, reason string")
        .withColumn("source_label", F.lit("ai")),
        reviews=spark.createDataFrame(human, "content_id long, text string, status string, human_decision string, human_reason string")
        .withColumns({"ai_decision": F.lit("review"), "ai_confidence": F.lit(0.5)}),
    )
    got = [(r["term"], r["frequency"], r["example_text"]) for r in catalog.kw_discovery(views).collect()]
    assert got == [("beta", 2, "t5"), ("gamma", 2, "t7"), ("alpha", 1, "t5"), ("omega", 1, "t7")]


def test_hard_cases_are_null_safe(spark):
    rows = [
        (1, 0.5, "block", None, None),
        (2, 0.9, "block", "block", None),
        (3, 0.9, "pass", None, None),
        (4, 0.9, "pass", "block", "pass"),
    ]
    events = spark.createDataFrame(
        rows, "content_id long, confidence double, decision string, ai_decision string, human_decision string"
    ).withColumn("text", F.lit("t"))
    got = {r["content_id"]: (r["difficulty"], r["label"]) for r in feedback.hard_cases(events).collect()}
    assert got == {1: ("grey_zone", "unsafe"), 2: ("ai_wrong", "safe"), 4: ("ai_wrong", "safe")}


def test_second_opinion_and_missing_audit(spark):
    rows = [
        (1, "safe", 0.5, "unsafe", 0.97, "porn", 0.6, "L2_bert", "unsafe"),
        (2, "safe", 0.5, "unsafe", 0.5, "porn", 0.6, "L3_llm", "porn"),
        (3, "safe", 0.5, "unsafe", 0.5, None, None, "L3_llm", "safe"),
        (4, "safe", 0.95, "unsafe", 0.99, "porn", 0.6, "L2_bert", "safe"),
        (5, None, None, None, None, None, None, "L3_llm", "unsafe"),
    ]
    df = spark.createDataFrame(
        rows,
        "id long, score_label string, score_confidence double, second_label string, "
        "second_confidence double, audit_label string, audit_confidence double, tier string, label string",
    ).withColumn("text", F.lit("t")).withColumn(
        "kw", F.struct(F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("confidence"))
    )
    for r in funnel.with_text_signal(df).collect():
        assert (r["text_signal"]["tier"], r["text_signal"]["label"]) == (r["tier"], r["label"]), r["id"]
    off = funnel.with_text_signal(df.where("id = 5"), classifier_enabled=False).first()["text_signal"]
    assert (off["label"], off["confidence"], off["model"]) == ("unsafe", 0.5, "fallback_bert")


def test_a_model_scores_each_text_once(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "yy"), ("c", " ")], "key string, text string")

    def model(batches):
        for texts in batches:
            yield pd.DataFrame({"n": texts.str.len()})

    got = funnel.score_distinct(df, model, "n long").collect()
    assert sorted(tuple(r) for r in got) == [("a", 1), ("b", 2)]


def test_classifier_learns_and_embeds(spark):
    rows = [(i, f"you idiot number {i}" if i % 2 else f"nice day number {i}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "content_id long, text string, label int")
    assert classifier.readiness(df).first()["ready"]
    model = classifier.train(df, features=1 << 12)
    scored = classifier.score(model, df.unionByName(spark.createDataFrame([(900, " ", 0)], df.schema)))
    right = scored.where("(score_label = 'unsafe') = (label = 1)").count()
    assert right == 201
    vectors = {r["content_id"]: r["embedding"] for r in classifier.embed(
        spark.createDataFrame([(1, "abcabc"), (2, "ABCABC"), (3, "xyz xyz"), (4, "")], "content_id long, text string")
    ).collect()}
    assert vectors[1] == vectors[2] != vectors[3] and not any(vectors[4])


def test_texts_shorter_than_a_gram_have_unit_vectors(spark):
    rows = [(1, "A."), (2, "x"), (3, "abc"), (4, " "), (5, None), (6, "a.")]
    vectors = {r[0]: r[1] for r in classifier.embed(spark.createDataFrame(rows, "content_id long, text string")).collect()}
    assert [round(sum(x * x for x in vectors[i]), 4) for i in range(1, 7)] == [1, 1, 1, 0, 0, 1]
    assert vectors[1] == vectors[6] != vectors[2]


def test_streams_equal_batch(spark):
    source = scratch_path(spark, "in")
    rows = [(i, f"t{i % 7}", "s", 1000 + i * 400) for i in range(40)]
    df = spark.createDataFrame(rows, "content_id long, text string, source string, ts long")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)

    out = scratch_path(spark, "dedup")
    writer = jobs.first_seen(stream).writeStream.format("parquet").option("path", out)
    jobs.run(writer, scratch_path(spark, "cp"))
    assert spark.read.parquet(out).count() == 7

    out = scratch_path(spark, "ttl")
    lives = jobs.ttl_cache(stream, ttl=2801)
    jobs.upsert_sink(lives, out, scratch_path(spark, "cp"), mode="complete")
    found = jobs.read_upserts(spark, out, ["key", "started"]).collect()
    assert len(found) == 7 and sum(r["hits"] for r in found) == 33

    out = scratch_path(spark, "counts")
    jobs.upsert_sink(jobs.windowed_counts(stream, "source"), out, scratch_path(spark, "cp"))
    counts = jobs.read_upserts(spark, out, ["window_start", "window_end", "source"])
    assert counts.agg(F.sum("n")).first()[0] == 40

    log = scratch_path(spark, "log")
    jobs.append_log(stream, log, scratch_path(spark, "cp"))
    assert spark.read.parquet(log).count() == 40


def test_ttl_ends_an_entry_on_the_second(spark, tmp_path):
    rows = [("a", "same", 0.0), ("b", "same", 3599.0), ("c", "same", 7199.0)]
    spark.createDataFrame(rows, "content_id string, text string, ts double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content_id string, text string, ts double").parquet(str(tmp_path / "in"))
    out = scratch_path(spark, "edge")
    jobs.upsert_sink(jobs.ttl_cache(stream, ttl=3600), out, scratch_path(spark, "cp"), mode="complete")
    lives = jobs.read_upserts(spark, out, ["key", "started"]).collect()
    assert sorted((r["started"], r["hits"]) for r in lives) == [(0, 1), (7199, 0)]


def test_newest_run_is_found_by_its_folder(spark, tmp_path):
    root = str(tmp_path / "runs")
    for run, n in (("20240101_000000", 3), ("20240301_000000", 2), ("20240201_000000", 5)):
        writers.write_assets({"a": spark.range(n)}, root, run)
    found = readers.latest_run(spark, f"{root}/a")
    assert found.count() == 2 and {r["run"] for r in found.collect()} == {"20240301_000000"}
    # No other run's files are part of the plan.
    assert all("run=20240301_000000" in f for f in found.inputFiles())
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.latest_run(spark, str(tmp_path / "none"))


def test_a_scorer_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os
        import uuid

        os.makedirs(log, exist_ok=True)
        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: texts.str.len().astype("int64").to_frame("size")

    scorers.register("size", load, "size long")
    df = spark.range(4000).select(
        F.col("id").alias("content_id"), F.concat(F.lit("t"), F.col("id") % 100).alias("text")
    ).withColumn("key", F.col("text")).unionByName(spark.createDataFrame([(-1, " ", "k")], "content_id long, text string, key string"))
    found = scorers.with_scores(df.repartition(16), "size")
    rows = found.collect()
    assert len(rows) == 4001 and all(r["size"] == (None if r["key"] == "k" else len(r["text"])) for r in rows)
    pids = [f.split("-")[0] for f in os.listdir(log)]
    assert len(pids) == len(set(pids))


def test_run_counts_equal_the_single_reports(spark, tmp_path):
    rows = [
        (i, f"c{i}", "t" if i % 7 else "", ["pass", "block", "review", None][i % 4], (i % 11) / 10, ["L1", "L2", None][i % 3],
         "says 'bad stuff'", "human" if i % 5 == 0 else "ai", "L3_llm" if i % 2 else "L2_bert", "unsafe",
         "unsafe" if i % 3 else "safe", ["block", "review", "pass"][i % 3] if i % 5 == 0 else None,
         ["pass", "block"][i % 2] if i % 5 == 0 else None, i)
        for i in range(300)
    ]
    names = (
        "event_id long, content_id string, text string, decision string, confidence double, tier string, reason string, "
        "source_label string, text_tier string, text_label string, bert_preliminary string, ai_decision string, human_decision string, ts long"
    )
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, names).write.parquet(path)
    events = spark.read.parquet(path)
    history = spark.createDataFrame([(f"2024-01-{d:02d}", 0.9, 10) for d in range(1, 11)], "date string, accuracy double, sample_size long")
    figures, recorded, terms = feedback.run(events, history, KeywordDictionary({"x": ["word"]}), "2024-02-01")
    got = {r["figure"]: r["value"] for r in figures.collect()}
    rates = feedback.report(events).first()
    for name in ("human_review_rate", "human_override_rate", "bert_llm_agreement"):
        assert got[name] == rates[name]
    assert got["false_positives"] == events.where("ai_decision = 'block' and human_decision = 'pass'").count()
    assert got["hard_cases"] == feedback.hard_cases(events).count()
    for r in feedback.labelled_summary(events).groupBy("sample").agg(F.sum("n").alias("n")).collect():
        assert got[f"samples_{r['sample']}"] == r["n"]
    for r in feedback.distributions(events).collect():
        assert got[f"{r['dimension']}_{r['value']}"] == r["n"]
    assert {r["bin"]: float(r["n"]) for r in feedback.confidence_bins(events).collect()} == {
        b: got.get(f"confidence_{b}", 0.0) for b in feedback.CONFIDENCE_BINS
    }
    assert got["terms"] == terms.count() == 1
    # The record of the run is part of the drift it reports.
    last = recorded.where("date = '2024-02-01'").first()
    assert last["accuracy"] == got["accuracy"] == round(1 - rates["human_override_rate"], 4)
    assert got["drop"] == round(0.9 - (0.9 * 6 + last["accuracy"]) / 7, 4)
    plan = feedback.run_cells(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
