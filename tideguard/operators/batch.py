"""Moderation of a whole table: gateway, funnel, decision, with copies judged once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.config import DecisionConfig, KeywordDictionary
from tideguard.functions.text import content_key
from tideguard.functions.traces import joined, no_steps, trace_step
from tideguard.operators import gateway
from tideguard.operators.action import action_traces
from tideguard.operators.decision import decision_traces, with_decision
from tideguard.operators.funnel import funnel_traces, with_text_signal
from tideguard.operators.reuse import first_of_copies
from tideguard.operators.skew import salted_join


def dedup(content: DataFrame, order: str = "content_id") -> tuple[DataFrame, DataFrame]:
    """(first row of every distinct content, every row's id, key and first id).

    The second frame is what copies are served from; a hot text is spread over tasks.
    """
    keyed = content.withColumn("key", content_key(F.coalesce("text", F.lit(""))))
    first, firsts = first_of_copies(keyed, "key", order)
    members = salted_join(
        keyed.select("key", order), firsts.withColumnRenamed("first_ord", "first_id"), ["key"],
        F.col(order), "inner",
    )
    return first, members


def cold_path(
    escalated: DataFrame,
    signals: DataFrame,
    config: DecisionConfig | None = None,
    placeholder_image: bool = True,
) -> DataFrame:
    """Decisions for escalated rows from the signal table.

    `signals` has one row per content_id with the columns `with_text_signal` and
    `aggregate_signals` read; content without a row is judged without signals.
    """
    joined_in = escalated.join(signals, "content_id", "left")
    signalled = with_text_signal(
        joined_in,
        config,
        prefiltered=F.col("keyword_prefiltered"),
        is_blank=~F.col("has_text"),
    ).withColumn("text_label", F.when(F.col("has_text"), F.col("text_signal.label")))
    ready = (
        signalled.withColumn("text_confidence", F.col("text_signal.confidence"))
        .withColumn("text_reason", F.col("text_signal.reason"))
    )
    decided = with_decision(ready.drop("keyword_label", "keyword_confidence"), config, placeholder_image)
    tier = F.when(F.col("has_text"), F.col("text_signal.tier")).otherwise("L3_llm")
    # The gateway's steps hold the text as they show it.
    shown = F.coalesce(F.get("traces", F.lit(0))["input"], F.lit(""))
    image = F.struct(F.col("image_label").alias("label"), F.col("image_confidence").alias("confidence"))
    image_step = trace_step("image_agent", "nsfw", "classifier", shown, image, "low")
    steps = joined(
        F.col("traces"),
        F.when(F.col("has_text"), funnel_traces(shown, F.col("text_signal"))),
        F.when(F.col("image_label").isNotNull(), F.array(image_step)),
        decision_traces(shown),
        action_traces(shown),
    )
    return decided.select(
        "content_id", "decision", "confidence", "reason", tier.alias("tier"), "rule",
        F.col("text_signal.cost").alias("cost"), steps.alias("traces"),
    )


def moderate(
    content: DataFrame,
    signals: DataFrame,
    dictionary: KeywordDictionary,
    stores: dict,
    config: DecisionConfig | None = None,
    mode: str = "word",
    cut: Callable[[DataFrame], DataFrame] | None = None,
    share_copies: bool = True,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Every row of `content` with decision, confidence, reason, tier, path, resolved_by, traces.

    `content` has content_id, text, ts and optionally the image columns and embedding, which may
    also come apart as `vectors` (`gateway.prepare`);
    `stores` are the keyword arguments of `gateway.check`. Copies of a text are judged once
    (their first row) unless an image comes with them. Rows without an id or time cannot be
    processed and come back with decision "error".
    """
    broken = F.col("content_id").isNull() | F.col("ts").isNull()
    usable, failed = content.where(~broken), content.where(broken)
    prepared = gateway.prepare(usable, dictionary, mode, vectors)
    prepared = cut(prepared) if cut else prepared
    if share_copies:
        # The key of an image is its own row: only texts are shared.
        keyed = prepared.withColumn(
            "key",
            F.when(F.col("has_image"), F.concat(F.lit("#"), F.col("content_id").cast("string")))
            .otherwise(F.col("key")),
        )
        first, firsts = first_of_copies(keyed, "key", "content_id")
        members = salted_join(
            keyed.select("key", "content_id"), firsts, ["key"], F.col("content_id"), "inner"
        ).select("content_id", F.col("first_ord").alias("first_id"))
        prepared = first.drop("copies")
    checked = gateway.check(prepared, cut=cut, **stores)
    checked = cut(checked) if cut else checked
    hot = checked.where(F.col("ruling").isNotNull()).select(
        "content_id", "ruling.*", F.lit("gateway").alias("rule"), F.lit("zero").alias("cost"),
        "traces", F.lit("hot").alias("path"), "resolved_by",
    )
    cold = (
        cold_path(checked.where(F.col("ruling").isNull()), signals, config)
        .withColumn("path", F.lit("cold"))
        .withColumn("resolved_by", F.lit("cold_path"))
    )
    judged = hot.unionByName(cold)
    if share_copies:
        results = judged.withColumnRenamed("content_id", "first_id")
        judged = salted_join(members, results, ["first_id"], F.col("content_id"), "inner").withColumn(
            "shared", F.col("first_id") != F.col("content_id")
        )
        shown = F.coalesce(F.get("traces", F.lit(0))["input"], F.lit(""))
        copied = F.when(F.col("shared"), dedup_step(F.col("first_id"), shown))
        judged = judged.withColumn("traces", joined(F.col("traces"), copied)).drop("first_id")
    else:
        judged = judged.withColumn("shared", F.lit(False))
    errors = failed.select(
        "content_id",
        F.lit("error").alias("decision"),
        F.lit(0.0).alias("confidence"),
        F.lit("Processing error: content without id or time").alias("reason"),
        F.lit("error").alias("tier"),
        F.lit("error").alias("rule"),
        F.lit("zero").alias("cost"),
        no_steps().alias("traces"),
        F.lit("error").alias("path"),
        F.lit("error").alias("resolved_by"),
        F.lit(False).alias("shared"),
    )
    return judged.unionByName(errors)


def dedup_step(shared_with: Column, text: Column) -> Column:
    """Trace step of a copy that took over another row's result."""
    output = F.struct(F.lit(True).alias("dedup"), shared_with.alias("shared_with"))
    return joined(F.array(trace_step("batch", "inflight_dedup", "SHA256 · in-flight", text, output)))


def formatted(results: DataFrame) -> DataFrame:
    """Response fields with their defaults for results that lack them."""
    return results.select(
        "content_id",
        F.coalesce("decision", F.lit("pass")).alias("decision"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("tier", F.lit("L3_llm")).alias("tier"),
        F.coalesce("path", F.lit("cold")).alias("path"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row: totals by decision and path, audit rate, tier distribution as text.

    Tiers are counted first, so the second step sees one row per tier only.
    """
    is_, total = (lambda c, v: F.count(F.when(F.col(c) == v, 1))), F.count(F.lit(1))
    per_tier = results.groupBy(F.coalesce("tier", F.lit("unknown")).alias("tier")).agg(
        total.alias("n"),
        is_("decision", "pass").alias("passed"),
        is_("decision", "block").alias("blocked"),
        is_("decision", "review").alias("reviewed"),
        is_("path", "hot").alias("hot_path"),
        is_("path", "cold").alias("cold_path"),
    )
    line = F.concat(F.col("tier"), F.lit("="), F.col("n").cast("string"))
    n = F.sum("n")
    audits = F.coalesce(F.sum(F.when(F.col("tier") == "L3_llm", F.col("n"))), F.lit(0))
    return per_tier.agg(
        n.alias("total"),
        *[F.sum(c).alias(c) for c in ("passed", "blocked", "reviewed", "hot_path", "cold_path")],
        F.round(F.sum("hot_path") / n, 4).alias("hot_path_rate"),
        F.round(audits / n, 4).alias("llm_call_rate"),
        F.array_join(F.array_sort(F.collect_list(line)), ";").alias("tier_distribution"),
    )
