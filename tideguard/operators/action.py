"""What follows a decision: reuse entries, review records, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.functions.text import content_key, filled
from tideguard.functions.traces import joined, trace_step
from tideguard.operators.review import enqueue


def reuse_entries(decided: DataFrame, decided_at: Column) -> DataFrame:
    """Entries for the reuse stores: computed decisions on non-blank text."""
    computed = ~F.coalesce(F.col("cache_hit"), F.lit(False))
    return decided.where(computed & filled(F.col("text"))).select(
        content_key(F.col("text")).alias("key"),
        "decision",
        "confidence",
        "reason",
        F.coalesce("tier", F.lit("")).alias("tier"),
        decided_at.alias("decided_at"),
    )


def event_rows(decided: DataFrame, happened_at: Column) -> DataFrame:
    """One event per decision for the feedback log."""
    stamp = F.from_unixtime(happened_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.lower(F.hex(F.pmod(F.xxhash64(F.col("content_id")), F.lit(65536))))
    return decided.select(
        F.concat(
            F.lit("evt_"), (happened_at * 1000).cast("string"), F.lit("_"), F.lpad(number, 4, "0")
        ).alias("event_id"),
        happened_at.alias("timestamp"),
        stamp.alias("timestamp_iso"),
        "content_id",
        "text",
        F.coalesce("user_id", F.lit("anonymous")).alias("user_id"),
        F.coalesce("source", F.lit("api")).alias("source"),
        "decision",
        "confidence",
        "reason",
        F.coalesce("tier", F.lit("cache")).alias("tier"),
        F.lit("ai").alias("source_label"),
    )


def outputs(decided: DataFrame, at: Column) -> dict[str, DataFrame]:
    """The three outputs of one decided frame: entries, reviews, events."""
    for name, kind in {"cache_hit": "boolean", "user_id": "string", "source": "string"}.items():
        if name not in decided.columns:
            decided = decided.withColumn(name, F.lit(None).cast(kind))
    return {
        "entries": reuse_entries(decided, at),
        "reviews": enqueue(decided, at),
        "events": event_rows(decided, at),
    }


def action_traces(shown: Column) -> Column:
    """Trace steps of what follows a decision that was computed."""
    outcome = F.struct("decision")
    queued = F.when(
        F.col("decision") == "review", trace_step("action", "human_review_queue", "review queue", shown, outcome)
    )
    return joined(F.array_compact(F.array(queued, trace_step("action", "execute", "none", shown, outcome))))


def split_outcomes(decided: DataFrame) -> dict[str, DataFrame]:
    """Rows by decision, as the three handlers of a caller take them."""
    return {d: decided.where(F.col("decision") == d) for d in ("block", "review", "pass")}
