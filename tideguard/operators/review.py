"""The human review queue as an append log: enqueue, pending, resolve, feed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.functions.text import content_key, filled


def review_id(content_id: Column, enqueued_at: Column) -> Column:
    named = F.concat_ws(":", content_id.cast("string"), enqueued_at.cast("string"))
    return F.substring(F.sha2(named, 256), 1, 16)


def enqueue(decided: DataFrame, enqueued_at: Column) -> DataFrame:
    """Pending review records of the rows decided "review"."""
    priority = F.col("priority") if "priority" in decided.columns else F.lit(None).cast("double")
    return decided.where(F.col("decision") == "review").select(
        review_id(F.col("content_id"), enqueued_at).alias("review_id"),
        "content_id",
        "text",
        F.lit("pending").alias("status"),
        enqueued_at.alias("enqueued_at"),
        F.coalesce(priority, F.lit(0.5)).alias("priority"),
        F.col("decision").alias("ai_decision"),
        F.col("confidence").alias("ai_confidence"),
        F.col("reason").alias("ai_reason"),
        F.lit(None).cast("string").alias("human_decision"),
        F.lit(None).cast("string").alias("human_reason"),
        F.lit(None).cast("string").alias("reviewed_by"),
    )


def pending(reviews: DataFrame, limit: int = 50) -> DataFrame:
    """The most urgent pending reviews; equal priorities in the order of arrival."""
    priority = F.coalesce("priority", F.lit(0.5))
    return (
        reviews.where(F.col("status") == "pending")
        .orderBy(priority.desc(), "enqueued_at", "review_id")
        .limit(limit)
    )


def resolve(
    reviews: DataFrame, resolutions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue after the resolutions, resolved records, rejected resolutions).

    A resolution has review_id, human_decision, reviewer, reason, resolved_at. Decisions
    other than pass and block and unknown reviews are rejected; the last one of several for
    a review wins.
    """
    allowed = F.coalesce(F.col("human_decision").isin("pass", "block"), F.lit(False))
    valid = resolutions.where(allowed)
    rest = [c for c in resolutions.columns if c != "review_id"]
    last = valid.groupBy("review_id").agg(F.max_by(F.struct(*rest), F.col("resolved_at")).alias("_r"))
    outcome = {
        "status": F.lit("reviewed"),
        "human_decision": F.col("_r.human_decision"),
        "human_reason": F.col("_r.reason"),
        "reviewed_by": F.col("_r.reviewer"),
    }
    both = reviews.join(last, "review_id", "left")
    touched = F.col("_r").isNotNull()
    queue = both.select(
        *[
            F.when(touched, outcome[c]).otherwise(F.col(c)).alias(c) if c in outcome else F.col(c)
            for c in reviews.columns
        ],
        F.when(touched, F.col("_r.resolved_at")).alias("reviewed_at"),
    )
    resolved = queue.where(F.col("reviewed_at").isNotNull())
    unknown = valid.join(reviews.select("review_id"), "review_id", "left_anti")
    rejected = resolutions.where(~allowed).withColumn(
        "error", F.lit("human_decision must be 'pass' or 'block'")
    ).unionByName(
        unknown.withColumn(
            "error", F.concat(F.lit("Review "), F.col("review_id"), F.lit(" not found"))
        )
    )
    return queue, resolved, rejected


def queue_stats(reviews: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))

    def n(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    return reviews.agg(
        total.alias("total"),
        n("pending").alias("pending"),
        n("reviewed").alias("reviewed"),
        F.round(n("pending") / F.greatest(total, F.lit(1)), 4).alias("pending_rate"),
    )


def human_entries(resolved: DataFrame) -> DataFrame:
    """Reuse entries of human decisions: certain, whatever was stored before."""
    return resolved.where(filled(F.col("text"))).select(
        content_key(F.col("text")).alias("key"),
        F.col("human_decision").alias("decision"),
        F.lit(1.0).alias("confidence"),
        F.coalesce("human_reason", F.lit("")).alias("reason"),
        F.lit("human_review").alias("tier"),
        F.col("reviewed_at").alias("decided_at"),
    )


def human_events(resolved: DataFrame) -> DataFrame:
    """Reviewed records as events of the feedback log."""
    return resolved.select(
        "content_id",
        "text",
        F.coalesce("human_decision", F.lit("pass")).alias("decision"),
        F.lit(1.0).alias("confidence"),
        F.coalesce("human_reason", F.lit("")).alias("reason"),
        F.lit("human").alias("source_label"),
        F.col("ai_decision"),
        F.col("ai_confidence"),
        F.col("human_decision"),
        F.col("human_reason"),
        F.lit("human_review").alias("tier"),
    )
