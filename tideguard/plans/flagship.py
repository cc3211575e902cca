"""The flagship query: from text to decisions per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideguard.functions.text import blank
from tideguard.operators.decision import with_decision
from tideguard.operators.funnel import with_text_signal
from tideguard.operators.keywords import with_verdict
from tideguard.plans.views import DICTIONARY, Views


def decisions_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    # The text is needed in the scan stage only; the join moves ids, sources and verdicts.
    seen = with_verdict(v.content, DICTIONARY).select(
        "content_id", "source", blank(F.col("text")).alias("is_blank"), "kw"
    )
    judged = with_text_signal(
        seen.join(v.signals, "content_id"), is_blank=F.col("is_blank")
    )
    ready = (
        judged.withColumn("text_label", F.col("text_signal.label"))
        .withColumn("text_confidence", F.col("text_signal.confidence"))
        .withColumn("text_reason", F.col("text_signal.reason"))
    )
    return (
        with_decision(ready)
        .groupBy("source", "decision")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    )
