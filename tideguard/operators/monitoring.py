"""Retrain trigger, drift, threshold calibration, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideguard.config import DRIFT_DROP, HISTORY_LENGTH, RETRAIN_LABELS, DecisionConfig

# --- fixed values: metric, limit, True if a value below the limit is alarming ----------
ALERT_RULES = [
    ("hot_path_rate", 0.30, True),
    ("chroma_cache_hit_rate", 0.10, True),
    ("llm_call_rate", 0.30, False),
    ("latency_p99_ms", 3000.0, False),
]
# --- end of fixed values ---------------------------------------------------------------


def keep_last(history: DataFrame, n: int = HISTORY_LENGTH, order: str = "date") -> DataFrame:
    """The last `n` accuracy records; TakeOrdered, never a full sort."""
    return history.orderBy(F.col(order).desc()).limit(n)


def drift(
    history: DataFrame, order: str = "date", recent: int = 7, drop: float = DRIFT_DROP
) -> DataFrame:
    """Mean accuracy of the last `recent` records against all kept earlier ones, one row.

    Fewer than `recent` records give no verdict; exactly `recent` are their own baseline.
    At most HISTORY_LENGTH records are ranked.
    """
    newest = Window.orderBy(F.col(order).desc())
    ranked = keep_last(history, order=order).withColumn("_rank", F.row_number().over(newest))
    late = F.col("_rank") <= recent
    n = F.count(F.lit(1))
    recent_avg = F.avg(F.when(late, F.col("accuracy")))
    baseline = F.when(n > recent, F.avg(F.when(~late, F.col("accuracy")))).otherwise(recent_avg)
    figures = ranked.agg(n.alias("records"), recent_avg.alias("r"), baseline.alias("b"))
    enough = F.col("records") >= recent
    return figures.select(
        "records",
        F.when(enough, F.round("r", 4)).alias("recent_avg"),
        F.when(enough, F.round("b", 4)).alias("baseline_avg"),
        F.when(enough, F.round(F.col("b") - F.col("r"), 4)).alias("drop"),
        F.coalesce(enough & (F.col("b") - F.col("r") > drop), F.lit(False)).alias("drift"),
    )


def retrain_trigger(
    labels: DataFrame, day: str = "day", last_reset: Column | None = None,
    threshold: int = RETRAIN_LABELS,
) -> DataFrame:
    """Labels per day with the running total since the last reset, and when it suffices.

    Labels are counted per day first; the running total orders days, not labels.
    """
    counted = labels if last_reset is None else labels.where(F.col(day) > last_reset)
    daily = counted.groupBy(day).agg(F.count(F.lit(1)).alias("new_labels"))
    so_far = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("new_labels").over(so_far)
    return daily.withColumn("labels_since_reset", total).select(
        day,
        "new_labels",
        "labels_since_reset",
        (F.col("labels_since_reset") >= threshold).alias("should_retrain"),
        _progress(F.col("labels_since_reset"), threshold).alias("message"),
    )


def running_trigger(
    daily: DataFrame, before: int = 0, threshold: int = RETRAIN_LABELS, reset: bool = False
) -> DataFrame:
    """Daily counts (day, new_labels) with the running count of labels, `before` of them already there.

    With `reset` a day on which they suffice starts training and the count begins again after it;
    `left_over` is the count after the day. The days of one call are gone through in order, in one
    row; there are as many as days, whatever the labels.
    """
    days = F.array_sort(F.collect_list(F.struct("day", F.col("new_labels").cast("long").alias("n"))))
    kind = "array<struct<day:string,n:bigint,total:bigint,left:bigint>>"

    def step(done: Column, d: Column) -> Column:
        so_far = F.coalesce(F.element_at(done, -1)["left"], F.lit(before).cast("long"))
        total = so_far + d["n"]
        left = F.when(F.lit(reset) & (total >= threshold), F.lit(0).cast("long")).otherwise(total)
        row = F.struct(d["day"].alias("day"), d["n"].alias("n"), total.alias("total"), left.alias("left"))
        return F.concat(done, F.array(row))

    empty = F.array(F.struct(F.lit("").alias("day"), *[F.lit(0 if c != "left" else before).cast("long").alias(c) for c in ("n", "total", "left")])).cast(kind)
    rows = daily.agg(F.aggregate(days, empty, step).alias("rows"))
    rows = rows.select(F.explode(F.expr("slice(rows, 2, greatest(size(rows) - 1, 0))")).alias("r"))
    total = F.col("r.total")
    return rows.select(
        F.col("r.day").alias("day"),
        F.col("r.n").alias("new_labels"),
        total.alias("labels_since_reset"),
        (total >= threshold).alias("should_retrain"),
        _progress(total, threshold).alias("message"),
        F.col("r.left").alias("left_over"),
    )


def _progress(count: Column, threshold: int) -> Column:
    ready = F.format_string(
        f"%d labels accumulated (threshold={threshold}) — ready for fine-tuning", count
    )
    waiting = F.concat(
        count.cast("string"),
        F.lit(f"/{threshold} labels ("),
        F.format_number(F.floor(count * 1000 / threshold) / 10, 1),
        F.lit("%) — need "),
        (F.lit(threshold) - count).cast("string"),
        F.lit(" more"),
    )
    return F.when(count >= threshold, ready).otherwise(waiting)


def calibrate(report: DataFrame, config: DecisionConfig | None = None, strict: bool = False):
    """New thresholds from the override rate of a report, one row.

    A zero override rate counts as accuracy 0.95, which is not enough to lower a threshold;
    `strict` takes it as accuracy 1.
    """
    cfg = config or DecisionConfig()
    high, grey = float(cfg["bert_high_confidence"]), float(cfg["grey_zone"]["high"])
    rate = F.coalesce(F.col("human_override_rate"), F.lit(0.0))
    accuracy = F.when((rate == 0.0) & F.lit(not strict), 0.95).otherwise(1.0 - rate)
    enough = F.col("total_events") >= 100
    good, bad = enough & (F.col("accuracy") > 0.95), enough & (1.0 - F.col("accuracy") > 0.20)
    return report.withColumn("accuracy", accuracy).select(
        F.round("accuracy", 4).alias("accuracy"),
        F.when(good, F.greatest(F.lit(0.85), F.round(F.lit(high) - 0.02, 2)))
        .when(bad, F.least(F.lit(0.98), F.round(F.lit(high) + 0.03, 2)))
        .otherwise(high)
        .alias("bert_high"),
        F.lit(float(cfg["bert_low_confidence"])).alias("bert_low"),
        F.lit(float(cfg["grey_zone"]["low"])).alias("grey_low"),
        F.when(bad, F.least(F.lit(0.80), F.round(F.lit(grey) + 0.05, 2)))
        .otherwise(grey)
        .alias("grey_high"),
    )


def health_status(
    labels: DataFrame, history: DataFrame, report: DataFrame, threshold: int = RETRAIN_LABELS
) -> DataFrame:
    """One row: label count and trigger, drift, thresholds."""
    count = labels.agg(F.count(F.lit(1)).alias("n"))
    found, limits = drift(history), calibrate(report)
    n = F.col("labels_since_reset")
    return limits.select(
        count.scalar().alias("labels_since_reset"),
        found.select("drift").scalar().alias("drift"),
        found.select("drop").scalar().alias("drop"),
        "bert_high",
        "grey_high",
    ).select(
        "*", (n >= threshold).alias("should_retrain"), _progress(n, threshold).alias("message")
    )


def daily_accuracy(events: DataFrame, ts: str, failed: Column) -> DataFrame:
    """One accuracy record per day: share of events that did not fail."""
    return events.groupBy(F.to_date(ts).cast("string").alias("date")).agg(
        F.round(1.0 - F.count(F.when(failed, 1)) / F.count(F.lit(1)), 4).alias("accuracy"),
        F.count(F.lit(1)).alias("sample_size"),
    )


def alerts(figures: DataFrame) -> DataFrame:
    """The figures that break an alert rule's limit: (metric, value, limit, alert)."""
    rules = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).cast("double").alias("value"),
            F.lit(limit).alias("limit_value"),
            ((F.col(name) < limit) if below else (F.col(name) > limit)).alias("alert"),
        )
        for name, limit, below in ALERT_RULES
    ]
    return figures.select(F.explode(F.array(*rules)).alias("_r")).select("_r.*")
