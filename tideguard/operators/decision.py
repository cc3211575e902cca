"""Signal aggregation and decision rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.config import DecisionConfig
from tideguard.functions.traces import joined, trace_step

# Maps that a tenant may set; columns so named override the parameters row by row.
MAPS = ["agent_weights", "label_severity", "score_thresholds"]


def _numbers(config: DecisionConfig, name: str) -> dict[str, float]:
    return {k: float(v) for k, v in config[name].items()}


def _setting(df: DataFrame, name: str, config: DecisionConfig) -> Column:
    """A map of the parameters: the row's own where it has one."""
    entries = [F.lit(x) for pair in _numbers(config, name).items() for x in pair]
    general = F.create_map(*entries).cast("map<string,double>")
    return F.coalesce(F.col(name), general) if name in df.columns else general


def _looked_up(table: Column, key: Column | str, unknown: float) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(table, key), F.lit(unknown))


def _weighed(signals: list[tuple[str, Column, Column, float]], weights: Column, severity: Column) -> tuple[Column, Column]:
    """(score, smallest confidence) over the signals that are present.

    A signal is its weight's name, label (null: absent), confidence and the severity of an
    unknown label. Weights are renormalised over the signals present.
    """
    present = [F.when(label.isNotNull(), _looked_up(weights, name, 0.0)) for name, label, _, _ in signals]
    total = F.nullif(reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(0.0)) for w in present]), F.lit(0.0))
    parts = []
    for weight, (_, label, confidence, unknown) in zip(present, signals, strict=True):
        share = F.coalesce(weight / total, F.lit(0.0))
        part = _looked_up(severity, label, unknown) * confidence * share
        parts.append(F.when(label.isNotNull(), part).otherwise(0.0))
    least = F.least(F.lit(1.0), *[F.when(label.isNotNull(), confidence) for _, label, confidence, _ in signals])
    return reduce(lambda a, b: a + b, parts), least


def score_label(score: Column, config: DecisionConfig, thresholds: Column | None = None) -> Column:
    """Label of a severity score, under the parameters or a map column of thresholds.

    With a "politics" threshold set, the top band is always "politics": the same threshold
    opens the band and tells the two labels apart.
    """
    t = _numbers(config, "score_thresholds")

    def at_least(label: str, unset: float) -> Column:
        if thresholds is None:
            return score >= t.get(label, unset)
        return score >= _looked_up(thresholds, label, unset)

    top = F.when(at_least("politics", 0.95), "politics").otherwise("violence")
    return (
        F.when(at_least("politics", 0.85), top)
        .when(at_least("porn", 0.65), "porn")
        .when(at_least("gambling", 0.45), "gambling")
        .when(at_least("toxic", 0.25), "toxic")
        .when(at_least("spam", 0.10), "spam")
        .otherwise("safe")
    )


def aggregate_signals(
    df: DataFrame, config: DecisionConfig | None = None, placeholder_image: bool = True
) -> DataFrame:
    """Adds `score`, `agg_label`, `agg_confidence` from the text and image signals.

    Reads text_label, text_confidence, image_label, image_confidence and, where the frame has
    them, multimodal_label and multimodal_confidence (null = no signal).
    With `placeholder_image` an absent image counts as a normal one at confidence 1, as on
    the full path; without, only signals that are present weigh in. Map columns named as in
    MAPS override the parameters row by row.
    """
    cfg = config or DecisionConfig()
    image_label, image_confidence = F.col("image_label"), F.col("image_confidence")
    if placeholder_image:
        absent = image_label.isNull()
        image_confidence = F.when(absent, 1.0).otherwise(image_confidence)
        image_label = F.when(absent, "normal").otherwise(image_label)
    signals = [
        ("text", F.col("text_label"), F.col("text_confidence"), 0.5),
        ("image", image_label, image_confidence, 0.0),
    ]
    if "multimodal_label" in df.columns:
        signals.append(("multimodal", F.col("multimodal_label"), F.col("multimodal_confidence"), 0.5))
    score, least = _weighed(signals, _setting(df, "agent_weights", cfg), _setting(df, "label_severity", cfg))
    thresholds = _setting(df, "score_thresholds", cfg) if "score_thresholds" in df.columns else None
    return (
        df.withColumn("score", score)
        .withColumn("agg_label", score_label(F.col("score"), cfg, thresholds))
        .withColumn("agg_confidence", least)
    )


def with_decision(
    df: DataFrame,
    config: DecisionConfig | None = None,
    placeholder_image: bool = True,
) -> DataFrame:
    """Adds decision, confidence, reason and the rule that decided.

    Reads the signal columns of `aggregate_signals` plus, where the frame has them:
    cached_decision, cached_confidence, cached_reason (an earlier decision to reuse),
    keyword_label, keyword_confidence, text_reason. Columns grey_low / grey_high /
    zero_tolerance and those of MAPS override the parameters row by row.
    """
    cfg = config or DecisionConfig()
    out = aggregate_signals(df, cfg, placeholder_image)

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    low = F.coalesce(given("grey_low", "double"), F.lit(float(cfg["grey_zone"]["low"])))
    high = F.coalesce(given("grey_high", "double"), F.lit(float(cfg["grey_zone"]["high"])))
    zero = F.coalesce(
        given("zero_tolerance", "array<string>"),
        F.array(*[F.lit(x) for x in cfg["zero_tolerance"]]).cast("array<string>"),
    )
    cached, kw_label = given("cached_decision", "string"), given("keyword_label", "string")
    kw_conf = F.coalesce(given("keyword_confidence", "double"), F.lit(0.0))
    text_reason = given("text_reason", "string")
    image_conf = F.col("image_confidence")
    label, conf = F.col("agg_label"), F.col("agg_confidence")

    def outcome(decision: str | Column, confidence: Column, reason: Column, rule: str) -> Column:
        return F.struct(
            (F.lit(decision) if isinstance(decision, str) else decision).alias("decision"),
            confidence.alias("confidence"),
            reason.alias("reason"),
            F.lit(rule).alias("rule"),
        )

    def said(default: Column) -> Column:
        return F.coalesce(text_reason, default)

    one = F.lit(1.0)
    kw = F.coalesce(kw_label, F.lit("unsafe"))
    has_image = F.col("image_label").isNotNull() | F.lit(placeholder_image)
    only_image = F.col("text_label").isNull() & has_image
    nsfw = (F.col("image_label") == "nsfw") & (image_conf > 0.5)
    ruling = (
        F.when(
            cached.isNotNull(),
            outcome(
                cached,
                given("cached_confidence", "double"),
                F.coalesce(given("cached_reason", "string"), F.lit("Cache hit")),
                "cache_reuse",
            ),
        )
        .when(
            (kw_conf > 0.99) & F.array_contains(zero, kw),
            outcome("block", one, F.lit("Zero-tolerance policy"), "zero_tolerance_keyword"),
        )
        .when(
            kw_conf > 0.99,
            outcome(
                "block",
                one,
                F.concat(F.lit("High-confidence keyword match: "), kw),
                "keyword_high_conf",
            ),
        )
        .when(
            only_image & nsfw,
            outcome(
                "block",
                image_conf,
                F.concat(
                    F.lit("Image NSFW detected (conf="),
                    F.format_string("%.2f", image_conf),
                    F.lit(")"),
                ),
                "image_nsfw",
            ),
        )
        .when(
            only_image,
            outcome(
                "pass", F.coalesce(image_conf, one), F.lit("Image appears normal"), "image_normal"
            ),
        )
        .when(
            F.col("text_label").isNull(),
            outcome("pass", F.lit(0.5), F.lit("No text moderation result"), "fallback"),
        )
        .when(
            F.array_contains(zero, label),
            outcome("block", conf, said(F.concat(F.lit("Zero-tolerance: "), label)), "zero_tolerance"),
        )
        .when(
            label == "safe",
            outcome("pass", conf, said(F.lit("Content classified as safe")), "safe"),
        )
        .when(
            conf.between(low, high),
            outcome("review", conf, said(F.lit("Grey zone — needs human review")), "grey_zone"),
        )
        .when(
            conf < low,
            outcome(
                "pass",
                conf,
                F.concat(
                    F.lit("Low confidence ("),
                    F.format_string("%.2f", conf),
                    F.lit(") — passing to avoid false positive"),
                ),
                "low_confidence_pass",
            ),
        )
        .otherwise(
            outcome("block", conf, said(F.concat(F.lit("Classified as: "), label)), "block")
        )
    )
    return (
        out.withColumn("_ruling", ruling)
        .select(
            *[c for c in out.columns if c not in ("decision", "confidence", "reason", "rule")],
            "_ruling.decision",
            "_ruling.confidence",
            "_ruling.reason",
            "_ruling.rule",
        )
    )


def decision_traces(shown: Column) -> Column:
    """Trace steps of `with_decision`: the weighing, where it came to that, and what decided."""
    rule = F.col("rule")
    weighed = rule.isin("zero_tolerance", "safe", "grey_zone", "low_confidence_pass", "block")
    score = F.struct(F.col("agg_label").alias("label"), F.col("score").alias("score"))
    outcome = F.struct("decision", "confidence", "rule")
    last = (
        F.when(rule.isin("zero_tolerance", "safe", "block"), "final")
        .when(rule == "zero_tolerance_keyword", "zero_tolerance")
        .when(rule.isin("image_nsfw", "image_normal"), "image_only")
        .otherwise(rule)
    )
    return joined(
        F.array_compact(
            F.array(
                F.when(weighed, trace_step("decision", "aggregate", "weighted_scoring", shown, score)),
                trace_step("decision", last, "none", shown, outcome),
            )
        )
    )


def config_table(spark, configs: dict[str, DecisionConfig]) -> DataFrame:
    """Per-tenant overrides of the decision rules, one row per tenant.

    Tenants are configuration, passed in by name, so the table is as small as the call.
    """
    rows = [
        (
            tenant,
            float(c["grey_zone"]["low"]),
            float(c["grey_zone"]["high"]),
            list(c["zero_tolerance"]),
            *[_numbers(c, name) for name in MAPS],
        )
        for tenant, c in configs.items()
    ]
    schema = "tenant string, grey_low double, grey_high double, zero_tolerance array<string>"
    schema += "".join(f", {name} map<string,double>" for name in MAPS)
    return spark.createDataFrame(rows, schema)
