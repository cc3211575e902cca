"""The text funnel: keyword, classifier with a second opinion, deep audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.config import DecisionConfig
from tideguard.functions.signals import skips_audit
from tideguard.functions.text import blank
from tideguard.functions.traces import joined, trace_step

SIGNAL_TYPE = (
    "struct<label:string,confidence:double,reason:string,tier:string,cost:string,"
    "preliminary:string,preliminary_confidence:double,model:string>"
)


def _signal(
    label: Column,
    confidence: Column,
    tier: str,
    cost: str,
    reason: Column | None = None,
    before: tuple[Column, Column] | None = None,
    model: Column | None = None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        label.alias("label"),
        confidence.alias("confidence"),
        (null if reason is None else reason).cast("string").alias("reason"),
        F.lit(tier).alias("tier"),
        F.lit(cost).alias("cost"),
        (before[0] if before else null).cast("string").alias("preliminary"),
        (before[1] if before else null).cast("double").alias("preliminary_confidence"),
        (null if model is None else model).cast("string").alias("model"),
    )


def with_text_signal(
    df: DataFrame,
    config: DecisionConfig | None = None,
    classifier_enabled: bool = True,
    prefiltered: Column | None = None,
    is_blank: Column | None = None,
) -> DataFrame:
    """Adds `text_signal`.

    Reads score_label / score_confidence (first classifier), second_label /
    second_confidence (second opinion), audit_label / audit_confidence / audit_reason (null
    = no answer in time) and `kw`. A sure keyword ends the funnel unless the gateway has
    scanned the text already; a classifier sure enough ends it before the audit; a missing
    audit falls back to the classifier. No classifier at all is unsafe at one half.
    """
    cfg = config or DecisionConfig()
    high = float(cfg["bert_high_confidence"])

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    first = (given("score_label", "string"), given("score_confidence", "double"))
    second = (given("second_label", "string"), given("second_confidence", "double"))
    use_second = first[0].isNull() | (~skips_audit(*first, high) & skips_audit(*second, high))
    if classifier_enabled:
        pre = (
            F.coalesce(F.when(use_second, second[0]), first[0], F.lit("unsafe")),
            F.coalesce(F.when(use_second, second[1]), first[1], F.lit(0.5)),
        )
        done = skips_audit(F.col("_pre_label"), F.col("_pre_confidence"), high)
    else:
        pre, done = (F.lit("unsafe"), F.lit(0.5)), F.lit(False)
    out = df.withColumn("_pre_label", pre[0]).withColumn("_pre_confidence", pre[1])
    before = (F.col("_pre_label"), F.col("_pre_confidence"))
    answered = given("audit_label", "string").isNotNull()
    empty = blank(F.col("text")) if is_blank is None else is_blank
    scan = F.lit(True) if prefiltered is None else ~prefiltered
    kw_sure = F.coalesce(F.col("kw.confidence") > 0.99, F.lit(False)) & scan
    signal = (
        F.when(empty, _signal(F.lit("safe"), F.lit(1.0), "L0_empty", "zero"))
        .when(kw_sure, _signal(F.col("kw.label"), F.col("kw.confidence"), "L1_keyword", "zero"))
        .when(done, _signal(*before, "L2_bert", "low"))
        .when(
            answered,
            _signal(
                given("audit_label", "string"),
                given("audit_confidence", "double"),
                "L3_llm",
                "high",
                F.coalesce(given("audit_reason", "string"), F.lit("")),
                before,
                F.lit("audit"),
            ),
        )
        .otherwise(
            _signal(
                *before,
                "L3_llm",
                "high",
                F.lit("LLM timeout, using BERT result"),
                before,
                F.lit("fallback_bert"),
            )
        )
    )
    return out.withColumn("text_signal", signal.cast(SIGNAL_TYPE)).drop(
        "_pre_label", "_pre_confidence"
    )


def funnel_traces(text: Column, signal: Column) -> Column:
    """Trace steps of the funnel, up to the tier that answered."""
    tier = signal["tier"]
    shown = F.struct(signal["label"].alias("label"), signal["confidence"].alias("confidence"))
    earlier = F.struct(
        signal["preliminary"].alias("label"), signal["preliminary_confidence"].alias("confidence")
    )
    steps = [
        F.when(tier == "L0_empty", trace_step("text_agent", "empty", "none", text, shown)),
        F.when(tier != "L0_empty", trace_step("text_agent", "L1_keyword", "keywords", text, shown)),
        F.when(
            tier == "L2_bert", trace_step("text_agent", "L2_bert", "classifier", text, shown, "low")
        ),
        F.when(
            tier == "L3_llm", trace_step("text_agent", "L2_bert", "classifier", text, earlier, "low")
        ),
        F.when(tier == "L3_llm", trace_step("text_agent", "L3_llm", "audit", text, shown, "high")),
    ]
    return joined(F.array_compact(F.array(*steps)))


def score_distinct(
    df: DataFrame, scorer: Callable, schema: str, key: str = "key", text: str = "text"
) -> DataFrame:
    """Runs a user's model once per distinct text: `key` and the model's columns.

    `scorer` takes an iterator of pandas Series of texts and yields data frames with the
    columns of `schema`, so a model is loaded once per task. It sees all copies of a text
    as one row; blank texts never reach it.
    """
    distinct = (
        df.where(~blank(F.col(text)))
        .groupBy(key)
        .agg(F.min(text).alias(text))
    )

    def run(batches):
        import pandas as pd

        keys = []

        def texts():
            for batch in batches:
                keys.append(batch[key])
                yield batch[text]

        for scored in scorer(texts()):
            yield pd.concat(
                [keys.pop(0).reset_index(drop=True), scored.reset_index(drop=True)], axis=1
            )

    return distinct.select(key, text).mapInPandas(run, f"{key} string, {schema}")
