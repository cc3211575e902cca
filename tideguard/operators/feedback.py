"""The event log as data assets: labelled set, discoveries, hard cases, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.config import RETRAIN_LABELS, KeywordDictionary
from tideguard.functions.text import decision_label, filled, sample_id
from tideguard.operators import monitoring
from tideguard.session import materialise

# --- fixed values: quotation marks around a term, bounds of the confidence report -----
QUOTED_TERM = "['\"「『](.+?)['\"」』]"
CONFIDENCE_BINS = ["0.0-0.3", "0.3-0.7", "0.7-0.9", "0.9-1.0"]
# --- end of fixed values --------------------------------------------------------------

LOGGED = {
    "event_id": "bigint",
    "ai_decision": "string",
    "ai_confidence": "double",
    "human_decision": "string",
    "human_reason": "string",
    "text_tier": "string",
    "text_label": "string",
    "bert_preliminary": "string",
    "ts": "bigint",
}


def all_events(ai: DataFrame, human: DataFrame) -> DataFrame:
    """Bag union of AI events and human events; columns one side lacks are null."""
    both = ai.unionByName(human, allowMissingColumns=True)
    for name, kind in LOGGED.items():
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast(kind))
    return both


def since(events: DataFrame, days: int, now: Column) -> DataFrame:
    """Events of the last `days` days; with an `event_date` (see `append_log`) older folders are not read."""
    start = now - days * 86400
    recent = events.where(F.col("ts") >= start)
    if "event_date" in events.columns:
        recent = recent.where(F.col("event_date") >= F.to_date(F.timestamp_seconds(start)))
    return recent


def labelled(events: DataFrame, min_confidence: float = 0.90, include_human: bool = True):
    """Non-blank events with `sample` = gold, silver or skipped and the sample's fields.

    Human decisions are gold, AI decisions of at least `min_confidence` silver.
    """
    human = (F.col("source_label") == "human") & F.lit(include_human)
    sure = (F.col("source_label") == "ai") & (F.col("confidence") >= min_confidence)
    sample = F.when(human, "gold").when(sure, "silver").otherwise("skipped")
    return events.where(filled(F.col("text"))).select(
        sample_id(F.col("text")).alias("id"),
        "text",
        F.when(human, F.col("decision")).otherwise(decision_label(F.col("decision"))).alias("label"),
        F.when(human, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(human, "human_review").otherwise("ai_high_conf").alias("source"),
        F.when(~human, F.coalesce("tier", F.lit("unknown"))).alias("model_tier"),
        F.when(~human, F.col("reason")).alias("ai_reason"),
        "ts",
        sample.alias("sample"),
    )


def labelled_dataset(events: DataFrame, min_confidence: float = 0.90) -> DataFrame:
    """The samples to train on."""
    return labelled(events, min_confidence).where(F.col("sample") != "skipped").drop("sample")


def labelled_summary(events: DataFrame, min_confidence: float = 0.90) -> DataFrame:
    """Number of events per kind of sample and label; label is null for skipped ones."""
    label = F.when(F.col("sample") != "skipped", F.col("label"))
    return (
        labelled(events, min_confidence)
        .groupBy("sample", label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def discover_keywords(
    events: DataFrame,
    dictionary: KeywordDictionary,
    order: str = "event_id",
    limit: int = 50,
) -> DataFrame:
    """Terms quoted in the reasons of blocks and not in the dictionary, most frequent first.

    Equal frequencies rank by first occurrence, whose text and reason serve as example. Events
    without `order`, as those of humans, come after the others, by content.
    """
    known = F.array(*[F.lit(w) for w in dictionary.word_category]).cast("array<string>")
    content = F.col("content_id") if "content_id" in events.columns else F.lit(None).cast("string")
    terms = events.where((F.col("decision") == "block") & F.col("reason").isNotNull()).select(
        F.struct(F.col(order).isNull(), F.col(order), content).alias("_ord"),
        F.substring(F.coalesce("text", F.lit("")), 1, 100).alias("example_text"),
        F.col("reason").alias("example_reason"),
        F.posexplode_outer(F.regexp_extract_all("reason", F.lit(QUOTED_TERM), 1)).alias(
            "_pos", "term"
        ),
    )
    # The last two only matter to events of one content.
    seen = F.struct("_ord", "example_reason", "example_text", "_pos")
    ranked = (
        terms.where((F.length("term") >= 2) & ~F.array_contains(known, F.col("term")))
        .groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.min(seen).alias("_first"),
            F.min_by(F.struct("example_text", "example_reason"), seen).alias("_example"),
        )
    )
    return (
        ranked.orderBy(F.col("frequency").desc(), "_first")
        .limit(limit)
        .select("term", "frequency", "_example.*")
    )


def false_positives(events: DataFrame) -> DataFrame:
    """Blocked by the AI and passed by a human."""
    return events.where((F.col("ai_decision") == "block") & (F.col("human_decision") == "pass")).select(
        "event_id", "content_id", "text", "ai_decision", "ai_confidence", "human_reason"
    )


def hard_cases(events: DataFrame) -> DataFrame:
    """Grey-zone events, and others whose AI and human decision differ (null-safe)."""
    grey = F.coalesce(F.col("confidence"), F.lit(0.0)).between(0.3, 0.7)
    differs = ~F.col("ai_decision").eqNullSafe(F.col("human_decision"))
    judged = F.coalesce("human_decision", F.lit("pass"))
    return events.where(grey | differs).select(
        "content_id",
        "text",
        decision_label(F.when(grey, F.col("decision")).otherwise(judged)).alias("label"),
        "confidence",
        F.when(grey, "grey_zone").otherwise("ai_wrong").alias("difficulty"),
    )


def distributions(events: DataFrame) -> DataFrame:
    """Events per tier and per decision in one pass: (dimension, value, n)."""
    tier = F.coalesce("tier", "text_tier", F.lit("unknown"))
    both = F.explode(
        F.array(
            F.struct(F.lit("tier").alias("dimension"), tier.alias("value")),
            F.struct(
                F.lit("decision").alias("dimension"),
                F.coalesce("decision", F.lit("?")).alias("value"),
            ),
        )
    )
    return (
        events.select(both.alias("_d"))
        .groupBy("_d.dimension", "_d.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _override_rates() -> list[Column]:
    total = F.count(F.lit(1))
    reviewed = F.count(F.when(F.col("ai_decision") == "review", 1))
    both = (F.coalesce("ai_decision", F.lit("")) != "") & (
        F.coalesce("human_decision", F.lit("")) != ""
    )
    overrides = F.count(F.when(both & (F.col("ai_decision") != F.col("human_decision")), 1))
    return [
        total.alias("total_events"),
        reviewed.alias("human_reviewed"),
        overrides.alias("overrides"),
        F.round(reviewed / F.greatest(total, F.lit(1)), 4).alias("human_review_rate"),
        F.round(overrides / F.greatest(reviewed, F.lit(1)), 4).alias("human_override_rate"),
    ]


def overrides(events: DataFrame) -> DataFrame:
    return events.agg(*_override_rates())


def _agreement() -> list[Column]:
    audited = (F.col("text_tier") == "L3_llm") & (F.coalesce("bert_preliminary", F.lit("")) != "")
    n = F.count(F.when(audited, 1))
    agreed = F.count(F.when(audited & (F.col("bert_preliminary") == F.col("text_label")), 1))
    return [
        n.alias("audited"),
        agreed.alias("agreed"),
        F.round(agreed / F.nullif(n, F.lit(0)), 4).alias("bert_llm_agreement"),
    ]


def agreement(events: DataFrame) -> DataFrame:
    """How often audit and classifier gave the same label; null without audits."""
    return events.agg(*_agreement())


def _confidence_bin() -> Column:
    """The range of the confidence, null where it is missing or zero."""
    c = F.col("confidence")
    cuts = [c < 0.3, c < 0.7, c < 0.9]
    bin_ = F.lit(CONFIDENCE_BINS[-1])
    for cut, name in reversed(list(zip(cuts, CONFIDENCE_BINS, strict=False))):
        bin_ = F.when(cut, name).otherwise(bin_)
    return F.when(F.coalesce(c, F.lit(0.0)) != 0.0, bin_)


def confidence_bins(events: DataFrame) -> DataFrame:
    """Events per confidence range; zero confidence means missing; empty ranges show 0."""
    bin_ = _confidence_bin()
    counts = events.agg(*[F.count(F.when(bin_ == b, 1)).alias(b) for b in CONFIDENCE_BINS])
    lines = [F.struct(F.lit(b).alias("bin"), F.col(f"`{b}`").alias("n")) for b in CONFIDENCE_BINS]
    return counts.select(F.explode(F.array(*lines)).alias("_l")).select("_l.*")


def report(events: DataFrame) -> DataFrame:
    """One row of health figures."""
    return events.agg(*_override_rates(), *_agreement())


def run_cells(events: DataFrame, min_confidence: float = 0.90) -> DataFrame:
    """All counts of the offline run in one pass, per sample, tier, decision and confidence range.

    There are as many rows as combinations of these, whatever the number of events.
    """
    human = F.col("source_label") == "human"
    sure = (F.col("source_label") == "ai") & (F.col("confidence") >= min_confidence)
    sample = F.when(human, "gold").when(sure, "silver").otherwise("skipped")
    ai, said = F.coalesce("ai_decision", F.lit("")), F.coalesce("human_decision", F.lit(""))
    audited = (F.col("text_tier") == "L3_llm") & (F.coalesce("bert_preliminary", F.lit("")) != "")
    grey = F.coalesce(F.col("confidence"), F.lit(0.0)).between(0.3, 0.7)
    flags = {
        "human_reviewed": F.col("ai_decision") == "review",
        "overrides": (ai != "") & (said != "") & (F.col("ai_decision") != F.col("human_decision")),
        "false_positives": (F.col("ai_decision") == "block") & (F.col("human_decision") == "pass"),
        "hard_cases": grey | ~F.col("ai_decision").eqNullSafe(F.col("human_decision")),
        "audited": audited,
        "agreed": audited & (F.col("bert_preliminary") == F.col("text_label")),
        "human": human,
    }
    return events.groupBy(
        F.when(filled(F.col("text")), sample).alias("sample"),
        F.coalesce("tier", "text_tier", F.lit("unknown")).alias("tier"),
        F.coalesce("decision", F.lit("?")).alias("decision"),
        _confidence_bin().alias("bin"),
    ).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(c, 1)).alias(k) for k, c in flags.items()])


def run(
    events: DataFrame,
    history: DataFrame,
    dictionary: KeywordDictionary,
    date: str,
    labels_before: int = 0,
    threshold: int = RETRAIN_LABELS,
    min_confidence: float = 0.90,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole offline run: (figures, accuracy history with this run's record, discovered terms).

    `figures` has figure and value: samples per kind, terms, false positives, hard cases, events per
    tier, decision and confidence range, review and override rate, agreement, new labels and
    whether they suffice to retrain, the accuracy recorded for `date`, drift against the history
    with that record, and the calibrated threshold. The events are read twice: once for all
    counts, once for the terms.
    """
    cells = materialise(run_cells(events, min_confidence), "run-cells")
    terms = materialise(discover_keywords(events, dictionary), "run-terms")
    total = F.coalesce(F.sum("n"), F.lit(0))
    count = {c: F.coalesce(F.sum(c), F.lit(0)) for c in cells.columns[5:]}
    rates = cells.agg(
        total.alias("total_events"),
        F.round(count["human_reviewed"] / F.greatest(total, F.lit(1)), 4).alias("human_review_rate"),
        F.round(count["overrides"] / F.greatest(count["human_reviewed"], F.lit(1)), 4).alias("human_override_rate"),
        F.round(count["agreed"] / F.nullif(count["audited"], F.lit(0)), 4).alias("bert_llm_agreement"),
        *[count[c].alias(c) for c in ("false_positives", "hard_cases", "human")],
    )
    rates = materialise(rates, "run-rates")
    record = rates.select(
        F.lit(date).alias("date"), F.round(1 - F.col("human_override_rate"), 4).alias("accuracy"),
        F.col("total_events").alias("sample_size"),
    )
    kept = history.select("date", "accuracy", "sample_size").where(F.col("date") != date)
    recorded = materialise(monitoring.keep_last(kept.unionByName(record)), "run-history")
    drift = monitoring.drift(recorded)
    enough = (F.col("human") + labels_before >= threshold).cast("double")

    def named(df: DataFrame, figures: dict[str, Column]) -> DataFrame:
        rows = [F.struct(F.lit(k).alias("figure"), v.cast("double").alias("value")) for k, v in figures.items()]
        return df.select(F.explode(F.array(*rows)).alias("f")).select("f.*")

    def counted(prefix: str, column: str) -> DataFrame:
        per = cells.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
        return per.select(
            F.concat(F.lit(f"{prefix}_"), column).alias("figure"), F.col("n").cast("double").alias("value")
        )

    same = ["false_positives", "hard_cases", "human_review_rate", "human_override_rate", "bert_llm_agreement"]
    figures = named(
        rates,
        {c: F.col(c) for c in same}
        | {"new_labels": F.col("human"), "should_retrain": enough}
        | {"accuracy": F.round(1 - F.col("human_override_rate"), 4)},
    )
    parts = [
        counted("samples", "sample"), counted("tier", "tier"), counted("decision", "decision"),
        counted("confidence", "bin"), named(terms.agg(F.count(F.lit(1)).alias("n")), {"terms": F.col("n")}),
        named(drift, {"drop": F.col("drop"), "drift": F.col("drift").cast("int")}),
        named(monitoring.calibrate(rates), {"bert_high": F.col("bert_high")}),
    ]
    for part in parts:
        figures = figures.unionByName(part)
    return figures, recorded, terms
