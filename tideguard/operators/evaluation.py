"""Evaluation of decisions against labelled cases.

Result frames have expected, decision, tier, path, latency_ms and whatever they are grouped
by. Every figure is a conditional count, so partial sums are combined, never rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideguard.config import (
    CACHE_TIERS,
    PRICE_PER_1K_TOKENS,
    RELIABILITY_BINS,
    TIER_ORDER,
    TIER_PRICES,
    TOKENS_PER_AUDIT,
)
from tideguard.functions.text import is_correct
from tideguard.operators.skew import first_rows
from tideguard.session import materialise

# --- fixed values: acceptance criteria (metric, target, True if it must exceed it) -----
ACCEPTANCE = [
    ("llm_call_rate", 0.20, False),
    ("bert_intercept_rate", 0.30, True),
    ("f1", 0.90, True),
    ("cache_hit_rate", 0.15, True),
    ("avg_latency_ms", 500.0, False),
]
# --- end of fixed values ---------------------------------------------------------------


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 4)


def _confusion() -> dict[str, Column]:
    unsafe, safe = F.col("expected") == "unsafe", F.col("expected") == "safe"
    flagged, passed = F.col("decision").isin("block", "review"), F.col("decision") == "pass"
    return {
        "tp": _n(unsafe & flagged),
        "tn": _n(safe & passed),
        "fp": _n(safe & flagged),
        "fn": _n(unsafe & passed),
    }


def _quality() -> list[Column]:
    c, total = _confusion(), F.count(F.lit(1))
    zero, null0 = F.lit(0.0), F.lit(0)
    precision = F.coalesce(c["tp"] / F.nullif(c["tp"] + c["fp"], null0), zero)
    recall = F.coalesce(c["tp"] / F.nullif(c["tp"] + c["fn"], null0), zero)
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, zero), zero)
    return [
        total.alias("total"),
        *[v.alias(k) for k, v in c.items()],
        _ratio(c["tp"] + c["tn"], total).alias("accuracy"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
    ]


def _funnel() -> list[Column]:
    total = F.count(F.lit(1))
    tier = F.coalesce("tier", F.lit("?"))
    return [
        _ratio(_n(tier == "L3_llm"), total).alias("llm_call_rate"),
        _ratio(_n(tier == "L2_bert"), total).alias("bert_intercept_rate"),
        _ratio(_n(tier == "L1_keyword"), total).alias("keyword_intercept_rate"),
        _ratio(_n(tier.isin(*CACHE_TIERS)), total).alias("cache_hit_rate"),
        _ratio(_n(F.col("path") == "hot"), total).alias("hot_path_rate"),
    ]


def confusion(results: DataFrame) -> DataFrame:
    """One row: tp, tn, fp, fn, accuracy, precision, recall, F1."""
    return results.agg(*_quality())


def funnel(results: DataFrame) -> DataFrame:
    """One row: share answered by audits, classifier, keywords, stores, and by the hot path."""
    return results.agg(F.count(F.lit(1)).alias("total"), *_funnel())


def metrics(results: DataFrame) -> DataFrame:
    """Confusion, funnel and mean latency in one pass, one row."""
    return results.agg(
        *_quality(), *_funnel(), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms")
    )


def per_class(results: DataFrame, group: str) -> DataFrame:
    c = _confusion()
    return results.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        _ratio(c["tp"] + c["tn"], F.count(F.lit(1))).alias("accuracy"),
        _ratio(c["tp"], c["tp"] + c["fn"]).alias("recall"),
        *[v.alias(k) for k, v in c.items()],
    )


def by_group(results: DataFrame, groups: list[str], high: float = 0.95) -> DataFrame:
    """Accuracy overall and per side, mean confidence per side, share the audit is spared."""
    ok = is_correct(F.col("expected"), F.col("decision"))
    safe, unsafe = F.col("expected") == "safe", F.col("expected") == "unsafe"
    total = F.count(F.lit(1))
    return results.groupBy(*groups).agg(
        total.alias("total"),
        _ratio(_n(ok), total).alias("accuracy"),
        _ratio(_n(ok & safe), _n(safe)).alias("safe_accuracy"),
        _ratio(_n(ok & unsafe), _n(unsafe)).alias("unsafe_accuracy"),
        F.round(F.avg(F.when(safe, F.col("confidence"))), 6).alias("avg_safe_conf"),
        F.round(F.avg(F.when(unsafe, F.col("confidence"))), 6).alias("avg_unsafe_conf"),
        _ratio(_n(F.col("confidence") >= high), total).alias("skip_rate"),
    )


def top_errors(results: DataFrame, category: str, k: int = 5) -> DataFrame:
    wrong = ~is_correct(F.col("expected"), F.col("decision"))
    return (
        results.where(wrong & (F.coalesce(category, F.lit("")) != ""))
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("errors"))
        .orderBy(F.col("errors").desc(), category)
        .limit(k)
    )


def misclassified(results: DataFrame, order: str, k: int = 20) -> DataFrame:
    """The first `k` wrong results."""
    return (
        results.where(~is_correct(F.col("expected"), F.col("decision"))).orderBy(order).limit(k)
    )


def latency(
    results: DataFrame,
    groups: list[str] | None = None,
    quantiles: tuple[float, ...] = (0.50, 0.95, 0.99),
    approximate: bool = False,
) -> DataFrame:
    """Latency quantiles, mean and maximum per group (or overall).

    The quantile is the value at 0-based rank int(n*q) of the sorted values, rounded to two
    decimals. Rounding keeps the order, so equal rounded values are counted first and only
    the counts are accumulated in order: what one task sorts is the number of hundredths of
    a millisecond in use, however many rows there are. `approximate` uses a sketch instead.
    """
    keys = groups or []
    rows = results.withColumn("_v", F.round("latency_ms", 2))
    if approximate:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.percentile_approx("_v", q, 10000).alias(f"p{round(q * 100)}")
                for q in quantiles
            ],
            F.round(F.avg("latency_ms"), 2).alias("avg"),
            F.max("_v").alias("max"),
        )
    counts = rows.groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("latency_ms").alias("_s")
    )
    ordered = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_v")
    running = counts.withColumn("_to", F.sum("_c").over(ordered))
    # The rank needs the size of the group: the same window without an order.
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    sized = running.withColumn("_n", F.sum("_c").over(whole))
    picks = [
        F.min(F.when(F.col("_to") > F.floor(F.col("_n") * F.lit(q)), F.col("_v"))).alias(
            f"p{round(q * 100)}"
        )
        for q in quantiles
    ]
    return sized.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        *picks,
        F.round(F.sum("_s") / F.sum("_c"), 2).alias("avg"),
        F.max("_v").alias("max"),
    )


def service_breakdown(results: DataFrame, service: str = "source") -> DataFrame:
    """Per service: requests, blocked / passed / escalated, hot share, latency figures."""
    hot = F.col("path") == "hot"
    total = F.count(F.lit(1))
    counts = results.groupBy(service).agg(
        total.alias("total"),
        _n(hot & (F.col("decision") == "block")).alias("hot_block"),
        _n(hot & (F.col("decision") != "block")).alias("hot_pass"),
        _n(~hot).alias("cold_escalated"),
        _ratio(_n(hot), total).alias("hot_rate"),
    )
    times = latency(results, [service], (0.99,)).select(
        service, F.col("avg").alias("avg_latency_ms"), F.col("p99").alias("p99_latency_ms")
    )
    return counts.join(times, service)


def reliability(results: DataFrame, correct: Column) -> DataFrame:
    """Per confidence bin: size, accuracy, mean confidence, gap. Empty bins are left out."""
    c = F.col("confidence")
    bin_ = F.lit(None).cast("string")
    for low, high in reversed(RELIABILITY_BINS):
        inside = (c >= low) if high == 1.0 else (c >= low) & (c < high)
        bin_ = F.when(inside, f"{low:.2f}-{high:.2f}").otherwise(bin_)
    binned = results.select(bin_.alias("bin"), c.alias("c"), correct.cast("int").alias("ok"))
    n = F.count(F.lit(1))
    return binned.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        n.alias("n"),
        F.round(F.sum("ok") / n, 6).alias("accuracy"),
        F.round(F.avg("c"), 6).alias("avg_confidence"),
        F.round(F.avg("c") - F.sum("ok") / n, 6).alias("gap"),
    )


def calibration_error(results: DataFrame, correct: Column) -> DataFrame:
    """Expected calibration error over the bins, with its verdict, one row."""
    bins = reliability(results, correct)
    ece = F.sum(F.col("n") * F.abs(F.col("gap"))) / F.sum("n")
    return bins.agg(F.sum("n").alias("n"), F.round(ece, 4).alias("ece")).withColumn(
        "verdict",
        F.when(F.col("ece") < 0.05, "well-calibrated")
        .when(F.col("ece") < 0.10, "marginally calibrated")
        .otherwise("poorly calibrated"),
    )


def overconfident(results: DataFrame, correct: Column, at_least: float = 0.90) -> DataFrame:
    return results.where((F.col("confidence") >= at_least) & ~correct)


def disagreement(pairs: DataFrame, expected: str = "expected") -> DataFrame:
    """Two models on the same cases (label_a, label_b): agreement and accuracy, one row."""
    total = F.count(F.lit(1))
    same = _n(F.col("label_a") == F.col("label_b"))
    return pairs.agg(
        total.alias("total"),
        (total - same).alias("disagreements"),
        _ratio(same, total).alias("agreement_rate"),
        _ratio(_n(F.col("label_a") == F.col(expected)), total).alias("accuracy_a"),
        _ratio(_n(F.col("label_b") == F.col(expected)), total).alias("accuracy_b"),
    )


def consistency(runs: DataFrame, item: str) -> DataFrame:
    """Repeated runs per item: runs, different labels, range of confidence."""
    per_label = runs.groupBy(item, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("confidence").alias("lo"),
        F.max("confidence").alias("hi"),
    )
    return per_label.groupBy(item).agg(
        F.sum("n").alias("runs"),
        F.count(F.lit(1)).alias("unique_labels"),
        F.min("lo").alias("min_confidence"),
        F.max("hi").alias("max_confidence"),
    )


def cost_by_tier(results: DataFrame) -> DataFrame:
    """Calls and cost per tier, by price per call and, for audits, by tokens."""
    prices = [F.lit(x) for pair in TIER_PRICES.items() for x in pair]
    price = F.coalesce(F.try_element_at(F.create_map(*prices), F.col("tier")), F.lit(0.0))
    tokens = F.when(
        F.col("tier") == "L3_llm",
        F.col("calls") * TOKENS_PER_AUDIT / 1000 * PRICE_PER_1K_TOKENS,
    ).otherwise(0.0)
    return (
        results.groupBy("tier")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(
            "tier",
            "calls",
            F.round(F.col("calls") * price, 6).alias("cost"),
            F.round(tokens, 6).alias("token_cost"),
        )
    )


def latency_histogram(results: DataFrame, per_decade: int = 10) -> DataFrame:
    """Counts in logarithmic latency buckets; values below 1 ms share the first."""
    value = F.greatest(F.col("latency_ms"), F.lit(1.0))
    bucket = F.floor(F.log10(value) * per_decade).cast("int")
    return results.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def ordered_funnel(results: DataFrame) -> DataFrame:
    """Tiers in report order with count and share; tiers without a place come last."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), F.col("tier"))
    total = results.agg(F.count(F.lit(1)).alias("t"))
    return results.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).select(
        F.when(place == 0, len(TIER_ORDER) + 1).otherwise(place).cast("int").alias("position"),
        "tier",
        "n",
        F.round(F.col("n") / total.scalar(), 4).alias("share"),
    )


def acceptance(results: DataFrame) -> DataFrame:
    """One row per criterion: value, target, passed."""
    lines = [
        F.struct(
            F.lit(name).alias("criterion"),
            F.col(name).cast("double").alias("value"),
            F.lit(target).alias("target"),
            ((F.col(name) > target) if above else (F.col(name) < target)).alias("passed"),
        )
        for name, target, above in ACCEPTANCE
    ]
    return metrics(results).select(F.explode(F.array(*lines)).alias("_l")).select("_l.*")


def run(
    content: DataFrame,
    cases: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    group: str = "source",
    errors: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An evaluation run over labelled corpora: (figures, wrong results, results).

    `cases` has content_id, corpus, expected and `group`; only the rows of `content` that have a
    case are judged, in one call. `figures` (corpus, figure, value) holds per corpus and for `all`
    of them together: quality, the share of each stage, whether each acceptance criterion holds
    (1 or 0; without latencies that one is left out) and the wrong results per group, the most frequent
    first. `wrong` are the first `errors` misclassified rows of each corpus.
    """
    labelled = content.join(cases.select("content_id"), "content_id", "left_semi")
    judged = judge(labelled).join(cases, "content_id")
    if "latency_ms" not in judged.columns:
        judged = judged.withColumn("latency_ms", F.lit(None).cast("double"))
    results = materialise(judged, "evaluated")
    measured = results.rollup("corpus").agg(*_quality(), *_funnel(), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"))
    measured = materialise(measured.withColumn("corpus", F.coalesce("corpus", F.lit("all"))), "measured")

    def listed(lines: list[Column]) -> DataFrame:
        rows = measured.select("corpus", F.explode(F.array(*lines)).alias("_l")).select("corpus", "_l.*")
        return rows.where(F.col("value").isNotNull())

    def line(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("figure"), value.cast("double").alias("value"))

    figures = listed([line(c, F.col(c)) for c in measured.columns if c != "corpus"])
    passed = listed([
        line(f"accepted_{name}", ((F.col(name) > target) if above else (F.col(name) < target)).cast("int"))
        for name, target, above in ACCEPTANCE
    ])
    missed = results.where(~is_correct(F.col("expected"), F.col("decision")))
    per_group = missed.groupBy("corpus", group).agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("corpus").orderBy(F.col("n").desc(), group)
    top = per_group.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= 5)
    worst = top.select("corpus", F.concat(F.lit("errors_"), group).alias("figure"), F.col("n").cast("double").alias("value"))
    first = Window.partitionBy("corpus").orderBy("content_id")
    wrong = missed.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= errors)
    shown = ["corpus", "content_id", "expected", "decision", "confidence", "tier", "reason"]
    return figures.unionByName(passed).unionByName(worst), wrong.select(*shown), results


def sample_order(item: Column, seed: int) -> Column:
    """Pseudo-random order of items, the same on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), item.cast("string")))


def balanced_sample(
    cases: DataFrame,
    item: str,
    n: int | None = None,
    seed: int = 42,
    unsafe_part: int = 3,
    safe_ratio: int = 3,
) -> DataFrame:
    """A balanced, repeatable sample of labelled cases.

    With `n`: n // unsafe_part unsafe cases (5 at least) and safe ones up to n. Without: all
    unsafe cases and up to `safe_ratio` times as many safe ones. The cut within a class is
    found on bucket counts; see `first_rows`.
    """
    counts = cases.agg(_n(F.col("expected") == "unsafe").alias("n"))
    unsafe = counts.scalar()
    if n is not None:
        take = F.greatest(F.lit(5), F.least(unsafe, F.lit(n // unsafe_part)))
        rest = F.lit(n) - take
    else:
        take, rest = unsafe, unsafe * safe_ratio
    limit = F.when(F.col("expected") == "unsafe", take).otherwise(rest)
    rows = cases.withColumn("_order", sample_order(F.col(item), seed))
    picked = first_rows(
        rows, ["expected"], [F.col("_order")], limit, F.substring("_order", 1, 4)
    )
    return picked.drop("_order")


def filter_results(results: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows matching every given filter: tier, path, decision, expected, correct, search."""
    out = results
    for column in ("tier", "path", "decision", "expected"):
        if wanted.get(column):
            out = out.where(F.col(column) == wanted[column])
    if wanted.get("correct"):
        ok = is_correct(F.col("expected"), F.col("decision"))
        out = out.where(ok if wanted["correct"] == "correct" else ~ok)
    if wanted.get("search"):
        out = out.where(F.contains(F.lower("text"), F.lit(wanted["search"].lower())))
    return out


def result_table(results: DataFrame) -> DataFrame:
    """Results as a report shows them: shortened texts, rounded numbers, trace summary."""
    steps = F.transform(
        "traces",
        lambda t: F.concat_ws(
            "|", t["node"], t["step"], t["cost"], F.substring(t["output"], 1, 200)
        ),
    )
    return results.select(
        "content_id",
        F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("text"),
        F.coalesce("expected", F.lit("?")).alias("expected"),
        F.coalesce("decision", F.lit("?")).alias("decision"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"),
        F.coalesce("tier", F.lit("?")).alias("tier"),
        F.coalesce("path", F.lit("?")).alias("path"),
        F.round(F.coalesce("latency_ms", F.lit(0.0)), 2).alias("latency_ms"),
        F.substring(F.coalesce("reason", F.lit("")), 1, 300).alias("reason"),
        F.array_join(steps, "\n").alias("traces"),
    )
