"""Verdicts from model scores and audit answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideguard.config import AUDIT_LABELS, AUDIT_UNSAFE_WORDS, CLASSIFIER_LABELS, GUARD_CATEGORIES
from tideguard.functions.text import mapped_label

AUDIT_SCHEMA = "label string, confidence double, reason string"


def _sided(score: Column, above: str, below: str) -> Column:
    """struct(label, confidence) of a one-sided score with the cut at one half."""
    return F.struct(
        F.when(score > 0.5, above).otherwise(below).alias("label"),
        F.round(F.when(score > 0.5, score).otherwise(1.0 - score), 4).alias("confidence"),
    )


def score_verdict(scores: Column) -> Column:
    """Classifier verdict from `array<struct<label, score>>`, best label first.

    A known best label decides; otherwise the best score among the unsafe labels does.
    No scores at all mean safe.
    """
    side = mapped_label(scores[0]["label"])
    unsafe = F.filter(scores, lambda s: s["label"].isin(*_unsafe_labels()))
    worst = F.coalesce(F.array_max(F.transform(unsafe, lambda s: s["score"])), F.lit(0.0))
    known = F.struct(
        side.alias("label"), F.round(scores[0]["score"], 4).alias("confidence")
    )
    nothing = F.struct(F.lit("safe").alias("label"), F.lit(1.0).alias("confidence"))
    return (
        F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, nothing)
        .when(side.isNotNull(), known)
        .otherwise(_sided(worst, "unsafe", "safe"))
    )


def _unsafe_labels() -> list[str]:
    return [k for k, v in CLASSIFIER_LABELS.items() if v == "unsafe"]


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def softmax_verdict(logits: Column) -> Column:
    """Verdict from the logits of a model whose classes are all kinds of unsafe."""
    return _sided(F.array_max(softmax(logits)), "unsafe", "safe")


def nsfw_verdict(scores: Column, n_bytes: Column, width: Column, height: Column) -> Column:
    """Image verdict from its scores; images too large or too small are not judged."""
    nsfw = F.filter(scores, lambda s: F.lower(s["label"]) == "nsfw")
    score = F.coalesce(F.array_max(F.transform(nsfw, lambda s: s["score"])), F.lit(0.0))
    unfit = (n_bytes > 10 * 1024 * 1024) | (width < 10) | (height < 10)
    skipped = F.struct(F.lit("normal").alias("label"), F.lit(0.5).alias("confidence"))
    return F.when(unfit, skipped).otherwise(_sided(score, "nsfw", "normal"))


def ocr_text(blocks: Column) -> Column:
    """struct(text, confidence): block texts joined by a space, mean of their confidence."""
    total = F.aggregate(blocks, F.lit(0.0), lambda a, b: a + b["confidence"])
    joined = F.array_join(F.transform(blocks, lambda b: b["text"]), " ")
    mean = F.round(total / F.nullif(F.size(blocks), F.lit(0)), 4)
    return F.struct(joined.alias("text"), F.coalesce(mean, F.lit(0.0)).alias("confidence"))


def skips_audit(label: Column, confidence: Column, high: float = 0.95) -> Column:
    return F.coalesce(label.isin("safe", "unsafe") & (confidence >= high), F.lit(False))


def unsure(confidence: Column, low: float = 0.40) -> Column:
    return F.coalesce(confidence, F.lit(1.0)) < low


def _as_object(text: Column) -> Column:
    """`text` as a JSON object with the audit fields, null when it is not one."""
    parsed = F.from_json(text, AUDIT_SCHEMA, {"mode": "PERMISSIVE"})
    valid = F.get_json_object(text, "$").isNotNull() & F.ltrim(text).startswith("{")
    return F.when(valid, parsed)


def parse_audit(answer: Column) -> Column:
    """struct(label, confidence, reason, parsed_as) of a free-form audit answer.

    Tried in turn: the answer itself, a fenced block, the outermost braces; an answer that
    is none of these is unsafe when it contains one of the tell-tale words.
    """
    fence = F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    braces = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    attempts = [("direct", answer), ("fenced", fence), ("braces", braces)]
    word = F.lower(answer).rlike("|".join(AUDIT_UNSAFE_WORDS))
    result = F.struct(
        F.when(word, "unsafe").otherwise("safe").alias("label"),
        F.lit(0.5).alias("confidence"),
        F.concat(
            F.lit("JSON parse failed, heuristic fallback. Raw: "), F.substring(answer, 1, 200)
        ).alias("reason"),
        F.lit("heuristic").alias("parsed_as"),
    )
    for name, text in reversed(attempts):
        got = _as_object(text)
        found = F.struct(
            F.coalesce(got["label"], F.lit("safe")).alias("label"),
            F.coalesce(got["confidence"], F.lit(0.8)).alias("confidence"),
            F.coalesce(got["reason"], F.lit("")).alias("reason"),
            F.lit(name).alias("parsed_as"),
        )
        result = F.when(got.isNotNull(), found).otherwise(result)
    return result


def parse_guard(answer: Column, model: str = "Qwen3Guard") -> Column:
    """struct(safety, label, confidence, categories, reason) of a guard model's answer."""
    named = F.regexp_extract(answer, r"(?i)Safety:\s*(Safe|Unsafe|Controversial)", 1)
    safety = F.nullif(F.lower(named), F.lit(""))
    low = F.lower(answer)
    label = F.when(
        safety.isin("unsafe", "controversial") | (safety.isNull() & F.contains(low, F.lit("unsafe"))),
        "unsafe",
    ).otherwise("safe")
    confidence = (
        F.when(safety.isin("safe", "unsafe"), 0.99)
        .when((safety == "controversial") | F.contains(low, F.lit("safe")), 0.7)
        .otherwise(0.5)
    )
    pattern = "(" + "|".join(re.escape(c).replace(r"\ ", " ") for c in GUARD_CATEGORIES) + ")"
    found = F.filter(F.regexp_extract_all(answer, F.lit(pattern), 1), lambda c: c != "None")
    listed = F.array_join(found, ", ")
    reason = F.concat(
        F.lit(f"{model}: "),
        F.coalesce(safety, F.lit("unknown")),
        F.when(listed != "", F.concat(F.lit(" — "), listed)).otherwise(""),
    )
    return F.struct(
        safety.alias("safety"),
        label.alias("label"),
        confidence.alias("confidence"),
        found.alias("categories"),
        reason.alias("reason"),
    )


def audit_problems(answer: Column) -> Column:
    """What is wrong with an audit answer under the response schema; empty when valid."""
    got = _as_object(answer)
    number = F.get_json_object(answer, "$.confidence")
    checks = [
        (got.isNull(), "not an object"),
        (got["label"].isNull(), "label missing"),
        (~got["label"].isin(*AUDIT_LABELS), "label unknown"),
        (number.isNull(), "confidence missing"),
        (number.isNotNull() & ~number.try_cast("double").between(0.0, 1.0), "confidence out of range"),
        (got["reason"].isNull(), "reason missing"),
    ]
    problems = [F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in checks]
    whole = F.when(got.isNull(), F.array(F.lit("not an object")))
    return F.coalesce(whole, F.array_compact(F.array(*problems)))
