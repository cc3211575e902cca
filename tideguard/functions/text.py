"""Text, key and routing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideguard.config import CLASSIFIER_LABELS, SHARED_KEY_PREFIX

IMAGE_PLACEHOLDER = "[Image URL: "


def filled(text: Column) -> Column:
    """True where there is more than white space; null counts as blank."""
    return F.coalesce(text, F.lit("")).rlike(r"\S")


def blank(text: Column) -> Column:
    return ~filled(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def resolve_text(text: Column, image_url: Column) -> Column:
    """The text to moderate: trimmed, or a placeholder when there is only an image URL."""
    placeholder = F.concat(F.lit(IMAGE_PLACEHOLDER), image_url, F.lit("]"))
    only_image = blank(text) & (F.coalesce(image_url, F.lit("")) != "")
    return F.when(only_image, placeholder).otherwise(stripped(F.coalesce(text, F.lit(""))))


def route(text: Column, ocr_text: Column) -> Column:
    """"text" when there is text to judge (own or recognised), else "decision"."""
    own = filled(text) & ~F.coalesce(text, F.lit("")).startswith(IMAGE_PLACEHOLDER)
    return F.when(own | filled(ocr_text), "text").otherwise("decision")


def content_type(text: Column, image_ref: Column) -> Column:
    has_text, has_image = filled(text), filled(image_ref)
    return (
        F.when(has_text & has_image, "mixed")
        .when(has_image, "image_only")
        .when(has_text, "text_only")
        .otherwise("empty")
    )


def append_ocr(text: Column, ocr_text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    joined = stripped(F.concat(own, F.lit(" [OCR: "), ocr_text, F.lit("]")))
    return F.when(F.coalesce(ocr_text, F.lit("")) != "", joined).otherwise(own)


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def shared_key(text: Column) -> Column:
    return F.concat(F.lit(SHARED_KEY_PREFIX), content_key(text))


def sample_id(text: Column) -> Column:
    return F.substring(content_key(text), 1, 12)


def image_ref_key(image_url: Column, image_base64: Column) -> Column:
    """Key of an image by reference: its URL, else the whole of its data."""
    url = F.coalesce(image_url, F.lit(""))
    data = F.coalesce(image_base64, F.lit(""))
    return F.substring(F.sha2(F.when(url != "", url).otherwise(data), 256), 1, 16)


def image_bytes(image_base64: Column) -> Column:
    """Decoded image, without its data-URI head; null when it cannot be decoded."""
    body = F.when(
        F.contains(image_base64, F.lit(",")), F.regexp_replace(image_base64, r"^[^,]*,", "")
    ).otherwise(image_base64)
    return F.try_to_binary(body, F.lit("base64"))


def decision_label(decision: Column) -> Column:
    """Decision as a data-set label; a reviewed item is suspicious, anything else safe."""
    return F.when(decision.isin("block", "unsafe", "review"), "unsafe").otherwise("safe")


def mapped_label(raw: Column, labels: dict[str, str] | None = None) -> Column:
    """Side of a raw classifier label, null when unknown."""
    table = labels or CLASSIFIER_LABELS
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), raw)


def is_correct(expected: Column, decision: Column) -> Column:
    caught = (expected == "unsafe") & decision.isin("block", "review")
    let_through = (expected == "safe") & (decision == "pass")
    return F.coalesce(caught | let_through, F.lit(False))


def audit_prompt(text: Column, context: Column) -> Column:
    """Prompt for an audit: the fenced text and, when given, the context as JSON."""
    fenced = F.concat(F.lit("Text to moderate:\n```\n"), text, F.lit("\n```"))
    extra = F.concat(F.lit("\n\nAdditional context:\n"), F.to_json(context))
    return F.when(context.isNull(), fenced).otherwise(F.concat(fenced, extra))


def match_ratio(expected: Column, actual: Column) -> Column:
    """Share of the expected characters that occur anywhere in the actual text."""
    want = F.lower(F.replace(expected, F.lit(" "), F.lit("")))
    have = F.lower(F.replace(actual, F.lit(" "), F.lit("")))
    # Characters not found are what is left after deleting every character of `have`.
    missing = F.length(F.call_function("translate", want, have, F.lit("")))
    ratio = (F.length(want) - missing) / F.length(want)
    return (
        F.when(F.coalesce(expected, F.lit("")) == "", 1.0)
        .when(F.coalesce(actual, F.lit("")) == "", 0.0)
        .when(want == "", 1.0)
        .otherwise(ratio)
    )
