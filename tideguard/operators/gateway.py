"""The gateway: cheap stages first, each one answering what it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.config import (
    HAMMING_THRESHOLD,
    LOCAL_TTL_SECONDS,
    SHARED_TTL_SECONDS,
    SIMILARITY_THRESHOLD,
    KeywordDictionary,
)
from tideguard.functions.text import content_key, filled
from tideguard.functions.traces import TRACE_TYPE, trace_step
from tideguard.operators.hashes import match_known
from tideguard.operators.keywords import with_verdict
from tideguard.operators.reuse import reuse_as_of, reuse_by_key
from tideguard.operators.semantic import reuse_semantic

DECISION_TYPE = "struct<decision:string,confidence:double,reason:string,tier:string>"
STAGES = [
    "known_hash", "image_hash", "image_ref", "empty", "memory", "shared", "whitelist", "keyword",
    "semantic", "ambiguous", "escalated",
]


def _ruling(decision: str, confidence: float, reason: Column | str, tier: str) -> Column:
    return F.struct(
        F.lit(decision).alias("decision"),
        F.lit(confidence).alias("confidence"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        F.lit(tier).alias("tier"),
    )


def prepare(
    content: DataFrame,
    dictionary: KeywordDictionary,
    mode: str = "word",
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Everything the gateway needs to know about the text, computed in the scan stage.

    The text itself goes no further: what is shuffled later is its key, its keyword verdict
    and the first 200 characters for the trace. Optional columns image_url, image_ref,
    image_hash, embedding default to null. Those that are stored apart come as `vectors`, by
    content_id, and are joined once the text is left behind.
    """
    optional = {
        "image_url": "string",
        "image_ref": "string",
        "image_hash": "bigint",
        "embedding": "array<float>",
    }
    for name, kind in optional.items():
        if name not in content.columns:
            content = content.withColumn(name, F.lit(None).cast(kind))
    judged = with_verdict(content, dictionary, mode=mode)
    slim = F.struct(
        "kw.label", "kw.confidence", "kw.whitelist_hit", "kw.combo_label", "kw.matches",
        "kw.suppressed",
    )
    left = judged.select(
        "content_id",
        "ts",
        content_key(F.coalesce("text", F.lit(""))).alias("key"),
        F.substring("text", 1, 200).alias("input"),
        filled(F.col("text")).alias("has_text"),
        *optional,
        slim.alias("kw"),
    )
    if vectors is not None:
        apart = [c for c in vectors.columns if c in optional]
        left = left.drop(*apart).join(vectors.select("content_id", *apart), "content_id", "left")
    has_image = F.col("image_ref").isNotNull() | F.col("image_hash").isNotNull()
    return left.select(
        "content_id", "ts", "key", "input", has_image.alias("has_image"), "has_text", *optional, "kw"
    )


def check(
    prepared: DataFrame,
    local: DataFrame,
    shared: DataFrame,
    known: DataFrame | None = None,
    image_hashes: DataFrame | None = None,
    image_refs: DataFrame | None = None,
    vectors: DataFrame | None = None,
    local_ttl: int = LOCAL_TTL_SECONDS,
    shared_ttl: int = SHARED_TTL_SECONDS,
    hamming_threshold: int = HAMMING_THRESHOLD,
    similarity_threshold: float = SIMILARITY_THRESHOLD,
    earlier_vectors_only: bool = False,
    cut: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """content_id, resolved_by, decision struct (null = escalate), keyword and trace columns.

    An image is looked up by known hash, by hash and by reference and never by its text. A
    text is answered when blank, by the local store, the shared store, the whitelist, a sure
    keyword, and for texts without keyword by the nearest stored vector. Only content no
    earlier stage answered is sent to the vector search. `cut` (such as
    `session.materialise`) stores the slim rows where several stages start from them: the
    texts are then scanned once. Without it Spark plans the shared part once per use.
    """
    prepared = cut(prepared) if cut else prepared
    images = prepared.where("has_image")
    blanks = prepared.where("not has_image and not has_text")
    texts = prepared.where("not has_image and has_text")

    seen = reuse_as_of(texts, {"local": (local, local_ttl), "shared": (shared, shared_ttl)})
    looked_up = _image_stages(images, known, image_hashes, image_refs, hamming_threshold)
    state = seen.unionByName(blanks, allowMissingColumns=True).unionByName(
        looked_up, allowMissingColumns=True
    )
    state = state.withColumn("early", _early(F.col("kw"))).withColumn(
        "open",
        F.col("has_text") & ~F.col("has_image") & F.col("early").isNull()
        & (F.col("kw.confidence") < 0.4),
    )
    if vectors is None:
        state = state.withColumn("near", F.lit(None).cast(DECISION_TYPE)).withColumn(
            "near_similarity", F.lit(None).cast("double")
        )
    else:
        state = cut(state) if cut else state
        asking = state.where(F.col("open") & F.col("embedding").isNotNull()).select(
            F.col("content_id").alias("query_id"), "embedding"
        )
        found = reuse_semantic(asking, vectors, similarity_threshold, earlier_vectors_only)
        near = found.where(F.col("entry_id").isNotNull()).select(
            F.col("query_id").alias("content_id"),
            F.struct("decision", "confidence", "reason", "tier").alias("near"),
            F.col("similarity").alias("near_similarity"),
        )
        state = state.join(near, "content_id", "left")
    return _answer(state)


def _image_stages(images, known, image_hashes, image_refs, threshold) -> DataFrame:
    out = images
    if known is not None:
        out = match_known(out, known, threshold, spread="content_id")
    else:
        out = out.withColumn("category", F.lit(None).cast("string"))
    for store, key, prefix in ((image_hashes, "image_hash", "ph"), (image_refs, "image_ref", "ref")):
        columns = {"decision": "string", "confidence": "double", "reason": "string", "tier": "string"}
        if store is not None:
            out = reuse_by_key(out, store, key, prefix, hot_from=images)
        else:
            for name, kind in columns.items():
                out = out.withColumn(f"{prefix}_{name}", F.lit(None).cast(kind))

    def payload(prefix: str) -> Column:
        entry = F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in columns])
        return F.when(F.col(f"{prefix}_decision").isNotNull(), entry).alias(prefix)

    keep = [c for c in images.columns]
    return out.select(*keep, F.col("category").alias("known_category"), payload("ph"), payload("ref"))


def _early(kw: Column) -> Column:
    """struct(by, ruling) of the stages before the vector search, null when none answers."""

    def by(name: str, ruling: Column) -> Column:
        return F.struct(F.lit(name).alias("by"), ruling.cast(DECISION_TYPE).alias("ruling"))

    image, text = F.col("has_image"), ~F.col("has_image")
    reason = F.concat(F.lit("Perceptual hash match: "), F.col("known_category"))

    def entry(name: str) -> Column:
        return F.struct(*[F.col(f"{name}.{c}") for c in ("decision", "confidence", "reason", "tier")])

    whitelist = _ruling(
        "pass", 1.0, "Whitelist match — known false positive phrase", "L0_whitelist"
    )
    keyword = _ruling(
        "block", 1.0, F.concat(F.lit("Hot-path keyword match: "), kw["label"]), "L1_keyword"
    )
    return (
        F.when(
            image & F.col("known_category").isNotNull(),
            by("known_hash", _ruling("block", 1.0, reason, "L0_phash")),
        )
        .when(image & F.col("ph").isNotNull(), by("image_hash", entry("ph")))
        .when(image & F.col("ref").isNotNull(), by("image_ref", entry("ref")))
        .when(
            text & ~F.col("has_text"),
            by("empty", _ruling("pass", 1.0, "empty content", "L0_empty")),
        )
        .when(text & F.col("local").isNotNull(), by("memory", entry("local")))
        .when(text & F.col("shared").isNotNull(), by("shared", entry("shared")))
        .when(text & kw["whitelist_hit"], by("whitelist", whitelist))
        .when(text & (kw["confidence"] > 0.99), by("keyword", keyword))
    )


def _answer(state: DataFrame) -> DataFrame:
    kw, near = F.col("kw"), F.col("near")
    ambiguous = ~F.col("has_image") & F.col("early").isNull() & (kw["confidence"] >= 0.4)
    resolved_by = (
        F.when(F.col("early").isNotNull(), F.col("early.by"))
        .when(near.isNotNull(), "semantic")
        .when(ambiguous, "ambiguous")
        .otherwise("escalated")
    )
    scanned = resolved_by.isin("whitelist", "keyword", "semantic", "ambiguous") | (
        (resolved_by == "escalated") & ~F.col("has_image")
    )
    carried = resolved_by.isin("keyword", "ambiguous")
    return state.select(
        "content_id",
        "ts",
        "key",
        "has_image",
        "has_text",
        resolved_by.alias("resolved_by"),
        F.coalesce("early.ruling", near).alias("ruling"),
        scanned.alias("keyword_prefiltered"),
        F.when(carried, kw["label"]).alias("keyword_label"),
        F.when(carried, kw["confidence"]).otherwise(0.0).alias("keyword_confidence"),
        F.struct(kw["label"].alias("label"), kw["confidence"].alias("confidence")).alias("kw"),
        F.col("near_similarity").alias("similarity"),
        _traces(state, resolved_by).alias("traces"),
    )


def _traces(state: DataFrame, by: Column) -> Column:
    """The steps up to the stage that answered."""
    text, url, kw = F.col("input"), F.coalesce("image_url", F.lit("base64")), F.col("kw")
    image = F.col("has_image")
    miss = F.struct(F.lit(True).alias("miss"))

    def stored(name: str) -> Column:
        return F.struct(*[F.col(f"{name}.{c}") for c in ("decision", "confidence", "reason", "tier")])

    def step(when: Column, name: str, model: str, shown: Column, output: Column) -> Column:
        return F.when(when, trace_step("gateway", name, model, shown, output))

    hashed = F.col("image_hash").isNotNull()
    hash_out = F.struct(F.col("image_hash").alias("phash"), F.col("known_category").alias("category"))
    past_memory = ~image & F.col("has_text") & (by != "memory")
    past_shared = past_memory & (by != "shared")
    searched = past_shared & by.isin("semantic", "escalated")
    steps = [
        step(by == "known_hash", "image_phash_block", "dHash", url, hash_out),
        step(by == "image_hash", "image_phash_cache", "dHash · cached", url, stored("ph")),
        step(
            image & hashed & by.isin("image_ref", "escalated"),
            "image_phash_ok",
            "dHash",
            url,
            hash_out,
        ),
        step(
            image & ~hashed,
            "image_no_bytes",
            "none",
            url,
            F.struct(F.lit("no image bytes, no perceptual hash").alias("reason")),
        ),
        step(by == "image_ref", "image_url_cache_hit", "SHA256 · image ref", url, stored("ref")),
        step(
            image & (by == "escalated"),
            "image_escalate",
            "none",
            url,
            F.struct(F.lit("image in no store").alias("reason")),
        ),
        step(by == "memory", "L0_memory_hit", "SHA256 · local store", text, stored("local")),
        step(past_memory, "L0_memory_miss", "SHA256 · local store", text, miss),
        step(by == "shared", "L0b_redis_hit", "SHA256 · shared store", text, stored("shared")),
        step(past_shared, "L0b_redis_miss", "SHA256 · shared store", text, miss),
        step(
            by == "whitelist",
            "whitelist_pass",
            "keywords · whitelist",
            text,
            F.struct(kw["suppressed"].alias("suppressed")),
        ),
        step(
            by == "keyword",
            "keyword_block",
            "keywords · standalone",
            text,
            F.struct(kw["label"].alias("label"), kw["matches"].alias("matched_keywords")),
        ),
        step(
            by == "ambiguous",
            "keyword_ambiguous",
            "keywords · embedded",
            text,
            F.struct(kw["label"].alias("label"), kw["confidence"].alias("confidence")),
        ),
        step(searched, "keyword_miss", "keywords", text, miss),
        step(by == "semantic", "L1_chroma_hit", "vectors", text, stored("near")),
        step(
            searched & (by == "escalated"),
            "L1_chroma_miss",
            "vectors",
            text,
            F.struct(F.lit(True).alias("similarity_below_threshold")),
        ),
    ]
    return F.array_compact(F.array(*steps)).cast(TRACE_TYPE)


def stats(checked: DataFrame) -> DataFrame:
    """Counters of the gateway as rates over all requests, one row.

    Known images count as keyword hits; blank content and ambiguous keywords count in the
    total only, so the rates need not add up to 1.
    """
    total = F.count(F.lit(1))

    def n(*stages: str) -> Column:
        return F.count(F.when(F.col("resolved_by").isin(*stages), 1))

    hits = {
        "image_cache_hit": ("image_hash", "image_ref"),
        "memory_cache_hit": ("memory",),
        "redis_cache_hit": ("shared",),
        "keyword_hit": ("keyword", "known_hash"),
        "whitelist_hit": ("whitelist",),
        "chroma_cache_hit": ("semantic",),
    }
    every = tuple(s for stages in hits.values() for s in stages)
    base = F.greatest(total, F.lit(1))
    return checked.agg(
        total.alias("total_requests"),
        *[F.round(n(*stages) / base, 4).alias(f"{name}_rate") for name, stages in hits.items()],
        F.round(n(*every) / base, 4).alias("hot_path_rate"),
        F.round(n("escalated") / base, 4).alias("escalated_rate"),
        n(*every).alias("cold_path_calls_saved"),
    )


def traffic_split(checked: DataFrame) -> DataFrame:
    """Count and share of blocked, passed and escalated content, texts and images apart."""
    outcome = (
        F.when(F.col("ruling").isNull(), "cold_escalated")
        .when(F.col("ruling.decision") == "block", "hot_block")
        .otherwise("hot_pass")
    )
    counts = checked.groupBy(
        F.when(F.col("has_image"), "image").otherwise("text").alias("kind"),
        outcome.alias("outcome"),
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = checked.agg(F.count(F.lit(1)).alias("t"))
    return counts.select(
        "kind", "outcome", "n", F.round(F.col("n") / totals.scalar(), 4).alias("share")
    )
