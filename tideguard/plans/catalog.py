"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideguard.config import DecisionConfig
from tideguard.functions import signals as S
from tideguard.functions import text as X
from tideguard.functions import traces
from tideguard.functions import vectors as V
from tideguard.operators import (
    action,
    batch,
    classifier,
    decision,
    evaluation,
    feedback,
    funnel,
    gateway,
    hashes,
    keywords,
    monitoring,
    reuse,
    review,
    scorers,
    semantic,
)
from tideguard.operators.skew import rows_of
from tideguard.plans.views import DICTIONARY, START, Views
from tideguard.session import materialise, scratch_path
from tideguard.sources import readers, writers
from tideguard.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The test vectors have no near copies: their closest pairs have a cosine of about 0.5.
TEST_SIMILARITY = 0.70


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Registers `fn` under its own name."""
    QUERIES[fn.__name__.removesuffix("_query")] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return fn


# --- sources and sinks ------------------------------------------------------------------


@query
def src_jsonl(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "jsonl")
    line = F.to_json(F.struct(F.col("content_id").cast("string").alias("id"), "text"))
    lines = F.explode(F.array(line, F.lit("  "), F.lit('{"id": "broken')))
    v.content.select(lines.alias("value")).write.text(path)
    return readers.read_batch_jsonl(v.spark, path)


@query
def src_csv(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "csv")
    quoted = F.regexp_replace("text", '"', '""')
    row = F.concat(F.lit('"'), quoted, F.lit('",'), F.col("content_id").cast("string"))
    v.content.select(F.explode(F.array(row, F.lit(""), F.lit('" ",7'))).alias("value")).write.text(
        path
    )
    # The SQL has blanks for line breaks; the file and the reader have the breaks.
    return readers.read_batch_csv(v.spark, path).withColumn("text", F.regexp_replace("text", "[\r\n]", " "))


@query
def events_recent(v: Views) -> DataFrame:
    events = v.table("events").withColumn("at", F.struct("ts", "event_id"))
    return readers.recent(events, "at", 100).select("event_id", "user_id", "event_type", "value")


@query
def events_append(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "events")
    writers.append_events(v.mod_events.where("tier = 'cache'"), path)
    writers.append_events(v.mod_events.where("tier <> 'cache'"), path)
    log = v.spark.read.parquet(path)
    day = F.floor(F.col("ts") / 86400).cast("long")
    return log.groupBy(day.alias("day"), "decision").agg(F.count(F.lit(1)).alias("n"))


@query
def events_count(v: Views) -> DataFrame:
    return readers.count_events(v.table("events"))


@query
def dict_load(v: Views) -> DataFrame:
    """A dictionary file derived from the documents: sources as words, by language."""
    path = scratch_path(v.spark, "dictionary")
    words = v.table("documents").groupBy("lang").agg(F.collect_set(F.upper("source")).alias("words"))
    as_map = F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "words"))))
    words.agg(F.to_json(as_map).alias("value")).write.text(path)
    return readers.dictionary_table(v.spark, path)


@query
def eval_cases(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "cases")
    v.eval_cases.select("text", F.col("expected").alias("label")).write.json(path)
    return readers.read_eval_cases(v.spark, path)


@query
def eval_label_map(v: Views) -> DataFrame:
    return v.table("labels").select(
        "doc_id",
        readers.expected_from_toxicity(F.col("toxic")).alias("by_toxicity"),
        readers.expected_from_class(F.col("quality") + F.col("toxic")).alias("by_class"),
        readers.expected_from_prompt_label(
            F.when(F.col("quality") == 1, "Safe").otherwise("UNSAFE")
        ).alias("by_prompt"),
    )


@query
def assets_write(v: Views) -> DataFrame:
    root = scratch_path(v.spark, "assets")
    events = _events(v)
    assets = {
        "labelled": feedback.labelled_dataset(events),
        "summary": feedback.labelled_summary(events),
        "keywords": feedback.discover_keywords(events, DICTIONARY),
        "false_positives": feedback.false_positives(events),
        "hard_cases": feedback.hard_cases(events),
        "report": feedback.report(events),
    }
    writers.write_assets(assets, root, "20240101_000000")
    return writers.inventory(v.spark, root, list(assets))


@query
def dataset_latest(v: Views) -> DataFrame:
    root = scratch_path(v.spark, "datasets")
    events = _events(v)
    for run, confidence in (("20240101_000000", 0.5), ("20240102_000000", 0.9)):
        writers.write_assets({"labelled": feedback.labelled_dataset(events, confidence)}, root, run)
    return readers.latest_run(v.spark, f"{root}/labelled").select(
        F.col("run").cast("string").alias("run"), "id", "label", "confidence", "source"
    )


@query
def train_load(v: Views) -> DataFrame:
    samples = v.content.select(
        "content_id",
        F.when(F.col("content_id") % 50 == 7, " ").otherwise(F.col("text")).alias("text"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("safe", "pass", "normal", "unsafe", "block", "other")]),
            (F.col("content_id") % 6 + 1).cast("int"),
        ).alias("label"),
    )
    return readers.training_rows(samples).select("content_id", "label")


@query
def hash_db_load(v: Views) -> DataFrame:
    """Whole hashes; every third image is loaded again, under another category."""
    first = v.images.select(
        F.lower(F.hex("image_hash")).alias("hash"),
        F.col("image_id").alias("load_ord"),
        F.concat(F.lit("category_"), F.col("label").cast("string")).alias("category"),
    )
    again = first.where(F.col("load_ord") % 3 == 0).select(
        "hash", (F.col("load_ord") + 10_000_000).alias("load_ord"), F.lit("again").alias("category")
    )
    return readers.load_known_hashes(first.unionByName(again))


@query
def result_table(v: Views) -> DataFrame:
    step = traces.trace_step(
        "decision", "final", "none", F.col("text"), F.struct(F.col("decision").alias("decision"))
    )
    return evaluation.result_table(v.results.withColumn("traces", F.array(step, step)))


@query
def image_b64(v: Views) -> DataFrame:
    data = F.base64(F.col("text").cast("binary"))
    kind = F.col("content_id") % 3
    sent = (
        F.when(kind == 0, F.concat(F.lit("data:image/png;base64,"), data))
        .when(kind == 1, data)
        .otherwise(F.concat(F.lit("%%%"), F.col("text")))
    )
    image = X.image_bytes(sent)
    return v.content.select(
        "content_id", F.length(image).cast("long").alias("n_bytes"), F.sha2(image, 256).alias("sha")
    )


# --- projections and predicates ------------------------------------------------------------


@query
def resolve_text(v: Views) -> DataFrame:
    c = v.gateway_content
    return c.select("content_id", X.resolve_text(F.col("text"), F.col("image_url")).alias("resolved"))


@query
def empty_pass(v: Views) -> DataFrame:
    return v.gateway_content.select(
        "content_id",
        X.blank(F.col("text")).alias("is_blank"),
        F.when(X.blank(F.col("text")), "L0_empty").alias("tier"),
    )


@query
def route_content(v: Views) -> DataFrame:
    resolved = X.resolve_text(F.col("text"), F.col("image_url"))
    ocr = F.when(F.col("content_id") % 4 == 3, F.col("source"))
    return v.gateway_content.select(
        "content_id",
        X.route(resolved, ocr).alias("next_step"),
        X.content_type(F.col("text"), F.col("image_ref")).alias("content_type"),
    )


@query
def ocr_append(v: Views) -> DataFrame:
    ocr = F.when(F.col("content_id") % 4 == 3, F.col("source")).otherwise("")
    return v.gateway_content.select(
        "content_id", X.append_ocr(F.col("text"), ocr).alias("text")
    )


@query
def content_keys(v: Views) -> DataFrame:
    text = F.col("text")
    url = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    return v.content.select(
        "content_id",
        X.content_key(text).alias("key"),
        X.shared_key(text).alias("shared_key"),
        X.sample_id(text).alias("sample_id"),
        X.image_ref_key(url, text).alias("image_ref"),
    )


@query
def decision_label(v: Views) -> DataFrame:
    return v.results.select(
        "content_id",
        X.decision_label(F.col("decision")).alias("from_decision"),
        X.decision_label(F.col("expected")).alias("from_label"),
        X.decision_label(F.col("lang")).alias("from_unknown"),
    )


def _raw_label() -> F.Column:
    names = ["toxic", "OK", "H2", "S3", "obscene", "LABEL_1", "V", "insult"]
    return F.element_at(
        F.array(*[F.lit(x) for x in names]), (F.col("content_id") % 8 + 1).cast("int")
    )


@query
def label_map(v: Views) -> DataFrame:
    return v.content.select("content_id", _raw_label().alias("raw"), X.mapped_label(_raw_label()).alias("label"))


def _hundredths(factor: int) -> F.Column:
    return (F.col("content_id") * factor % 101) / F.lit(100.0)


@query
def score_verdict(v: Views) -> DataFrame:
    """Three scores per document: a raw label, then two of unsafe classes."""
    scores = F.array(
        F.struct(_raw_label().alias("label"), _hundredths(37).alias("score")),
        F.struct(F.lit("threat").alias("label"), _hundredths(53).alias("score")),
        F.struct(F.lit("SH").alias("label"), _hundredths(29).alias("score")),
    )
    scored = v.content.select(
        "content_id", S.score_verdict(F.when(F.col("lang") == "de", F.array().cast(
            "array<struct<label:string,score:double>>")).otherwise(scores)).alias("_v")
    )
    return scored.select("content_id", "_v.*")


@query
def softmax_verdict(v: Views) -> DataFrame:
    scored = v.table("embeddings").select(
        "vec_id",
        S.softmax_verdict(
            F.transform("embedding", lambda x: x.cast("double") * 20)
        ).alias("_v"),
    )
    return scored.select("vec_id", "_v.*")


@query
def nsfw_verdict(v: Views) -> DataFrame:
    scores = F.array(
        F.struct(F.lit("normal").alias("label"), _hundredths(37).alias("score")),
        F.struct(F.lit("NSFW").alias("label"), _hundredths(53).alias("score")),
    )
    verdict = S.nsfw_verdict(
        scores,
        F.length("text") * 1000,
        F.col("content_id") % 20,
        F.col("content_id") % 30,
    )
    return v.content.select("content_id", verdict.alias("_v")).select("content_id", "_v.*")


@query
def ocr_blocks(v: Views) -> DataFrame:
    """The turns of a conversation as the recognised blocks of an image."""
    block = F.struct("turn", "text", ((F.col("turn") * 17 + 3) % 11 / 10.0).alias("confidence"))
    pages = v.table("conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(block)).alias("blocks")
    )
    return pages.select("conv_id", S.ocr_text(F.col("blocks")).alias("_o")).select("conv_id", "_o.*")


@query
def is_correct(v: Views) -> DataFrame:
    return v.results.select(
        "content_id",
        "expected",
        "decision",
        X.is_correct(F.col("expected"), F.col("decision")).alias("correct"),
    )


@query
def result_filter(v: Views) -> DataFrame:
    return evaluation.filter_results(
        v.results, path="cold", expected="safe", correct="correct", search="The "
    ).select("content_id", "tier", "decision")


@query
def outcome_split(v: Views) -> DataFrame:
    parts = action.split_outcomes(v.results)
    counted = [
        df.groupBy(F.lit(name).alias("outcome"), "lang").agg(F.count(F.lit(1)).alias("n"))
        for name, df in parts.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def response_format(v: Views) -> DataFrame:
    gap = F.col("content_id") % 5
    partial = v.results.select(
        "content_id",
        F.when(gap != 0, F.col("decision")).alias("decision"),
        F.when(gap != 1, F.col("confidence")).alias("confidence"),
        F.when(gap != 2, F.col("reason")).alias("reason"),
        F.when(gap != 3, F.col("tier")).alias("tier"),
        F.when(gap != 4, F.col("path")).alias("path"),
    )
    return batch.formatted(partial)


@query
def audit_prompt(v: Views) -> DataFrame:
    context = F.when(F.col("lang") == "en", F.struct(F.col("source").alias("source")))
    return v.content.select("content_id", X.audit_prompt(F.col("text"), context).alias("prompt"))


@query
def trace_steps(v: Views) -> DataFrame:
    step = traces.trace_step(
        "decision",
        "final",
        "none",
        F.col("text"),
        F.struct(F.col("decision").alias("decision")),
    )
    t = v.results.select("content_id", step.alias("t"))
    return t.select("content_id", "t.node", "t.step", "t.input", "t.output", "t.cost")


# --- text matching ----------------------------------------------------------------------


@query
def kw_match(v: Views) -> DataFrame:
    return keywords.occurrences(v.content, DICTIONARY).select(
        "content_id", "word", "category", "n"
    )


@query
def kw_match_many(v: Views) -> DataFrame:
    """A dictionary of 2,000 words, on the same path."""
    return keywords.occurrences(v.content, v.large_dictionary).select(
        "content_id", "word", "category", "n"
    )


@query
def kw_match_distinct(v: Views) -> DataFrame:
    judged = keywords.with_verdict(v.content, DICTIONARY, distinct=True)
    return judged.select("content_id", "kw.n_matches", "kw.category_count", "kw.confidence")


def _matched(v: Views) -> DataFrame:
    found = keywords.with_matches(v.content, DICTIONARY)
    return found.select("content_id", "kw_found", "kw_matches")


@query
def kw_whitelist(v: Views) -> DataFrame:
    """Matched words and whether they survive the whitelist."""
    kept = F.transform("kw_matches", lambda m: m["word"])
    return (
        _matched(v)
        .select("content_id", rows_of(F.col("kw_found")).alias("_m"), kept.alias("_kept"))
        .where("_m is not null")
        .select(
            "content_id",
            "_m.word",
            F.array_contains("_kept", F.col("_m.word")).alias("survives"),
        )
    )


@query
def kw_context(v: Views) -> DataFrame:
    return (
        _matched(v)
        .select("content_id", rows_of(F.col("kw_matches")).alias("_m"))
        .where("_m is not null")
        .select("content_id", "_m.word", "_m.context")
    )


@query
def kw_positions(v: Views) -> DataFrame:
    at = keywords.positions(F.lower(F.col("text")), "idiot")
    rows = v.content.select("content_id", rows_of(at).alias("position"))
    return rows.where("position is not null")


@query
def cjk_flag(v: Views) -> DataFrame:
    flag = keywords.is_cjk(F.col("text")).alias("has_cjk")
    return v.content.groupBy("lang", flag).agg(F.count(F.lit(1)).alias("n"))


def _verdicts(v: Views) -> DataFrame:
    return keywords.with_verdict(v.content, DICTIONARY).select("content_id", "kw.*")


@query
def kw_severity(v: Views) -> DataFrame:
    hit = F.size("matches") > 0
    return _verdicts(v).where(hit & F.col("combo_label").isNull()).select("content_id", "label")


@query
def kw_combo(v: Views) -> DataFrame:
    found = v.content.select(
        "content_id", keywords.combo_hit(F.lower(F.col("text")), DICTIONARY).alias("c")
    )
    return found.where("c is not null").select("content_id", "c.ord", "c.label", "c.note")


@query
def kw_confidence(v: Views) -> DataFrame:
    return _verdicts(v).where(F.col("combo_label").isNull()).select(
        "content_id", "n_matches", "category_count", "standalone", "confidence"
    )


@query
def kw_verdict(v: Views) -> DataFrame:
    return _verdicts(v).select(
        "content_id", "label", "confidence", "n_matches", "category_count", "multi_hit",
        "whitelist_hit", "combo_label", "combo_note",
    )


@query
def audit_parse(v: Views) -> DataFrame:
    return v.audits.select("content_id", S.parse_audit(F.col("raw")).alias("_p")).select(
        "content_id", "_p.*"
    )


@query
def guard_parse(v: Views) -> DataFrame:
    answer = F.expr(
        "case content_id % 5 "
        "when 0 then concat('Safety: Unsafe\\nCategories: PII, Violent ', source) "
        "when 1 then 'safety:  SAFE\\nCategories: None' "
        "when 2 then 'Safety: Controversial\\nCategories: Jailbreak' "
        "when 3 then concat('this is unsafe ', source) else concat('it is ', lang) end"
    )
    return v.content.select("content_id", S.parse_guard(answer).alias("_g")).select(
        "content_id", "_g.safety", "_g.label", "_g.confidence", "_g.reason"
    )


@query
def match_ratio(v: Views) -> DataFrame:
    actual = F.when(F.col("content_id") % 9 == 0, "").otherwise(F.col("source"))
    return v.content.select(
        "content_id", F.round(X.match_ratio(F.col("text"), actual), 6).alias("ratio")
    )


@query
def audit_validate(v: Views) -> DataFrame:
    problems = S.audit_problems(F.col("raw"))
    return v.audits.select(
        "content_id",
        (F.size(problems) == 0).alias("valid"),
        F.array_join(problems, ", ").alias("problems"),
    )


# --- reuse ------------------------------------------------------------------------------


@query
def reuse_exact(v: Views) -> DataFrame:
    return reuse.reuse_exact(v.requests, v.decisions)


@query
def reuse_two_tier(v: Views) -> DataFrame:
    return reuse.reuse_two_tier(v.requests, v.decisions, v.decisions)


@query
def reuse_image(v: Views) -> DataFrame:
    images = v.gateway_content.where("image_ref is not null").select(
        "content_id", "image_hash", "image_ref"
    )
    by_hash = reuse.reuse_by_key(images, v.image_hash_store, "image_hash", "ph")
    both = reuse.reuse_by_key(by_hash, v.image_ref_store, "image_ref", "ref")
    return both.select(
        "content_id",
        F.coalesce("ph_decision", "ref_decision").alias("decision"),
        F.coalesce("ph_confidence", "ref_confidence").alias("confidence"),
        F.coalesce("ph_reason", "ref_reason").alias("reason"),
    )


@query
def hash_known(v: Views) -> DataFrame:
    return hashes.match_known(v.images, v.known_hashes).select(
        "image_id", "known_hash", "distance", "category"
    )


@query
def hash_near(v: Views) -> DataFrame:
    """Images with the closest other image of the known category within 15 bits."""
    return hashes.match_known(v.images, v.known_hashes, threshold=15, nearest=True).select(
        "image_id", "known_ord", "distance"
    )


@query
def hash_pairs(v: Views) -> DataFrame:
    return hashes.distance_summary(v.images)


@query
def hash_sweep(v: Views) -> DataFrame:
    return hashes.threshold_sweep(v.images)


@query
def key_collisions(v: Views) -> DataFrame:
    """Texts against their keys cut to 16 bits, which do collide."""
    key = X.content_key(F.col("text"))
    return hashes.key_collisions(v.content, key, F.substring(key, 1, 4))


@query
def reuse_potential(v: Views) -> DataFrame:
    return hashes.reuse_potential(v.requests, "key")


@query
def reuse_semantic(v: Views) -> DataFrame:
    queries = v.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    found = semantic.reuse_semantic(queries, v.vectors, TEST_SIMILARITY, earlier_only=True)
    return found.select(
        "query_id", "entry_id", F.round("similarity", 6).alias("similarity"), "decision", "reason"
    )


@query
def reuse_semantic_near(v: Views) -> DataFrame:
    """Every vector with a third of its components raised, at the threshold in use."""
    raised = F.transform(
        "embedding",
        lambda x, i: x.cast("double") * F.when((i + F.col("vec_id")) % 3 == 0, 1.25).otherwise(1.0),
    )
    queries = v.table("embeddings").select(F.col("vec_id").alias("query_id"), raised.alias("embedding"))
    store = v.vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return semantic.reuse_semantic(queries, store).select(
        "query_id", "entry_id", F.round("similarity", 6).alias("similarity"), "decision", "reason"
    )


@query
def batch_semantic(v: Views) -> DataFrame:
    """Documents with a vector reuse the nearest earlier one; copies of a text are one item."""
    first, _ = batch.dedup(v.gateway_content.where("embedding is not null"))
    items = first.select(F.col("content_id").alias("query_id"), "embedding")
    store = items.select(F.col("query_id").alias("entry_id"), "embedding")
    found = semantic.nearest(items, store, TEST_SIMILARITY, earlier_only=True)
    return found.select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"))


@query
def cosine(v: Views) -> DataFrame:
    """Every vector against the next one."""
    a = v.table("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = v.table("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        "vec_id",
        F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"),
        F.round(V.similarity(F.col("a"), F.col("b")), 6).alias("similarity"),
        F.round(V.norm(V.l2_normalised(F.col("a"))), 6).alias("norm"),
    )


@query
def score_named(v: Views) -> DataFrame:
    """A scorer by name: the share of capitals, once per distinct text."""
    keyed = v.content.select("content_id", "text", X.content_key(F.col("text")).alias("key"))
    return scorers.with_scores(keyed, "shouting").select("content_id", "key", "n_letters", "share")


@query
def dhash(v: Views) -> DataFrame:
    return v.images.select(
        "image_id", "image_hash", V.hash_hex(F.col("image_hash"), 56).alias("hex")
    )


@query
def hamming(v: Views) -> DataFrame:
    """Every image hash against the next one, as numbers and as hex; some cut short."""
    hex_ = V.hash_hex(F.col("image_hash"), 56)
    a = v.images.select("image_id", F.col("image_hash").alias("a"), hex_.alias("ha"))
    cut = F.when(F.col("image_id") % 5 == 0, F.substring(hex_, 1, 7)).otherwise(hex_)
    b = v.images.select(
        (F.col("image_id") - 1).alias("image_id"), F.col("image_hash").alias("b"), cut.alias("hb")
    )
    return a.join(b, "image_id").select(
        "image_id",
        V.hamming(F.col("a"), F.col("b")).alias("distance"),
        V.hamming_hex(F.col("ha"), F.col("hb")).alias("hex_distance"),
    )


@query
def phash(v: Views) -> DataFrame:
    """Every vector as an 8 x 8 image blown up to 32 x 32 by repetition."""
    grey = F.transform(
        F.sequence(F.lit(0), F.lit(1023)),
        lambda i: F.get(
            F.col("embedding"),
            (F.floor(i / 128) * 8 + F.floor((i % 32) / 4)).cast("int"),
        ).cast("double"),
    )
    return v.table("embeddings").select("vec_id", V.phash_udf()(grey).alias("phash"))


@query
def embed_texts(v: Views) -> DataFrame:
    vectors = classifier.embed(v.gateway_content.select("content_id", "text"))
    return vectors.select(
        "content_id",
        F.size("embedding").alias("size"),
        F.round(V.norm(F.col("embedding")), 4).alias("norm"),
    )


@query
def vector_upsert(v: Views) -> DataFrame:
    """Store of all vectors by label and hash byte, rewritten by decisions, without label 9."""
    store = v.vectors.selectExpr(
        "concat(reason, '/', entry_id % 20) as key", "entry_id as version", "decision"
    )
    newer = store.where("version % 3 = 0").selectExpr(
        "key", "version + 100000 as version", "'review' as decision"
    )
    kept = reuse.upsert(store, newer, ["key"], ["version"])
    gone = store.where("key like 'like label 9/%'")
    return reuse.invalidate(kept, gone, ["key"])


@query
def cache_stats(v: Views) -> DataFrame:
    found = reuse.reuse_exact(v.requests, v.decisions)
    return reuse.cache_stats(found, F.col("hit"), v.decisions.select("key").distinct())


@query
def latest_state(v: Views) -> DataFrame:
    """Last event per user."""
    events = v.table("events").select("user_id", "event_id", "event_type", "value")
    return reuse.latest(events, ["user_id"], ["event_id"])


@query
def batch_dedup(v: Views) -> DataFrame:
    _, members = batch.dedup(v.content)
    return members.select(
        "content_id", "first_id", (F.col("first_id") != F.col("content_id")).alias("is_copy")
    )


# --- gateway, funnel, decision ---------------------------------------------------------


def _stores(v: Views) -> dict:
    return {
        "local": v.decisions,
        "shared": v.decisions,
        "known": v.known_hashes,
        "image_hashes": v.image_hash_store,
        "image_refs": v.image_ref_store,
        "vectors": v.vectors,
        "similarity_threshold": TEST_SIMILARITY,
        "earlier_vectors_only": True,
    }


def _checked(v: Views, cut: bool = True) -> DataFrame:
    prepared = gateway.prepare(v.gateway_texts, DICTIONARY, vectors=v.gateway_vectors)
    return gateway.check(prepared, **_stores(v), cut=materialise if cut else None)


@query
def gateway_query(v: Views) -> DataFrame:
    return _checked(v).select(
        "content_id",
        "resolved_by",
        "ruling.decision",
        "ruling.confidence",
        "ruling.reason",
        "ruling.tier",
        "keyword_prefiltered",
        "keyword_label",
        "keyword_confidence",
    )


@query
def gateway_stats(v: Views) -> DataFrame:
    return gateway.stats(_checked(v))


@query
def traffic_split(v: Views) -> DataFrame:
    return gateway.traffic_split(materialise(_checked(v), "checked"))


@query
def trace_concat(v: Views) -> DataFrame:
    """Gateway steps followed by a decision step: how many, and their names in order."""
    last = traces.trace_step("decision", "final", "none", F.lit(""), F.struct(F.lit(1).alias("x")))
    steps = traces.joined(F.col("traces"), F.array(last))
    return _checked(v).select(
        "content_id",
        F.size(steps).alias("n_steps"),
        F.array_join(F.transform(steps, lambda s: s["step"]), ">").alias("steps"),
    )


@query
def skip_audit(v: Views) -> DataFrame:
    return v.signals.select(
        "content_id",
        S.skips_audit(F.col("score_label"), F.col("score_confidence")).alias("skips"),
        S.unsure(F.col("score_confidence")).alias("unsure"),
    )


@query
def text_funnel(v: Views) -> DataFrame:
    seen = keywords.with_verdict(v.content, DICTIONARY).select(
        "content_id", "kw", X.blank(F.col("text")).alias("is_blank")
    )
    out = funnel.with_text_signal(seen.join(v.signals, "content_id"), is_blank=F.col("is_blank"))
    return out.select(
        "content_id", "text_signal.label", "text_signal.confidence", "text_signal.reason",
        "text_signal.tier", "text_signal.cost", "text_signal.preliminary",
    )


def _signalled(v: Views) -> DataFrame:
    return v.signals.select(
        "content_id",
        F.col("audit_label").alias("text_label"),
        F.col("audit_confidence").alias("text_confidence"),
        F.col("audit_reason").alias("text_reason"),
        "image_label",
        "image_confidence",
    )


@query
def score_aggregate(v: Views) -> DataFrame:
    out = decision.aggregate_signals(_signalled(v))
    return out.select("content_id", F.round("score", 6).alias("score"), "agg_label", "agg_confidence")


@query
def score_label(v: Views) -> DataFrame:
    """The ladder over one score per document, under the default and a lowered setting."""
    score = F.col("content_id") % 1000 / F.lit(1000.0)
    lower = DecisionConfig().with_updates({"score_thresholds": {"politics": 0.7, "spam": 0.2}})
    return v.signals.select(
        "content_id",
        decision.score_label(score, DecisionConfig()).alias("label"),
        decision.score_label(score, lower).alias("label_lower"),
    )


def _decision_inputs(v: Views) -> DataFrame:
    """Signals plus a cached decision or a sure keyword on some rows."""
    return _signalled(v).selectExpr(
        "*",
        "case when content_id % 10 = 9 then 'review' end as cached_decision",
        "case when content_id % 10 = 9 then 0.8D end as cached_confidence",
        "case when content_id % 20 = 9 then 'seen before' end as cached_reason",
        "case content_id % 12 when 5 then 'politics' when 7 then 'toxic' end as keyword_label",
        "case when content_id % 12 in (5, 7) then 1.0D when content_id % 12 = 3 then 0.6D "
        "else 0.0D end as keyword_confidence",
    )


@query
def decide(v: Views) -> DataFrame:
    """The rules on present signals only and with an absent image counted as normal."""
    columns = ["content_id", "decision", "confidence", "reason", "rule"]
    plain = decision.with_decision(_decision_inputs(v), placeholder_image=False).select(*columns)
    graph = decision.with_decision(_decision_inputs(v), placeholder_image=True).select(*columns)
    return plain.withColumn("mode", F.lit("signals")).unionByName(
        graph.withColumn("mode", F.lit("placeholder"))
    )


@query
def config_overrides(v: Views) -> DataFrame:
    """Decisions under per-tenant parameters; the language is the tenant."""
    base = DecisionConfig()
    tenants = {
        "en": base.with_updates({"grey_zone": {"low": 0.2}}),
        "fr": base.with_updates({"grey_zone": {"high": 0.9}, "zero_tolerance": ["porn"]}),
        "de": base,
    }
    rows = _signalled(v).join(v.table("documents").selectExpr("doc_id as content_id", "lang"), "content_id")
    table = decision.config_table(v.spark, tenants).withColumnRenamed("tenant", "lang")
    tenanted = rows.join(F.broadcast(table), "lang", "left")
    return decision.with_decision(tenanted, placeholder_image=False).select(
        "content_id", "lang", "decision", "confidence", "rule"
    )


def _decided(v: Views) -> DataFrame:
    out = decision.with_decision(_decision_inputs(v), placeholder_image=False)
    return out.join(v.content, "content_id").withColumn("tier", F.lit("L3_llm")).withColumn(
        "cache_hit", F.col("cached_decision").isNotNull()
    )


@query
def action_outputs(v: Views) -> DataFrame:
    out = action.outputs(_decided(v), F.col("ts"))
    parts = [
        df.groupBy(F.lit(name).alias("output"), F.col(what).alias("decision")).agg(
            F.count(F.lit(1)).alias("n")
        )
        for name, what, df in (
            ("entries", "decision", out["entries"]),
            ("reviews", "ai_decision", out["reviews"]),
            ("events", "decision", out["events"]),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def review_enqueue(v: Views) -> DataFrame:
    return review.enqueue(_decided(v), F.col("ts")).select(
        "review_id", "content_id", "status", "priority", "ai_decision", "ai_confidence"
    )


@query
def review_pending(v: Views) -> DataFrame:
    return review.pending(v.reviews).select("review_id", "priority", "enqueued_at")


@query
def review_stats(v: Views) -> DataFrame:
    return review.queue_stats(v.reviews)


@query
def review_resolve(v: Views) -> DataFrame:
    """All resolutions: what the queue says afterwards, or why they were rejected."""
    _, resolved, rejected = review.resolve(v.reviews, v.resolutions)
    done = resolved.select(
        "review_id", "human_decision", "reviewed_by", F.lit(None).cast("string").alias("error")
    )
    return done.unionByName(
        rejected.select(
            "review_id", "human_decision", F.col("reviewer").alias("reviewed_by"), "error"
        )
    )


@query
def review_feedback(v: Views) -> DataFrame:
    """The reuse store after human decisions were written over it."""
    _, resolved, _ = review.resolve(v.reviews, v.resolutions)
    human = review.human_entries(resolved).withColumn("entry_ord", F.lit(0).cast("long"))
    store = reuse.upsert(v.decisions, human, ["key"], ["decided_at", "entry_ord"])
    return store.select("key", "decision", "confidence", "reason", "tier")


@query
def human_events(v: Views) -> DataFrame:
    reviewed = v.reviews.where("status = 'reviewed'")
    return review.human_events(reviewed).select(
        "content_id", "decision", "confidence", "reason", "source_label", "ai_decision", "tier"
    )


def _moderated(v: Views) -> DataFrame:
    return batch.moderate(
        v.gateway_texts, v.signals, DICTIONARY, _stores(v), cut=materialise, vectors=v.gateway_vectors
    )


MODERATED = [
    "content_id", "decision", "confidence", "reason", "tier", "path", "resolved_by", "shared"
]


@query
def moderate_batch(v: Views) -> DataFrame:
    return _moderated(v).select(*MODERATED)


@query
def moderate_traces(v: Views) -> DataFrame:
    """The steps of every document through the whole service, copies with where they took it from."""
    names = F.transform("traces", lambda s: s["step"])
    return _moderated(v).select(
        "content_id", F.size("traces").alias("n_steps"), F.array_join(names, ">").alias("steps")
    )


@query
def moderate_outputs(v: Views) -> DataFrame:
    """What a moderated batch leaves: entries for reuse, reviews, events, by decision."""
    content = v.gateway_content.select("content_id", "text", "ts")
    decided = materialise(
        _moderated(v).withColumn("cache_hit", F.col("path") == "hot").join(content, "content_id"), "decided"
    )
    out = action.outputs(decided, F.col("ts"))
    parts = [
        df.groupBy(F.lit(name).alias("output"), F.col(what).alias("decision")).agg(F.count(F.lit(1)).alias("n"))
        for name, what, df in (
            ("entries", "decision", out["entries"]),
            ("reviews", "ai_decision", out["reviews"]),
            ("events", "decision", out["events"]),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def batch_summary(v: Views) -> DataFrame:
    return batch.summary(_moderated(v))


def _evaluated(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    cases = v.eval_cases.select("content_id", F.col("lang").alias("corpus"), "expected", "source")

    def judge(content: DataFrame) -> DataFrame:
        judged = batch.moderate(content, v.signals, DICTIONARY, _stores(v), cut=materialise)
        return judged.select("content_id", "decision", "confidence", "reason", "tier", "path")

    return evaluation.run(v.gateway_content, cases, judge)


@query
def eval_run(v: Views) -> DataFrame:
    """Labelled documents through the whole service: figures per language as corpus, and in all."""
    return _evaluated(v)[0]


@query
def eval_run_errors(v: Views) -> DataFrame:
    """The first wrong results of each corpus of the run."""
    return _evaluated(v)[1]


# --- feedback and monitoring --------------------------------------------------------------


def _events(v: Views) -> DataFrame:
    reviewed = review.human_events(v.reviews.where("status = 'reviewed'"))
    return feedback.all_events(v.mod_events, reviewed)


@query
def events_union(v: Views) -> DataFrame:
    return _events(v).select(
        "content_id", "source_label", "decision", "confidence", "tier", "ai_decision", "event_id"
    )


@query
def labelled_dataset(v: Views) -> DataFrame:
    return feedback.labelled_dataset(_events(v)).select(
        "id", "label", "confidence", "source", "model_tier", "ai_reason"
    )


@query
def labelled_summary(v: Views) -> DataFrame:
    return feedback.labelled_summary(_events(v))


@query
def kw_discovery(v: Views) -> DataFrame:
    return feedback.discover_keywords(_events(v), DICTIONARY)


@query
def false_positives(v: Views) -> DataFrame:
    return feedback.false_positives(_events(v)).select(
        "content_id", "ai_decision", "ai_confidence", "human_reason"
    )


@query
def hard_cases(v: Views) -> DataFrame:
    return feedback.hard_cases(_events(v)).select("content_id", "label", "confidence", "difficulty")


@query
def report_distributions(v: Views) -> DataFrame:
    return feedback.distributions(_events(v))


@query
def report_overrides(v: Views) -> DataFrame:
    return feedback.overrides(_events(v))


@query
def report_agreement(v: Views) -> DataFrame:
    return feedback.agreement(_events(v))


@query
def report_conf_bins(v: Views) -> DataFrame:
    return feedback.confidence_bins(_events(v))


@query
def drift_detect(v: Views) -> DataFrame:
    return monitoring.drift(v.daily_history)


@query
def accuracy_history(v: Views) -> DataFrame:
    return monitoring.keep_last(v.daily_history)


def _human_labels(v: Views) -> DataFrame:
    day = F.floor((F.col("enqueued_at") - START) / 86400).cast("long")
    return v.reviews.where("status = 'reviewed'").select(day.alias("day"))


@query
def finetune_trigger(v: Views) -> DataFrame:
    """Running number of purchases, as labels, per day against a threshold of 1500."""
    days = v.table("events").where("event_type = 'purchase'").select(
        F.to_date("ts").cast("string").alias("day")
    )
    return monitoring.retrain_trigger(days, threshold=1500)


@query
def calibrate(v: Views) -> DataFrame:
    return monitoring.calibrate(feedback.report(_events(v)))


@query
def health_status(v: Views) -> DataFrame:
    return monitoring.health_status(
        _human_labels(v), v.daily_history, feedback.report(_events(v))
    )


# The day of the run, after all days of the history.
RUN_DATE = "2024-03-01"


def _feedback_run(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    return feedback.run(_events(v), v.daily_history, DICTIONARY, RUN_DATE)


@query
def feedback_run(v: Views) -> DataFrame:
    """The whole offline run as one list of figures."""
    return _feedback_run(v)[0]


@query
def feedback_history(v: Views) -> DataFrame:
    """The accuracy records that a run leaves, its own included."""
    return _feedback_run(v)[1]


@query
def labelled_recent(v: Views) -> DataFrame:
    """Samples of the last half day, read off a log with a folder per day."""
    path = scratch_path(v.spark, "log")
    writers.append_events(v.mod_events, path)
    now = F.lit(START + 86400)
    log = v.spark.read.parquet(path)
    return feedback.labelled_summary(feedback.since(log, 1, now).where(F.col("ts") < now))


@query
def ops_alerts(v: Views) -> DataFrame:
    """The alert rules on the figures of the result table."""
    figures = evaluation.metrics(v.results)
    times = evaluation.latency(v.results)
    return monitoring.alerts(
        figures.select(
            "hot_path_rate",
            F.col("cache_hit_rate").alias("chroma_cache_hit_rate"),
            "llm_call_rate",
            times.select("p99").scalar().alias("latency_p99_ms"),
        )
    )


# --- evaluation --------------------------------------------------------------------------


@query
def eval_confusion(v: Views) -> DataFrame:
    return evaluation.confusion(v.results)


@query
def eval_funnel(v: Views) -> DataFrame:
    return evaluation.funnel(v.results)


@query
def eval_latency(v: Views) -> DataFrame:
    return evaluation.latency(v.results, ["path"])


@query
def eval_per_class(v: Views) -> DataFrame:
    return evaluation.per_class(v.results, "quality")


@query
def eval_top_errors(v: Views) -> DataFrame:
    return evaluation.top_errors(v.results, "source")


@query
def eval_by_group(v: Views) -> DataFrame:
    return evaluation.by_group(v.results, ["lang"])


def _score_results(v: Views) -> DataFrame:
    return v.eval_cases.select("content_id", "expected").join(
        v.signals.select("content_id", "score_label", "score_confidence", "audit_label", "audit_confidence"),
        "content_id",
    ).withColumn("confidence", F.col("score_confidence"))


@query
def eval_reliability(v: Views) -> DataFrame:
    return evaluation.reliability(_score_results(v), F.col("score_label") == F.col("expected"))


@query
def eval_ece(v: Views) -> DataFrame:
    return evaluation.calibration_error(_score_results(v), F.col("score_label") == F.col("expected"))


@query
def eval_overconfident(v: Views) -> DataFrame:
    return evaluation.overconfident(
        _score_results(v), F.col("score_label") == F.col("expected")
    ).select("content_id", "expected", "score_label", "confidence")


@query
def eval_disagreement(v: Views) -> DataFrame:
    audit = F.when(F.col("audit_label") == "safe", "safe").otherwise("unsafe")
    return evaluation.disagreement(
        _score_results(v).withColumn("label_a", F.col("score_label")).withColumn("label_b", audit)
    )


@query
def eval_consistency(v: Views) -> DataFrame:
    """Scores of all documents of a source as repeated runs on one item."""
    runs = v.table("documents").selectExpr("doc_id as content_id", "source").join(
        v.signals, "content_id"
    ).selectExpr("source", "audit_label as label", "audit_confidence as confidence")
    return evaluation.consistency(runs.where("label is not null"), "source")


@query
def service_breakdown(v: Views) -> DataFrame:
    return evaluation.service_breakdown(v.results)


@query
def cost_by_tier(v: Views) -> DataFrame:
    return evaluation.cost_by_tier(v.results)


@query
def latency_hist(v: Views) -> DataFrame:
    return evaluation.latency_histogram(v.results)


@query
def funnel_ordered(v: Views) -> DataFrame:
    return evaluation.ordered_funnel(v.results)


@query
def eval_acceptance(v: Views) -> DataFrame:
    return evaluation.acceptance(v.results)


@query
def eval_misclassified(v: Views) -> DataFrame:
    return evaluation.misclassified(v.results, "content_id").select(
        "content_id", "expected", "decision", "tier"
    )


@query
def balanced_sample(v: Views) -> DataFrame:
    return evaluation.balanced_sample(
        v.eval_cases.select("content_id", "expected"), "content_id", n=150
    )


@query
def balanced_sample_full(v: Views) -> DataFrame:
    return evaluation.balanced_sample(
        v.eval_cases.select("content_id", "expected"), "content_id", safe_ratio=3
    )


# --- classifier ---------------------------------------------------------------------------


def _samples(v: Views) -> DataFrame:
    return v.eval_cases.select(
        "content_id", "text", F.when(F.col("expected") == "unsafe", 1).otherwise(0).alias("label")
    )


@query
def train_prepare(v: Views) -> DataFrame:
    return classifier.split(_samples(v)).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def train_ready(v: Views) -> DataFrame:
    return classifier.readiness(_samples(v))


@query
def train_classifier(v: Views) -> DataFrame:
    """Quality of the classifier on the part it was not trained on."""
    parts = classifier.split(_samples(v))
    model = classifier.train(parts.where("part = 'train'"))
    scored = classifier.score(model, parts)
    as_results = scored.select(
        "part",
        F.when(F.col("label") == 1, "unsafe").otherwise("safe").alias("expected"),
        F.when(F.col("score_label") == "unsafe", "block").otherwise("pass").alias("decision"),
    )
    return evaluation.per_class(as_results, "part")


@query
def score_texts(v: Views) -> DataFrame:
    model = classifier.train(_samples(v))
    return classifier.score(model, v.content.select("content_id", "text")).select(
        "content_id", "score_label", "score_confidence"
    )


# --- streaming ----------------------------------------------------------------------------


def _stream(v: Views, name: str) -> DataFrame:
    schema = v.table(name).schema
    return v.spark.readStream.schema(schema).parquet(f"{v.sf_dir}/{name}*.parquet")


def _content_stream(v: Views) -> DataFrame:
    return _stream(v, "documents").select(
        F.col("doc_id").alias("content_id"),
        "text",
        "source",
        "lang",
        (F.col("doc_id") * 120 + START).alias("ts"),
    )


def _moderated_stream(v: Views) -> str:
    """The folder of a moderated stream's outputs."""
    path, checkpoint = scratch_path(v.spark, "moderated"), scratch_path(v.spark, "checkpoint")
    # Prepared before the stream starts, so no micro-batch computes them again.
    decisions = materialise(v.decisions, "stream-decisions")
    signals = materialise(v.signals, "stream-signals")
    stores = {"local": decisions, "shared": decisions}

    def judge(rows: DataFrame) -> DataFrame:
        return batch.moderate(rows, signals, DICTIONARY, stores, cut=materialise).select(*MODERATED)

    jobs.moderate_stream(_content_stream(v), judge, path, checkpoint)
    return path


@query
def stream_moderate(v: Views) -> DataFrame:
    return v.spark.read.parquet(f"{_moderated_stream(v)}/decisions").select(*MODERATED)


@query
def stream_reviews(v: Views) -> DataFrame:
    """The review records that a moderated stream leaves."""
    return v.spark.read.parquet(f"{_moderated_stream(v)}/reviews").select(
        "review_id", "content_id", "status", "enqueued_at", "priority", "ai_decision",
        "ai_confidence", "ai_reason",
    )


@query
def stream_outcomes(v: Views) -> DataFrame:
    """The events that a moderated stream leaves."""
    return v.spark.read.parquet(f"{_moderated_stream(v)}/events").select(
        "timestamp", "timestamp_iso", "content_id", "source", "decision", "confidence", "reason",
        "tier", "source_label",
    )


@query
def stream_ttl_cache(v: Views) -> DataFrame:
    """Requests answered from a cache that lives in the stream; each brings an answer of its own."""
    path, checkpoint = scratch_path(v.spark, "answers"), scratch_path(v.spark, "checkpoint")
    own = v.decisions.select(F.col("entry_ord").alias("content_id"), *jobs.ANSWER)
    answers = jobs.cached_answers(_content_stream(v).join(own, "content_id"), ttl=36000)
    jobs.run(answers.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)
    return v.spark.read.parquet(path).select(
        F.col("content_id").cast("long").alias("content_id"), "key", "hit",
        F.col("answered_by").cast("long").alias("answered_by"), *jobs.ANSWER,
    )


@query
def stream_cache_lives(v: Views) -> DataFrame:
    path, checkpoint = scratch_path(v.spark, "cache"), scratch_path(v.spark, "checkpoint")
    lives = jobs.ttl_cache(_content_stream(v), ttl=36000)
    jobs.upsert_sink(lives, path, checkpoint, mode="complete")
    return jobs.read_upserts(v.spark, path, ["key", "started"])


@query
def stream_dedup(v: Views) -> DataFrame:
    path, checkpoint = scratch_path(v.spark, "dedup"), scratch_path(v.spark, "checkpoint")
    first = jobs.first_seen(_content_stream(v)).select("key")
    jobs.run(first.writeStream.format("parquet").option("path", path), checkpoint)
    return v.spark.read.parquet(path)


@query
def stream_stats(v: Views) -> DataFrame:
    """Events by type in sliding windows of an hour."""
    path, checkpoint = scratch_path(v.spark, "stats"), scratch_path(v.spark, "checkpoint")
    events = _stream(v, "events").select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "event_type"
    )
    counts = jobs.windowed_counts(events, "event_type", "1 hour", "15 minutes")
    jobs.upsert_sink(counts, path, checkpoint)
    return jobs.read_upserts(v.spark, path, ["window_start", "window_end", "event_type"])


@query
def stream_events(v: Views) -> DataFrame:
    path, checkpoint = scratch_path(v.spark, "log"), scratch_path(v.spark, "checkpoint")
    jobs.append_log(_content_stream(v), path, checkpoint)
    log = v.spark.read.parquet(path)
    return log.select("content_id", X.content_key(F.col("text")).alias("key"), "ts")


@query
def stream_trigger(v: Views) -> DataFrame:
    """The running total of labels against 200, kept by a stream."""
    path, checkpoint = scratch_path(v.spark, "labels"), scratch_path(v.spark, "checkpoint")
    jobs.trigger_stream(jobs.daily_counts(_content_stream(v)), path, checkpoint, threshold=200)
    return v.spark.read.parquet(f"{path}/triggers").drop("left_over", "batch")
