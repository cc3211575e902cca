"""Views over the given tables that stand for the engine's inputs.

Each view is defined twice by the same integer arithmetic: as a DataFrame here, as SQL in
`oracle.py`. All cover their whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideguard.config import Combo, KeywordDictionary
from tideguard.functions.text import content_key, image_ref_key
from tideguard.functions.vectors import dhash

START = 1704067200

# Categories are spread over the words to exercise every step of the ladder.
DICTIONARY = KeywordDictionary(
    {
        "toxic": ["idiot", "moron", "stupid", "clown"],
        "violence": ["scum", "trash"],
        "porn": ["worthless", "pathetic"],
        "gambling": ["loser"],
        "politics": ["disgusting"],
    },
    (
        Combo(("idiot", "trash"), "violence", "insult and trash"),
        Combo(("moron", "worthless"), "toxic", "double insult"),
        Combo(("the", "token"), "politics", "words outside the dictionary"),
    ),
    ("idiot of", "idiot and", "trash idiot", "trash the"),
)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def text_table(self, name: str) -> DataFrame:
        """A table whose texts are worked on row by row, spread over the cores first.

        The files are one row group each, which one task reads; large inputs come in many
        splits and are left as they are.
        """
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def content(self) -> DataFrame:
        return self.text_table("documents").select(
            F.col("doc_id").alias("content_id"),
            "text",
            "source",
            "lang",
            (F.col("doc_id") * 120 + START).alias("ts"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        """Scores of two classifiers, audit and image signal per content."""
        return self.table("documents").selectExpr(
            "doc_id as content_id",
            "case when (doc_id * 13) % 3 = 0 then 'unsafe' else 'safe' end as score_label",
            "((doc_id * 37) % 101) / 100.0D as score_confidence",
            "case when (doc_id * 7) % 2 = 0 then 'unsafe' else 'safe' end as second_label",
            "((doc_id * 71) % 101) / 100.0D as second_confidence",
            "case when doc_id % 7 <> 0 then element_at(array('safe', 'toxic', 'violence', "
            "'politics', 'porn', 'gambling', 'spam'), cast((doc_id * 3) % 7 + 1 as int)) end "
            "as audit_label",
            "case when doc_id % 7 <> 0 then ((doc_id * 53) % 101) / 100.0D end "
            "as audit_confidence",
            "case when doc_id % 7 <> 0 then concat('audit of ', source) end as audit_reason",
            "case when doc_id % 6 = 0 then 'nsfw' when doc_id % 3 = 0 then 'normal' end "
            "as image_label",
            "case when doc_id % 3 = 0 then ((doc_id * 29) % 101) / 100.0D end "
            "as image_confidence",
        )

    @cached_property
    def audits(self) -> DataFrame:
        """Raw audit answers: plain JSON, fenced, in prose, unreadable."""
        signals = self.signals.select("content_id", "audit_label", "audit_confidence", "audit_reason")
        body = (
            "concat('{\"label\": \"', coalesce(audit_label, 'none'), '\", \"confidence\": ', "
            "cast(coalesce(audit_confidence, 7.0D) as string), "
            "case when content_id % 5 = 0 then '' else "
            "concat(', \"reason\": \"', coalesce(audit_reason, ''), '\"') end, '}')"
        )
        return signals.selectExpr(
            "content_id",
            f"case content_id % 4 when 0 then {body} "
            f"when 1 then concat('```json\\n', {body}, '\\n```') "
            f"when 2 then concat('The answer is ', {body}, ' as asked.') "
            "else concat('I think this is ', coalesce(audit_label, 'fine'), ' content') end as raw",
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """Earlier decisions on every text, up to 8520 s before its request and 3600 s after."""
        return self.table("documents").select(
            content_key(F.col("text")).alias("key"),
            F.expr(f"doc_id * 120 + {START} + 3600 - ((doc_id * 53) % 101) * 120").alias("decided_at"),
            F.col("doc_id").alias("entry_ord"),
            F.expr("case doc_id % 3 when 0 then 'pass' when 1 then 'block' else 'review' end").alias(
                "decision"
            ),
            F.expr("((doc_id * 37) % 101) / 100.0D").alias("confidence"),
            F.concat(F.lit("earlier "), F.col("lang")).alias("reason"),
            F.expr("case when doc_id % 2 = 0 then 'L2_bert' else 'L3_llm' end").alias("tier"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.content.select("content_id", content_key(F.col("text")).alias("key"), "ts")

    @cached_property
    def images(self) -> DataFrame:
        """Every embedding read as an 8 x 8 grey image, with its 56-bit hash."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("image_id"),
            "label",
            dhash(F.col("embedding"), 8, 8).alias("image_hash"),
        )

    @cached_property
    def known_hashes(self) -> DataFrame:
        """The images of label 0 as the known harmful ones."""
        return self.images.where(F.col("label") == 0).select(
            F.col("image_hash").alias("known_hash"),
            F.col("image_id").alias("known_ord"),
            F.concat(F.lit("category_"), (F.col("image_id") % 3).cast("string")).alias("category"),
        )

    @cached_property
    def large_dictionary(self) -> KeywordDictionary:
        """A dictionary of 2,000 words: those of the documents that come first by their MD5."""
        words = self.table("documents").select(
            F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,8}"), 0)).alias("w")
        )
        some = words.distinct().orderBy(F.md5(F.col("w").cast("binary"))).limit(2000).collect()
        labels = ["politics", "violence", "porn", "gambling", "toxic"]
        return KeywordDictionary({c: [r["w"] for r in some[i::5]] for i, c in enumerate(labels)}, (), ())

    @cached_property
    def vectors(self) -> DataFrame:
        """Every embedding with a decision, as semantic reuse entries."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("entry_id"),
            "embedding",
            F.expr("case when label < 5 then 'pass' else 'block' end").alias("decision"),
            F.expr("0.5D + label / 20.0D").alias("confidence"),
            F.concat(F.lit("like label "), F.col("label").cast("string")).alias("reason"),
            F.lit("L2_bert").alias("tier"),
        )

    @cached_property
    def gateway_texts(self) -> DataFrame:
        """Content with blank texts and images, without what is made of vectors."""
        image = F.expr("content_id % 3 = 0")
        return self.content.select(
            "content_id",
            F.expr("case when content_id % 50 = 7 then ' ' else text end").alias("text"),
            "source",
            "ts",
            F.when(image, F.concat(F.lit("http://img/"), F.col("source"))).alias("image_url"),
            F.when(
                image, image_ref_key(F.concat(F.lit("http://img/"), F.col("source")), F.lit(""))
            ).alias("image_ref"),
        )

    @cached_property
    def gateway_vectors(self) -> DataFrame:
        """The embeddings by the content of their id, and the hashes of its images."""
        vectors = self.table("embeddings").select(F.col("vec_id").alias("content_id"), "embedding")
        hashed = F.when(F.expr("content_id % 3 = 0"), dhash(F.col("embedding"), 8, 8))
        return vectors.select("content_id", hashed.alias("image_hash"), "embedding")

    @cached_property
    def gateway_content(self) -> DataFrame:
        """Content with blank texts, images and vectors: documents and the embedding of their id."""
        return self.gateway_texts.join(self.gateway_vectors, "content_id", "left")

    @cached_property
    def image_hash_store(self) -> DataFrame:
        """Decisions on images of label 1, by hash."""
        images = self.images.where(F.col("label") == 1)
        return images.groupBy("image_hash").agg(F.min("image_id").alias("image_id")).select(
            "image_hash",
            F.lit("review").alias("decision"),
            F.lit(0.6).alias("confidence"),
            F.concat(F.lit("seen as image "), F.col("image_id").cast("string")).alias("reason"),
            F.lit("image_agent").alias("tier"),
        )

    @cached_property
    def image_ref_store(self) -> DataFrame:
        """Decisions on the image references of English content, by reference."""
        english = self.table("documents").where(F.col("lang") == "en")
        url = F.concat(F.lit("http://img/"), F.col("source"))
        return english.groupBy("source").agg(F.min("doc_id").alias("doc_id")).where(
            F.col("source") < "src2"
        ).select(
            image_ref_key(url, F.lit("")).alias("image_ref"),
            F.lit("pass").alias("decision"),
            F.lit(0.9).alias("confidence"),
            F.lit("reference seen").alias("reason"),
            F.lit("image_agent").alias("tier"),
        )

    @cached_property
    def mod_events(self) -> DataFrame:
        """AI events: one per document."""
        return self.text_table("documents").selectExpr(
            "doc_id as event_id",
            "doc_id as content_id",
            "text",
            "source",
            f"doc_id * 120 + {START} as ts",
            "case (doc_id * 13) % 4 when 0 then 'pass' when 1 then 'block' when 2 then 'review' "
            "else 'block' end as decision",
            "((doc_id * 37) % 101) / 100.0D as confidence",
            "case doc_id % 5 when 0 then 'L3_llm' when 1 then 'L2_bert' when 2 then 'L1_keyword' "
            "when 3 then 'cache' else 'L3_llm' end as tier",
            "concat('uses ''', source, ''' with \"', lang, '\" and ''idiot'' or ''x''') as reason",
            "'ai' as source_label",
            "case when doc_id % 5 in (0, 4) then 'L3_llm' else 'L2_bert' end as text_tier",
            "case when (doc_id * 7) % 3 = 0 then 'unsafe' else 'safe' end as text_label",
            "case when doc_id % 11 = 0 then null when doc_id % 2 = 0 then 'unsafe' else 'safe' end "
            "as bert_preliminary",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """Documents whose first score lies in the grey zone, as review records."""
        grey = self.signals.where(F.col("score_confidence").between(0.3, 0.7)).select(
            "content_id", "score_confidence"
        )
        return self.content.join(grey, "content_id").selectExpr(
            "concat('rev', cast(content_id as string)) as review_id",
            "content_id",
            "text",
            "case content_id % 3 when 0 then 'pending' when 1 then 'reviewed' else 'dismissed' end "
            "as status",
            "ts as enqueued_at",
            "((content_id * 17) % 101) / 100.0D as priority",
            "case content_id % 4 when 0 then 'review' when 1 then 'block' when 2 then 'pass' "
            "else 'block' end as ai_decision",
            "score_confidence as ai_confidence",
            "'grey zone' as ai_reason",
            "case when content_id % 3 = 1 then case when content_id % 5 < 2 then 'pass' "
            "else 'block' end end as human_decision",
            "case when content_id % 3 = 1 then concat('checked, says \"abuse of ', source, '\"') end "
            "as human_reason",
            "case when content_id % 3 = 1 then concat('mod', source) end as reviewed_by",
        )

    @cached_property
    def resolutions(self) -> DataFrame:
        """A resolution per document: some for unknown reviews, some with a bad decision."""
        return self.table("documents").selectExpr(
            "concat('rev', cast(doc_id as string)) as review_id",
            "case doc_id % 5 when 0 then 'pass' when 1 then 'block' when 2 then 'maybe' "
            "when 3 then 'block' else 'pass' end as human_decision",
            "concat('mod', source) as reviewer",
            "concat('because ', lang) as reason",
            f"doc_id * 120 + {START} + 86400 as resolved_at",
        )

    @cached_property
    def eval_cases(self) -> DataFrame:
        labels = self.table("labels").selectExpr(
            "doc_id as content_id",
            "case when toxic = 1 then 'unsafe' else 'safe' end as expected",
            "quality",
        )
        return self.content.join(labels, "content_id")

    @cached_property
    def results(self) -> DataFrame:
        """Eval cases with a decision, tier, path and latency by formula."""
        return self.eval_cases.selectExpr(
            "content_id",
            "text",
            "lang",
            "source",
            "quality",
            "expected",
            "case when (expected = 'unsafe') = (content_id % 5 <> 0) "
            "then case when content_id % 2 = 0 then 'block' else 'review' end "
            "else 'pass' end as decision",
            "((content_id * 37) % 101) / 100.0D as confidence",
            "element_at(array('L0_memory', 'L1_keyword', 'L2_bert', 'L3_llm', 'L0_whitelist', "
            "'L1_chroma', 'L2_bert', 'human_review'), cast((content_id * 5) % 8 + 1 as int)) as tier",
            "case when (content_id * 5) % 8 in (0, 1, 4, 5) then 'hot' else 'cold' end as path",
            "((content_id * 97) % 2000) / 4.0D as latency_ms",
            "concat('because of ', lang) as reason",
        )

    @cached_property
    def daily_history(self) -> DataFrame:
        """Accuracy per day: the share of events that are not errors."""
        from tideguard.operators.monitoring import daily_accuracy

        return daily_accuracy(self.table("events"), "ts", F.col("event_type") == "error")
