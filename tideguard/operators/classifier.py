"""Distributed text features and the linear classifier behind the L2 tier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.functions.text import blank, content_key
from tideguard.operators.skew import salted_join

# --- fixed values -------------------------------------------------------------------
MIN_TRAINING_ROWS = 100
EMBEDDING_SIZE = 512
# --- end of fixed values ------------------------------------------------------------


def split(samples: DataFrame, key: str = "text") -> DataFrame:
    """Adds `part`: train for nine tenths, test for the rest, by a hash of the key.

    Copies of a text always land in the same part.
    """
    tenth = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(10))
    return samples.withColumn("part", F.when(tenth == 0, "test").otherwise("train"))


def readiness(samples: DataFrame) -> DataFrame:
    """One row: samples, safe and unsafe count, whether there are enough to train."""
    total = F.count(F.lit(1))
    return samples.agg(
        total.alias("samples"),
        F.count(F.when(F.col("label") == 0, 1)).alias("safe_count"),
        F.count(F.when(F.col("label") == 1, 1)).alias("unsafe_count"),
        (total >= MIN_TRAINING_ROWS).alias("ready"),
    )


def train(samples: DataFrame, features: int = 1 << 16) -> PipelineModel:
    """Fits words -> hashed tf-idf -> logistic regression on (text, label)."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="label", regParam=0.01, maxIter=20,
            probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
        ),
    ]
    return Pipeline(stages=stages).fit(samples.select("text", F.col("label").cast("double")))


def score(model: PipelineModel, content: DataFrame) -> DataFrame:
    """Adds score_label and score_confidence; blank text is safe for certain."""
    unsafe = vector_to_array(F.col("_probability"))[1]
    scored = model.transform(content).withColumn("_p", unsafe)
    empty = blank(F.col("text"))
    label = F.when(~empty & (F.col("_p") > 0.5), "unsafe").otherwise("safe")
    confidence = F.when(empty, 1.0).otherwise(F.greatest(F.col("_p"), 1.0 - F.col("_p")))
    return scored.select(
        *content.columns,
        label.alias("score_label"),
        F.round(confidence, 4).alias("score_confidence"),
    )


def embed(
    content: DataFrame, id_column: str = "content_id", size: int = EMBEDDING_SIZE, n: int = 3
) -> DataFrame:
    """(id, embedding): unit vectors of hashed character n-grams over the whole text.

    Each distinct text is embedded once; blank texts get the zero vector. A text of fewer than `n`
    characters is one gram.
    """
    keyed = content.select(
        id_column, F.coalesce("text", F.lit("")).alias("text"), 
    ).withColumn("key", content_key(F.col("text")))
    distinct = keyed.groupBy("key").agg(F.min("text").alias("text"))
    chars = F.when(blank(F.col("text")), F.array().cast("array<string>")).otherwise(
        F.split(F.lower("text"), "")
    )
    grams = NGram(n=n, inputCol="_chars", outputCol="_grams").transform(
        distinct.withColumn("_chars", chars)
    )
    short = F.array(F.array_join("_chars", ""))
    grams = grams.withColumn("_grams", F.when(F.size("_chars").between(1, n - 1), short).otherwise(F.col("_grams")))
    counted = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=size).transform(grams)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    vectors = unit.select("key", vector_to_array("_unit", "float32").alias("embedding"))
    return salted_join(keyed.select(id_column, "key"), vectors, ["key"], F.col(id_column)).select(
        id_column, "embedding"
    )
