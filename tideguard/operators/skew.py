"""Joins and ranks that hold when one key has a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than
# HOT_SHARE hot keys whatever the data: their table may always be broadcast.
HOT_SHARE = 200
SALTS = 64


def rows_of(items: Column) -> Column:
    """One row per array element; follow with `where(element is not null)` if arrays may be empty.

    Spark turns `explode` of a computed array into a filter on its size and pushes that down,
    which computes the array twice. The outer form is not rewritten.
    """
    return F.explode_outer(items)


def fits_broadcast(df: DataFrame, expansion: int = 1) -> bool:
    """True if `df` is small enough to broadcast by Spark's size estimate.

    The estimate errs upwards except for exploded arrays, which it does not count:
    `expansion` is the number of rows one row became.
    """
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) * expansion <= _bytes(limit)


def _bytes(setting: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = setting.lower().removesuffix("b") or "0"
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than 1/share of the rows (fewer than `share` of them by definition)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.where(F.col("_n") * share > total.scalar()).select(
        *keys, F.lit(True).alias("_hot")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "left",
    salts: int = SALTS,
    hot_from: DataFrame | None = None,
    expansion: int = 1,
) -> DataFrame:
    """Equi join in which a hot key of `left` is spread over `salts` tasks.

    A `right` that Spark may broadcast by its size estimate is joined plainly: no row of
    `left` moves, so no key can be hot. Otherwise hot keys are counted and salted.
    `spread` must differ between the rows of one key (a row id); the few rows of `right`
    with a hot key are repeated once per salt. Null keys match nothing and are spread too.
    `how` is "left" or "inner". `hot_from` is the frame whose keys are counted, where that
    is cheaper than `left` itself: the frame a chain of joins starts from. `expansion`: see
    `fits_broadcast`.
    """
    if how not in ("left", "inner"):
        raise ValueError("salted_join supports left and inner joins")
    if fits_broadcast(right, expansion):
        return left.join(right, keys, how)
    counted = (left if hot_from is None else hot_from).select(*keys).dropna()
    hot = F.broadcast(hot_keys(counted, keys))
    anywhere = F.pmod(F.xxhash64(spread), F.lit(salts))
    loose = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]) | F.col("_hot")
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(loose, anywhere).otherwise(0).cast("int")
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    # "merge" keeps Spark from broadcasting by an estimate that has just been overruled.
    return (
        salted_left.drop("_hot")
        .join(salted_right.hint("merge"), [*keys, "_salt"], how)
        .drop("_salt")
    )


def first_rows(
    df: DataFrame, groups: list[str], order: list[Column], limit: Column, bucket: Column
) -> DataFrame:
    """The first `limit` rows of every group, for limits of any size.

    `bucket` is a coarse, monotone image of the order (for a hash order, its leading
    digits). Counting rows per bucket shows which buckets are kept whole; only the rows of
    the single bucket where the limit falls are ranked, so no group is sorted in one task.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_limit", limit.cast("long"))
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    running = Window.partitionBy(*groups).orderBy("_bucket")
    edges = sizes.select(
        *groups,
        "_bucket",
        (F.sum("_size").over(running) - F.col("_size")).alias("_before"),
        F.col("_size"),
    )
    placed = rows.join(edges, [*groups, "_bucket"])
    whole = placed.where(F.col("_before") + F.col("_size") <= F.col("_limit"))
    split = placed.where(
        (F.col("_before") < F.col("_limit"))
        & (F.col("_before") + F.col("_size") > F.col("_limit"))
    )
    rank = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(*order))
    cut = split.withColumn("_rank", rank).where(F.col("_before") + F.col("_rank") <= F.col("_limit"))
    helper = ["_bucket", "_limit", "_before", "_size"]
    return whole.drop(*helper).unionByName(cut.drop("_rank", *helper))
