"""Helpers of the corpus operators: tables, words, prefix sums and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideguard.session import materialise

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words (runs of characters that are not ASCII white space) as an array; none: empty."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def wrapped(docs: DataFrame, *columns: Column) -> DataFrame:
    """`doc`, the whole row, beside working columns: no name of the input can clash with theirs."""
    return docs.select(F.struct("*").alias("doc"), *columns)


def place_of(docs: DataFrame) -> Column:
    """Which row of a stored Parquet table a row is: its file and its number in that file.

    Unlike a number by partition, it stays the same when the table is read again, also after
    executors were lost or gained and Spark cuts the files into other splits.
    """
    meta = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))


def running_totals(rows: DataFrame, group: list[str], block: str, order: list, totals: dict):
    """Adds, or replaces, each `out` of `totals {out: value column}`: the sum over the group's rows before.

    Rows are ordered by (`block`, `order`). Sums per (group, block) are added up first, so no
    task sorts more than one block of rows, whatever the size of the group.
    """
    rows = rows.drop(*totals)
    keys = [*group, block]
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(*[F.sum(v).alias(f"_sum_{o}") for o, v in totals.items()])
    starts = sums.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)],
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_start_{o}") for o in totals],
    )
    # Written, so that Spark knows how small it is and need not move the rows a second time.
    starts = materialise(starts, "block-starts")
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.select(
        "*", *[F.coalesce(F.sum(v).over(here), F.lit(0)).alias(f"_here_{o}") for o, v in totals.items()]
    )
    on = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)]
    return inner.join(starts, on).select(
        *rows.columns, *[(F.col(f"_start_{o}") + F.col(f"_here_{o}")).alias(o) for o in totals]
    )


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str = "numbered") -> DataFrame:
    """`rows` with `idx`, the number from 0 within the group by `order`, and `n`, the group's rows.

    `rows` must be a stored table: rows equal in `order` are told apart by their places, so that
    no range of rows is too large for its task. The sorted rows are written; what is joined to
    them has one row per group and range. Groups must not be null.
    """
    keys = [*groups, *order]
    placed = rows.withColumn("_place", place_of(rows))
    ranges = placed.repartitionByRange(*keys, "_place").sortWithinPartitions(*keys, "_place")
    ranges = ranges.drop("_place").withColumn("_at", F.monotonically_increasing_id())
    ranges = materialise(ranges, name).withColumn("_range", F.shiftright("_at", 33))
    ends = ranges.groupBy(*groups, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(
        *groups, "_range", "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("n"),
    )
    starts = materialise(starts, f"{name}-starts")
    idx = F.col("_at") - F.col("_first") + F.col("_before")
    return ranges.join(starts, [*groups, "_range"]).withColumn("idx", idx).drop(
        "_at", "_range", "_first", "_before"
    )


def shuffled_order(key: Column, seed: int = 0) -> Column:
    """60 bits of a hash of the key, the same in every engine that has MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_range(order: Column, parts: int) -> Column:
    """Which of `parts` equal ranges of `shuffled_order` a value falls in."""
    return F.floor(order / F.lit(((1 << 60) // parts) + 1))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; component: its smallest node.

    Alternates two contractions until nothing changes: every node hands its larger neighbours
    to the smallest node it knows, then its smaller ones. Edges stay at most as many as at the
    start and the number of rounds grows with the logarithm of the longest chain. Minima are
    pre-aggregated and joined back, so that a node with very many edges is spread by Spark's
    skew join. Each round is written to the shared folder.
    """
    now = materialise(_ordered(edges), name)
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _ordered(_contract(both, "a", "b").where("b > least(a, m)").select("b", "m"))
        now = materialise(_ordered(_small(large)), name)
        after = _signature(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    tops = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.unionByName(tops)


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with the smaller node as `a`."""
    first, second = edges.columns
    return (
        edges.where(F.col(first) != F.col(second))
        .select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
        .distinct()
    )


def _contract(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """Every pair with `m`, the smallest of the key and what it is paired with."""
    least = pairs.groupBy(key).agg(F.least(F.min(other), F.first(key)).alias("m"))
    return pairs.join(least, key)


def _small(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node itself, tied to the smallest of them."""
    tied = _contract(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "u", "v")
    return tied.select("v", "m").unionByName(
        tied.select(F.col("u").alias("v"), "m").distinct()
    )


def _signature(edges: DataFrame):
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)).alias("x"),
    ).first()
    return row["n"], row["x"]
