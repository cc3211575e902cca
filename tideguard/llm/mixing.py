"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled and queued; a document's virtual finish time is the words
its source has sent up to its end divided by the source's target. Sorted by that time over all
sources and cut where the total budget is used up, every source ends near its target. A source
whose target exceeds its size queues its documents a second time after the first round.

Defined cases: a null text has size 0; documents of size 0 are never taken. A null source is a
source of its own, last in order. Equal rows are queued one after the other; ties go by hash,
document number, size and round. An empty table gives an empty result. Further columns
are kept by `mixture`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideguard.llm.common import hash_range, place_of, running_totals, shuffled_order, text_of, words_of, wrapped
from tideguard.session import materialise

# Rows of a source that one window task sorts, on average.
BLOCK_ROWS = 2_000
# Steps of virtual time in which words are counted before the cut is looked for within one.
TICKS = 4_096
ROUNDS = 2
# A tick with at most so many rows is sorted.
SORTED_ROWS = 10_000


def targets(sizes: DataFrame, weights: list[int], share: float) -> DataFrame:
    """(source, source_size, target) for `sizes(source, source_size)`.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all words.
    A target stops at ROUNDS times its source's size and the excess goes to the others by
    weight, until none is above: the level at which that holds is found by going through the
    sources by size per weight. One row per source passes through the window, not the documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(in_order) - 1
    ranked = sizes.withColumn("_place", place).withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights)) + 1)
    )
    by_need = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("_cap", F.col("source_size") * ROUNDS)
        .withColumn("_budget", F.sum("source_size").over(all_rows) * F.lit(share))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.sum("_weight").over(after))
        # The first source that its cap does not stop sets the level for all after it.
        .withColumn("_free", F.col("_level") * F.col("_weight") < F.col("_cap"))
        .withColumn("_at", F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_weight"), "_place", "_level"))).over(all_rows))
    )
    share_of = F.col("_at._level") * F.col("_weight")
    target = F.when(F.col("_at").isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), share_of)
    )
    return levels.select("source", "source_size", target.alias("target"))


def fair_mix(rows: DataFrame, weights: list[int], share: float, seed: int = 0) -> DataFrame:
    """`rows(doc, doc_id, source, size)` with source_size, target and `copies` (0, 1 or 2).

    The words of a source before a document come from sums per block of hash order, the cut from
    sums per tick of virtual time, in ever finer ticks; only the rows of the last tick are sorted.
    """
    rows = rows.withColumn("_h", shuffled_order(F.col("doc_id"), seed))
    sums = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")
    )
    sums = materialise(sums, "source-sizes")
    shares = targets(sums.select("source", "source_size"), weights, share)
    total = sums.agg(F.sum("source_size"), F.max("_rows")).first()
    blocks = max(1, (total[1] or 0) // BLOCK_ROWS)
    rows = rows.withColumn("_block", hash_range(F.col("_h"), blocks))
    rows = running_totals(rows, ["source"], "_block", ["_h", "doc_id", "size"], {"_before": "size"})
    named = shares.withColumnRenamed("source", "_source")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_block")
    rows = materialise(rows, "mix-queue")
    left_out = _first_left_out(rows, (total[0] or 0) * share)
    within = [F.lit(True)] * ROUNDS
    if left_out is not None:
        types = dict(rows.select(_turn(0).alias("t")).select("t.*").dtypes)
        edge = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in left_out.asDict().items()])
        within = [_turn(r) < edge for r in range(ROUNDS)]
    copies = F.when(F.col("size") > 0, sum(w.cast("int") for w in within)).otherwise(0)
    return rows.withColumn("copies", copies).drop("_h", "_before")


def _turn(turn: int) -> Column:
    """Where a document's copy of this round stands in the queue of all sources."""
    sent = turn * F.col("source_size") + F.col("_before") + F.col("size")
    return F.struct(
        (sent / F.col("target")).alias("finish"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("_h").alias("h"),
        F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"),
        F.col("size").cast("long").alias("size"),
        F.col("_before").cast("long").alias("before"),
        F.lit(turn).alias("turn"),
    )


def _first_left_out(rows: DataFrame, budget: float):
    """The queue's first copy that the budget does not cover; None if it covers all."""
    turns = F.explode(F.array(*[_turn(r) for r in range(ROUNDS)]))
    inside = rows.where(F.col("size") > 0).select(turns.alias("t")).select("t.*")
    place = F.struct(*inside.columns)
    low, high, so_far = 0.0, float(2 * ROUNDS), 0
    while True:
        step = (high - low) / TICKS
        tick = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(step)), F.lit(TICKS))
        ticks = inside.groupBy(tick.alias("tick")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
        )
        till = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("words").over(till), F.lit(0)) + so_far
        over = ticks.withColumn("till", before).where(F.col("till") + F.col("words") > budget)
        edge = over.orderBy("tick").first()
        if edge is None:
            return None
        inside, so_far = inside.where(tick == edge["tick"]), edge["till"]
        finer = low + edge["tick"] * step
        if edge["n"] <= SORTED_ROWS or edge["tick"] == TICKS or finer + step == finer:
            break
        low, high = finer, finer + step
    used = F.sum("size").over(Window.orderBy(*inside.columns)) + so_far
    return inside.withColumn("used", used).where(F.col("used") > budget).agg(F.min(place)).first()[0]


def _sized(doc: Column) -> list[Column]:
    size = F.size(words_of(text_of())).cast("long")
    return [doc.alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size.alias("size")]


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5) -> DataFrame:
    """doc_id, size, source_size, target and words taken of every document."""
    rows = materialise(docs.select(*_sized(F.struct("doc_id"))), "mix-sizes")
    return fair_mix(rows, list(weights), share).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixture(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5) -> DataFrame:
    """`docs` as mixed: every document as many times as it is taken.

    The queue holds places of rows, not texts. `docs` is read twice and must be a stored Parquet
    table.
    """
    row = place_of(docs).alias("row")
    numbered = materialise(docs.select(*_sized(F.struct(row))), "mix-sizes")
    taken = fair_mix(numbered, list(weights), share).where("copies > 0").select(F.col("doc.row").alias("of_row"), "copies")
    mixed = wrapped(docs, row).join(taken, F.col("row") == F.col("of_row"))
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return mixed.select("doc", times.alias("time")).select("doc.*")
