"""Exact top-k search by inner product with segment statistics at several resolutions.

A vector is cut into segments; of each its mean and the deviation around it are kept, at a coarse
and at finer resolutions. Over one segment of s components the product of two vectors is at most
s * mean * mean + deviation * deviation (Cauchy-Schwarz on what is left around the means), which
is the same as a lower bound of their distance. Summed over the segments it bounds the score from
above, the finer the closer.

1. Rows are ordered by a word of bits: whether each coarse segment's mean is high, then each finer
   one's. Stretches of BLOCK rows in that order are blocks of similar vectors, however many equal
   ones there are. A block scores its own queries, which gives each a score it must beat, and puts out
   the largest and smallest means and the largest deviation of every segment: its envelope.
2. Queries, in the same order and in chunks of CHUNK, meet the envelopes only, coarse to fine;
   the blocks that may hold a better score are named.
3. A named block and the queries of a chunk that named it are brought together. Statistics, coarse
   to fine, leave few rows, and only those are compared by their components. The k best per block
   are ranked, those per query again; Spark cuts such ranks before it moves the rows.

No pair of a query and a row is a row of any table. Blocks, chunks and matrices have fixed sizes.

Defined cases: vectors that are null or hold null or non-finite components take no part; an empty
vector is all zeros, and a shorter vector is filled with zeros. Rows with equal ids are different
rows: each is a candidate for the other, and each asks its own query. A null id asks no query
and loses all ties. Scores are whole numbers, taken in double precision while that is exact and in
Python's integers beyond; one that does not fit a long ends at its limits. An empty table gives an empty
result. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideguard.llm.common import numbered
from tideguard.session import materialise

BLOCK = 2048
CHUNK = 4096
# Queries compared at once: bounds the matrices.
SLICE = 256
RESOLUTIONS = (4, 16)
# Envelopes that meet a chunk of queries at once.
PAGE = 1 << 14
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component, as doubles that are whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))


@cache
def _edges(width: int, parts: int) -> np.ndarray:
    return np.linspace(0, width, min(parts, max(width, 1)) + 1).astype(int)


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def statistics(rows: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean * sqrt(s), deviation) of each segment: their products are a segment's two terms."""
    edges = _edges(rows.shape[1], parts)
    size = np.diff(edges)
    means = np.add.reduceat(rows, edges[:-1], axis=1) / size if rows.shape[1] else np.zeros((len(rows), 1))
    if not rows.shape[1]:
        return means, means
    spread = rows - np.repeat(means, size, axis=1)
    return means * np.sqrt(size), np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1))


def _bounds(queries: np.ndarray, rows: np.ndarray, parts: int, reach: np.ndarray) -> np.ndarray:
    """Upper bounds of all scores; `reach`: |query| * |row|, of which rounding takes its share."""
    (qm, qd), (rm, rd) = statistics(queries, parts), statistics(rows, parts)
    return qm @ rm.T + qd @ rd.T + 1e-9 * reach + 1e-6


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = max((np.abs(m).max(initial=0.0) for m in (queries, rows)))
    if most * most * queries.shape[1] < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (queries, rows)]
    return np.clip(whole[0] @ whole[1].T, -LONG, LONG).astype(np.int64)


def best_rows(
    queries: np.ndarray, asked: np.ndarray, floor: np.ndarray, rows: np.ndarray, ids: np.ndarray, names: np.ndarray, k: int
):
    """(query number, row number, score) of each query's k best rows that reach its floor.

    Ties go to smaller ids. `asked` and `names` are the places of queries and rows: a query is
    not compared with its own row. Rows whose bound is below the floor at any resolution are left out.
    """
    by_id = np.argsort(ids, kind="stable")
    rows, names = rows[by_id], names[by_id]
    lengths = np.sqrt((rows * rows).sum(axis=1))
    out = []
    for start in range(0, len(queries), SLICE):
        some, mine, least = (x[start : start + SLICE] for x in (queries, asked, floor))
        reach = np.sqrt((some * some).sum(axis=1))
        left = np.arange(len(rows))
        for parts in RESOLUTIONS:
            bound = _bounds(some, rows[left], parts, reach[:, None] * lengths[left][None, :])
            left = left[(bound >= least[:, None]).any(axis=0)]
        if not len(left):
            continue
        score = scores(some, rows[left])
        allowed = (score >= least[:, None]) & (mine[:, None] != names[left][None, :])
        for i in range(len(some)):
            at = _first(score[i], np.flatnonzero(allowed[i]), k)
            out.append((np.full(len(at), start + i), by_id[left[at]], score[i, at]))
    if not out:
        return tuple(np.empty(0, "int64") for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of `at` with the greatest score, ties by position (rows are in order of their ids)."""
    if len(at) > k:
        edge = np.partition(score[at], len(at) - k)[len(at) - k]
        above, equal = at[score[at] > edge], at[score[at] == edge]
        at = np.concatenate([above, equal[: k - len(above)]])
    return at[np.lexsort((at, -score[at]))]


ROW = "row long, query_id long, id long, named boolean, score long"


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.hstack(parts)


def envelope(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest mean and greatest deviation of each segment at all resolutions."""
    found = [statistics(rows, parts) for parts in RESOLUTIONS]
    means, spreads = (_flat([f[i] for f in found]) for i in (0, 1))
    return means.min(axis=0), means.max(axis=0), spreads.max(axis=0)


def reaching(queries: np.ndarray, floor: np.ndarray, low: np.ndarray, high: np.ndarray, spread: np.ndarray, longest: np.ndarray):
    """(query, block) numbers where the block's envelope allows a score of at least the floor."""
    q, b = np.arange(len(queries)), np.arange(len(low))
    allowed = np.ones((len(q), len(b)), dtype=bool)
    slack = 1e-9 * np.sqrt((queries * queries).sum(axis=1))[:, None] * longest[None, :] + 1e-6
    start = 0
    for parts in RESOLUTIONS:
        means, deviations = statistics(queries, parts)
        at = slice(start, start + means.shape[1])
        start = at.stop
        # Blocks that a coarser resolution has ruled out for all queries are not looked at again.
        left = np.flatnonzero(allowed.any(axis=0))
        bound = (
            np.maximum(means, 0) @ high[left, at].T
            + np.minimum(means, 0) @ low[left, at].T
            + deviations @ spread[left, at].T
        )
        allowed[:, left] &= bound + slack[:, left] >= floor[:, None]
    return np.nonzero(allowed)


def nearest_rows(vectors: DataFrame, asks: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `asks`, the k rows of greatest score.

    `vectors`: a stored table of vec_id (long) and v, an array of whole numbers as doubles.
    """
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0

    @F.pandas_udf("binary")
    def word(batch: pd.Series) -> pd.Series:
        means = [statistics(matrix(batch.tolist(), width), parts)[0] for parts in RESOLUTIONS]
        return pd.Series([np.packbits(bits).tobytes() for bits in _flat(means) > 0], dtype=object)

    worded = vectors.select(
        # A null id goes after all others.
        F.coalesce("vec_id", F.lit(LONG)).alias("id"), F.col("vec_id").isNotNull().alias("named"),
        "v", F.coalesce(asks & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks"), word("v").alias("word"),
    )
    rows = numbered(materialise(worded, "topk-words"), [], ["word"], "topk-order").drop("word", "n")
    rows = materialise(
        rows.withColumnRenamed("idx", "row").withColumn("block", F.expr(f"row div {BLOCK}")), "topk-rows"
    )

    def own(block: pd.DataFrame) -> pd.DataFrame:
        asking = block[block["asks"]]
        floor = np.full(len(asking), -np.inf)
        return _best(asking, floor, block, width, k)

    def shape_of(block: pd.DataFrame) -> pd.DataFrame:
        data = matrix(block["v"].tolist(), width)
        low, high, spread = envelope(data)
        longest = np.sqrt((data * data).sum(axis=1)).max()
        return pd.DataFrame({
            "block": [block["block"].iloc[0]], "low": [low], "high": [high], "spread": [spread], "longest": [longest],
        })

    first = materialise(rows.groupBy("block").applyInPandas(own, ROW), "topk-first")
    schema = "block long, low array<double>, high array<double>, spread array<double>, longest double"
    envelopes = materialise(rows.groupBy("block").applyInPandas(shape_of, schema), "topk-envelopes")
    reached = first.groupBy("row").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least"))
    asked = rows.where("asks").join(reached, "row", "left").select(
        "row", F.col("id").alias("query_id"), "v", "block",
        F.when(F.col("_n") == k, F.col("_least").cast("double")).alias("floor"),
    )
    asked = materialise(asked, "topk-asked")
    queries = numbered(asked, [], ["row"], "topk-queries").drop("n")
    queries = materialise(queries.withColumn("chunk", F.expr(f"idx div {CHUNK}")).drop("idx"), "topk-chunks")
    chunks = queries.agg(F.max("chunk")).first()[0] or 0
    pages = (envelopes.agg(F.max("block")).first()[0] or 0) // PAGE
    shown = envelopes.withColumn("page", F.expr(f"block div {PAGE}")).withColumn(
        "chunk", F.explode(F.expr(f"sequence(0L, {chunks}L)"))
    )
    asking = queries.withColumn("page", F.explode(F.expr(f"sequence(0L, {pages}L)")))

    def named(some: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = {"block": [], "chunk": [], "row": []}
        if len(some) and len(blocks):
            low, high, spread = (np.stack(blocks[c].tolist()) for c in ("low", "high", "spread"))
            names, longest = blocks["block"].to_numpy(), blocks["longest"].to_numpy()
            for start in range(0, len(some), SLICE):
                part = some.iloc[start : start + SLICE]
                floor = part["floor"].fillna(-np.inf).to_numpy()
                q, b = reaching(matrix(part["v"].tolist(), width), floor, low, high, spread, longest)
                other = part["block"].to_numpy()[q] != names[b]
                out["block"].extend(names[b][other])
                out["chunk"].extend(part["chunk"].to_numpy()[q][other])
                out["row"].extend(part["row"].to_numpy()[q][other])
        return pd.DataFrame(out)

    keys = ["chunk", "page"]
    reach = asking.groupBy(*keys).cogroup(shown.groupBy(*keys)).applyInPandas(
        named, "block long, chunk long, row long"
    )
    reach = materialise(reach, "topk-reach")
    sent = reach.join(queries.drop("chunk", "block"), "row")
    pairs = reach.select("block", F.col("chunk").alias("to_chunk")).distinct()
    copied = rows.drop("asks").join(pairs, "block")

    def better(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        floor = some["floor"].fillna(-np.inf).to_numpy()
        return _best(some.rename(columns={"query_id": "id"}), floor, block, width, k)

    later = sent.groupBy("block", "chunk").cogroup(copied.groupBy("block", "to_chunk")).applyInPandas(better, ROW)
    place = F.row_number().over(
        Window.partitionBy("row").orderBy(F.desc("score"), "id", F.desc("named"))
    )
    ranked = first.unionByName(later).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select(
        "query_id", "rank", F.when(F.col("named"), F.col("id")).alias("vec_id"), "score"
    )


def _best(asking: pd.DataFrame, floor: np.ndarray, block: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """The k best rows of a block for each of `asking`, as rows of ROW."""
    ids, names = block["id"].to_numpy(), block["row"].to_numpy()
    own = asking["row"].to_numpy()
    data = matrix(block["v"].tolist(), width)
    q, r, score = best_rows(matrix(asking["v"].tolist(), width), own, floor, data, ids, names, k)
    return pd.DataFrame({
        "row": own[q], "query_id": asking["id"].to_numpy()[q], "id": ids[r],
        "named": block["named"].to_numpy()[r], "score": score,
    })


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = 20, factor: int = 64) -> DataFrame:
    """`nearest_rows` of embeddings scaled to whole numbers; rows whose vec_id `every` divides ask."""
    whole = vectors.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), factor).alias("v")
    )
    return nearest_rows(whole, F.col("vec_id") % every == 0, k)
