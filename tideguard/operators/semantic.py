"""Semantic reuse: the nearest stored vector above a similarity threshold.

Exact, and without comparing everything to everything. Stored vectors lie in cells: each goes to
the nearest of up to TOP_PIVOTS pivots and, in stores that need more cells, to the nearest of that
pivot's own ones, so cells keep about `cell_rows` vectors whatever the store holds.

A query first asks the cell it would lie in itself. What it finds there, or else the threshold,
is the radius within which a better match can only lie. A cell may hold one if the ball of that
radius reaches over the planes that part its pivot from the others (the hyperplane bound), and
into the ring between its nearest and its furthest vector. Only (query, cell) pairs that pass
both are compared. A query is sent once to each bundle of BUNDLE cells, with a bit for each cell of
the bundle that it asks: without spread, where queries reach most cells, vectors move per bundle
and not per cell. A block task multiplies matrices cell by cell and returns the best match per query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.config import SIMILARITY_THRESHOLD
from tideguard.operators.skew import rows_of, salted_join
from tideguard.session import materialise

# Vectors per cell, pivots per level: two levels hold TOP_PIVOTS * SUB_PIVOTS cells.
CELL_ROWS = 4096
TOP_PIVOTS = 512
SUB_PIVOTS = 512
BLOCK_ROWS = 8192
# Cells that a query is sent to at once; SUB_PIVOTS is a multiple of it.
BUNDLE = 8
# As many blocks of a bundle's rows meet in a task.
BLOCKS_TOGETHER = 4
# Of a query's pivots this many of the nearest are held against every cell.
RIVALS = 4
SLACK = 1e-6
CELL = ["cell", "sub"]


@dataclass(frozen=True)
class VectorIndex:
    """Stored vectors in their cells.

    `entries`: entry_id, vector, cell, sub. `pivots` and `rings` (nearest, furthest vector) of
    the top level, at most TOP_PIVOTS of each. `subs`: cell, sub, pivot, near, far; null if one
    level is enough.
    """

    entries: DataFrame
    pivots: list[list[float]]
    rings: list[tuple[float, float]]
    subs: DataFrame | None


def _unit(rows):
    import numpy as np

    m = np.stack([np.asarray(v, dtype="float64") for v in rows])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _distances(vectors, pivots):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * vectors @ pivots.T))


def _reached(vectors, radius, pivots, near, far):
    """Which cells (columns) may hold a vector within `radius` of each of `vectors` (rows)."""
    import numpy as np

    products = vectors @ pivots.T
    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * products))
    r = radius[:, None]
    reach = (d <= far[None, :] + r) & (d >= near[None, :] - r)
    between = _distances(pivots, pivots)
    rivals = np.argsort(-products, axis=1, kind="stable")[:, :RIVALS]
    for k in range(rivals.shape[1]):
        rival = rivals[:, k]
        ahead = products[np.arange(len(vectors)), rival][:, None] - products
        reach &= ahead <= r * between[rival] + SLACK
    return reach


def _masks(reach):
    """For each row of reached places (columns) a row of masks, one per bundle."""
    import numpy as np

    n, places = reach.shape
    bits = np.zeros((n, -(-places // BUNDLE) * BUNDLE), "int32")
    bits[:, :places] = reach
    bits = bits.reshape(n, -1, BUNDLE) << np.arange(BUNDLE, dtype="int32")
    return bits.sum(axis=2, dtype="int32")


def _bundled(rows: DataFrame, deep: bool) -> DataFrame:
    """`rows` with `bundle` and the `place` in it instead of their cell; `deep`: two levels."""
    at = F.col("cell") * SUB_PIVOTS + F.col("sub") if deep else F.col("cell")
    return rows.withColumn("bundle", F.floor(at / BUNDLE).cast("int")).withColumn(
        "place", (at % BUNDLE).cast("int")
    ).drop(*CELL)


def _cells(sent: DataFrame, deep: bool) -> DataFrame:
    """A row per cell of `sent`, which has a row per bundle."""
    at = F.col("bundle") * BUNDLE + F.col("_place")
    cell, sub = (F.floor(at / SUB_PIVOTS), at % SUB_PIVOTS) if deep else (at, F.lit(0))
    every = F.explode(F.array(*[F.lit(i) for i in range(BUNDLE)]))
    return sent.withColumn("_place", every).where("shiftright(mask, _place) % 2 = 1").select(
        "query_id", "embedding", cell.cast("int").alias("cell"), sub.cast("int").alias("sub")
    )


def _sample(vectors: DataFrame, n: int) -> list[list[float]]:
    """`n` stored vectors in hash order: a sample of fixed size, the same on every run."""
    rows = vectors.select("vector", F.xxhash64("vector").alias("_h")).orderBy("_h").limit(n)
    return [list(r["vector"]) for r in rows.collect()]


def _in_chunks(df: DataFrame, row_id: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """`df` with a `chunk` per cell of about `rows` rows, and the number of chunks per cell."""
    n = F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("chunks")
    counts = df.groupBy("cell").agg(n)
    chunk = F.pmod(F.xxhash64(row_id), F.col("chunks")).cast("int")
    return df.join(counts, "cell").withColumn("chunk", chunk).drop("chunks"), counts


def _per_chunk(subs: DataFrame, counts: DataFrame) -> DataFrame:
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return subs.join(counts, "cell").withColumn("at_chunk", every).drop("chunks")


def _with_sub(rows: DataFrame, row_id: str, vector: str, subs: DataFrame, block_rows: int) -> DataFrame:
    """`rows` with `sub`, the nearest pivot of their cell, and the distance to it."""
    kept = [row_id, vector, "cell"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def place(some: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        some = some[kept].copy()
        if not len(some) or not len(pivots):
            return some.assign(sub=0, distance=0.0).head(0)
        d = _distances(_unit(some[vector]), _unit(pivots["pivot"]))
        nearest = d.argmin(axis=1)
        return some.assign(sub=pivots["sub"].to_numpy()[nearest], distance=d.min(axis=1))

    chunked, counts = _in_chunks(rows.select(*kept), row_id, block_rows)
    left = chunked.groupBy("cell", "chunk")
    return left.cogroup(_per_chunk(subs, counts).groupBy("cell", "at_chunk")).applyInPandas(
        place, f"{schema}, sub int, distance double"
    )


def _cell_of(pivots: list[list[float]]):
    @F.pandas_udf("struct<cell:int,distance:double>")
    def cell_of(vectors: pd.Series) -> pd.DataFrame:
        d = _distances(_unit(vectors), _unit(pivots))
        return pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "distance": d.min(axis=1)})

    return cell_of


def build_index(
    store: DataFrame,
    cell_rows: int = CELL_ROWS,
    top_pivots: int = TOP_PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> VectorIndex | None:
    """Cells of a store of entry_id and embedding; None without a vector.

    Equal vectors are one entry, the one with the smallest id. Zero vectors are left out.
    """
    entries = (
        store.where(F.exists("embedding", lambda x: x != 0))
        .groupBy(F.col("embedding").alias("vector"))
        .agg(F.min("entry_id").alias("entry_id"))
    )
    entries = materialise(entries, "vector-entries")
    cells = -(-entries.count() // cell_rows)
    if not cells:
        return None
    two_levels = cells > top_pivots
    pivots = _sample(entries, math.ceil(math.sqrt(cells)) if two_levels else cells)
    if len(pivots) == 1:
        # One cell that everything reaches: nothing has to be measured.
        one = entries.select("entry_id", "vector", F.lit(0).alias("cell"), F.lit(0).alias("sub"))
        return VectorIndex(one, pivots, [(0.0, 2.0)], None)
    placed = entries.withColumn("_at", _cell_of(pivots)("vector")).select(
        "entry_id", "vector", "_at.cell", F.col("_at.distance").alias("distance")
    )
    placed = materialise(placed, "vector-cells")
    ring = [F.min("distance").alias("near"), F.max("distance").alias("far")]
    rings = [(math.inf, -math.inf)] * len(pivots)
    sizes = placed.groupBy("cell").agg(*ring, F.count(F.lit(1)).alias("n"))
    for r in sizes.collect():
        rings[r["cell"]] = (r["near"], r["far"])
    if not two_levels:
        flat = placed.select("entry_id", "vector", "cell", F.lit(0).alias("sub"))
        return VectorIndex(flat, pivots, rings, None)
    wanted = F.least(F.ceil(F.col("n") / cell_rows), F.lit(SUB_PIVOTS))
    order = F.row_number().over(_by_cell(F.xxhash64("vector")))
    subs = (
        placed.withColumn("_rank", order)
        .where(F.col("_rank") <= SUB_PIVOTS)
        .join(sizes.select("cell", wanted.alias("_wanted")), "cell")
        .where(F.col("_rank") <= F.col("_wanted"))
        .select("cell", (F.col("_rank") - 1).cast("int").alias("sub"), F.col("vector").alias("pivot"))
    )
    subs = materialise(subs, "vector-subs")
    deep = materialise(_with_sub(placed, "entry_id", "vector", subs, block_rows), "vector-entries")
    subs = materialise(subs.join(deep.groupBy(*CELL).agg(*ring), CELL), "vector-rings")
    return VectorIndex(deep.drop("distance"), pivots, rings, subs)


def _by_cell(order):
    from pyspark.sql import Window

    return Window.partitionBy("cell").orderBy(order)


def home_cells(index: VectorIndex, queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, embedding, cell, sub): the cell every query would lie in itself."""
    if len(index.pivots) == 1:
        return queries.select("query_id", "embedding", F.lit(0).alias("cell"), F.lit(0).alias("sub"))
    at = queries.withColumn("_at", _cell_of(index.pivots)("embedding")).select(
        "query_id", "embedding", "_at.cell"
    )
    if index.subs is None:
        return at.withColumn("sub", F.lit(0))
    pivots = index.subs.select("cell", "sub", "pivot")
    return _with_sub(at, "query_id", "embedding", pivots, block_rows).drop("distance")


def reached_bundles(index: VectorIndex, queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, embedding, bundle, mask) of all cells but the home that may hold a match.

    `queries` has query_id, embedding, the home's cell and sub, and `radius`, the distance of unit
    vectors that a match must not exceed.
    """
    pivots, rings, deep = index.pivots, index.rings, index.subs is not None

    def at_top(vectors: pd.Series, radius: pd.Series):
        import numpy as np

        near, far = np.array(rings).T
        return _reached(_unit(vectors), radius.to_numpy() + SLACK, _unit(pivots), near, far)

    if not deep:

        @F.pandas_udf("array<int>")
        def masks(vectors: pd.Series, radius: pd.Series, home: pd.Series) -> pd.Series:
            reach = at_top(vectors, radius)
            reach[range(len(home)), home.to_numpy()] = False
            return pd.Series(list(_masks(reach)))

        per_bundle = F.posexplode_outer(masks("embedding", "radius", "cell")).alias("bundle", "mask")
        return queries.select("query_id", "embedding", per_bundle).where("mask <> 0")

    @F.pandas_udf("array<int>")
    def top_cells(vectors: pd.Series, radius: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([np.flatnonzero(r).astype("int32") for r in at_top(vectors, radius)])

    def sub_cells(some: pd.DataFrame, subs: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = some[["query_id", "embedding"]]
        if not len(some) or not len(subs):
            return out.assign(bundle=0, mask=0).head(0)
        reach = _reached(
            _unit(some["embedding"]), some["radius"].to_numpy() + SLACK, _unit(subs["pivot"]),
            subs["near"].to_numpy(), subs["far"].to_numpy(),
        )
        cell = some["cell"].iloc[0]
        at_home = some["home_cell"].to_numpy() == cell
        reach &= ~(at_home[:, None] & (some["home_sub"].to_numpy()[:, None] == subs["sub"].to_numpy()))
        placed = np.zeros((len(some), SUB_PIVOTS), bool)
        placed[:, subs["sub"].to_numpy()] = reach
        masks = _masks(placed)
        q, b = np.nonzero(masks)
        return out.iloc[q].assign(bundle=cell * (SUB_PIVOTS // BUNDLE) + b, mask=masks[q, b])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    homes = [F.col("cell").alias("home_cell"), F.col("sub").alias("home_sub")]
    sent = queries.select(
        "query_id", "embedding", "radius", *homes, rows_of(top_cells("embedding", "radius")).alias("cell")
    ).where("cell is not null")
    sent = materialise(sent, "vector-sent")
    chunked, counts = _in_chunks(sent, "query_id", block_rows)
    right = _per_chunk(index.subs, counts).groupBy("cell", "at_chunk")
    return chunked.groupBy("cell", "chunk").cogroup(right).applyInPandas(
        sub_cells, f"query_id {kinds['query_id']}, embedding {kinds['embedding']}, bundle int, mask int"
    )


def best_in_bundles(
    sent: DataFrame,
    entries: DataFrame,
    threshold: float,
    earlier_only: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, entry_id, similarity): the best match per query and block of the cells it asks.

    `sent` has query_id, embedding, bundle and mask, `entries` entry_id, vector, bundle and place.
    Large bundles are cut into blocks of entries and of queries.
    """
    most = block_rows * BLOCKS_TOGETHER
    n = F.count(F.lit(1))
    # Few queries are cut smaller, so that they keep more than a task or two busy.
    some = F.least(F.greatest(n / 8, F.lit(block_rows)), F.lit(most))

    def blocks(df: DataFrame, rows, name: str) -> DataFrame:
        return df.groupBy("bundle").agg(F.ceil(n / rows).cast("int").alias(name))

    # One row per bundle.
    plan = blocks(entries, most, "store_blocks").join(blocks(sent, some, "query_blocks"), "bundle")

    def spread(id_column: str, n: str):
        return F.pmod(F.xxhash64(id_column), F.col(n)).cast("int")

    def all_blocks(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        sent.join(plan, "bundle")
        .withColumn("q_block", spread("query_id", "query_blocks"))
        .withColumn("s_block", all_blocks("store_blocks"))
        .drop("store_blocks", "query_blocks")
    )
    right = (
        entries.join(plan, "bundle")
        .withColumn("s_block", spread("entry_id", "store_blocks"))
        .withColumn("q_block", all_blocks("query_blocks"))
        .drop("store_blocks", "query_blocks")
    )

    def best_in_block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": [], "entry_id": [], "similarity": []})
        asking, mask, vectors = q["query_id"].to_numpy(), q["mask"].to_numpy(), _unit(q["embedding"])
        order = np.argsort(asking, kind="stable")
        asking, mask, vectors = asking[order], mask[order], vectors[order]
        value, entry = np.full(len(q), -1.0), np.zeros(len(q), "int64")
        for place, cell in s.groupby("place"):
            cell = cell.sort_values("entry_id")
            ids, stored = cell["entry_id"].to_numpy(), _unit(cell["vector"]).T
            here = np.flatnonzero(mask >> place & 1)
            for start in range(0, len(here), 1024):
                rows = here[start : start + 1024]
                # The ids ascend: what no query of these may see is left out.
                seen = np.searchsorted(ids, asking[rows[-1]]) if earlier_only else len(ids)
                if not seen:
                    continue
                score = (1.0 + vectors[rows] @ stored[:, :seen]) / 2.0
                if earlier_only:
                    score[asking[rows][:, None] <= ids[None, :seen]] = -1.0
                top = score.argmax(axis=1)
                best, found = score[range(len(rows)), top], ids[top]
                better = (best > value[rows]) | ((best == value[rows]) & (found < entry[rows]))
                value[rows[better]], entry[rows[better]] = best[better], found[better]
        good = value >= threshold
        return pd.DataFrame({"query_id": asking[good], "entry_id": entry[good], "similarity": value[good]})

    keys = ["bundle", "q_block", "s_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best_in_block, "query_id long, entry_id long, similarity double"
    )


def _at_home(home: DataFrame, deep: bool) -> DataFrame:
    return _bundled(home, deep).withColumn("mask", F.expr("shiftleft(1, place)")).drop("place")


def _best(found: DataFrame) -> DataFrame:
    best = F.max_by(
        F.struct("entry_id", "similarity"), F.struct("similarity", -F.col("entry_id"))
    ).alias("_best")
    return found.groupBy("query_id").agg(best).select("query_id", "_best.*")


def _bundled_routes(
    index: VectorIndex, queries: DataFrame, threshold: float, earlier_only: bool, block_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`routes` with the further cells by bundle."""
    deep = index.subs is not None
    home = materialise(home_cells(index, queries, block_rows), "vector-homes")
    entries = _bundled(index.entries, deep)
    first = _best(best_in_bundles(_at_home(home, deep), entries, threshold, earlier_only, block_rows))
    first = materialise(first, "vector-first")
    cos = 2.0 * F.greatest(F.coalesce("similarity", F.lit(threshold)), F.lit(threshold)) - 1.0
    radius = F.sqrt(F.greatest(2.0 - 2.0 * cos, F.lit(0.0)))
    # A slack of 1e-6 on the distance covers the rounding of products near one.
    asking = home.join(first, "query_id", "left").select(
        "query_id", "embedding", *CELL, (radius + 1e-6).alias("radius")
    )
    asking = materialise(asking, "vector-asking")
    return home, first, reached_bundles(index, asking, block_rows)


def routes(
    index: VectorIndex,
    queries: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    earlier_only: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(home cells, matches found there, further cells): all that a search compares.

    The further cells leave out each query's home.
    """
    home, first, further = _bundled_routes(index, queries, threshold, earlier_only, block_rows)
    return home, first, _cells(further, index.subs is not None)


def nearest(
    queries: DataFrame,
    store: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    earlier_only: bool = False,
    cell_rows: int = CELL_ROWS,
    top_pivots: int = TOP_PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, entry_id, similarity) of the best match per query; no row without one.

    `queries` has query_id and embedding, `store` entry_id and embedding; ids are numbers
    and order the entries. similarity = (1 + cosine) / 2 >= threshold. Equal vectors count
    as one entry, the one with the smallest id, which also wins ties. With `earlier_only`
    an entry is visible only to queries with a larger id. Zero vectors never match.
    """
    asked = queries.where(F.exists("embedding", lambda x: x != 0)).select("query_id", "embedding")
    index = build_index(store, cell_rows, top_pivots, block_rows)
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, entry_id long, similarity double")
    entries = _bundled(index.entries, index.subs is not None)
    if len(index.pivots) == 1:
        home = _at_home(home_cells(index, asked), False)
        return _best(best_in_bundles(home, entries, threshold, earlier_only, block_rows))
    _, first, further = _bundled_routes(index, asked, threshold, earlier_only, block_rows)
    further = materialise(further, "vector-further")
    later = best_in_bundles(further, entries, threshold, earlier_only, block_rows)
    return _best(first.unionByName(later))


def reuse_semantic(
    queries: DataFrame,
    store: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    earlier_only: bool = False,
) -> DataFrame:
    """Queries with their match and its payload; one row per query, nulls on a miss.

    `store` has entry_id, embedding and payload columns.
    """
    payload = [c for c in store.columns if c not in ("entry_id", "embedding")]
    found = nearest(queries, store, threshold, earlier_only)
    # One entry may answer a large share of the queries.
    paid = salted_join(found, store.select("entry_id", *payload), ["entry_id"], F.col("query_id"))
    return queries.select("query_id").join(paid, "query_id", "left")
