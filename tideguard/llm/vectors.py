"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are brought to length 1 and turned so that the leading coordinates carry the most. Tiles
of vectors are compared pair by pair: products of the leading coordinates are added up first,
what the others can still add is bounded by the product of the suffix norms, and a tile pair, or
what is left of it, is given up as soon as no cosine in it can reach the threshold. Bounds are
taken in single precision, widened by its rounding; what they let through is decided in double.

Tiles are cut from the leaves of a k-d tree over the leading coordinates. Each leaf has a centre
and the largest angle to it: leaf pairs that are too far apart are not compared at all, and where
the angles prove that all pairs link (a crowd of near copies), links are counted from the sizes
and tied by one edge per vector. Tasks return counts and spanning edges, never the pairs. The
rotation and the tree come from a sample of bounded size; they only lay out the work, so results
do not depend on it.

Vectors move once: leaves are dealt to blocks of bounded size, and a block is a folder of the
shared scratch. A task reads the two blocks that it compares from there, without a shuffle, so
disk grows with the vectors and not with the pairs of blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing. Vectors link only with vectors of the same length. Equal vectors are compared once and
counted as often as they occur, also under the same number. A component of rows without numbers
has no number. An empty table gives an empty result. Columns other than vec_id and embedding are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideguard.llm.common import components
from tideguard.session import materialise, scratch_path

THRESHOLD = 0.9
# Vectors of a leaf, about, and of a tile (what is multiplied at once).
STRIP, TILE = 4_096, 1_024
# Bytes of a block's turned vectors (a task holds two blocks), blocks at least where there are
# that many strips, and pairs of blocks that one job compares.
BLOCK_BYTES, BLOCKS, JOB = 32 << 20, 6, 128
# Leaves of the tree at most, and vectors and bytes of the sample that lays it out.
LEAVES, SAMPLE, SAMPLE_BYTES = 4_096, 20_000, 16 << 20
LEADING = 16
# Rounding of rotated products; angles and bounds are widened by it.
SLACK = 1e-9


def tree(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, list[tuple[int, float]], np.ndarray]:
    """(rotation, splits in heap order, leaf centres) from unit vectors."""
    _, turn = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], -1))
    turn = turn[:, ::-1]
    points = sample @ turn
    groups, splits = [points], []
    while len(groups) < leaves:
        halves = []
        for g in groups:
            lead = g[:, :LEADING]
            by = int(lead.var(axis=0).argmax()) if len(g) else 0
            at = float(np.median(lead[:, by])) if len(g) else 0.0
            splits.append((by, at))
            halves += [g[lead[:, by] <= at], g[lead[:, by] > at]]
        groups = halves
    centres = np.array([g.mean(axis=0) if len(g) else np.eye(sample.shape[1])[0] for g in groups])
    return turn, splits, centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def leaf_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    by = np.array([s[0] for s in splits] + [0])
    cut = np.array([s[1] for s in splits] + [0.0])
    while len(points) and at[0] < len(splits):
        at = 2 * at + 1 + (points[np.arange(len(points)), by[at]] > cut[at])
    return at - len(splits)


class Tile:
    """Vectors of a leaf, with their leading coordinates and suffix norms as single numbers."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.leads = vectors, {}

    def lead(self, high: int) -> np.ndarray:
        if high not in self.leads:
            rest = np.linalg.norm(self.vectors[:, high:], axis=1, keepdims=True)
            self.leads[high] = np.hstack([self.vectors[:, :high], rest]).astype(np.float32)
        return self.leads[high]


def linked(x: Tile, y: Tile, threshold: float, start: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers of all pairs whose product reaches the threshold, leading coordinates first.

    Also how many coordinates leave few others, from which the next tile pair may `start`.
    """
    dims, cells, tried = x.vectors.shape[1], len(x.vectors) * len(y.vectors), []
    for high in sorted({min(dims, 8 << k) for k in range(32)}):
        if high < min(start, dims):
            continue
        # A product of the leading coordinates and of the suffix norms: the most that it can be.
        most = x.lead(high) @ y.lead(high).T
        rounding = (high + 8) * 2.0**-23
        at = np.flatnonzero(most >= np.float32(threshold - SLACK - rounding))
        tried.append((len(at), high))
        if len(at) * 512 <= cells:
            break
    if len(at) * 16 > cells:
        rows, cols = np.nonzero(x.vectors @ y.vectors.T >= threshold)
    else:
        rows, cols = np.divmod(at, len(y.vectors))
        reach = np.einsum("ij,ij->i", x.vectors[rows], y.vectors[cols]) >= threshold
        rows, cols = rows[reach], cols[reach]
    enough = next((h for n, h in tried if (n - len(rows)) * 512 <= cells), high)
    return rows, cols, enough


def spanning(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """The smallest position in reach of each of n nodes, by the links given."""
    label = np.arange(n)
    while len(rows):
        least = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, least)
        np.minimum.at(new, cols, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def compare_blocks(one: dict, two: dict | None, compared: np.ndarray, threshold: float) -> pd.DataFrame:
    """(node, links, hub) of two blocks, or of one with itself.

    A block: `nodes`, `copies` and `vectors` by `leaf`, ascending. `compared`: which leaves are.
    """
    other = two or one
    shift = 0 if two is None else len(one["nodes"])
    nodes = np.concatenate([one["nodes"], other["nodes"]]) if two else one["nodes"]
    links, hub = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    mine = _tiles(one)
    others = _tiles(two) if two else mine
    start = 8
    for i, (leaf, at, x) in enumerate(mine):
        for j in range(i if two is None else 0, len(others)):
            to, there, y = others[j]
            if not compared[leaf, to]:
                continue
            rows, cols, start = linked(x, y, threshold, start)
            if two is None and i == j:
                rows, cols = rows[rows < cols], cols[rows < cols]
            if not len(rows):
                continue
            n, m, base = len(x.vectors), len(y.vectors), shift + there
            weights = one["copies"][at : at + n], other["copies"][there : there + m]
            links[at : at + n] += np.bincount(rows, weights[1][cols], n).astype(np.int64)
            links[base : base + m] += np.bincount(cols, weights[0][rows], m).astype(np.int64)
            a, b = hub[rows + at], hub[cols + base]
            ends = np.unique((a * len(nodes) + b)[a != b])
            if len(ends):
                hub = spanning(*np.divmod(ends, len(nodes)), len(nodes))[hub]
    has = links > 0
    return pd.DataFrame({"node": nodes[has], "links": links[has], "hub": nodes[hub[has]]})


def _tiles(block: dict) -> list[tuple[int, int, Tile]]:
    """(leaf, first place, vectors) of the tiles of a block."""
    leaf, out = block["leaf"], []
    starts = np.flatnonzero(np.diff(leaf, prepend=-1))
    for low, high in zip(starts, [*starts[1:], len(leaf)], strict=True):
        for at in range(low, high, TILE):
            out.append((int(leaf[low]), at, Tile(block["vectors"][at : min(at + TILE, high)])))
    return out


def leaf_plan(leaves: pd.DataFrame, centres: np.ndarray, threshold: float):
    """What to do with each pair of leaves.

    `leaves`: leaf, angle (largest to its centre), vectors (rows with copies), node (smallest).
    Returns which of all leaves are to be compared, as a square, and for each leaf the links and
    the hub that pairs of leaves with nothing but links give it.
    """
    ids, angle = leaves["leaf"].to_numpy(), leaves["angle"].to_numpy()
    sizes, first = leaves["vectors"].to_numpy(), leaves["node"].to_numpy()
    reach = float(np.arccos(threshold))
    compared = np.zeros((len(centres), len(centres)), bool)
    whole = np.zeros((len(ids), len(ids)), bool)
    for k in range(len(ids)):
        between = np.arccos(np.clip(centres[ids[k:]] @ centres[ids[k]], -1, 1))
        between[0] = 0.0
        wide = angle[k:] + angle[k]
        near = between - wide <= reach + 1e-6
        all_link = between + wide <= reach - 1e-6
        compared[ids[k], ids[k:]] = compared[ids[k:], ids[k]] = near & ~all_link
        whole[k, k:] = whole[k:, k] = all_link
    tied = whole.any(axis=1)
    hub = np.where(tied, first[whole.argmax(axis=1)], -1) if len(ids) else first
    label = spanning(*np.nonzero(np.triu(whole, 1)), len(ids))
    return compared, pd.DataFrame({"leaf": ids, "more": whole @ sizes, "hub": hub, "root": first[label]})


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `table(vec_id, embedding)`."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    good = F.expr("size(vector) > 0 and forall(vector, c -> c is not null and not isnan(c) and abs(c) < double('Infinity')) and exists(vector, c -> c != 0)")
    # Stored as wide as given.
    kind = "float" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "double"
    usable = rows.where(good).select("vec_id", F.col("vector").cast(f"array<{kind}>").alias("vector"))
    usable = usable.withColumn("hash", F.xxhash64("vector"))
    sizes = usable.groupBy(F.size("vector").alias("dims")).agg(F.approx_count_distinct("hash").alias("n")).orderBy("dims").collect()
    out = rows.where(~F.coalesce(good, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    for size in sizes:
        out = out.unionByName(_linked_rows(usable.where(F.size("vector") == size["dims"]), size["dims"], size["n"], threshold))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked_rows(rows: DataFrame, dims: int, about: int, threshold: float) -> DataFrame:
    """vec_id, n_links and component_id of vectors of one length, of which some `about` are different."""
    blocks, turn, centres = _blocks(rows, dims, about)
    parts = _compare(blocks, dims, turn, centres, threshold)
    nodes = blocks.where("copies is not null").select("node", "ids", "copies", "least")
    groups = components(parts.where("node != hub").select("node", "hub"), "vectors")
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    # Only vectors with links are in it.
    marks = materialise(links.join(groups, "node", "left").withColumnRenamed("node", "of"), "marks")
    smallest = (
        nodes.select("node", "least").join(marks, F.col("node") == F.col("of"))
        .groupBy(F.col("component").alias("of_component")).agg(F.min("least").alias("smallest"))
    )
    marks = marks.join(smallest, F.col("component") == F.col("of_component"), "left").select("of", "links", "component", "smallest")
    named = nodes.join(marks, F.col("node") == F.col("of"), "left").select(
        "node", "ids", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"),
    )
    more = blocks.where("copies is null").select(F.col("node").alias("of"), F.col("ids").alias("more"))
    if more.limit(1).count():
        named = named.unionByName(
            more.join(named.drop("ids"), F.col("node") == F.col("of")).select("node", F.col("more").alias("ids"), "n_links", "component_id")
        )
    return named.select(F.explode("ids").alias("vec_id"), "n_links", "component_id")


def _blocks(rows: DataFrame, dims: int, about: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(block, leaf, angle, node, ids, copies, least, data), written by block; rotation; centres.

    A vector has its bytes (`data`), rows (`copies`) and smallest number in one row; further rows
    of it, where it is so frequent that its numbers (`ids`) take many rows, have none of these.
    """
    spark = rows.sparkSession
    keep = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    # Hashes pick vectors, not rows: copies weigh nothing.
    share = min(1 << 30, int((2 * keep / max(about, 1) + 1e-9) * (1 << 30)))
    picked = rows.where(F.pmod("hash", F.lit(1 << 30)) < share).select("hash", "vector").distinct()
    sample = picked.orderBy("hash").limit(keep).collect()
    if not sample:
        sample = rows.select("vector").limit(keep).collect()
    start = unit(np.array([r["vector"] for r in sample], np.float64))
    leaves = 1 << max(0, min(LEAVES, -(-about // STRIP)) - 1).bit_length()
    turn, splits, centres = tree(start, leaves)
    counts = np.bincount(leaf_of(start @ turn, splits), minlength=leaves) * (about / len(start))
    first, parts = deal(counts, max(1, BLOCK_BYTES // (8 * dims)))
    kind = np.float32 if rows.schema["vector"].dataType.simpleString() == "array<float>" else np.float64

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different vectors of a batch with all their numbers."""
        for b in batches:
            if not b.num_rows:
                continue
            # + 0 makes a zero of minus zero.
            raw = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims) + kind(0)
            _, at, of = np.unique(raw.view(np.dtype((np.void, raw.itemsize * dims))).ravel(), return_index=True, return_inverse=True)
            ids = b.column("vec_id").take(pa.array(np.argsort(of, kind="stable")))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(at)))]).astype(np.int32)
            raw = raw[at]
            points = unit(raw.astype(np.float64)) @ turn
            leaf = leaf_of(points, splits)
            cosine = np.einsum("ij,ij->i", points, centres[leaf])
            yield pa.RecordBatch.from_arrays([
                pa.array((first[leaf] + mixed(raw) % parts[leaf]).astype(np.int32)), pa.array(leaf.astype(np.int32)),
                pa.array(np.arccos(np.clip(cosine, -1, 1))), pa.ListArray.from_arrays(pa.array(ends), ids),
                pa.array([r.tobytes() for r in raw], pa.binary()),
            ], ["block", "leaf", "angle", "ids", "data"])

    schema = "block int, leaf int, angle double, ids array<long>, data binary"
    assigned = rows.select("vec_id", "vector").mapInArrow(assign, schema)
    dealt = assigned.repartition(int((first + parts).max()), "block").sortWithinPartitions("block", "leaf", "data")
    merged = dealt.withColumn("at", F.monotonically_increasing_id()).mapInArrow(
        merge_copies, "block int, leaf int, angle double, node long, ids array<long>, copies long, least long, data binary"
    )
    path = scratch_path(spark, "blocks")
    merged.write.partitionBy("block").parquet(path)
    return spark.read.schema(merged.schema).parquet(path), turn, centres


def deal(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each leaf and its number of blocks, from the vectors of each leaf, about.

    Neighbouring leaves share a block; a leaf beyond `most` vectors has several of its own.
    """
    full = min(most, max(STRIP, counts.sum() / BLOCKS))
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block, held = 0, 0.0
    for leaf, n in enumerate(counts):
        if held and held + n > full:
            block, held = block + 1, 0.0
        first[leaf], held = block, held + n
        if n > most:
            parts[leaf] = -(-n // most)
            block, held = block + parts[leaf], 0.0
    return first, parts


def mixed(raw: np.ndarray) -> np.ndarray:
    """A number per row of `raw`, the same for the same bytes."""
    words = raw.view(np.uint32).astype(np.uint64)
    factors = np.random.default_rng(0).integers(1, 1 << 63, words.shape[1], dtype=np.uint64) | np.uint64(1)
    return ((words * factors).sum(axis=1, dtype=np.uint64) >> np.uint64(33)).astype(np.int64)


def merge_copies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one vector, which follow each other, get one node; the last has what holds for all."""
    kinds = {
        "block": pa.int32(), "leaf": pa.int32(), "angle": pa.float64(), "node": pa.int64(), "ids": pa.list_(pa.int64()),
        "copies": pa.int64(), "least": pa.int64(), "data": pa.binary(),
    }

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    last = None
    for b in batches:
        out = []
        for block, leaf, angle, ids, data, node in zip(*(b.column(c).to_pylist() for c in ("block", "leaf", "angle", "ids", "data", "at")), strict=True):
            copies, least = len(ids), min((i for i in ids if i is not None), default=None)
            if last is not None and last[-1] == data:
                node, copies = last[3], last[5] + copies
                least = min((i for i in (last[6], least) if i is not None), default=None)
                out.append((*last[:5], None, None, None))
            elif last is not None:
                out.append(last)
            last = (block, leaf, angle, node, ids, copies, least, data)
        if out:
            yield batch(out)
    if last is not None:
        yield batch([last])


def _compare(blocks: DataFrame, dims: int, turn: np.ndarray, centres: np.ndarray, threshold: float) -> DataFrame:
    """(node, links, hub): what each pair of blocks says of its vectors."""
    spark = blocks.sparkSession
    heads = blocks.where("copies is not null")
    about = heads.groupBy("leaf").agg(
        F.max("angle").alias("angle"), F.sum("copies").alias("vectors"), F.min("node").alias("node"), F.collect_set("block").alias("blocks")
    ).orderBy("leaf").toPandas()
    compared, whole = leaf_plan(about, centres, threshold)
    path = scratch_path(spark, "links")
    schema = "node long, links long, hub long"
    if (whole["hub"] >= 0).any():
        crowded = spark.createDataFrame(whole[whole["hub"] >= 0])
        own = heads.select("leaf", "node", "copies").join(F.broadcast(crowded), "leaf")
        # A leaf that links within counts the vector itself; two edges tie it to all of its hubs.
        within = [int(a) for a, r in zip(whole["leaf"], whole["hub"], strict=True) if r >= 0 and not compared[a, a]]
        minus = F.when(F.col("leaf").isin(within), F.col("copies")).otherwise(0)
        inside = own.select("node", (F.col("more") - minus).alias("links"), "hub").unionByName(
            own.select("node", F.lit(0).cast("long").alias("links"), F.col("root").alias("hub"))
        )
        inside.write.parquet(path)

    held: dict[int, list[int]] = {}
    for leaf, some in zip(about["leaf"], about["blocks"], strict=True):
        for block in some:
            held.setdefault(int(block), []).append(int(leaf))
    pairs = [(i, j) for i in held for j in held if i <= j and compared[np.ix_(held[i], held[j])].any()]
    source = heads.select("block", "leaf", "node", "copies", "data")
    flags = np.packbits(compared)

    def read(batches: list[pa.RecordBatch]) -> dict:
        leaf, nodes, copies = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("leaf", "node", "copies"))
        order = np.argsort(leaf, kind="stable")
        data = [b.column("data").to_pylist() for b in batches]
        kind = np.dtype(f"f{len(data[0][0]) // dims}")
        raw = np.concatenate([np.frombuffer(b"".join(d), kind).reshape(-1, dims) for d in data])[order]
        del data
        turned = np.empty(raw.shape)
        for at in range(0, len(raw), TILE):
            turned[at : at + TILE] = unit(raw[at : at + TILE].astype(np.float64)) @ turn
        return {"leaf": leaf[order], "nodes": nodes[order], "copies": copies[order], "vectors": turned}

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            of = b.column("block").to_numpy()
            for block in np.unique(of):
                parts.setdefault(int(block), []).append(b.filter(pa.array(of == block)))
        if parts:
            ends = [read(parts.pop(block)) for block in sorted(parts)]
            square = np.unpackbits(flags, count=len(centres) ** 2).reshape(len(centres), -1).astype(bool)
            links = compare_blocks(ends[0], ends[1] if len(ends) > 1 else None, square, threshold)
            yield pa.RecordBatch.from_pandas(links, preserve_index=False)

    for k in range(0, len(pairs), JOB):
        # The first part reads nothing: of parts of one partition each alone, Spark makes one partition.
        both = source.where("block < 0")
        for pair in pairs[k : k + JOB]:
            both = both.unionByName(source.where(F.col("block").isin(*pair)).coalesce(1))
        both.mapInArrow(compare, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
