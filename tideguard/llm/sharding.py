"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

Old shards give, new shards have capacities; a flow of least cost says how many bytes of which
old shard go where (a byte that stays costs nothing). Documents of a shard lie in blocks of
falling size, then hash order, so a flow is a byte range of the shard: whole blocks, and a cut inside one. Only the
per-shard sums reach the driver. Then the shards that gain or lose documents are written anew, whole,
with their texts.

Defined cases: a null text counts as empty (size 1, CRC 0). Equal rows are told apart only by
their position, so any of them may be the one that moves. An empty table gives an empty result.
Columns of the input keep their names; helper columns of `reshard` start with `_`, and files
written have `to_shard` and `to_slot` besides, which the input must not have. Law `bytes` asks for even
sizes only: equal texts may lie in different shards. `docs` is read twice and must be a stored
Parquet table. A document longer than a
new shard's capacity still goes to one shard as a whole.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideguard.llm.common import hash_range, place_of, running_totals, shuffled_order, text_of, wrapped
from tideguard.session import materialise

# Rows of one block of a shard: what one window task sorts.
BLOCK_ROWS = 2_000


def plan_transfers(
    sizes: dict[int, int], capacities: dict[int, int], cost=lambda old, new: int(old != new)
) -> list[tuple[int, int, int]]:
    """Flows (old shard, new shard, bytes) with the least total of bytes times cost.

    Successive shortest paths in the residual graph of shards; `cost(old, new)` is per byte.
    The input is one number per shard, whatever the size of the data.
    """
    if sum(sizes.values()) != sum(capacities.values()):
        raise ValueError("the capacities must add up to the sizes")
    left, room = dict(sizes), dict(capacities)
    flow: dict[tuple[int, int], int] = {}
    while any(left.values()):
        # Shortest residual distances from all shards that still have bytes to give.
        old_cost = {i: 0 for i, n in left.items() if n}
        new_cost: dict[int, int] = {}
        new_from: dict[int, int] = {}
        old_from: dict[int, int] = {}
        queue = deque(sorted(old_cost))
        while queue:
            i = queue.popleft()
            for j in capacities:
                through = old_cost[i] + cost(i, j)
                if through >= new_cost.get(j, through + 1):
                    continue
                new_cost[j], new_from[j] = through, i
                for back, units in flow.items():
                    k = back[0]
                    undone = through - cost(k, j)
                    if back[1] == j and units and undone < old_cost.get(k, undone + 1):
                        old_cost[k], old_from[k] = undone, j
                        queue.append(k)
        j = min((j for j, n in room.items() if n), key=lambda j: (new_cost[j], j))
        end, path = j, []
        while True:
            i = new_from[j]
            path.append((i, j, 1))
            if i not in old_from:
                break
            j = old_from[i]
            path.append((i, j, -1))
        units = min(left[i], room[end], *(flow[a, b] for a, b, way in path if way < 0), left[i])
        for a, b, way in path:
            flow[a, b] = flow.get((a, b), 0) + way * units
        left[i] -= units
        room[end] -= units
    return sorted((i, j, n) for (i, j), n in flow.items() if n)


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def reshard(docs: DataFrame, old: str, size: str, key: list[str], capacities) -> DataFrame:
    """`docs` with `shard` and `slot` (gapless from 0 within the shard).

    `old`: column with the present shard number; `size`: column with the bytes; `key`: columns
    that order the documents of a shard, the first of them by its hash. `capacities`: function of the total that gives
    {shard: bytes}. A document goes where its middle byte falls.
    """
    sizes = {
        r["shard"]: r
        for r in docs.groupBy(F.col(old).alias("shard"))
        .agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .collect()
    }
    total = sum(r["bytes"] for r in sizes.values())
    flows = plan_transfers({i: r["bytes"] for i, r in sizes.items()}, capacities(total))
    blocks = max(1, max((r["rows"] for r in sizes.values()), default=0) // BLOCK_ROWS)
    rows = docs.withColumn("_h", shuffled_order(F.col(key[0])))
    # Large documents first: what moves, and where a range is cut, are the shard's smallest.
    by_size = 64 - F.length(F.bin(size))
    rows = rows.withColumn("_block", by_size * blocks + hash_range(F.col("_h"), blocks))
    order = ["_h", *key]
    placed = running_totals(rows, [old], "_block", order, {"_before": size})
    middle = F.col("_before") + F.col(size) / 2
    placed = placed.withColumn("shard", _target(F.col(old), middle, flows)).withColumn(
        "_part", F.col(old).cast("long") * (64 * blocks) + F.col("_block")
    )
    slots = running_totals(placed, ["shard"], "_part", order, {"slot": F.lit(1).cast("long")})
    return slots.drop("_h", "_block", "_part", "_before")


def _target(old: Column, position: Column, flows: list[tuple[int, int, int]]) -> Column:
    """The new shard of a byte position: each old shard's flows lie one after the other."""
    choice = F.lit(None).cast("int")
    by_old: dict[int, list[tuple[int, int]]] = {}
    for i, j, n in flows:
        by_old.setdefault(i, []).append((j, n))
    for i, parts in by_old.items():
        # What stays comes first, so documents before the first cut keep their shard.
        parts.sort(key=lambda part: (part[0] != i, part[0]))
        inner, end = F.lit(parts[-1][0]), sum(n for _, n in parts)
        for j, n in reversed(parts):
            end -= n
            inner = F.when(position < end + n, F.lit(j)).otherwise(inner)
        choice = F.when(old == i, inner).otherwise(choice)
    return choice.cast("int")


def changed_shards(placed: DataFrame, old: str) -> list[int]:
    """The shards that a document leaves or reaches: one number per shard at most."""
    moved = placed.where(~F.col(old).eqNullSafe(F.col("shard")))
    ends = moved.select(F.explode(F.array(F.col(old).cast("int"), "shard")).alias("shard"))
    return sorted(r["shard"] for r in ends.distinct().collect())


def rewrite(docs: DataFrame, placed: DataFrame, old: str, path: str) -> list[int]:
    """Writes the changed shards with their documents under `path/to_shard=N` and returns their numbers.

    `docs` is the stored table, `placed` has `row` (its `place_of`), `shard` and `slot`. Files have the
    columns of `docs` and `to_slot`, each in the order of its slots. A repeated run replaces what is
    there. Shards that nothing comes to or goes from are left as they are.
    """
    changed = changed_shards(placed, old)
    wanted = placed.where(F.col("shard").isin(changed)).select(
        "row", F.col("shard").alias("to_shard"), F.col("slot").alias("to_slot")
    )
    rows = wrapped(docs, place_of(docs).alias("row"))
    moved = rows.join(wanted, "row").select("doc.*", "to_shard", "to_slot")
    (
        moved.sortWithinPartitions("to_shard", "to_slot")
        .write.partitionBy("to_shard")
        .option("compression", "zstd")
        .mode("overwrite")
        .parquet(path)
    )
    return changed


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, size (UTF-8 bytes and 1) and old shard of every document of a stored table."""
    size = F.octet_length(text_of()).cast("long") + 1
    return docs.select(place_of(docs).alias("row"), "doc_id", size.alias("size"))


def reshard_documents(docs: DataFrame, old_shards: int, new_shards: int, path: str) -> DataFrame:
    """The documents in their new shards, written under `path`; law `bytes`.

    The old layout is the one the corpus came in: `old_shards` shards by hash of the document
    number. The new shards have equal capacities in bytes. The rows returned, with digests of the
    texts, are read off the files written, and off `docs` for shards that did not change.
    """
    rows = sized(docs).withColumn(
        "old_shard", (shuffled_order(F.col("doc_id"), seed=1) % old_shards).cast("int")
    )
    rows = materialise(rows, "shard-sizes")
    placed = reshard(
        rows, "old_shard", "size", ["doc_id", "size", "row"],
        lambda total: even_capacities(total, new_shards),
    )
    placed = materialise(placed, "shard-places")
    changed = rewrite(docs, placed, "old_shard", path)
    text = text_of()
    digest = [
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
    ]
    kept = placed.where(~F.col("shard").isin(changed)).select("row", "shard", "slot")
    same = docs.select("doc_id", "text", place_of(docs).alias("row")).join(kept, "row")
    out = same.select(*digest, "shard", "slot")
    if changed:
        schema = T.StructType([*docs.schema.fields, T.StructField("to_slot", T.LongType()), T.StructField("to_shard", T.IntegerType())])
        written = docs.sparkSession.read.schema(schema).parquet(path)
        out = written.select(*digest, F.col("to_shard").alias("shard"), F.col("to_slot").alias("slot")).unionByName(out)
    return out.withColumn("grown_shard", F.lit(None).cast("int"))
