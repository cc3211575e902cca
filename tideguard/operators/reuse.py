"""Reuse of earlier decisions by content key, and maintenance of the stores behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideguard.config import LOCAL_TTL_SECONDS, SHARED_TTL_SECONDS
from tideguard.operators.skew import salted_join

PAYLOAD = ["decision", "confidence", "reason", "tier"]
# A block of a key's time line: as many seconds, so at most as many rows.
BLOCK_SECONDS = 3600


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by `order`; aggregated map-side, so a hot key is one row per task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[f"_row.{c}" for c in rest])


def upsert(store: DataFrame, entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`store` with `entries` written over it: the newest row per key wins."""
    return latest(store.unionByName(entries), keys, order)


def invalidate(store: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(keys_gone.select(*keys).distinct(), keys, "left_anti")


def reuse_as_of(
    requests: DataFrame,
    stores: dict[str, tuple[DataFrame, int]],
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """For every request and store, the entry valid at the time of the request.

    `requests` has key, ts (epoch seconds) and any other columns, which are kept. A store is
    (entries, ttl); entries have key, decided_at, entry_ord and the payload, and hold for
    decided_at <= ts < decided_at + ttl, the newest entry winning. The result adds one
    nullable struct per store, named after it. A null key matches nothing.

    Requests of one key and second have one answer, and of the entries of one key and second
    only the newest of each store counts; so all stores and requests are reduced to one row per
    key and second first, on the map side. A key's time line is cut into blocks. The last entries of
    every block are carried over the blocks, one row each, and what reaches a block is put before its
    first second; then the blocks are gone through in time order, in parallel. No pair of request
    and entry is built, and no task has more rows of a key than a block has seconds, or the time
    line blocks. The answers go back to the requests by key and second, spread where that is hot.
    """
    names = list(stores)
    kind = F.struct("decided_at", *PAYLOAD)
    parts = [requests.select("key", F.col("ts").cast("long").alias("at"), F.lit(True).alias("asked"))]
    for name, (entries, _) in stores.items():
        parts.append(
            entries.select(
                "key", F.col("decided_at").cast("long").alias("at"),
                kind.alias(name), F.col("entry_ord").cast("long").alias(f"_ord_{name}"),
            )
        )
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    newest = [F.max_by(n, f"_ord_{n}").alias(n) for n in names]
    line = (
        rows.where(F.col("key").isNotNull())
        .groupBy("key", "at")
        .agg(F.max("asked").alias("asked"), *newest)
        .withColumn("block", F.floor(F.col("at") / block_seconds))
    )

    def last(name: str, window) -> Column:
        return F.last(name, ignorenulls=True).over(window).alias(name)

    ends = line.groupBy("key", "block").agg(
        F.max("asked").alias("asked"),
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("at"))).alias(n) for n in names],
    )
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "key", (F.col("block") * block_seconds - 1).alias("at"), F.lit(None).cast("boolean").alias("asked"),
        *[last(n, earlier) for n in names], "block", F.col("asked").alias("_wanted"),
    ).where(F.col("_wanted"))
    so_far = (
        Window.partitionBy("key", "block")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = line.unionByName(carried.drop("_wanted")).select("key", "at", "asked", *[last(n, so_far) for n in names])
    valid = [
        F.when(F.col("at") < F.col(f"{n}.decided_at") + F.lit(stores[n][1]), F.col(n)).alias(n)
        for n in names
    ]
    found = seen.where("asked").select("key", F.col("at").alias("_at"), *valid)
    timed = requests.withColumn("_at", F.col("ts").cast("long"))
    spread = F.struct(*requests.columns) if "content_id" not in requests.columns else F.col("content_id")
    return salted_join(timed, found, ["key", "_at"], spread).select(*requests.columns, *names)


def reuse_exact(
    requests: DataFrame,
    decisions: DataFrame,
    ttl: int = LOCAL_TTL_SECONDS,
    id_column: str = "content_id",
) -> DataFrame:
    """One-store `reuse_as_of`, with `hit` and the payload flattened."""
    found = reuse_as_of(requests.select(id_column, "key", "ts"), {"entry": (decisions, ttl)})
    return found.select(id_column, F.col("entry").isNotNull().alias("hit"), "entry.*")


def reuse_two_tier(
    requests: DataFrame,
    local: DataFrame,
    shared: DataFrame,
    local_ttl: int = LOCAL_TTL_SECONDS,
    shared_ttl: int = SHARED_TTL_SECONDS,
    id_column: str = "content_id",
) -> DataFrame:
    """Local store first, then the shared one; `store` tells which answered."""
    found = reuse_as_of(
        requests.select(id_column, "key", "ts"),
        {"local": (local, local_ttl), "shared": (shared, shared_ttl)},
    )
    store = F.when(F.col("local").isNotNull(), "local").when(F.col("shared").isNotNull(), "shared")
    return found.select(
        id_column, store.alias("store"), F.coalesce("local", "shared").alias("_e")
    ).select(id_column, "store", "_e.*")


def reuse_by_key(
    requests: DataFrame,
    store: DataFrame,
    key: str,
    prefix: str,
    id_column: str = "content_id",
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Left equi join with a store that has one row per key (image hash or reference).

    Adds the payload columns as `{prefix}_{column}`; null keys never match.
    """
    entries = store.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in PAYLOAD])
    return salted_join(requests, entries, [key], F.col(id_column), hot_from=hot_from)


def first_of_copies(
    df: DataFrame, key: str = "key", order: str = "ord"
) -> tuple[DataFrame, DataFrame]:
    """(first row of every key, `key -> first order`): one row per distinct content."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_row"), F.count(F.lit(1)).alias("copies")
    )
    # The ids are counted by themselves: no other column is read, sorted or moved for them.
    firsts = df.groupBy(key).agg(F.min(order).alias("first_ord"))
    return first.select(key, *[f"_row.{c}" for c in rest], "copies"), firsts


def share_results(
    df: DataFrame, results: DataFrame, key: str = "key", spread: str = "ord"
) -> DataFrame:
    """Gives every copy the result computed once per key, spreading hot keys over tasks."""
    return salted_join(df, results, [key], F.col(spread), "inner")


def cache_stats(reuse: DataFrame, hit: Column, entries: DataFrame) -> DataFrame:
    """One row: entries, hits, misses, hit_rate."""
    total = F.count(F.lit(1))
    hits = F.count(F.when(hit, 1))
    size = entries.agg(F.count(F.lit(1)).alias("entries"))
    return reuse.agg(
        hits.alias("hits"),
        (total - hits).alias("misses"),
        F.round(F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(0.0)), 4).alias("hit_rate"),
    ).select(size.scalar().alias("entries"), "hits", "misses", "hit_rate")
