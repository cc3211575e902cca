"""Reuse joins, skew helpers and hash joins against loops in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideguard.functions import vectors as V
from tideguard.operators import batch, gateway, hashes, reuse, semantic, skew
from tideguard.plans.catalog import DICTIONARY

DECISIONS = "key string, decided_at long, entry_ord long, decision string, confidence double, reason string, tier string"


def test_as_of_reuse_equals_loop(spark):
    rng = random.Random(5)
    # One key holds a third of all rows.
    keys = ["hot"] * 5 + [f"k{i}" for i in range(10)]
    entries = [(rng.choice(keys), rng.randint(0, 20000), i, f"d{i}", 0.5, "", "") for i in range(300)]
    asked = [(i, rng.choice(keys), rng.randint(0, 25000)) for i in range(400)]
    store = spark.createDataFrame(entries, DECISIONS)
    requests = spark.createDataFrame(asked, "content_id long, key string, ts long")

    def best(key, ts, ttl):
        live = [(at, o, d) for k, at, o, d, *_ in entries if k == key and at <= ts < at + ttl]
        return max(live)[2] if live else None

    for seconds in (3600, 250, 1):
        found = reuse.reuse_as_of(requests, {"a": (store, 1000), "b": (store, 2500)}, seconds)
        got = {
            r["content_id"]: (r["a"] and r["a"]["decision"], r["b"] and r["b"]["decision"])
            for r in found.collect()
        }
        assert got == {i: (best(k, t, 1000), best(k, t, 2500)) for i, k, t in asked}


def test_a_hot_key_ends_in_many_tasks(spark, no_broadcast):
    """200,000 requests of one key within an hour: no task has an eighth of them."""
    asked = spark.range(200_000).select(
        F.col("id").alias("content_id"), F.lit("hot").alias("key"), (F.col("id") % 3600 + 7200).alias("ts")
    )
    entries = spark.range(50_000).select(
        F.lit("hot").alias("key"), (F.col("id") % 3000 + 7300).alias("decided_at"), F.col("id").alias("entry_ord"),
        F.lit("pass").alias("decision"), F.lit(1.0).alias("confidence"), F.lit("").alias("reason"),
        F.lit("").alias("tier"),
    )
    asked = asked.unionByName(asked.limit(20_000).withColumn("ts", F.lit(7500).cast("long")))
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = reuse.reuse_as_of(asked, {"a": (entries, 100)}).withColumn("task", F.spark_partition_id())
        tasks = found.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("hits")).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert sum(r["n"] for r in tasks) == 220_000
    assert max(r["n"] for r in tasks) < 220_000 / 8
    # Entries of seconds 7300 to 10299 hold for 100 seconds each.
    assert sum(r["hits"] for r in tasks) == found.where("ts between 7300 and 10398").count()


def test_salted_join_equals_join(spark, no_broadcast):
    left = spark.range(3000).select(
        F.col("id"), F.expr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else 'k' || id % 50 end as k")
    )
    right = spark.range(60).select(
        F.expr("case when id = 0 then 'hot' else 'k' || id end as k"), F.col("id").alias("v")
    )
    assert [r["k"] for r in skew.hot_keys(left.dropna(), ["k"], 3).collect()] == ["hot"]
    for how in ("left", "inner"):
        got = skew.salted_join(left, right, ["k"], F.col("id"), how).select("id", "k", "v")
        want = left.join(right, "k", how).select("id", "k", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_rows_equals_row_number(spark):
    df = spark.range(5000).select("id", F.expr("id % 3 = 0 as g"), F.md5(F.col("id").cast("string")).alias("o"))
    limit = F.when(F.col("g"), 700).otherwise(33)
    got = skew.first_rows(df, ["g"], [F.col("o")], limit, F.substring("o", 1, 2))
    ranked = sorted(df.collect(), key=lambda r: r["o"])
    want = [r for r in ranked if r["g"]][:700] + [r for r in ranked if not r["g"]][:33]
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want)


def test_copies_share_the_first_row(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, "a")], "content_id long, text string")
    first, members = batch.dedup(df)
    assert sorted((r["content_id"], r["copies"]) for r in first.collect()) == [(1, 3), (2, 1)]
    assert sorted((r["content_id"], r["first_id"]) for r in members.collect()) == [(1, 1), (2, 2), (3, 1), (9, 1)]


def test_upsert_and_invalidate(spark):
    store = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "key string, at long, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], "key string, at long, v string")
    merged = reuse.upsert(store, new, ["key"], ["at"])
    kept = reuse.invalidate(merged, spark.createDataFrame([("b",)], "key string"), ["key"])
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 2, "z"), ("c", 1, "w")]


@pytest.mark.parametrize("threshold", [3, 10, 13])
def test_banded_hash_join_equals_full_scan(spark, no_broadcast, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]

    def near(h):
        for b in rng.sample(range(64), rng.randint(0, 16)):
            h ^= 1 << b
        return h

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    known = [(signed(h), i, f"c{i}") for i, h in enumerate(base)]
    images = [(i, signed(near(rng.choice(base))) if i % 9 else None) for i in range(200)]
    out = hashes.match_known(
        spark.createDataFrame(images, "image_id long, image_hash long"),
        spark.createDataFrame(known, "known_hash long, known_ord long, category string"),
        threshold,
    )

    def first(h):
        mask = (1 << 64) - 1
        hits = [o for k, o, _ in known if h is not None and ((h ^ k) & mask).bit_count() <= threshold]
        return min(hits, default=None)

    assert {r["image_id"]: r["known_ord"] for r in out.collect()} == {i: first(h) for i, h in images}


def test_hamming_of_hex(spark):
    rows = [
        ("f7b3ffffffffffff", "f7b3fffffffffffe", 1),
        ("ffffffffffffffff", "0000000000000000", 64),
        ("ff", "ff0", 999),
        ("", "", 999),
        ("zz", "00", 999),
        ("0" * 63 + "f", "0" * 64, 4),
    ]
    df = spark.createDataFrame(rows, "a string, b string, d int")
    got = df.select(V.hamming_hex(F.col("a"), F.col("b")).alias("x"), "d").collect()
    assert all(r["x"] == r["d"] for r in got)


def test_dhash_and_phash_of_grey_matrices(spark):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 255, 72)
    bits = "".join("1" if grey[r * 9 + c] < grey[r * 9 + c + 1] else "0" for r in range(8) for c in range(8))
    df = spark.createDataFrame([([int(x) for x in grey],), (None,)], "g array<int>")
    got = [r["h"] for r in df.select(V.hash_hex(V.dhash(F.col("g"))).alias("h")).collect()]
    assert got == [f"{int(bits, 2):016x}", None]

    x = rng.random((32, 32)) * 255
    k = np.arange(32)
    freq = np.array(
        [
            [
                (x * np.outer(np.cos((2 * k + 1) * u * np.pi / 64), np.cos((2 * k + 1) * w * np.pi / 64))).sum()
                * (2**-0.5 if u == 0 else 1) * (2**-0.5 if w == 0 else 1) / 16
                for w in range(8)
            ]
            for u in range(8)
        ]
    )
    want = "".join("1" if b else "0" for b in (freq > np.median(freq)).flatten())
    df = spark.createDataFrame([(x.flatten().tolist(),)], "g array<double>")
    assert df.select(V.phash_udf()("g").alias("h")).first()["h"] == f"{int(want, 2):016x}"


def unit(rng, n, dims):
    v = rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize(
    "threshold,earlier,cell_rows,top_pivots",
    [(0.95, False, 40, 512), (0.9, True, 20, 4), (0.6, False, 20, 4), (0.9, True, 1000, 512)],
)
def test_nearest_equals_full_comparison(spark, no_broadcast, threshold, earlier, cell_rows, top_pivots):
    rng = np.random.default_rng(7)
    centres = unit(rng, 20, 16)
    # A third of the vectors lie around one centre, some are equal, one is zero.
    pick = np.where(rng.random(300) < 0.33, 0, rng.integers(0, 20, 300))
    v = centres[pick] + rng.normal(size=(300, 16)) * 0.08
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    v[10] = v[11] = v[12]
    v[13] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)], "id long, embedding array<float>")
    out = semantic.nearest(
        df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "entry_id"),
        threshold, earlier, cell_rows=cell_rows, top_pivots=top_pivots, block_rows=16,
    )
    got = {r["query_id"]: (r["entry_id"], round(r["similarity"], 9)) for r in out.collect()}
    w = v.astype("float64")
    norms = np.linalg.norm(w, axis=1)
    w = w / np.where(norms == 0, 1, norms)[:, None]
    want = {}
    for i in range(300):
        s = [
            ((1 + w[i] @ w[j]) / 2, -j)
            for j in range(300)
            if i != 13 and j not in (11, 12, 13) and (not earlier or j < i)
        ]
        s = [(round(a, 9), b) for a, b in s]
        if s and max(s)[0] >= threshold:
            want[i] = (-max(s)[1], max(s)[0])
    assert got == want


def test_vectors_without_spread_move_per_bundle_of_cells(spark):
    v = unit(np.random.default_rng(4), 600, 64)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>")
    index = semantic.build_index(df.withColumnRenamed("id", "entry_id"), cell_rows=15)
    asked = df.withColumnRenamed("id", "query_id")
    _, _, moved = semantic._bundled_routes(index, asked, 0.7, True, 64)
    _, _, compared = semantic.routes(index, asked, 0.7, True, 64)
    # 40 cells, of which nearly every query reaches nearly all.
    assert compared.count() > 600 * 30 and moved.count() <= 600 * 40 / semantic.BUNDLE


def on_a_manifold(rng, n, dims=48, inner=6):
    """Vectors with few degrees of freedom and a little noise, as texts of a few themes have."""
    base = np.random.default_rng(0).normal(size=(inner, dims))
    v = rng.normal(size=(n, inner)) @ base + 0.05 * rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("top_pivots", [512, 8])
def test_pairs_scored_grow_less_than_the_square(spark, top_pivots):
    """Four times the queries and four times the store: 16 times the pairs if all were scored."""
    rng, scored = np.random.default_rng(3), []
    for n in (1000, 4000):
        rows = [[float(x) for x in r] for r in on_a_manifold(rng, n)]
        asked = [[float(x) for x in r] for r in on_a_manifold(rng, n // 2)]
        store = spark.createDataFrame(list(enumerate(rows)), "entry_id long, embedding array<float>")
        queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, embedding array<float>")
        index = semantic.build_index(store, cell_rows=32, top_pivots=top_pivots)
        home, _, further = semantic.routes(index, queries, 0.95)
        sizes = index.entries.groupBy(*semantic.CELL).agg(F.count(F.lit(1)).alias("n"))
        sent = home.select(*semantic.CELL).unionByName(further.select(*semantic.CELL))
        scored.append(sent.join(sizes, semantic.CELL).agg(F.sum("n")).first()[0])
        assert scored[-1] < 0.3 * n * n / 2
    assert scored[1] < 7 * scored[0]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("bits,threshold", [(64, 10), (56, 10), (56, 15), (12, 3), (6, 7)])
def test_hash_candidates_equal_full_comparison(spark, no_broadcast, bits, threshold):
    draw = random.Random(bits + threshold)
    images = [draw.getrandbits(bits) for _ in range(120)]
    known = [draw.getrandbits(bits) for _ in range(40)] + [images[0]]
    for h in images[:40]:
        for b in draw.sample(range(bits), draw.randint(0, min(bits, threshold + 2))):
            h ^= 1 << b
        known.append(h)
    images, known = sorted(set(images)), sorted(set(known))
    want = sorted(
        (signed(i), signed(k), (i ^ k).bit_count())
        for i in images for k in known if (i ^ k).bit_count() <= threshold
    )
    left = spark.createDataFrame([(signed(h),) for h in images], "image_hash long")
    right = spark.createDataFrame([(signed(h),) for h in known], "known_hash long")
    plans = [None]
    if bits == 12:
        # Flips on both sides.
        plans = [None, [hashes.Band(0, 6, 1, 1), hashes.Band(6, 6, 0, 0)], [hashes.Band(0, 12, 1, 2)], [hashes.Band(0, 12, 0, 3)]]
    for bands in plans:
        got = hashes.candidates_within(left, right, threshold, bands)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_flipped_hashes_are_made_in_many_tasks(spark, monkeypatch):
    """Few bytes of hashes, many rows of flips: no task makes more than its share."""
    monkeypatch.setattr(hashes, "TASK_ROWS", 1 << 14)
    known = spark.createDataFrame([(i * 7919,) for i in range(400)], "known_hash long").distinct()
    bands = hashes.plan_bands(56, 10, 400, 4000)
    each = sum(b.stored_rows for b in bands)
    made = hashes.stored_entries(hashes.spread_out(known, 400, each), bands)
    per_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 400 * each
    assert max(per_task) < 2 * (1 << 14)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # No function that is called per row of flips.
    assert "lambda" not in plan


def test_hash_join_sorts_by_part_first(spark, no_broadcast):
    """The band has a few values only; led by it, the sort compares whole rows."""
    left = spark.createDataFrame([(1,), (2,)], "image_hash long")
    right = spark.createDataFrame([(3,)], "known_hash long")
    met = hashes.meetings(left, right, hashes.plan_bands(56, 10, 1, 2))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [part#") >= 2 and "Sort [band#" not in plan


def test_first_ids_read_nothing_else(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "key string, ord int, more string")
    first, firsts = reuse.first_of_copies(df)
    assert sorted(map(tuple, first.collect())) == [("a", 1, "y", 2), ("b", 2, "z", 1)]
    assert sorted(map(tuple, firsts.collect())) == [("a", 1), ("b", 2)]
    plan = firsts._jdf.queryExecution().optimizedPlan().toString()
    assert "more" not in plan.split("LogicalRDD")[0]


def test_few_hashes_meet_by_chance(spark):
    """Under one percent of all pairs of 56-bit hashes come out of the join for 10 bits."""
    draw = random.Random(1)
    left = spark.createDataFrame([(draw.getrandbits(56),) for _ in range(2000)], "image_hash long")
    right = spark.createDataFrame([(draw.getrandbits(56),) for _ in range(200)], "known_hash long")
    bands = hashes.plan_bands(56, 10, 200, 2000)
    assert hashes.meetings(left, right, bands).count() < 0.01 * 2000 * 200
    assert sum(b.share for b in hashes.plan_bands(64, 10, 10**6, 10**8)) < 0.002


@pytest.mark.parametrize("block", [7, 4096])
def test_distances_of_all_pairs_are_counted_by_blocks(spark, block):
    draw = random.Random(2)
    values = [signed(draw.getrandbits(64)) for _ in range(90)] + [5, 5]
    want = {}
    for i, x in enumerate(values):
        for y in values[i + 1 :]:
            d = ((x ^ y) & ((1 << 64) - 1)).bit_count()
            want[d] = want.get(d, 0) + 1
    df = spark.createDataFrame(list(enumerate(values)), "_ref_id long, reference long")
    assert {r["d"]: r["n"] for r in hashes.pair_distances(df, block).collect()} == want


def test_texts_stay_behind_when_vectors_are_joined(spark, no_broadcast):
    """Vectors stored apart are joined to judged texts: the same rows, and the text is not moved."""
    texts = spark.range(40).selectExpr(
        "id as content_id", "if(id % 7 = 0, ' ', concat('some kill text ', id)) as text",
        "timestamp'2024-01-01' as ts", "if(id % 5 = 0, concat('ref', id), null) as image_ref",
    )
    vectors = spark.range(0, 50, 2).selectExpr(
        "id as content_id", "if(id % 3 = 0, id, null) as image_hash", "array(float(id), 1f) as embedding"
    )
    apart = gateway.prepare(texts, DICTIONARY, vectors=vectors)
    together = gateway.prepare(texts.join(vectors, "content_id", "left"), DICTIONARY)
    assert apart.schema == together.schema
    assert sorted(map(str, apart.collect())) == sorted(map(str, together.collect()))
    plan = apart._jdf.queryExecution().optimizedPlan().toString()
    # The verdict is a generated row; it lies below the join.
    assert plan.index("Join LeftOuter") < plan.index("Generate")
