"""SimHash near-duplicates by tables of distances to pivot fingerprints.

Every distinct fingerprint gets its Hamming distances to a fixed set of reference fingerprints.
Two uses of that table find the links without comparing all with all:

* References that are zero outside one 16-bit block measure that block only, once the distance
  to the zero fingerprint is taken off. Two fingerprints that differ in at most two bits agree
  in at least two of the four blocks, hence in all coordinates of these blocks: the coordinates
  of each pair of blocks are a join key.
* References over all bits bound the distance from below: pairs whose coordinates differ by more
  than the radius anywhere are discarded. Survivors are verified on the fingerprints.

A key that very many fingerprints share (a large group of near copies) would give the square of
their number. There each fingerprint is tied to the smallest one that shares a variant with it, a
variant being the fingerprint with at most one of the bits outside the two blocks flipped: two
fingerprints share one exactly if they are within two bits, so no link is lost and rows grow in
proportion.

Defined cases: a null or empty text has fingerprint 0, which links like any other. Equal texts
share a fingerprint and are one node. Null document numbers are passed over when the smallest is
looked for. An empty table gives an empty result. The input's other columns are kept by
`without_near_copies`, whatever their names.
"""

from __future__ import annotations

import random
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideguard.llm.common import components, place_of, text_of, wrapped
from tideguard.session import materialise

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS, BLOCK_BITS = 4, 16
# Fingerprints of one key that are compared in pairs; above, variants tie them.
PAIRED = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bits that are set in over half of the hashes of all word shingles; as a signed number."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = len(words) - width + 1
        spans = zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in spans]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def pivots(bits: range, number: int, seed: int) -> list[int]:
    """Reference fingerprints: random over `bits`, zero elsewhere; signed."""
    draw = random.Random(seed)
    out = []
    for _ in range(number):
        value = sum(draw.getrandbits(1) << b for b in bits)
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


BLOCK_PIVOTS = [
    pivots(range(b * BLOCK_BITS, (b + 1) * BLOCK_BITS), 12, seed=b) for b in range(BLOCKS)
]
WIDE_PIVOTS = pivots(range(64), 16, seed=64)


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot).cast("long"))).cast("long")


def block_coordinates(fp: Column, block: int) -> list[Column]:
    """Distances to the block's pivots less the distance to zero: they depend on its bits only."""
    zero = distance(fp, 0)
    return [distance(fp, p) - zero for p in BLOCK_PIVOTS[block]]


def packed_coordinates(fp: Column) -> list[Column]:
    """Distances to the wide pivots, eight to a number, so that they travel with the key."""
    groups = [WIDE_PIVOTS[i : i + 8] for i in range(0, len(WIDE_PIVOTS), 8)]
    return [
        reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(distance(fp, p), 8 * k) for k, p in enumerate(g)])
        for g in groups
    ]


def largest_difference(x: list[Column], y: list[Column]) -> Column:
    """The largest difference of any coordinate of two packed tables."""
    parts = [
        F.abs(F.shiftright(a, 8 * k).bitwiseAND(255) - F.shiftright(b, 8 * k).bitwiseAND(255))
        for a, b in zip(x, y, strict=True)
        for k in range(8)
    ]
    return F.greatest(*parts)


def _keyed(fingerprints: DataFrame) -> DataFrame:
    """`fingerprints(fp)` once per pair of blocks: key, free (bits outside the blocks), fp, t0, t1."""
    fp = F.col("fp")
    sides = []
    for pair in combinations(range(BLOCKS), 2):
        coordinates = [c for b in pair for c in block_coordinates(fp, b)]
        inside = sum(((1 << BLOCK_BITS) - 1) << (b * BLOCK_BITS) for b in pair)
        free = ~inside & ((1 << 64) - 1)
        free = free - (1 << 64) if free >> 63 else free
        number = F.lit(pair[0] * BLOCKS + pair[1])
        sides.append(F.struct(F.xxhash64(number, *coordinates).alias("key"), F.lit(free).cast("long").alias("free")))
    table = [c.alias(f"t{i}") for i, c in enumerate(packed_coordinates(fp))]
    return fingerprints.select("fp", *table, F.explode(F.array(*sides)).alias("s")).select("s.*", "fp", "t0", "t1")


def links(fingerprints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b): links between distinct fingerprints that have the same components as all links.

    Below `paired` fingerprints a key, these are all links within the radius.
    """
    keyed = materialise(_keyed(fingerprints), "pivot-table")
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > paired)
    crowded = materialise(crowded.select("key"), "crowded")
    left = keyed.join(crowded, "key", "left_anti")
    right = left.select("key", F.col("fp").alias("other"), F.col("t0").alias("u0"), F.col("t1").alias("u1"))
    near = largest_difference([F.col("t0"), F.col("t1")], [F.col("u0"), F.col("u1")]) <= RADIUS
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS
    pairs = left.join(right, "key").where((F.col("fp") < F.col("other")) & near & close)

    bits = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    flips = F.filter(bits, lambda bit: bit.bitwiseAND(F.col("free")) != 0)
    variants = F.explode(
        F.concat(F.array("fp"), F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit)))
    )
    shared = (
        keyed.join(crowded, "key", "left_semi")
        .select("key", variants.alias("variant"), "fp")
        .groupBy("key", "variant")
        # At most one fingerprint per free bit and one more: the group is bounded.
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where(F.col("a") != F.col("b"))
    )
    return pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).unionByName(shared)


def grouped(rows: DataFrame, paired: int = PAIRED) -> DataFrame:
    """`rows(doc_id, fp, ...)` with component_id, the smallest document number in reach."""
    least = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    groups = components(links(least.select("fp"), paired), "simhash")
    named = least.join(groups, least["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group")
    )
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_fp = named.join(smallest, "group").select(F.col("fp").alias("of_fp"), "component_id", "group")
    return rows.join(by_fp, F.col("fp") == F.col("of_fp")).drop("of_fp")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows = docs.select("doc_id", fingerprint_of(text_of()).alias("fp"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return grouped(materialise(rows, "simhash")).select(
        "doc_id", digits.alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group: that of the smallest number.

    Rows are told apart by their place in the table, so that of equal rows one stays. `docs` is
    read twice and must be a stored Parquet table; its texts are not written again.
    """
    row = place_of(docs).alias("row")
    prints = docs.select(row, F.col("doc_id").alias("doc_id"), fingerprint_of(text_of()).alias("fp"))
    groups = grouped(materialise(prints, "simhash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = groups.groupBy("group").agg(first.alias("s")).select("s.row")
    return wrapped(docs, row).join(stay, "row", "left_semi").select("doc.*")
