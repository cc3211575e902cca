"""Perceptual-hash matching: known images, near duplicates, threshold sweep."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.config import HAMMING_THRESHOLD, HASH_SWEEP_THRESHOLDS
from tideguard.functions.vectors import hamming
from tideguard.operators.skew import rows_of, salted_join
from tideguard.session import materialise

# What a plan may put out: rows per hash, and its share of all pairs if any plan keeps to it.
MOST_ROWS = 1 << 13
CANDIDATE_SHARE = 0.0075
# Rows that a task makes of hashes and their flips.
TASK_ROWS = 1 << 20
# Hashes of a block of an all-pairs summary.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Band:
    """`width` bits from `start`; parts of two hashes may differ in `stored + asked` of them.

    The stored hash is entered with up to `stored` bits flipped, the other one with up to `asked`.
    """

    start: int
    width: int
    stored: int
    asked: int

    @property
    def stored_rows(self) -> int:
        rows = sum(comb(self.width, n) for n in range(self.stored + 1))
        return rows + self.asked * comb(self.width, self.stored)

    @property
    def asked_rows(self) -> int:
        return sum(comb(self.width, n) for n in range(self.asked + 1))

    @property
    def share(self) -> float:
        """The part of all pairs of random hashes that meets in this band."""
        far = comb(self.width, self.stored) * (self.asked_rows - 1)
        near = sum(comb(self.width, n) for n in range(self.stored + 1))
        return (near + far) / 2.0**self.width


def plan_bands(width: int, threshold: int, stored: int, asked: int) -> list[Band]:
    """The cheapest way to find all pairs of hashes within `threshold` bits of `width`.

    Cut in m parts, two such hashes differ in some part i by at most r_i bits if the r_i add up to
    threshold - m + 1. Few parts mean few pairs that meet by chance and many flipped entries, so
    the number of parts and who is flipped follow from the numbers of hashes on both sides. Plans
    whose chance pairs stay under CANDIDATE_SHARE come first, whatever the others would save.
    """
    if threshold >= width:
        return [Band(0, 0, 0, 0)]
    best = None
    for parts in range(1, min(width, threshold + 1) + 1):
        spare = threshold - parts + 1
        radii = [spare // parts + (i < spare % parts) for i in range(parts)]
        widths = [width // parts + (i < width % parts) for i in range(parts)]
        for flipped in range(max(radii) + 1):
            start, bands = 0, []
            for w, r in zip(widths, radii, strict=True):
                bands.append(Band(start, w, r - min(flipped, r), min(flipped, r)))
                start += w
            entries, probes = sum(b.stored_rows for b in bands), sum(b.asked_rows for b in bands)
            if max(entries, probes) > MOST_ROWS:
                continue
            share = sum(b.share for b in bands)
            cost = stored * entries + asked * probes + stored * asked * share
            key = (share > CANDIDATE_SHARE, cost)
            if best is None or key < best[0]:
                best = (key, bands)
    return best[1]


def _flips(width: int, least: int, most: int) -> list[int]:
    """All masks with `least` to `most` of `width` bits set."""
    return [
        sum(1 << b for b in bits)
        for n in range(least, most + 1)
        for bits in combinations(range(width), n)
    ]


def _part(value: Column, band: Band) -> Column:
    whole = F.shiftrightunsigned(value, band.start)
    return whole if band.width >= 64 else whole.bitwiseAND(F.lit((1 << band.width) - 1))


def _longs(masks: list[int]) -> Column:
    # As signed numbers, which is what a mask of 64 bits has to be.
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.expr("array(" + ", ".join(f"{m}L" if m > -(1 << 63) else "bigint('-9223372036854775808')" for m in signed) + ")")


def _varying(images: DataFrame, known: DataFrame) -> tuple[int, int, int]:
    """(bits in use, hashes on the left, hashes on the right)."""
    bits, counts = 0, []
    for df, name in ((images, "image_hash"), (known, "known_hash")):
        row = df.agg(F.expr(f"bit_or({name})").alias("b"), F.count(name).alias("n")).first()
        bits |= (row["b"] or 0) & ((1 << 64) - 1)
        counts.append(row["n"])
    return max(bits.bit_length(), 1), *counts


def _entered(df: DataFrame, column: str, lists: list[tuple], flip: str) -> DataFrame:
    """A row per hash and flip: (`column`, band, part, `flip`).

    `lists` has (number of the band, band, far, least, most): as many bits are flipped. A first row
    per list holds its flips as a constant and a second step makes rows of them, so Spark compiles the
    work per flip.
    """

    def per_list(number: int, band: Band, far: int, least: int, most: int) -> Column:
        return F.struct(
            F.lit(number * 64 + far).alias("band"),
            _part(F.col(column), band).alias("part"),
            _longs(_flips(band.width, least, most)).alias("flips"),
        )

    rows = df.select(column, rows_of(F.array(*[per_list(*one) for one in lists])).alias("_p"))
    rows = rows.select(column, "_p.band", "_p.part", rows_of(F.col("_p.flips")).alias(flip))
    return rows.withColumn("part", F.col("part").bitwiseXOR(F.col(flip)))


def stored_entries(known: DataFrame, bands: list[Band]) -> DataFrame:
    """(known_hash, band, part, _stored): the stored hashes under their parts, bits flipped."""
    near = [(i, b, 0, 0, b.stored) for i, b in enumerate(bands)]
    far = [(i, b, n, b.stored, b.stored) for i, b in enumerate(bands) for n in range(1, b.asked + 1)]
    return _entered(known.select("known_hash"), "known_hash", near + far, "_stored")


def spread_out(df: DataFrame, hashes: int, rows_each: int) -> DataFrame:
    """`df` in as many tasks as its rows will need once each has become `rows_each`.

    Hashes are a few bytes, so Spark would put very many of them together in one task.
    """
    return df.repartition(max(1, -(-hashes * rows_each // TASK_ROWS)))


def meetings(images: DataFrame, known: DataFrame, bands: list[Band]) -> DataFrame:
    """(image_hash, known_hash, band, _asked, _stored): the pairs that share a part of a band.

    Both sides are entered under their parts with some bits flipped and met by equality. A part
    that differs in no more bits than the stored side has flipped meets the plain part; one that
    differs in more meets the entry with all its flips, at the probe with the lowest of the
    differing bits flipped. Parts shared by many hashes are salted.
    """

    probes = _entered(
        images.select("image_hash"), "image_hash",
        [(i, b, n, n, n) for i, b in enumerate(bands) for n in range(b.asked + 1)], "_asked",
    )
    entries = stored_entries(known, bands)
    met = salted_join(
        probes, entries, ["part", "band"], F.col("image_hash"), "inner",
        expansion=sum(b.stored_rows for b in bands),
    )
    return met.withColumn("band", F.expr("band div 64"))


def candidates_within(
    images: DataFrame, known: DataFrame, threshold: int = HAMMING_THRESHOLD, bands: list[Band] | None = None
) -> DataFrame:
    """All (image_hash, known_hash, distance) with distance <= threshold, each pair once.

    Exact: see `plan_bands` and `meetings`. A band yields a pair once; a pair met in several
    bands is kept in the first only.
    """
    if bands is None:
        width, asked, stored = _varying(images, known)
        bands = plan_bands(width, threshold, stored, asked)
        images = spread_out(images, asked, sum(b.asked_rows for b in bands))
        known = spread_out(known, stored, sum(b.stored_rows for b in bands))
    met = meetings(images, known, bands)
    # The probe's flips are the lowest of the differing bits.
    lowest = F.col("_stored").bitwiseAND(-F.col("_stored"))
    canonical = (F.col("_asked") == 0) | (F.col("_stored") == 0) | (F.col("_asked") < lowest)
    differing = F.col("image_hash").bitwiseXOR(F.col("known_hash"))
    first = F.coalesce(
        *[F.when(F.bit_count(_part(differing, b)) <= b.stored + b.asked, i) for i, b in enumerate(bands)]
    )
    distance = hamming(F.col("image_hash"), F.col("known_hash"))
    return met.where((distance <= threshold) & canonical & (F.col("band") == first)).select(
        "image_hash", "known_hash", distance.alias("distance")
    )


def match_known(
    images: DataFrame,
    known: DataFrame,
    threshold: int = HAMMING_THRESHOLD,
    nearest: bool = False,
    spread: str = "image_id",
) -> DataFrame:
    """Left join of images with the known hash they match.

    `known` has known_hash, known_ord and any metadata. The first known hash in range wins,
    or with `nearest` the closest one (then the first). Images are compared once per
    distinct hash; unmatched ones keep null metadata.
    """
    meta = [c for c in known.columns if c != "known_hash"]
    one = known.groupBy("known_hash").agg(
        F.min_by(F.struct(*meta), F.col("known_ord")).alias("_meta")
    )
    distinct = images.where(F.col("image_hash").isNotNull()).select("image_hash").distinct()
    pairs = candidates_within(distinct, one, threshold).join(one, "known_hash")
    rank = F.struct("distance", "_meta.known_ord") if nearest else F.struct("_meta.known_ord")
    best = (
        pairs.groupBy("image_hash")
        .agg(F.min_by(F.struct("known_hash", "distance", "_meta"), rank).alias("_best"))
        .select(
            "image_hash", "_best.known_hash", "_best.distance", *[f"_best._meta.{c}" for c in meta]
        )
    )
    return salted_join(images, best, ["image_hash"], F.col(spread))


def references(images: DataFrame, group: str = "label", order: str = "image_id") -> DataFrame:
    """The original of every group: its first image."""
    first = F.min(F.struct(F.col(order).alias("id"), F.col("image_hash").alias("hash")))
    return (
        images.where(F.col("image_hash").isNotNull())
        .groupBy(group)
        .agg(first.alias("_first"))
        .select(group, F.col("_first.id").alias("_ref_id"), F.col("_first.hash").alias("reference"))
    )


def pair_distances(hashes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(d, n): how many pairs of the rows of `hashes(reference)` are d bits apart, each pair once.

    Rows are dealt into blocks and every pair of blocks is one group, so a group has two blocks
    whatever the number of rows; it puts out counts per distance and no pairs.
    """
    blocks = max(1, -(-hashes.count() // block_rows))
    at = F.pmod(F.xxhash64("_ref_id"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = hashes.select("reference", at.alias("at"), F.explode(every).alias("with"))
    # A block meets each block once; within a group, `first` tells the two blocks apart.
    meets = dealt.select(
        "reference", F.least("at", "with").alias("a"), F.greatest("at", "with").alias("b"),
        (F.col("at") <= F.col("with")).alias("first"),
    )

    def count(key, group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        left = group.loc[group["first"], "reference"].to_numpy(dtype="int64")
        counts = np.zeros(65, dtype="int64")
        if key[0] == key[1]:
            for i in range(len(left) - 1):
                counts += np.bincount(np.bitwise_count((left[i + 1 :] ^ left[i]).view("uint64")), minlength=65)
        else:
            right = group.loc[~group["first"], "reference"].to_numpy(dtype="int64")
            for h in left:
                counts += np.bincount(np.bitwise_count((right ^ h).view("uint64")), minlength=65)
        d = np.flatnonzero(counts)
        return pd.DataFrame({"d": d.astype("int32"), "n": counts[d]})

    found = meets.groupBy("a", "b").applyInPandas(count, "d int, n long")
    return found.groupBy("d").agg(F.sum("n").alias("n"))


def distance_counts(
    images: DataFrame, group: str = "label", order: str = "image_id", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(pairs, d, n): how many similar and how many different pairs are d bits apart.

    Similar: an image and the original of its group. Different: two originals. Images are
    never paired with each other, so the work is linear in them.
    """
    originals = materialise(references(images, group, order), "originals")
    hashed = images.where(F.col("image_hash").isNotNull())
    variants = salted_join(hashed, originals, [group], F.col(order), "inner").where(
        F.col(order) != F.col("_ref_id")
    )
    near = variants.groupBy(hamming(F.col("image_hash"), F.col("reference")).alias("d")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # A null group has an original too, but is no group to tell from the others.
    apart = pair_distances(originals.where(F.col(group).isNotNull()), block_rows)
    return near.select(F.lit("similar").alias("pairs"), "d", "n").unionByName(
        apart.select(F.lit("different").alias("pairs"), "d", "n")
    )


def distance_summary(
    images: DataFrame, group: str = "label", order: str = "image_id"
) -> DataFrame:
    """Count, min, max and mean distance of similar and of different pairs (`distance_counts`)."""
    return (
        distance_counts(images, group, order)
        .groupBy("pairs")
        .agg(
            F.sum("n").alias("n"),
            F.min("d").alias("min_distance"),
            F.max("d").alias("max_distance"),
            F.round(F.sum(F.col("d") * F.col("n")) / F.sum("n"), 4).alias("avg_distance"),
        )
    )


def threshold_sweep(
    images: DataFrame,
    group: str = "label",
    order: str = "image_id",
    thresholds: list[int] | None = None,
) -> DataFrame:
    """Recovery and false-match rate per Hamming threshold.

    Recovery: images, the originals aside, within the threshold of their own original. False
    match: pairs of two originals within it. Both are sums over `distance_counts`.
    """
    thresholds = thresholds or HASH_SWEEP_THRESHOLDS
    counts = distance_counts(images, group, order)

    def pairs(kind: str, within: Column) -> Column:
        return F.coalesce(F.sum(F.when((F.col("pairs") == kind) & within, F.col("n"))), F.lit(0))

    every = F.array(*[F.lit(t) for t in thresholds])
    rows = counts.select("*", F.explode(every).alias("threshold"))
    inside = F.col("d") <= F.col("threshold")
    sums = rows.groupBy("threshold").agg(
        pairs("similar", F.lit(True)).alias("own"),
        pairs("different", F.lit(True)).alias("other"),
        pairs("similar", inside).alias("recovered"),
        pairs("different", inside).alias("false_matches"),
    )
    return sums.select(
        "threshold", "recovered", "false_matches",
        F.round(F.col("recovered") / F.nullif(F.col("own"), F.lit(0)), 4).alias("recovery_rate"),
        F.round(F.col("false_matches") / F.nullif(F.col("other"), F.lit(0)), 4).alias("false_match_rate"),
    )


def key_collisions(df: DataFrame, content: Column, key: Column) -> DataFrame:
    """One row: rows, distinct contents, distinct keys, contents sharing a key with another."""
    pairs = df.select(key.alias("k"), content.alias("c")).groupBy("k", "c").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_key = pairs.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.sum("contents").alias("distinct_contents"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum(F.col("contents") - 1).alias("collisions"),
    )


def reuse_potential(df: DataFrame, key: str) -> DataFrame:
    """Hit rate a store without expiry would have reached on this traffic."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("requests"),
        F.sum(F.col("n") - 1).alias("hits"),
        F.count(F.lit(1)).alias("misses"),
        F.round(F.sum(F.col("n") - 1) / F.sum("n"), 4).alias("hit_rate"),
    )
