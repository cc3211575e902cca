"""Removal of long repeated passages by common-prefix intervals of an enhanced suffix array.

A string of LENGTH bytes that occurs twice has the same bytes, so a rule that picks places by
their bytes picks the same place in both: anchors are the places with the smallest hash of the
GRAM bytes that start there, in each stretch of LENGTH bytes. Only anchors whose hash occurs
again can lie in a repeat, and only their suffixes go into the suffix array, partitioned by that
hash and sorted by Spark.

Within a hash, suffixes that share a prefix are neighbours. A scan with a stack turns the lengths
shared by neighbours into intervals, the nodes of the suffix tree. In each node the bytes before
the anchors, read backwards, are sorted and scanned in the same way: an interval there that
holds more than one child of the node can be extended neither to the right (the children
differ) nor to the left (the interval's members differ) and is a maximal repeat, with all of its
occurrences. What is covered by repeats of at least LENGTH bytes goes.

An anchor sees LENGTH bytes to the right and as many to the left as any stretch around it can
hold; longer repeats have anchors all along. Equal contexts are scanned once. A hash with more
than CROWD different contexts is not gathered: every stretch around its anchors is hashed and
counted instead, which gives the same bytes in proportion to the contexts.

Defined cases: a null text is empty; texts shorter than LENGTH are kept whole. Of equal texts of
at least LENGTH bytes all are removed whole, as each repeats the others; they are scanned once.
An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideguard.llm.common import text_of
from tideguard.session import materialise, scratch_path

LENGTH = 400
GRAM = 96
CROWD = 200_000
# Contexts whose bytes a task remembers to have sent.
REMEMBERED = 200_000
# Bytes whose anchors are looked for at once; positions take 20 bits.
CHUNK = 1 << 20
KEY = ["k0", "k1"]
FACTOR = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of FACTOR and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def until(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._row(f, size) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(factor: int, size: int) -> np.ndarray:
        row = np.full(size, factor, np.uint64)
        row[0] = 1
        return np.cumprod(row, dtype=np.uint64)


POWERS = Powers()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on; equal bytes have equal hashes."""
    up, down = POWERS.until(len(data))
    sums = np.cumsum(data * up, dtype=np.uint64)
    hashes = sums[gram - 1 :].copy()
    hashes[1:] -= sums[: len(data) - gram]
    hashes *= down[: len(hashes)]
    hashes ^= hashes >> np.uint64(32)
    hashes *= MIX
    hashes ^= hashes >> np.uint64(29)
    return hashes


def picked(part: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each place, place picked for each stretch): the leftmost of the smallest hash."""
    wide = length - gram + 1
    found = gram_hashes(part.astype(np.uint64), gram)
    # The place makes equal hashes differ, so that the leftmost is the smallest.
    least = (found & ~np.uint64(CHUNK - 1)) | np.arange(len(found), dtype=np.uint64)
    done = 1
    while done * 2 <= wide:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < wide:
        least = np.minimum(least[: len(least) - (wide - done)], least[wide - done :])
    return found, (least & np.uint64(CHUNK - 1)).astype(np.int64)


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): for each stretch of `length` bytes the place with the smallest hash."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low in range(0, len(data) - length + 1, CHUNK - length + 1):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - low), low)
        found, at = picked(part, length, gram)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        places.append(at + low)
        hashes.append(found[at])
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common from the start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of suffixes that share `length` bytes.

    `common[i]` is what suffixes i and i + 1 share. A stack holds the intervals that are open;
    a shorter length closes those that are longer, so inner intervals come before outer ones.
    """
    stack: list[tuple[int, int]] = []
    for i, n in enumerate([*common, -1]):
        start = i
        while stack and stack[-1][0] > n:
            length, start = stack.pop()
            yield length, start, i
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, start))


def maximal_repeats(
    rights: list[bytes], lefts: list[bytes], length: int = LENGTH
) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of the maximal repeats of at least `length` bytes around an anchor.

    `rights` are sorted; `lefts` are the bytes before the anchors, read backwards. `left` and
    `right` count the bytes of the repeat before and from the anchor on.
    """
    common = [shared(a, b) for a, b in zip(rights, rights[1:], strict=False)]
    rank = {i: k for k, i in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    for right, first, last in intervals(common):
        need = length - right
        # Neighbours that share no more than the node's length are in different children.
        child, number = {first: 0}, 0
        for i in range(first, last):
            number += common[i] == right
            child[i + 1] = number
        members = sorted(range(first, last + 1), key=rank.__getitem__)
        before = [shared(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        if max(before) < need:
            continue
        for left, low, high in intervals(before):
            if left < need:
                continue
            group = members[low : high + 1]
            if any(child[i] != child[group[0]] for i in group):
                yield left, right, group


def around(rights: list[bytes], lefts: list[bytes], copies: list[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """For each distinct context the bytes before and from the anchor on that repeats cover.

    0, 0: none. `copies` says how often a context occurs. All repeats hold the anchor's bytes, so
    together they cover one run.
    """
    before, after = [0] * len(rights), [0] * len(rights)
    for k, n in enumerate(copies):
        if n > 1 and len(rights[k]) + len(lefts[k]) >= length:
            before[k], after[k] = len(lefts[k]), len(rights[k])
    if len(rights) > 1:
        for left, right, members in maximal_repeats(rights, lefts, length):
            for k in members:
                before[k], after[k] = max(before[k], left), max(after[k], right)
    return before, after


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap, joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _digest_key(sha: str):
    """128 bits of a hex digest as two numbers."""
    return [
        F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long").alias(k) for i, k in enumerate(KEY)
    ]


def _bucketed(spark: SparkSession, texts: DataFrame) -> str:
    """Writes `texts` as a table bucketed by key, so that joins by key do not move the texts."""
    path = scratch_path(spark, "texts")
    name = "llm_" + path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
    return name


def _find_anchors(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for low in range(0, len(batch), 500):
            out = []
            part = batch.iloc[low : low + 500]
            for k0, k1, data in zip(part["k0"], part["k1"], part["data"], strict=True):
                at, found = anchors(data)
                out.append((np.full(len(at), k0), np.full(len(at), k1), at, found.view(np.int64)))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pd.DataFrame(dict(zip(["k0", "k1", "place", "h"], columns, strict=True)))


def _contexts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every anchor with its context's digest; the bytes only where the task first meets them.

    Periodic text has an anchor in every period, nearly all with one context.
    """
    reach, sent = LENGTH - GRAM, set()
    for batch in batches:
        for k0, k1, data, hits in zip(batch["k0"], batch["k1"], batch["data"], batch["hits"], strict=True):
            if len(sent) > REMEMBERED:
                sent.clear()
            rows = []
            for x in hits:
                at = x["place"]
                right, left = data[at : at + LENGTH], data[max(0, at - reach) : at][::-1]
                c = hashlib.blake2b(left, digest_size=16, key=len(left).to_bytes(4, "big"))
                c.update(right)
                c = c.digest()
                rows.append((x["h"], k0, k1, at, c, *((None, None) if c in sent else (right, left))))
                sent.add(c)
            yield pd.DataFrame(rows, columns=["h", "k0", "k1", "place", "c", "rights", "lefts"])


def _scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is covered around sorted contexts; those of one hash are at most CROWD."""

    def rows():
        for b in batches:
            yield from zip(b["h"], b["c"], b["rights"], b["lefts"], b["copies"], strict=True)

    out = []
    for _, group in groupby(rows(), key=lambda r: r[0]):
        _, names, rights, lefts, copies = map(list, zip(*group, strict=True))
        found = zip(names, *around(rights, lefts, copies), strict=True)
        out += [r for r in found if r[1] + r[2]]
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["c", "before", "after"])
            out = []
    yield pd.DataFrame(out, columns=["c", "before", "after"])


def _stretches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stretches of LENGTH bytes that picked the context's anchor, by digest and distance.

    A stretch belongs to the one anchor that it picked, so it is counted once.
    """
    for b in batches:
        for c, right, left, copies in zip(b["c"], b["rights"], b["lefts"], b["copies"], strict=True):
            data = left[::-1] + right
            if len(data) < LENGTH:
                continue
            _, at = picked(np.frombuffer(data, np.uint8), LENGTH, GRAM)
            rows = [
                (hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest(), c, copies, len(left) - i)
                for i in np.flatnonzero(at == len(left)).tolist()
            ]
            yield pd.DataFrame(rows, columns=["digest", "c", "copies", "before"])


def _cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for k0, k1, data, spans in zip(batch["k0"], batch["k1"], batch["data"], batch["spans"], strict=True):
            runs = merged((s["start"], s["stop"]) for s in spans)
            kept, at = hashlib.sha256(), 0
            for start, stop in runs:
                kept.update(data[at:start])
                at = stop
            kept.update(data[at:])
            out.append((k0, k1, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "stop": b} for a, b in runs]))
        yield pd.DataFrame(out, columns=["k0", "k1", "n_removed", "n_spans", "kept", "runs"])


def repeated_spans(texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(k0, k1, start, stop): covered bytes of `texts(k0, k1, text)`, spans of one text may overlap."""
    data = texts.select(*KEY, F.col("text").cast("binary").alias("data"))
    found = materialise(data.mapInPandas(_find_anchors, "k0 long, k1 long, place long, h long"), "anchors")
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    hits = found.join(again, "h").groupBy(*KEY).agg(F.collect_list(F.struct("place", "h")).alias("hits"))
    columns = "h long, k0 long, k1 long, place long, c binary, rights binary, lefts binary"
    suffixes = materialise(data.join(hits, KEY).mapInPandas(_contexts, columns), "suffixes")
    # Equal contexts are reduced before the shuffle: each occurs once in what follows.
    contexts = suffixes.groupBy("h", "c").agg(
        F.max("rights").alias("rights"), F.max("lefts").alias("lefts"), F.count(F.lit(1)).alias("copies")
    )
    contexts = materialise(contexts, "contexts")
    crowds = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("h")
    crowds = materialise(crowds, "crowds")
    few = contexts.join(crowds, "h", "left_anti") if crowds.take(1) else contexts
    covered = few.repartition("h").sortWithinPartitions("h", "rights", "lefts").mapInPandas(
        _scan, "c binary, before long, after long"
    )
    if crowds.take(1):
        many = contexts.join(crowds, "h", "left_semi").select("c", "rights", "lefts", "copies")
        stretches = materialise(many.mapInPandas(_stretches, "digest binary, c binary, copies long, before long"), "stretches")
        twice = stretches.groupBy("digest").agg(F.sum("copies").alias("n")).where("n > 1").select("digest")
        covered = covered.unionByName(
            stretches.join(twice, "digest").groupBy("c").agg(
                F.max("before").alias("before"), (F.lit(LENGTH) - F.min("before")).alias("after")
            )
        )
    spans = suffixes.select(*KEY, "place", "c").join(covered, "c")
    return spans.select(*KEY, (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("stop"))


def without_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans removed, of every document."""
    spark = docs.sparkSession
    data = text_of()
    named = docs.select(
        F.col("doc_id").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"),
        F.sha2(data.cast("binary"), 256).alias("sha"), data.alias("text"),
    )
    listed = materialise(named.select("doc_id", "n_bytes", "sha"), "digests")
    long_texts = named.where(F.col("n_bytes") >= LENGTH).select(*_digest_key("sha"), "text")
    # Equal texts are reduced before the shuffle, so a text with very many copies is no hot key.
    texts = long_texts.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = _bucketed(spark, texts)
    stored = spark.table(name)
    spans = repeated_spans(stored.select(*KEY, "text"), crowd)
    by_text = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    single = stored.where("copies = 1").select(*KEY, F.col("text").cast("binary").alias("data"))
    runs = "array<struct<start long, stop long>>"
    parts = single.join(by_text, KEY).mapInPandas(
        _cut, f"k0 long, k1 long, n_removed long, n_spans long, kept string, runs {runs}"
    )
    whole = stored.where("copies > 1").select(
        *KEY, F.lit(True).alias("all"), F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("long").alias("n_spans"),
        F.lit(None).cast("string").alias("kept"), F.lit(None).cast(runs).alias("runs"),
    )
    changed = materialise(parts.withColumn("all", F.lit(False)).unionByName(whole), "removed")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    keyed = listed.select("*", *_digest_key("sha"))
    out = keyed.join(changed, KEY, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    is_all = F.coalesce("all", F.lit(False))
    return out.select(
        "doc_id", "n_bytes",
        F.when(is_all, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(is_all, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(is_all, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(is_all, everything).otherwise(F.coalesce("runs", F.array().cast(runs))).alias("removed"),
    )
