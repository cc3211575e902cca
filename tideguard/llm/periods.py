"""Detection of periodic runs by an online, sparse diagonal DP, and their removal.

A run is a stretch of words in which words `period` apart are equal, as long as it can be: at
least MIN_WORDS words and twice the period. On the diagonal of a lag, the places where a word
equals the one that many words before, a run is a match of at least `period` words.

The words of a text are read in order. Earlier occurrences of a word say which lags match there;
a lag that already matched has its length increased by one, one that does not match ends, and if
it is long enough its run is put out at once. Of the runs that end together and start together
the one of the smallest lag has the smallest period, the others are multiples of it.

What makes it sparse: an occurrence opens a lag only where a run can follow from it. A run's
diagonal has GRAM equal words one after the other, and for lags of at least L words L of them;
so occurrences are those of grams of GRAM words for lags below 2 * GRAM, and of grams of
L = 12, 24, 48, ... words for lags from L to 2L. Occurrences of a gram that are at most L / 2 words
apart belong together: the gram is periodic there, and lags between them belong to runs of that
smaller period. Where a match starts, either the word is the first of its occurrences that belong
together or the earlier one is the first of its own; only these open a lag, a few per word. How far
a lag matches is read in strides, so an active lag costs nothing per word until it ends.

Defined cases: a null text is empty, without words, runs or kept words. A null doc_id stays null.
Rows are judged one by one, so ties, equal rows and their order do not matter. An empty table
gives an empty result. Columns other than doc_id and text are not read. Words are compared byte
by byte; a text of any length is one row of one task, as it is in the table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import text_of

MIN_WORDS = 12
# Any run has this many matches one after the other: max(period, MIN_WORDS - period) of them.
GRAM = MIN_WORDS // 2
# Short texts are put together up to this many words, which numpy takes in one go.
TOGETHER = 1 << 18
RUNS = "array<struct<start:long,length:long,period:long>>"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words that end at each word; the first ones get none of their own."""
    h = _mixed(ids.astype(np.uint64), np.uint64(1))
    two = h.copy()
    two[1:] = _mixed(h[:-1], h[1:])
    three = two.copy()
    three[2:] = _mixed(two[1:-1], h[2:])
    six = three.copy()
    six[5:] = _mixed(three[2:-3], three[5:])
    return six


def _ranges(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every `at` with each number from its `low` up to, not including, its `high`."""
    size = np.maximum(high - low, 0)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(at, size), np.repeat(low, size) + inner


def _openings(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag), by word: the earlier occurrences from which a run can follow.

    `ids` has a number of its own before every text, so that no gram of two texts occurs twice.
    """
    n = len(ids)
    hashes, places = _grams(ids), np.arange(GRAM - 1, n)
    length, low, high, apart = GRAM, 1, 2 * GRAM, 0
    found = []
    while len(places):
        order = places[np.argsort(hashes[places], kind="stable")]
        same = hashes[order[1:]] == hashes[order[:-1]]
        twice = np.zeros(n, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        # Grams that occur once are of no use; the others are numbered.
        order = order[twice[order]]
        new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])[: len(order)]
        key = np.cumsum(new) * (4 * n) + order
        at = np.arange(len(order))
        first = new | (np.diff(order, prepend=0) > apart)
        heads = at[first]
        # A head with all that came before it, and all with the heads that came before them.
        b, a = _ranges(heads, np.searchsorted(key, key[heads] - high + 1), np.searchsorted(key, key[heads] - low, "right"))
        found.append((order[b], order[b] - order[a]))
        if apart:
            a, b = _ranges(heads, np.searchsorted(key, key[heads] + low), np.searchsorted(key, key[heads] + high))
            other = np.cumsum(first)[a] != np.cumsum(first)[b]
            found.append((order[b[other]], (order[b] - order[a])[other]))
        if high > longest:
            break
        # Grams of twice the words; both halves must occur twice.
        places = np.flatnonzero(twice[length:] & twice[:-length]) + length
        longer = np.zeros(n, dtype=np.uint64)
        longer[places] = _mixed(hashes[places - length], hashes[places])
        hashes, length = longer, 2 * length
        low, high, apart = length, 2 * length, length // 2
    at, lag = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, "int64"),) * 2
    order = np.lexsort((lag, at))
    return at[order], lag[order]


def _match(ids: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """First and last + 1 of the words around `i` that equal the ones `lag` before them."""
    end, stride = i, 32
    while True:
        some = ids[end : end + stride]
        differs = some != ids[end - lag : end - lag + len(some)]
        k = int(differs.argmax())
        if differs[k]:
            end += k
            break
        end, stride = end + len(some), 2 * stride
    start, stride = i, 32
    while True:
        low = max(start - stride, lag)
        differs = ids[low:start] != ids[low - lag : start - lag]
        k = int(differs[::-1].argmax())
        if differs[::-1][k]:
            return start - k, end
        start, stride = low, 2 * stride


def find_runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in the order in which they end.

    The first and the last of `ids` must be numbers that occur nowhere else.
    """
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}
    ends: list[tuple[int, int, int]] = []

    def close(until: int) -> None:
        while ends and ends[0][0] <= until:
            end, periods = ends[0][0], {}
            while ends and ends[0][0] == end:
                _, lag, start = heappop(ends)
                if end - start >= max(lag, MIN_WORDS - lag):
                    periods.setdefault(start - lag, lag)
                if active.get(lag) == end:
                    del active[lag]
            runs.extend((start, end - start, lag) for start, lag in periods.items())

    at, lags = _openings(ids, longest or len(ids))
    for i, lag in zip(at.tolist(), lags.tolist(), strict=True):
        close(i)
        if lag not in active and ids[i] == ids[i - lag]:
            start, end = _match(ids, i, lag)
            active[lag] = end
            heappush(ends, (end, lag, start))
    close(len(ids))
    return runs


def _together(texts: list[bytes], most: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first text, words of each) of stretches of texts with about `most` words."""
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        # Split on ASCII white space, which is what parts words here.
        held.append((text or b"").split())
        n += len(held[-1])
        if n >= most:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def _judged(texts: list[list[bytes]]) -> Iterator[tuple[list, bytes]]:
    """Runs by start and period, and the kept words joined, of each text's words."""
    numbers = defaultdict(count().__next__)
    parts, starts, at = [np.array([-1])], [], 1
    for k, words in enumerate(texts):
        starts.append(at)
        parts += [np.fromiter(map(numbers.__getitem__, words), "int64", len(words)), np.array([-2 - k])]
        at += len(words) + 1
    by_text = defaultdict(list)
    edges = np.array(starts)
    for start, length, period in find_runs(np.concatenate(parts), max(map(len, texts))):
        k = int(np.searchsorted(edges, start, side="right")) - 1
        by_text[k].append((start - starts[k], length, period))
    for k, words in enumerate(texts):
        runs = sorted(by_text[k], key=lambda r: (r[0], r[2]))
        if runs:
            kept = np.ones(len(words), dtype=bool)
            for start, length, period in runs:
                kept[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(kept)]
        yield runs, b" ".join(words)


def collapse_runs(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """doc_id, `runs` (start, length, period; by start, then period) and `collapsed`.

    `collapsed` is the text without the words that repeat: of every run only the first period
    stays. Its words are joined by single spaces.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        names = ["start", "length", "period"]
        for batch in batches:
            for first, texts in _together(batch.column(1).to_pylist(), together):
                runs, kept = zip(*_judged(texts), strict=True)
                rows = [[dict(zip(names, r, strict=True)) for r in some] for some in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(rows, run), pa.array(kept, pa.binary())],
                    ["doc_id", "runs", "collapsed"],
                )

    read = docs.select("doc_id", text_of().cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = read.mapInArrow(collapse, f"doc_id {kind}, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_from(words: Column, start: Column, period: Column) -> Column:
    """`words`, from number `start` (from 0) on replaced by its first `period` words over and over."""
    tail = F.size(words) - start
    unit = F.slice(words, start + 1, period)
    times = F.ceil(tail / period).cast("int")
    return F.concat(
        F.slice(words, F.lit(1), start), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), tail)
    )


def digests(collapsed: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of the rows of `collapse_runs`."""

    # Greatest length first, ties by start, then period.
    def rank(r: Column) -> Column:
        return F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))

    top = F.array_min(F.transform("runs", rank))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = collapsed.withColumn("_top", top)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.start").alias("start"),
        (-F.col("_top.l")).alias("length"),
        F.col("_top.period").alias("period"),
        F.expr("1000 * -_top.l div _top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of `docs`, every tenth text (by CRC 32 of the number) made periodic.

    From word a = g % n on, it repeats p = 1 + (n - a) div (3 + g % 8) words, g being the CRC
    over 10. The words of those texts are joined by single spaces. A null doc_id has no CRC and
    its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Bytes other than ASCII white space, so no word is torn or joined.
    words = F.filter(F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w"), F.floor(h / 10).alias("_g"))
    a = (F.col("_g") % F.size("_w")).cast("int")
    sized = split.withColumn("_a", F.when(F.size("_w") > 0, a))
    period = (1 + F.floor((F.size("_w") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    again = F.array_join(repeated_from(F.col("_w"), F.col("_a"), period), " ")
    return sized.select("doc_id", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text")).alias("text"))
