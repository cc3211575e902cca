"""Sum-of-squares packing of token pieces into sequences of fixed length.

Documents are tokenized in Arrow batches and cut into pieces; pieces shorter than a sequence are
dealt evenly over packers. A packer puts each piece where the sum over all residual gaps of the
squared number of open bins with that gap becomes smallest, which keeps open bins of many
different gaps and so leaves few of them half full. Bins still open when all pieces are placed
are emptied and packed once more by best fit, as nothing comes any more that variety would serve.

Defined cases: a null text is empty and has the end token only. Equal rows are packed each on
its own. An empty table gives an empty result. Pieces of full length are sequences by themselves.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import text_of
from tideguard.session import materialise

SEQUENCE = 1_024
END = 2
# Pieces that one packer places, on average.
PACKER_PIECES = 100_000
SPACES = re.compile(r"\s\s")


class Tokenizer:
    """Token ids by a byte-level BPE given as ranks, the way `tokenizers` cuts the text.

    The pattern's look-ahead only matters where white space follows white space. Texts without
    that are cut by the pattern less this branch, which runs about twice as fast. The texts of
    special tokens, of which `specials_file` (the same vocabulary as JSON) has the ids, are cut out
    first and are those tokens.
    """

    def __init__(self, ranks_file: str, specials_file: str | None = None):
        import public_tokenizers
        import tiktoken

        self.specials: dict[str, int] = {}
        if specials_file:
            with open(specials_file, encoding="utf-8") as f:
                self.specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
        # Longer ones first, should one begin with another.
        texts = sorted(self.specials, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, texts)) + ")") if texts else None

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = public_tokenizers.PATTERN
        self.full, self.fast = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for name, pattern in (("full", whole), ("fast", whole.replace(r"\s+(?!\S)|", "")))
        )

    def encode(self, text: str) -> list[int]:
        if self.cuts and self.cuts.search(text):
            ids = []
            for part in self.cuts.split(text):
                ids += [self.specials[part]] if part in self.specials else self._ordinary(part)
            return ids
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        return (self.full if SPACES.search(text) else self.fast).encode_ordinary(text)


_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}


def specials_of(ranks_file: str) -> str:
    """The JSON form of a vocabulary, beside its ranks."""
    return ranks_file.removesuffix(".tiktoken") + ".json"


def tokenizer(ranks_file: str) -> Tokenizer:
    """One per worker process."""
    files = ranks_file, specials_of(ranks_file)
    if files not in _TOKENIZERS:
        _TOKENIZERS[files] = Tokenizer(*files)
    return _TOKENIZERS[files]


def cut(n_ids: int, length: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, if it is too long."""
    first = (n_ids - 1) % length + 1
    return [(0, first)] + [(at, length) for at in range(first, n_ids, length)]


def pieces(docs: DataFrame, ranks_file: str, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(ranks_file)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = array("I", encoder.encode(text))
                ids.append(END)
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    own = np.asarray(ids[start : start + n], "<u4")
                    row = (doc_id, k, start, n, zlib.crc32(own.tobytes()))
                    out.append((*row, own.astype(np.int32)) if with_ids else row)
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInPandas(rows, schema)


def place(lengths: Iterable[int], capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(bin, offset) of every piece, in the order given, by the sum-of-squares rule.

    Putting a piece of size s in a bin with gap g changes the sum by
    2 * (open[g - s] - open[g] + 1), a new bin by 2 * open[capacity - s] + 1; full bins do not
    count. Ties go to the smallest gap that is left.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = [], 0
    for s in lengths:
        after = open_bins[: capacity - s + 1]
        change = 2 * (after - open_bins[s:]) + 2
        change[0] -= 1  # the bin is full and leaves the sum
        change[open_bins[s:] == 0] = 1 << 60
        change[capacity - s] = 2 * after[capacity - s] + 1 if s < capacity else 0
        left = int(change.argmin())
        if left == capacity - s:
            number, bins = bins, bins + 1
        else:
            number = waiting[left + s].pop()
            open_bins[left + s] -= 1
        out.append((number, capacity - s - left))
        if left:
            open_bins[left] += 1
            waiting[left].append(number)
    return out


def refit(lengths: list[int], places: list[tuple[int, int]], capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """`places` with the pieces of all bins that are not full packed again by best fit.

    Kept only if it takes fewer bins.
    """
    filled: dict[int, int] = defaultdict(int)
    for s, (number, _) in zip(lengths, places, strict=True):
        filled[number] += s
    open_bins = sorted(b for b, n in filled.items() if n < capacity)
    loose = [i for i, (b, _) in enumerate(places) if filled[b] < capacity]
    loose.sort(key=lambda i: (-lengths[i], i))
    gaps: list[tuple[int, int]] = []
    new: dict[int, tuple[int, int]] = {}
    used = 0
    for i in loose:
        at = bisect_left(gaps, (lengths[i], -1))
        if at < len(gaps):
            gap, number = gaps.pop(at)
        elif used == len(open_bins):
            return places
        else:
            gap, number = capacity, open_bins[used]
            used += 1
        new[i] = (number, capacity - gap)
        if gap > lengths[i]:
            insort(gaps, (gap - lengths[i], number))
    return [new.get(i, p) for i, p in enumerate(places)]


def pack(cut_pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """`cut_pieces` with sequence_id and offset."""
    columns = ", ".join(f"{n} {t}" for n, t in cut_pieces.dtypes)

    def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(batches)
        if not own:
            return
        # The same order whatever order the rows came in; the largest first.
        rows = pd.concat(own).sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        sizes = rows["length"].tolist()
        at = np.array(refit(sizes, place(sizes, length), length), np.int64).reshape(-1, 2)
        number = TaskContext.get().partitionId() << 33
        yield rows.assign(sequence_id=number + at[:, 0], offset=at[:, 1])

    short = cut_pieces.where(F.col("length") < length)
    packers = max(1, math.ceil(short.count() / PACKER_PIECES))
    dealt = short.repartition(packers).mapInPandas(packed, f"{columns}, sequence_id long, offset long")
    full = cut_pieces.where(F.col("length") == length)
    alone = -1 - F.monotonically_increasing_id()
    return dealt.unionByName(full.select("*", alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order; `packed` must hold the ids. At most one sequence a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, ranks_file: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(materialise(pieces(docs, ranks_file), "pieces"))
