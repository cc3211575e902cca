"""Quality rules by host: a host that mostly fails takes its documents with it.

Each document gets figures of its whole text and fails or passes each rule. Failures are added
up by host; a host's rate for a rule is shrunk towards the corpus by a beta prior fitted to all
hosts (method of moments), so that a host with few documents is not judged by chance. A host
whose shrunk rate for a rule exceeds HOST_LIMIT is rejected, and its verdict is joined back.

Defined cases: a null or empty text has no words and fails by its length. Documents without a
source are one host. Equal rows each count. An empty table gives an empty result. The input's
other columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideguard.llm.common import text_of, wrapped
from tideguard.session import materialise

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
HOST_LIMIT = 0.5
# A host rate's prior weighs at least one document and at most so many.
PRIOR_WEIGHT = 1_000.0
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more.

    Windows are numbered by doubling: equal numbers for 1, 2, 4 and 8 words mean equal words,
    without hashing.
    """
    places = len(words) - window + 1
    if places < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    width = 1
    while width < window:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        _, ids = np.unique(pairs, return_inverse=True)
        width *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:places] += again
    edge[window : window + places] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def figures(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text or "") - sum(data.count(b) for b in BLANKS),
        sum(data.count(s) for s in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in FIGURES]))
def _figures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([figures(t) for t in texts], columns=FIGURES, dtype="int64")


def rules() -> dict[str, Column]:
    """What a document fails by: name of the rule, condition on the figures."""
    words = F.col("n_words")
    return {
        "too_short": words < 20,
        "repetitive": 100 * F.col("n_repeat_words") > 30 * words,
        "symbols": 10 * F.col("n_symbols") > 8 * words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
    }


BASE_RULES = ["too_short", "repetitive"]


def host_verdicts(rated: DataFrame, names: list[str]) -> DataFrame:
    """(of_host, host_rate): a host's highest shrunk rate of failure over the rules `names`.

    `rated` has `host` and one boolean column per rule.
    """
    # Hosts are counted once; everything after works on one row per host.
    counts = rated.groupBy(F.col("host").alias("of_host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in names]
    )
    counts = materialise(counts, "host-counts")
    sums = []
    for r in names:
        sums += [F.sum(r).alias(r), F.sum(F.col(r) / F.col("n") * F.col(r)).alias(f"{r}_sq")]
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *sums).first()
    rates = []
    for r in names:
        a, b = _prior(total["n"] or 0, total["hosts"], total[r] or 0, total[f"{r}_sq"] or 0.0)
        rates.append((F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)))
    return counts.select("of_host", reduce(F.greatest, rates).alias("host_rate"))


def _prior(n: int, hosts: int, failed: int, weighted_square: float) -> tuple[float, float]:
    """Beta prior (a, b) of a rule's rate over hosts, by the method of moments.

    The spread of the hosts' rates, weighted by their documents, less what chance alone makes.
    """
    mean = failed / n if n else 0.0
    noise = mean * (1 - mean)
    spread = weighted_square / n - mean * mean - noise * hosts / n if n else 0.0
    weight = noise / spread - 1 if spread > 0 else PRIOR_WEIGHT
    weight = min(max(weight, 1.0), PRIOR_WEIGHT)
    return mean * weight, (1 - mean) * weight


def _rated(rows: DataFrame) -> DataFrame:
    """`rows(doc, host, text)` with figures, rules and base_failed, without `text`."""
    rated = rows.select("doc", "host", _figures("text").alias("f")).select("doc", "host", "f.*")
    tests = rules()
    failed = reduce(lambda x, y: x | y, [tests[r] for r in BASE_RULES])
    return rated.withColumns(tests).withColumn("base_failed", failed)


def _judged(rated: DataFrame) -> DataFrame:
    """`rated` with host_rate and kept.

    The rated rows are written once; hosts are counted from them and joined back.
    """
    rated = materialise(rated, "rated", codec="zstd")
    hosts = host_verdicts(rated, list(rules()))
    judged = rated.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= HOST_LIMIT))


RESULTS = [*FIGURES, "base_failed", "host_rate", "kept"]


def host_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """`docs` with the figures, base_failed, host_rate and kept (replacing columns so named)."""
    judged = _judged(_rated(wrapped(docs, F.col(host).alias("host"), text_of().alias("text"))))
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c not in RESULTS]
    return judged.select(*own, *RESULTS)


def passing(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, as they came.

    Documents that fail a base rule go whatever their host's verdict: they count for the host,
    but are not carried along.
    """
    rated = _rated(wrapped(docs, F.col(host).alias("host"), text_of().alias("text")))
    doc = F.when(~F.col("base_failed"), F.col("doc")).alias("doc")
    return _judged(rated.select(doc, "host", *rules(), "base_failed")).where("kept").select("doc.*")


def judge_documents(docs: DataFrame) -> DataFrame:
    """The figures and verdicts of every document, without its text."""
    rows = docs.select(
        F.struct("doc_id").alias("doc"), F.col("source").alias("host"), text_of().alias("text")
    )
    rate = F.round("host_rate", 6).alias("host_rate")
    return _judged(_rated(rows)).select("doc.*", *FIGURES, "base_failed", "kept", F.col("host").alias("source"), rate)
