"""Line dedup by an exact set-similarity join.

A line is the set of its words. The words of a line are ordered by rarity in the corpus, rarest
first. Two lines whose Jaccard similarity reaches 0.8 share a word within their first words (the
prefix), so prefixes are joined by word; of the shorter line half the prefix is enough, as it
shares eight ninths of its words. Pairs are dropped where the lengths, the places of the
shared word, or a parity sketch of the sets rule the similarity out. What is left is verified on
the words themselves, and the later line of each match is removed. Later means by document
number (null last), then by row and place in the text. Rows are told apart by their place in
the stored table.

Rarity comes from counts of all words in a table of fixed size. It only has to be one order for
all lines, so words that share a counter cost time, never results.

Lines with equal sets are one line in the join: the first stays, the others are removed. A word
in the half prefixes of more than CROWD lines (a crowd of near copies) first compares each line with
the word's first line only, which settles nearly all of a crowd in proportion to its size; only
pairs in which a line is still unsettled go through the full join.

Defined cases: lines without words are never removed; a null text has no lines and stays null. A
document may lose all its lines and stays, with an empty text. Repeated rows lose the lines of
the later row. An empty table gives an empty result. Columns other than doc_id and text are kept
by `without_repeated_lines` as they are, but for `n_chars`, which is counted again. A text of very
many lines is one row, split once where its lines are needed again.

Everything is DataFrame functions; `docs` is read several times and must be a stored Parquet table.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import SPACE, place_of, text_of, words_of, wrapped
from tideguard.session import materialise

# Jaccard similarity of 4/5: shared words o of lines of x and y words reach it if 9 o >= 4 (x + y).
COUNTERS = 1 << 18
# Lines above this many words need SHARED common prefix words, which lengthens the prefix by as many.
LONG, SHARED = 200, 3
# Lines up to this many words use one half of the sketch, where it still tells sets apart.
SHORT = 64
CROWD = 500
FLAGS = 1 << 20


def _words(text: Column) -> Column:
    """Words of a line, with empty ones where white space does not stand alone.

    Nearly all lines have single spaces only, for which Spark's split needs no pattern.
    """
    other = [F.contains(text, F.lit(c)) for c in "\t\n\x0b\x0c\r"]
    return F.when(reduce(Column.__or__, other), F.split(text, SPACE)).otherwise(F.split(text, " "))


def rarity_ranks(docs: DataFrame) -> str:
    """For each counter a rank from 0 to 31 that grows with the count of its words; as JSON.

    COUNTERS numbers, whatever the size of the corpus.
    """
    words = F.split(F.replace(text_of(), F.lit("\n"), F.lit(" ")), " ")
    counted = (
        docs.select(F.explode(words).alias("word"))
        .groupBy(F.xxhash64("word").bitwiseAND(COUNTERS - 1).alias("counter"))
        .agg(F.least(F.floor(F.log2(F.count(F.lit(1)))), F.lit(31)).cast("int").alias("rank"))
    )
    every = docs.sparkSession.range(COUNTERS).withColumnRenamed("id", "counter").join(counted, "counter", "left")
    inside = F.sort_array(F.collect_list(F.struct("counter", F.coalesce("rank", F.lit(0)).alias("rank"))))
    parts = every.groupBy(F.floor(F.col("counter") / 1_024).alias("part")).agg(
        F.array_join(F.transform(inside, lambda x: x["rank"].cast("string")), ",").alias("ranks")
    )
    return "[" + ",".join(r["ranks"] for r in sorted(parts.collect())) + "]"


@contextmanager
def _short_plan_texts(spark):
    """Keeps the table of ranks, a literal, out of the texts that Spark makes of plans."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _prefix_length(n: Column) -> Column:
    return F.least(n, n - F.ceil(n * 4 / 5) + F.when(n > LONG, SHARED).otherwise(1)).cast("int")


def _in_short_prefix() -> Column:
    """Whether the word at `place` counts for the shorter line of a pair, which shares 8/9 of its words."""
    n = F.col("n")
    return F.col("place") <= n - F.ceil(n * 8 / 9) + F.when(n > LONG, SHARED).otherwise(1)


def line_sets(docs: DataFrame, ranks: str) -> DataFrame:
    """Of `docs(row, doc_id, text)`: id, row, doc, line, n (words), key, s0, s1 (sketch) and prefix of every line with words."""
    lines = docs.select(
        "row", F.col("doc_id").cast("long").alias("doc"), text_of().alias("text")
    ).select("row", "doc", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    table = F.from_json(F.lit(ranks), "array<bigint>")
    hashes = F.array_remove(
        F.array_distinct(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))
    )

    def rank(h: Column) -> Column:
        # Never null, so that Spark sorts the packed words as plain numbers.
        return F.coalesce(F.get(table, h.bitwiseAND(COUNTERS - 1).cast("int")), F.lit(0).cast("long"))

    # Rank in the high bits, hash below: sorted numbers are in order of rarity.
    packed = F.transform(hashes, lambda h: F.shiftleft(rank(h), 58).bitwiseOR(F.shiftrightunsigned(h, 6)))
    sets = lines.select("row", "doc", "line", F.sort_array(packed).alias("words"))

    def parity(half: bool) -> Column:
        """Bits by the last six digits, of all words or of those whose seventh digit is set."""
        one = F.lit(1).cast("long")

        def flipped(s: Column, t: Column) -> Column:
            bit = F.shiftright(t, 6).bitwiseAND(1) if half else one
            return s.bitwiseXOR(F.call_function("shiftleft", bit, t.bitwiseAND(63).cast("int")))

        return F.aggregate("words", F.lit(0).cast("long"), flipped)

    n = F.size("words")
    return sets.select(
        F.monotonically_increasing_id().alias("id"), "row", "doc", "line", n.alias("n"), F.xxhash64("words").alias("key"),
        parity(False).alias("s0"), F.when(n <= SHORT, 0).otherwise(parity(True)).cast("long").alias("s1"),
        F.transform(F.slice("words", F.lit(1), _prefix_length(n)), lambda t: t.bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefix"),
    )


def may_match(x: str, y: str) -> Column:
    """Length, positional and sketch filters on a shared prefix word of x and y."""
    nx, ny, px, py = (F.col(f"{s}.{c}") for c in ("n", "place") for s in (x, y))
    total = nx + ny
    fits = 5 * F.least(nx, ny) >= 4 * F.greatest(nx, ny)
    reachable = F.least(px, py) + F.least(nx - px, ny - py)
    s0, s1 = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("s0", "s1"))
    folded, full = F.bit_count(s0), F.bit_count(s0.bitwiseXOR(s1)) + F.bit_count(s1)
    differing = F.when(F.least(nx, ny) <= SHORT, folded).otherwise(full)
    return fits & (9 * reachable >= 4 * total) & (9 * differing <= total)


def _enough(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) that share as many prefix words as their lengths ask for."""
    shared = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n"))
    return shared.where((F.col("words") >= SHARED) | (F.col("n") <= LONG)).select("x", "y")


def _verified(docs: DataFrame, lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, row, line): the later line of each of `pairs(x, y)` that reaches the similarity."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    wanted = materialise(lines.select("id", "row", "doc", "line").join(ids, "id"), "wanted")
    # Which rows may be wanted, as bits: only their texts are moved.
    flag = F.pmod(F.xxhash64("row"), F.lit(FLAGS))
    words = F.sort_array(F.collect_list(F.struct("word", "bits")))
    flags = (
        wanted.select(flag.alias("flag")).distinct()
        .groupBy(F.floor(F.col("flag") / 63).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(flag % 63 as int)))").alias("bits"))
    )
    every = docs.sparkSession.range(FLAGS // 63 + 1).withColumnRenamed("id", "word")
    filled = every.join(flags, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    table = filled.agg(F.transform(words, lambda x: x["bits"]).alias("bits")).scalar()
    texts = docs.select("row", text_of().alias("text"))
    bits = F.get(table, F.floor(flag / 63).cast("int"))
    texts = texts.where(F.call_function("shiftright", bits, (flag % 63).cast("int")).bitwiseAND(1) == 1)
    # One row per document, its text split once as a value of a lambda, whatever the lines wanted.
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("id", "doc", "line")).alias("wanted"))

    def picked(lines: Column) -> Column:
        def one(w: Column) -> Column:
            return F.struct(w["id"].alias("id"), w["doc"].alias("doc"), w["line"].alias("line"), F.get(lines, w["line"]).alias("text"))

        return F.transform("wanted", one)

    here = F.transform(F.array(F.split("text", "\n")), picked)[0]
    cut = by_row.join(texts, "row").select("row", F.explode(here).alias("w"))
    order = F.struct(F.coalesce("w.doc", F.lit((1 << 63) - 1)).alias("doc"), "row", "w.line")
    sets = cut.select("w.id", order.alias("at"), F.array_distinct(words_of(F.col("w.text"))).alias("words"))
    sets = materialise(sets, "wanted-sets")
    x = sets.select(F.col("id").alias("x"), F.col("at").alias("ax"), F.col("words").alias("wx"))
    y = sets.select(F.col("id").alias("y"), F.col("at").alias("ay"), F.col("words").alias("wy"))
    both = pairs.join(x, "x").join(y, "y")
    shared = F.size(F.array_intersect("wx", "wy"))
    alike = both.where(9 * shared >= 4 * (F.size("wx") + F.size("wy")))

    def line(end: str) -> Column:
        return F.struct(F.col(end).alias("id"), F.col(f"a{end}.row").alias("row"), F.col(f"a{end}.line").alias("line"))

    later = F.when(F.col("ax") < F.col("ay"), line("y")).otherwise(line("x"))
    return alike.select(later.alias("later")).select("later.*").distinct()


def _packed(words: DataFrame) -> DataFrame:
    """n, place and settled of `words` as one number: rows of the join are moved and sorted, and made short."""
    n, place = F.col("n").cast("long"), F.col("place").cast("long")
    sizes = F.shiftleft(n, 32).bitwiseOR(F.shiftleft(place, 1)).bitwiseOR(F.col("settled").cast("long"))
    return words.select("id", "word", "s0", "s1", sizes.alias("sizes"))


def _unpacked(end: str) -> Column:
    sizes = F.col(f"{end}.sizes")
    return F.struct(
        F.col(f"{end}.id").alias("id"), F.col(f"{end}.s0").alias("s0"), F.col(f"{end}.s1").alias("s1"),
        F.shiftright(sizes, 32).alias("n"), F.shiftright(sizes.bitwiseAND(0xFFFFFFFF), 1).alias("place"),
        (sizes.bitwiseAND(1) == 1).alias("settled"),
    ).alias(end)


def repeated_lines(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(row, line): the lines to remove; `row` is place_of `docs`."""
    docs = docs.select(place_of(docs).alias("row"), "doc_id", "text")
    with _short_plan_texts(docs.sparkSession):
        lines = materialise(line_sets(docs, rarity_ranks(docs)), "lines").where("n > 0")
    same = ["key", "n", "s0", "s1"]
    order = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), "row", "line", "id")
    sets = lines.groupBy(*same).agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("prefix").alias("prefix")
    )
    sets = materialise(sets.select(*same, "first.doc", "first.id", "copies", "prefix"), "line-sets")
    several = sets.where("copies > 1").select(*same, F.col("id").alias("first"))
    copies = lines.select("id", "row", "line", *same).join(several, same).where("id != first").select("row", "line")

    words = sets.where("n > 3").select(
        "id", "doc", "n", "s0", "s1", F.posexplode("prefix").alias("place", "word")
    ).withColumn("place", F.col("place") + 1)
    settled = _settle_crowds(docs, lines, words, crowd)
    if settled is None:
        marked = words.withColumn("settled", F.lit(False))
    else:
        marks = settled.select("id", F.lit(True).alias("settled"))
        marked = words.join(marks, "id", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    x, y = _packed(marked.where(_in_short_prefix())), _packed(marked)
    shorter = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    pairs = (
        x.alias("x").join(y.alias("y"), F.col("x.word") == F.col("y.word"))
        .select(_unpacked("x"), _unpacked("y"))
        .where(shorter & ~(F.col("x.settled") & F.col("y.settled")) & may_match("x", "y"))
        .select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.col("x.n").alias("n"))
    )
    pairs = materialise(_enough(pairs), "pairs")
    later = _verified(docs, lines, pairs)
    if settled is not None:
        later = later.unionByName(settled).distinct()
    return copies.unionByName(later.select("row", "line"))


def _settle_crowds(docs: DataFrame, lines: DataFrame, words: DataFrame, crowd: int) -> DataFrame | None:
    """(id): lines that match the first line of a crowded word; None if no word is crowded."""
    doc = F.coalesce("doc", F.lit((1 << 63) - 1))
    # Numbers only, which Spark counts without sorting; the first line is then looked up for these words.
    short = words.where(_in_short_prefix())
    counted = short.groupBy("word").agg(F.count(F.lit(1)).alias("lines"), F.min(doc).alias("least"))
    counted = materialise(counted.where(F.col("lines") > crowd).select("word", "least"), "crowded-words")
    if not counted.take(1):
        return None
    order = F.struct("id", "n", "place", "s0", "s1")
    of_least = short.join(counted, "word").where(doc == F.col("least"))
    crowded = materialise(of_least.groupBy("word").agg(F.min(order).alias("first")).select("word", "first.*"), "crowded")
    pairs = (
        crowded.alias("x").join(words.alias("y"), F.col("x.word") == F.col("y.word"))
        .where((F.col("x.id") != F.col("y.id")) & may_match("x", "y"))
        .select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.least("x.n", "y.n").alias("n"))
    )
    return materialise(_verified(docs, lines, materialise(_enough(pairs), "crowd-pairs")), "settled")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the lines removed (from 0) of every document."""
    rows = docs.select(
        place_of(docs).alias("row"), "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
    )
    gone = _by_row(repeated_lines(docs))
    none = F.array().cast("array<int>")
    return rows.join(gone, "row", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("gone", none).alias("removed"),
    )


def _by_row(removed: DataFrame) -> DataFrame:
    return removed.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the lines that repeat earlier ones."""
    gone = _by_row(repeated_lines(docs)).withColumnRenamed("row", "of_row")
    rows = wrapped(docs, place_of(docs).alias("row"))
    joined = rows.join(gone, F.col("row") == F.col("of_row"), "left")

    def kept_of(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.transform(F.array_except(numbers, F.col("gone")), lambda i: F.get(lines, i))

    # The lines as a value of a lambda: split once, not once per line.
    kept = F.transform(F.array(F.split(F.col("doc.text"), "\n")), kept_of)[0]
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.concat_ws("\n", kept))
    named = joined.select("doc", text.alias("text"))
    columns = [
        F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("doc")[c].alias(c)
        for c in docs.columns
    ]
    return named.select(*columns)
