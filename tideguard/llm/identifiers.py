"""Personal data by bootstrapped contextual extraction.

Patterns of form find the seeds: e-mail addresses, IP addresses, card numbers (Luhn) and phone
numbers. The two words before the word that an identifier begins in are a lexical pattern of its
kind, whatever these words hold and whatever punctuation the identifier stands in. Patterns and the
instances they occur with are a graph that is scored in rounds: a pattern is as good as the
instances it introduces, an instance that no form vouches for as good as its patterns. Patterns
that stay above CONFIDENCE with SEEDS different seeds discover further identifiers: words of the
kind's make-up in the same place that the forms do not cover. Forms always stay.

A word that has not the make-up itself is taken together with the digit words that follow it:
words of digits, brackets, dots, hyphens and slashes, between which are only spaces, brackets,
dots and hyphens. The run goes on as far as it can and has the make-up as a whole or not at all.
A plus sign, a line break, other punctuation after a word and a span of a form end it. Runs may
start at any of their words, so discovered spans of different patterns may overlap.

Matches are leftmost and do not overlap within a kind; a match that fails its check (parts,
digits, Luhn) is dropped and nothing is tried again inside it. Positions are code points, ends
exclusive. Repetitions are possessive and may only start where a run starts, so that a very long
run of one class costs time in proportion and no stack.

Defined cases: a null or empty text has no spans. Repeated rows have the same spans each and
count once as instances. An empty table gives an empty result. Columns other than doc_id and text
are not read. Everything is DataFrame functions; `docs` is read twice and must be a stored
Parquet table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideguard.llm.common import place_of, text_of
from tideguard.session import materialise

KINDS = ["email", "ip", "card", "phone"]
# The forms are fixed; possessive and anchored to the start of a run they match the same.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A word with a digit or an at sign: what a pattern may discover.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# Between two words of a run, the end of a word that others may follow, and a word that may follow.
GLUE = r"^[\x20().-]++$"
LEADS = r"^[^\p{L}0-9@]*+[0-9][0-9().+/-]*(?<=[0-9)-])$"
FOLLOWS = r"^[(.-]*+[0-9][0-9().+/-]*+[^\p{L}0-9@]*+$"
# Digits that an identifier may have at most; a word of a run has one at least.
LONGEST = 19
PART = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
# The last two words of a reversed text.
CONTEXT = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)"
ROUNDS, CONFIDENCE, SEEDS = 3, 0.8, 3
# Doubt that every pattern starts with, in instances.
DOUBT = 0.25


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """Whether a match of a form is an identifier of the kind."""
    n = F.length(_digits(value))
    return (
        F.when(kind == "ip", F.rlike(value, F.lit(rf"^{PART}(?:\.{PART}){{3}}$")))
        .when(kind == "card", n.between(13, 19) & luhn(F.when(n <= 19, _digits(value))))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def could_be(kind: str, value: Column) -> Column:
    """Whether a word, or a run of words, has the make-up of the kind, without its form."""
    n = F.length(_digits(value))
    return {
        "email": F.rlike(value, F.lit(r"^[^@]+@[^@]+$")),
        "ip": F.rlike(value, F.lit(r"^[0-9]+(?:[.:_-][0-9]+){3}$")),
        "card": F.rlike(value, F.lit(r"^[0-9\x20.-]+$")) & n.between(13, LONGEST),
        "phone": F.rlike(value, F.lit(r"^[0-9\x20().+/-]+$")) & n.between(9, 15),
    }[kind]


def _matches(kind: str, pattern: str, text: Column) -> Column:
    """Array of (kind, number, gap, context, glue, value): a match and the length of what is before it.

    Candidates have a `context`, the two words before them in reverse: candidates are whole words,
    so that the last two of them, and what is between, hold two words. `glue` is all that is
    before a candidate since the last one, where a run may go on over that.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("value"), F.split(text, pattern).alias("gap"))
    none = F.lit(None).cast("string")

    def row(all_: Column, x: Column, i: Column) -> Column:
        context, glue = none, none
        if kind == "":
            last = F.slice(all_, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
            # The gap before the first of them is not needed where there are two.
            words = F.transform(last, lambda y, j: F.concat(F.when((j == 0) & (i > 1), "").otherwise(y["gap"]), y["value"]))
            before = F.reverse(F.concat(F.array_join(words, ""), x["gap"]))
            two = [F.reverse(F.regexp_extract(before, CONTEXT, n)) for n in (2, 1)]
            context = F.when(two[0] != "", F.lower(F.concat_ws(" ", *two)))
            glue = F.when(F.rlike(x["gap"], F.lit(GLUE)), x["gap"])
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("number"), F.length(x["gap"]).alias("gap"),
            context.alias("context"), glue.alias("glue"), x["value"].alias("value"),
        )

    # As a variable, the array is made once and not for every element that looks back in it.
    rows = F.transform(F.array(pairs), lambda all_: F.transform(all_, lambda x, i: row(all_, x, i)))[0]
    # The part after the last match has no value.
    return F.filter(rows, lambda x: x["value"].isNotNull())


def found_spans(docs: DataFrame) -> DataFrame:
    """row, kind, start, stop, value, pattern (the two words before), number, glue of matches and candidates."""
    text = F.col("text")
    some = docs.select(place_of(docs).alias("row"), text_of().alias("text")).where(
        F.rlike(text, F.lit("[0-9@]"))
    )
    nothing = F.array().cast("array<struct<kind:string,number:int,gap:int,context:string,glue:string,value:string>>")
    has = {"email": "@", "phone": "+", "ip": "."}
    kinds = [
        F.when(F.contains(text, F.lit(has.get(k, ""))), _matches(k, p, text)).otherwise(nothing)
        for k, p in [*FORMS.items(), ("", CANDIDATE)]
    ]
    rows = some.select("row", F.explode(F.concat(*kinds)).alias("m")).select("row", "m.*").repartition("row")
    till = Window.partitionBy("row", "kind").orderBy("number")
    length = F.length("value")
    stop = F.sum(F.col("gap") + length).over(till).cast("long")
    placed = rows.select(
        "row", "kind", (stop - length).alias("start"), stop.alias("stop"), "value", "context", "number", "glue"
    ).where((F.col("kind") == "") | passes(F.col("kind"), F.col("value")))
    # A match begins in a word with a digit or an at sign: that candidate's context is its own.
    candidate = F.col("kind") == ""
    so_far = Window.partitionBy("row").orderBy("start", ~candidate).rowsBetween(Window.unboundedPreceding, 0)
    word = F.last(F.when(candidate, F.struct("context")), ignorenulls=True).over(so_far)
    return placed.select("row", "kind", "start", "stop", "value", word["context"].alias("pattern"), "number", "glue")


def _core(value: Column) -> Column:
    """A candidate without the punctuation around it."""
    return F.regexp_replace(F.regexp_replace(value, r"^[^\p{L}0-9+(]+", ""), r"[^\p{L}0-9]+$", "")


def _any_kind(value: Column) -> Column:
    fits = F.lit(False)
    for kind in KINDS:
        fits = fits | could_be(kind, value)
    return fits


def uncovered(spans: DataFrame) -> DataFrame:
    """row, start, value, run, pattern of candidates that no base span touches.

    The punctuation around them is cut off. `run` is the word with those that follow it, where
    these have the make-up of a kind together.
    """
    near = Window.partitionBy("row").orderBy("start", "stop")
    base = F.col("kind") != ""
    before = F.max(F.when(base, F.col("stop"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
    free = spans.select("*", before.alias("before"), after.alias("after")).where(
        ~base & (F.coalesce("before", F.lit(0)) <= F.col("start"))
        & (F.col("after").isNull() | (F.col("after") >= F.col("stop")))
    )
    follows = (
        F.col("glue").isNotNull() & F.rlike("value", F.lit(FOLLOWS))
        & (F.lag("number").over(near) == F.col("number") - 1) & F.lag(F.rlike("value", F.lit(LEADS))).over(near)
    )
    first = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    parted = free.withColumn("first", first).withColumn("part", F.sum("first").over(near))
    ahead = Window.partitionBy("row", "part").orderBy("number")
    words = F.collect_list(F.struct(F.when(F.col("first") == 0, F.col("glue")).alias("glue"), "value"))
    led = parted.select(
        "row", "start", "value", "pattern", words.over(ahead.rowsBetween(0, LONGEST - 1)).alias("words"),
        F.sum(F.length(_digits(F.col("value")))).over(ahead.rowsBetween(0, LONGEST)).alias("digits"),
    )
    rest = F.transform(F.slice("words", 2, LONGEST), lambda w: F.concat(w["glue"], w["value"]))
    run = F.when(
        (F.size("words") > 1) & (F.col("digits") <= LONGEST), _core(F.concat("value", F.array_join(rest, "")))
    )
    head = F.length(F.regexp_extract("value", r"^[^\p{L}0-9+(]*", 0))
    cut = led.select("row", (F.col("start") + head).alias("start"), _core(F.col("value")).alias("value"), run.alias("run"), "pattern")
    return cut.withColumn("run", F.when(_any_kind(F.col("run")), F.col("run")))


def confident_patterns(seeds: DataFrame, others: DataFrame) -> DataFrame:
    """(kind, pattern): patterns that stay above CONFIDENCE.

    `seeds(kind, pattern, value)` vouch for themselves, `others(pattern, value)` do not. Every
    instance counts once per pattern, however often it occurs.
    """
    kinds = F.explode(F.array(*map(F.lit, KINDS)))
    known = seeds.where("pattern is not null").distinct()
    led = known.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= SEEDS)
    led = materialise(led, "patterns")
    # A pattern's instances of other kinds speak against it, as unknown words do.
    named = known.select(F.col("kind").alias("own"), "pattern", "value").unionByName(
        others.where("pattern is not null").select(F.lit("").alias("own"), "pattern", "value").distinct()
    )
    graph = named.join(led.select("kind", "pattern"), "pattern").select(
        "kind", "pattern", F.concat_ws(":", "own", "value").alias("instance"), (F.col("own") == F.col("kind")).alias("seed"),
        (F.col("own") == "").alias("unknown"),
    )
    graph = materialise(graph, "pattern-instances")
    trust = graph.select("kind", "instance", F.col("seed").cast("double").alias("trust")).distinct()
    for _ in range(ROUNDS):
        scored = graph.join(trust, ["kind", "instance"]).groupBy("kind", "pattern").agg(
            (F.sum("trust") / (F.count(F.lit(1)) + DOUBT)).alias("confidence")
        )
        scored = materialise(scored, "confidence")
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        of_patterns = F.when(F.max("unknown"), 1 - F.exp(doubt)).otherwise(0.0)
        trust = graph.join(scored, ["kind", "pattern"]).groupBy("kind", "instance").agg(
            F.when(F.max("seed"), 1.0).otherwise(of_patterns).alias("trust")
        )
    return scored.where(F.col("confidence") >= CONFIDENCE).select("kind", "pattern")


def spans(docs: DataFrame) -> DataFrame:
    """row, kind, start, stop, value, discovered: base spans, and those that patterns add."""
    found = materialise(found_spans(docs), "forms")
    base = found.where("kind != ''")
    free = materialise(uncovered(found), "candidates")
    word, run = F.col("value"), F.col("run")
    # A word that is only the beginning of a run is no instance.
    instance = F.when(_any_kind(word), word).otherwise(F.coalesce(run, word))
    good = confident_patterns(base.select("kind", "pattern", "value"), free.select("pattern", instance.alias("value")))
    fitting = F.lit(None).cast("string")
    for kind in KINDS:
        of_kind = F.when(could_be(kind, word), word).when(could_be(kind, run), run)
        fitting = F.when(F.col("kind") == kind, of_kind).otherwise(fitting)
    new = free.join(good, "pattern").withColumn("value", fitting).where("value is not null")
    new = new.withColumn("stop", F.col("start") + F.length("value"))
    columns = ["row", "kind", "start", "stop", "value"]
    return base.select(*columns, F.lit(False).alias("discovered")).unionByName(
        new.select(*columns, F.lit(True).alias("discovered"))
    )


def _listed(spans_: Column) -> Column:
    ordered = F.sort_array(spans_)
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans and n_discovered of every document."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    place = F.struct(kind.alias("kind"), "start", "stop")
    own = ~F.col("discovered")
    by_row = spans(docs).groupBy("row").agg(
        *[F.sum((own & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS],
        _listed(F.collect_list(F.when(own, place))).alias("base"),
        _listed(F.collect_list(place)).alias("spans"),
        F.sum(F.col("discovered").cast("long")).alias("n_discovered"),
    )
    rows = docs.select(place_of(docs).alias("row"), "doc_id")
    zero = F.lit(0).cast("long")
    return rows.join(by_row, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_discovered", zero).alias("n_discovered"),
    )
