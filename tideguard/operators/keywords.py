"""Multi-keyword matching, whitelist, context, combinations and the confidence ladder.

The dictionary travels as one pattern, a trie of its words, and as an array literal; every step
works on arrays inside the row, so a verdict needs no shuffle, no join and no second look at the
text: the plan is scan, project. The pattern is tried once per character, and only where the next
characters are such that words have at their first places; it leaves at the first character that no
word goes on with, so its cost hardly depends on the number of words.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.config import SEVERITY_ORDER, KeywordDictionary
from tideguard.operators.skew import rows_of

CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
TOKEN_MARK = "\u0001"


def is_cjk(char: Column) -> Column:
    return char.rlike(f"[{CJK}]")


def boundary_pattern(word: str, mode: str) -> str:
    """Pattern of a standalone occurrence.

    "word": no letter, digit or underscore next to it. "cjk": no CJK character next to it.
    "token": starts and ends on a token edge of a text joined by `joined_tokens`.
    """
    if mode == "word":
        return r"(?<![\p{L}\p{N}_])" + re.escape(word) + r"(?![\p{L}\p{N}_])"
    if mode == "cjk":
        return f"(?<![{CJK}])" + re.escape(word) + f"(?![{CJK}])"
    if mode == "token":
        return TOKEN_MARK + f"{TOKEN_MARK}?".join(re.escape(c) for c in word) + TOKEN_MARK
    raise ValueError(f"unknown context mode {mode!r}")


def joined_tokens(tokens: Column) -> Column:
    """Tokens of a segmented text with a mark at every edge, as "token" mode reads them."""
    mark = F.lit(TOKEN_MARK)
    return F.concat(mark, F.array_join(F.transform(tokens, F.lower), TOKEN_MARK), mark)


# Branches of a trie node that are tried one after the other; more are halved by ranges first.
BRANCHES = 16
# As many characters are looked at before the trie is tried.
FIRST_CHARS = 3


def _char(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}"


def trie_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of `words` that starts where it is tried."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def choice(branches: list[tuple[str, str]]) -> str:
        if len(branches) <= BRANCHES:
            return "|".join(_char(c) + rest for c, rest in branches)
        half = len(branches) // 2
        sides = [branches[:half], branches[half:]]
        return "|".join(f"(?=[{_char(s[0][0])}-{_char(s[-1][0])}])(?:{choice(s)})" for s in sides)

    def build(node: dict) -> str:
        branches = [(c, build(child)) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        if "" in node:
            return f"(?:{choice(branches)})?"
        return _char(branches[0][0]) + branches[0][1] if len(branches) == 1 else f"(?:{choice(branches)})"

    return build(root)


def first_chars_pattern(words: list[str]) -> str:
    """A pattern of the first characters of `words`: a class per place, as long as every word has it."""
    places = min(FIRST_CHARS, min(map(len, words)))
    classes = [sorted({w[i] for w in words}) for i in range(places)]
    return "".join(f"[{''.join(map(_char, chars))}]" for chars in classes)


def _dictionary_literal(words: dict[str, str], mode: str) -> Column:
    """Words, categories, severities and context patterns, in the order of the dictionary."""
    rank = {c: i for i, c in enumerate(SEVERITY_ORDER)}
    rows = [
        {"word": w, "category": c, "severity": rank.get(c, len(rank)), "pattern": boundary_pattern(w, mode)}
        for w, c in words.items()
    ]
    # One literal: a column per entry would take the driver longer than the scan takes.
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<word:string,category:string,severity:int,pattern:string>>")


def found_words(lower_text: Column, words: list[str]) -> Column:
    """The word at every place where one occurs, places in order; occurrences may overlap.

    Where several words start, the longest comes, then those it starts with.
    """
    words = [w for w in words if w]
    if not words:
        return F.array().cast("array<string>")
    pattern = f"(?={first_chars_pattern(words)})(?=({trie_pattern(words)}))"
    longest = F.regexp_extract_all(lower_text, F.lit(pattern), 1)
    known = set(words)
    shorter = {w: [w[:n] for n in range(len(w) - 1, 0, -1) if w[:n] in known] for w in words}
    shorter = {w: [w, *s] for w, s in shorter.items() if s}
    if not shorter:
        return longest
    table = F.from_json(F.lit(json.dumps(shorter)), "map<string,array<string>>")
    return F.flatten(F.transform(longest, lambda w: F.coalesce(table[w], F.array(w))))


MATCH_TYPE = "array<struct<word:string,category:string,severity:int,pattern:string,n:int>>"


def _counted(found: Column, dictionary: KeywordDictionary, mode: str) -> Column:
    """`array<struct<word, category, severity, pattern, n>>` in the order of the dictionary."""
    entries = _dictionary_literal(dictionary.word_category, mode)

    def with_count(d: Column) -> Column:
        n = F.size(F.filter(found, lambda w: w == d["word"]))
        return F.struct(*[d[f].alias(f) for f in ("word", "category", "severity", "pattern")], n.alias("n"))

    mine = F.filter(entries, lambda d: F.array_contains(found, d["word"]))
    counted = F.transform(mine, with_count).cast(MATCH_TYPE)
    return F.when(F.size(found) > 0, counted).otherwise(F.array().cast(MATCH_TYPE))


def _surviving(found: Column, spans: Column) -> Column:
    """Matches with an occurrence outside every whitelist span, `n` unchanged.

    A hit inside a span is a hit of the span's own text, so counting decides it.
    """

    def inside(m: Column) -> Column:
        return F.aggregate(spans, F.lit(0), lambda s, span: s + _overlapping_count(span, m["word"]))

    return F.filter(found, lambda m: m["n"] > inside(m))


def _overlapping_count(text: Column, word: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.size(
        F.filter(starts, lambda i: F.substring(text, i, F.length(word)) == word)
    )


def combo_hit(lower_text: Column, dictionary: KeywordDictionary) -> Column:
    """First combination all of whose words occur anywhere, as struct(ord, label, note)."""
    if not dictionary.combos:
        return F.lit(None).cast("struct<ord:int,label:string,note:string,words:array<string>>")
    combos = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(c.label).alias("label"),
                F.lit(c.note).alias("note"),
                F.array(*[F.lit(w) for w in c.words]).alias("words"),
            )
            for i, c in enumerate(dictionary.combos)
        ]
    )
    hits = F.filter(
        combos, lambda c: F.forall(c["words"], lambda w: F.contains(lower_text, w))
    )
    return F.get(hits, F.lit(0))


def ladder(n_matches: Column, n_categories: Column, standalone: Column) -> Column:
    """Confidence from the number of matches and categories and from the context."""

    def either(embedded: float) -> Column:
        return F.when(standalone, 1.0).otherwise(embedded)

    return (
        F.when(n_matches == 0, 0.0)
        .when(n_matches == 1, either(0.6))
        .when(n_categories >= 3, 1.0)
        .when(n_categories == 2, either(0.9))
        .when(n_matches >= 3, either(0.85))
        .otherwise(either(0.75))
    )


def with_matches(
    df: DataFrame,
    dictionary: KeywordDictionary,
    text: str = "text",
    mode: str = "word",
    tokens: str | None = None,
) -> DataFrame:
    """Adds `kw_found` (all matches), `kw_matches` (after the whitelist, with context).

    Matches are `array<struct<word, category, severity, pattern, n>>` in the order of the
    dictionary, n counting every occurrence; occurrences may overlap, those of one word
    included. Also adds `_lower`, the lower-case text: its own column, so that it is computed
    once per row and not once per word inside the lambdas.
    """
    lower = F.col("_lower")
    subject = joined_tokens(F.col(tokens)) if mode == "token" else lower
    out = (
        df.withColumn("_lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_words", found_words(lower, list(dictionary.word_category)))
        .withColumn("kw_found", _counted(F.col("_words"), dictionary, mode))
        .drop("_words")
    )
    hit = F.size("kw_found") > 0
    if dictionary.whitelist:
        pattern = F.lit(f"({dictionary.whitelist_pattern})")
        spans = F.when(hit, F.regexp_extract_all(lower, pattern, 1)).otherwise(
            F.array().cast("array<string>")
        )
        kept = F.when(F.size("_spans") == 0, F.col("kw_found")).otherwise(
            _surviving(F.col("kw_found"), F.col("_spans"))
        )
        out = out.withColumn("_spans", spans).withColumn("_kept", kept)
    else:
        out = out.withColumn("_spans", F.array().cast("array<string>")).withColumn(
            "_kept", F.col("kw_found")
        )

    def judged(m: Column) -> Column:
        alone = F.when(F.rlike(subject, m["pattern"]), "standalone").otherwise("embedded")
        kept = [m[f].alias(f) for f in ("word", "category", "severity", "n")]
        return F.struct(*kept, alone.alias("context"))

    return out.withColumn("kw_matches", F.transform("_kept", judged)).drop("_kept", "_spans")


def with_verdict(
    df: DataFrame,
    dictionary: KeywordDictionary,
    text: str = "text",
    mode: str = "word",
    tokens: str | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Adds `kw`, the full verdict on `text`.

    struct(label, confidence, n_matches, category_count, multi_hit, standalone,
    whitelist_hit, combo_label, combo_note, matches, suppressed). `distinct` counts a word
    once per text instead of once per occurrence.
    """
    out = with_matches(df, dictionary, text, mode, tokens)
    # Occurrences after the last dictionary category that is not ranked count as "toxic".
    ranks = F.array(*[F.lit(c) for c in [*SEVERITY_ORDER, "toxic"]])
    worst = F.array_min(F.transform("kw_matches", lambda m: m["severity"]))
    weight = (lambda m: F.lit(1)) if distinct else (lambda m: m["n"])
    n_matches = F.aggregate("kw_matches", F.lit(0), lambda s, m: s + weight(m))
    n_categories = F.size(F.array_distinct(F.transform("kw_matches", lambda m: m["category"])))
    standalone = F.exists("kw_matches", lambda m: m["context"] == "standalone")
    out = (
        out.withColumn("_combo", combo_hit(F.col("_lower"), dictionary))
        .withColumn("_n", n_matches)
        .withColumn("_cats", n_categories)
        .withColumn("_alone", standalone)
    )
    whitelisted = (F.size("kw_found") > 0) & (F.size("kw_matches") == 0)
    combo = F.col("_combo").isNotNull() & ~whitelisted
    label = (
        F.when(combo, F.col("_combo.label"))
        .when(F.size("kw_matches") > 0, F.get(ranks, worst))
    )
    verdict = F.struct(
        label.alias("label"),
        F.when(combo, 1.0)
        .otherwise(ladder(F.col("_n"), F.col("_cats"), F.col("_alone")))
        .alias("confidence"),
        F.col("_n").alias("n_matches"),
        F.when(combo & (F.col("_cats") == 0), 1).otherwise(F.col("_cats")).alias("category_count"),
        (combo | (F.col("_n") >= 2)).alias("multi_hit"),
        F.col("_alone").alias("standalone"),
        whitelisted.alias("whitelist_hit"),
        F.when(combo, F.col("_combo.label")).alias("combo_label"),
        F.when(combo, F.col("_combo.note")).alias("combo_note"),
        F.col("kw_matches").alias("matches"),
        F.when(whitelisted, F.transform("kw_found", lambda m: m["word"])).alias("suppressed"),
    )
    # As a generated row: Spark would push a filter on `kw` down to the text, where every use of a
    # column stands for its whole expression, and match each text many times over.
    return out.withColumn("kw", rows_of(F.array(verdict))).drop(
        "_lower", "_combo", "_n", "_cats", "_alone", "kw_found", "kw_matches"
    )


def positions(lower_text: Column, word: str) -> Column:
    """1-based start of every occurrence, overlaps included.

    The text is cut into characters once; every place is looked at once, so the work grows
    with the text and not with the number of occurrences before a place.
    """
    size = len(word)

    def places(chars: Column) -> Column:
        def here(i: Column) -> Column:
            first = F.get(chars, i - 1) == F.lit(word[0])
            return first & (F.array_join(F.slice(chars, i, F.lit(size)), "") == F.lit(word))

        last = F.size(chars) - (size - 1)
        every = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1))))
        return F.filter(F.coalesce(every, F.array().cast("array<int>")), here)

    # Characters as one value of a lambda, so that they are not cut anew per place.
    return F.transform(F.array(F.split(lower_text, "")), places)[0]


def occurrences(df: DataFrame, dictionary: KeywordDictionary, text: str = "text") -> DataFrame:
    """One row per text and matched word with category and number of occurrences."""
    words = found_words(F.col("_lower"), list(dictionary.word_category))
    found = (
        df.withColumn("_lower", F.lower(F.col(text)))
        .withColumn("_words", words)
        .withColumn("_found", _counted(F.col("_words"), dictionary, "word"))
    )
    rows = found.select(*df.columns, rows_of(F.col("_found")).alias("_m"))
    return rows.where(F.col("_m").isNotNull()).select(
        *df.columns, "_m.word", "_m.category", "_m.n"
    )
