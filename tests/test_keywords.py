"""Keyword operators against a character-by-character scan in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tideguard.config import Combo, KeywordDictionary
from tideguard.operators import keywords

WORDS = KeywordDictionary(
    {"toxic": ["ab", "aa", "abab", "Bc"], "violence": ["abc", "cab"], "odd": ["bb", "ab"]},
    (Combo(("ca", "bb"), "porn", "first"), Combo(("aab", "cc"), "gambling", "second")),
    ("abc a", "bab"),
)


def occurrences(text, word):
    return [i for i in range(len(text)) if text.startswith(word, i)]


def expected_verdict(text, d):
    low = text.lower()
    hits = {w: occurrences(low, w) for w in d.word_category}
    hits = {w: at for w, at in hits.items() if at}
    combo = next((c for c in d.combos if all(w in low for w in c.words)), None)
    if not hits:
        return (combo.label, 1.0) if combo else (None, 0.0)
    spans = [m.span() for m in re.finditer(d.whitelist_pattern, low)]

    def real(w, i):
        return not any(s <= i and i + len(w) <= e for s, e in spans)

    kept = {w: at for w, at in hits.items() if any(real(w, i) for i in at)}
    if not kept:
        return (None, 0.0)
    order = ["politics", "violence", "porn", "gambling", "toxic"]
    cats = {d.word_category[w] for w in kept}
    label = next((c for c in order if c in cats), "toxic")
    if combo:
        return (combo.label, 1.0)
    alone = any(
        (i == 0 or not low[i - 1].isalnum()) and (i + len(w) == len(low) or not low[i + len(w)].isalnum())
        for w, at in kept.items()
        for i in at
    )
    n = sum(len(at) for at in kept.values())
    if n == 1:
        low_conf = 0.6
    elif len(cats) >= 3:
        low_conf = 1.0
    elif len(cats) == 2:
        low_conf = 0.9
    else:
        low_conf = 0.85 if n >= 3 else 0.75
    return (label, 1.0 if alone else low_conf)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcABC  x") for _ in range(rng.randint(0, 24)))) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(4)


def test_verdict_equals_plain_scan(texts):
    rows, df = texts
    got = {
        r["id"]: (r["label"], r["confidence"])
        for r in keywords.with_verdict(df, WORDS)
        .select("id", "kw.label", "kw.confidence")
        .collect()
    }
    assert got == {i: expected_verdict(t, WORDS) for i, t in rows}


def test_every_occurrence_counts_overlaps_included(texts):
    rows, df = texts
    got = {(r["id"], r["word"]): r["n"] for r in keywords.occurrences(df, WORDS).collect()}
    want = {
        (i, w): len(occurrences(t.lower(), w))
        for i, t in rows
        for w in WORDS.word_category
        if w in t.lower()
    }
    assert got == want


def test_many_words_of_any_script(spark):
    """Thousands of words, some the start or a part of others: every occurrence, dictionary order."""
    draw = random.Random(8)
    letters = "abcd日本語中文字テ😀.*(é"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 7))) for _ in range(4000)]
    words = sorted(set(words), key=words.index)
    dictionary = KeywordDictionary({"toxic": words[::2], "porn": words[1::2]}, (), ())
    texts = ["".join(draw.choice(letters + "XYZ ") for _ in range(draw.randint(0, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string")
    found = keywords.with_matches(df, dictionary).select("id", "kw_found").collect()
    got = {r["id"]: [(m["word"], m["category"], m["n"]) for m in r["kw_found"]] for r in found}
    want = {-1: []}
    for i, t in enumerate(texts):
        counts = {w: len(occurrences(t.lower(), w)) for w in dictionary.word_category}
        want[i] = [(w, dictionary.word_category[w], n) for w, n in counts.items() if n]
    assert got == want


@pytest.mark.parametrize(
    "words", [["a"], ["ab", "cab", "abca"], ["abc", "bca", "cabb", "abcab"], ["]a", "^b-", "a\\c", "-"], ["😀a", "a😀b", "b😀"]]
)
def test_words_are_found_behind_their_first_characters(spark, words):
    """The trie is tried only where the next characters are those of a word."""
    draw = random.Random(7)
    chars = sorted({c for w in words for c in w} | {"x"})
    texts = ["", *words, *["".join(draw.choices(chars, k=60)) for _ in range(40)]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", keywords.found_words(F.col("text"), words).alias("f"))
    for r in found.collect():
        t = r["text"]
        at = [[w for w in sorted(words, key=len, reverse=True) if t.startswith(w, i)] for i in range(len(t))]
        assert r["f"] == [w for ws in at for w in ws]
    classes = keywords.first_chars_pattern(words)
    assert f"(?={classes})(?=(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\[[^\]]+\]", classes)) == min(3, *map(len, words))


def test_pattern_depth_follows_the_words():
    """Branches are halved, so a node of n characters costs about log n tries."""
    words = [chr(c) + "x" for c in range(0x4E00, 0x5600)]
    pattern = keywords.trie_pattern(words)
    assert all(re.fullmatch(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern), w) for w in words[::97])
    depth = deepest = 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        deepest = max(deepest, depth)
    assert deepest < 16


@pytest.mark.parametrize("word", ["ab", "aa", "abab"])
def test_positions(texts, word):
    rows, df = texts
    got = {
        r["id"]: list(r["p"])
        for r in df.select("id", keywords.positions(F.lower("text"), word).alias("p")).collect()
    }
    assert got == {i: [p + 1 for p in occurrences(t.lower(), word)] for i, t in rows}


CHINESE = KeywordDictionary(
    {
        "politics": ["台独", "港独"],
        "violence": ["杀了你", "弄死你"],
        "porn": ["约炮", "裸照", "一夜情", "性交", "口交"],
        "gambling": ["赌博", "下注"],
        "toxic": ["傻逼", "脑残", "弱智", "白痴", "垃圾", "fuck", "你妈", "他妈的"],
    },
    (
        Combo(("台独", "港独"), "politics"),
        Combo(("傻逼", "杀了你"), "violence"),
        Combo(("约炮", "裸照"), "porn"),
        Combo(("赌博", "下注"), "gambling"),
        Combo(("傻逼", "脑残"), "toxic"),
        Combo(("台湾", "独立"), "politics"),
    ),
)
# (text, its words as a segmenter cuts it, label, confidence)
CASES = [
    ("你真是个傻逼", "你/真是/个/傻逼", "toxic", 1.0),
    ("支持台独", "支持/台独", "politics", 1.0),
    ("我要杀了你", "我要/杀/了/你", "violence", 1.0),
    ("你这个傻逼我要杀了你", "你/这个/傻逼/我要/杀/了/你", "violence", 1.0),
    ("支持台独和港独", "支持/台独/和/港独", "politics", 1.0),
    ("加微信约炮发裸照给你", "加/微信/约炮/发/裸照/给/你", "porn", 1.0),
    ("你这个傻逼加我微信约炮", "你/这个/傻逼/加/我/微信/约炮", "porn", 1.0),
    ("赌博约炮一夜情在线下注", "赌博/约炮/一夜情/在线/下注", "gambling", 1.0),
    ("接口交换技术性交朋友", "接口/交换/技术/性/交朋友", None, 0.0),
    ("接口交换技术讨论", "接口/交换/技术/讨论", None, 0.0),
    ("这个fucking单词", "这个/fucking/单词", "toxic", 0.6),
    ("这个系统有漏洞和bug需要修复", "这个/系统/有/漏洞/和/bug/需要/修复", None, 0.0),
    ("台湾是独立的", "台湾/是/独立/的", "politics", 1.0),
    ("今天天气真好适合出去玩", "今天/天气/真好/适合/出去/玩", None, 0.0),
    ("这是一种赌博式的投资行为", "这是/一种/赌博/式/的/投资/行为", None, 0.0),
    ("操场上有个傻逼在骂人", "操场/上/有/个/傻逼/在/骂人", "toxic", 1.0),
    ("他叫傻逼拉曼", "他/叫/傻逼拉曼", "toxic", 0.6),
    ("", "", None, 0.0),
    ("FUCK", "FUCK", "toxic", 1.0),
]


def test_segmented_cases(spark):
    rows = [(t, s.split("/")) for t, s, _, _ in CASES]
    df = spark.createDataFrame(rows, "text string, tokens array<string>")
    judged = keywords.with_verdict(df, CHINESE, mode="token", tokens="tokens")
    got = [(r["text"], r["label"], r["confidence"]) for r in judged.select("text", "kw.*").collect()]
    assert got == [(t, label, c) for t, _, label, c in CASES]


def test_neighbouring_cjk_characters_embed_a_word(spark):
    df = spark.createDataFrame([("傻逼!",), ("个傻逼",), ("傻逼们 傻逼",)], "text string")
    judged = keywords.with_verdict(df, CHINESE, mode="cjk").select("text", "kw.confidence")
    assert {r["text"]: r["confidence"] for r in judged.collect()} == {
        "傻逼!": 1.0,
        "个傻逼": 0.6,
        "傻逼们 傻逼": 1.0,
    }
    flags = df.select(keywords.is_cjk(F.col("text")).alias("c"), keywords.is_cjk(F.lit("é")).alias("l"))
    assert all(r["c"] and not r["l"] for r in flags.collect())


def test_a_filter_on_the_verdict_does_not_match_the_text_again(spark):
    df = spark.createDataFrame([("接口交换",), ("傻逼",), ("好",)], "text string").repartition(2)
    judged = keywords.with_verdict(df, CHINESE, mode="cjk").select("text", "kw.*")
    hit = judged.where((F.size("matches") > 0) & F.col("combo_label").isNull())
    plan = hit._jdf.queryExecution().optimizedPlan().toString()
    # Once for the words, once for the whitelist.
    assert plan.count("regexp_extract_all") == 2
    assert [r["text"] for r in hit.collect()] == ["傻逼"]


def test_whitelist_reports_what_it_suppressed(spark):
    df = spark.createDataFrame([("接口交换",), ("接口交换 口交",)], "text string")
    rows = keywords.with_verdict(df, CHINESE, mode="cjk").select("kw.*").collect()
    assert rows[0]["whitelist_hit"] and rows[0]["suppressed"] == ["口交"]
    # A word with one occurrence outside keeps all of its occurrences.
    assert not rows[1]["whitelist_hit"] and rows[1]["n_matches"] == 2
