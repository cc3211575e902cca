"""Periodic runs, Merkle manifest and top-k search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideguard.llm import merkle, periods, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---------------------------------------------------------------------------------


def plain_runs(words):
    best, n = {}, len(words)
    for q in range(1, n):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                best.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def planted(doc_id, text):
    words, h = WORD.findall(text or ""), crc(doc_id)
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_periodic(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_runs_of_random_words(letters):
    draw = random.Random(letters)
    for _ in range(150):
        n = draw.randint(1, 130)
        words = [draw.randrange(letters) for _ in range(n)]
        for _ in range(draw.randint(0, 4)):
            a = draw.randrange(n)
            p = draw.randint(1, max(1, (n - a) // 2))
            for i in range(a + p, draw.randint(a, n)):
                words[i] = words[i - p]
        got = sorted((s - 1, length, q) for s, length, q in periods.find_runs(np.array([-1, *words, -2])))
        assert got == plain_runs(words)


@pytest.mark.parametrize("unit", [[0], [0, 1], [0, 0, 1]])
def test_runs_of_stretches_that_repeat_themselves(unit):
    draw = random.Random(len(unit))
    for _ in range(25):
        words = []
        while len(words) < 500:
            words += (unit * draw.randint(1, 60))[: draw.randint(1, 120)] + [draw.randrange(3)] * draw.randint(0, 1)
        got = sorted((s - 1, length, q) for s, length, q in periods.find_runs(np.array([-1, *words, -2])))
        assert got == plain_runs(words)


def test_runs_of_long_texts_take_little():
    """Lags per word grow with the logarithm of the text, not with the text."""
    for words in ([7] * 100_000, [*range(31)] * 4_000, [7, 8] * 30_000 + [7] * 3, [9] * 20_000 + [8] + [9] * 20_000):
        ids = np.array([-1, *words, -2])
        at, lags = periods._openings(ids, len(words))
        assert len(at) <= 40 * len(words)
        assert len(periods.find_runs(ids)) <= 3


@pytest.mark.parametrize("together", [1, 1 << 18])
def test_runs_equal_brute_force(docs, rows, together):
    some = [r for r in rows if len(r[1] or "") < 12_000]
    got = periods.digests(periods.collapse_runs(periods.with_planted_runs(docs.where("length(coalesce(text, '')) < 12000")), together))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_periodic(r[0], r[1]) for r in some), key=repr)


def test_collapsed_texts(spark, no_docs):
    rows = [(1, "go " * 40 + "end"), (2, None), (3, ""), (None, "a b c " * 4), (None, "  x\n\ty")]
    got = periods.collapse_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got] == [
        (1, [(0, 40, 1)], "go end"), (2, [], ""), (3, [], ""), (None, [(0, 12, 3)], "a b c"), (None, [], "  x y"),
    ]
    assert periods.digests(periods.collapse_runs(periods.with_planted_runs(no_docs))).count() == 0


# --- 12 ---------------------------------------------------------------------------------


def up(nodes):
    """Levels of a tree from its nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % 8
        out.append((level[start:i], level[i + 1 : start + 8]))
        i //= 8
    return out


def plain_manifest(rows):
    def leaf(row, text):
        values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    by_lang = defaultdict(list)
    for r in rows:
        changed = None
        h = crc(r["doc_id"])
        if h is not None and h % 3 == 0 and r["text"] is not None:
            changed = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        by_lang[r["lang"]].append((r["doc_id"], leaf(r, r["text"]), changed))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = up([x[1] for x in by_lang[lang]])
    above = up([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (doc_id, digest, changed) in enumerate(by_lang[lang]):
            siblings = path(trees[lang], i) + path(above, k)
            folded = changed or digest
            for before, after in siblings:
                folded = sha("".join([*before, folded, *after]))
            proof = sha("".join(x for before, after in siblings for x in [*before, *after]))
            root = above[-1][0]
            out.append((doc_id, digest, trees[lang][-1][0], root, proof, folded, folded == root))
    return out


def manifest_of(docs, height=merkle.LEVELS):
    return [tuple(r) for r in merkle.tampered_manifest(docs, height).drop("levels").collect()]


def langs_of(docs, name):
    docs = docs.withColumn("text", F.initcap("text"))
    if name == "one":
        return docs.withColumn("lang", F.lit("xx"))
    if name == "each":
        # As many languages as rows, which need a tree of several superblocks themselves.
        return docs.withColumn("lang", F.concat(F.lit("l"), "doc_id"))
    third = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(9))
    return docs.withColumn("lang", F.when(third == 0, None).when(third < 7, "en").when(third == 7, "").otherwise("é"))


@pytest.mark.parametrize("levels, langs", [(1, "some"), (1, "each"), (2, "one"), (3, "some")])
def test_manifest_equals_brute_force(docs, levels, langs):
    docs = langs_of(docs, langs)
    rows = docs.collect()
    got = manifest_of(docs, levels)
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, grp string, idx int"
    whole = [(1 << 60, None, None, None, None, "g", 3), (None, "", "", 0, "Ü", None, None), (None, "", "", 0, "Ü", None, None)]
    for n in range(4):
        docs = spark.createDataFrame(whole[:n], schema)
        assert sorted(manifest_of(docs), key=repr) == sorted(plain_manifest(docs.collect()), key=repr)


# --- 13 ---------------------------------------------------------------------------------


def plain_topk(data, every, k):
    rows = []
    for vec_id, v in data:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((vec_id, [math.floor(64 * x) for x in v]))
    out = []
    for i, (vec_id, q) in enumerate(rows):
        if vec_id is None or vec_id % every:
            continue
        others = [
            (-sum(a * b for a, b in zip(q, c, strict=False)), 1 << 62 if j is None else j, j)
            for n, (j, c) in enumerate(rows) if n != i
        ]
        others.sort(key=lambda x: x[:2])
        out += [(vec_id, place + 1, j, -s) for place, (s, _, j) in enumerate(others[:k])]
    return out


def searched():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(8, 32))
    data = [list(map(float, centres[i % 8] * (1 + i % 3) + draw.normal(size=32) * (0.1 if i % 2 else 1.0))) for i in range(400)]
    data += [data[3]] * 150 + [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] * 32, [1.0, -2.0]]
    rows = list(enumerate(data))
    return [*rows, (0, data[0]), (20, data[20]), (None, data[3]), (None, data[40]), ((1 << 60) + 20, data[5])]


@pytest.mark.parametrize("block, chunk, part, page", [(16, 8, 3, 4), (64, 4096, 256, 1 << 14), (4096, 4096, 256, 1 << 14)])
def test_topk_equals_brute_force(spark, monkeypatch, tmp_path, block, chunk, part, page):
    for name, value in {"BLOCK": block, "CHUNK": chunk, "SLICE": part, "PAGE": page}.items():
        monkeypatch.setattr(topk, name, value)
    spark.createDataFrame(searched(), "vec_id long, embedding array<double>").withColumn("row", F.lit("x")).write.parquet(str(tmp_path / "v"))
    got = topk.nearest_vectors(spark.read.parquet(str(tmp_path / "v")), every=20, k=7).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_topk(searched(), 20, 7), key=repr)


def test_topk_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.nearest_vectors(spark.createDataFrame([], schema)).count() == 0
    assert topk.nearest_vectors(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    data = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, []), (20, [0.5, 0.5])]
    got = topk.nearest_vectors(spark.createDataFrame(data, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_topk(data, 20, 20))


def test_topk_scores_beyond_doubles():
    q, r = np.array([[2.0**40 + 1, 1.0]]), np.array([[2.0**20 + 1, 3.0], [2.0**40, 0.0]])
    assert topk.scores(q, r).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3, topk.LONG]]


def test_topk_leaves_most_rows_uncompared():
    """Of tight groups, few rows are left after the segment bounds."""
    draw = np.random.default_rng(1)
    centres = np.round(draw.normal(size=(40, 64)) * 20)
    rows = np.vstack([c + np.round(draw.normal(size=(50, 64))) for c in centres])
    queries = rows[::50]
    exact = topk.scores(queries, rows)
    floor = np.sort(exact, axis=1)[:, -10].astype(float)
    bounds = topk._bounds(queries, rows, topk.RESOLUTIONS[-1], np.ones(exact.shape))
    assert (bounds >= exact).all()
    assert (bounds >= floor[:, None]).mean() < 0.1
