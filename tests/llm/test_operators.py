"""The corpus operators against plain versions, on copies, nulls, empty and long texts."""

import contextlib
import hashlib
import os
import random
import re
import threading
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideguard.llm import chat, identifiers, lines, mixing, packing, quality, repeats, sharding, simhash, vectors
from tideguard.llm.common import components
from tideguard.llm.queries import ranks_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


# --- 1 ----------------------------------------------------------------------------------


def plain_removed(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone = [], Counter()
    for i in order:
        for k, line in enumerate((rows[i][1] or "").split("\n")):
            words = frozenset(WORD.findall(line))
            if words:
                if any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
                    gone[i, k] += 1
                seen.append(words)
    return set(gone)


@pytest.mark.parametrize("crowd", [3, 500])
def test_lines_equal_brute_force(docs, rows, crowd):
    got = lines.repeated_lines(docs, crowd).collect()
    # One file: the place in it is the row's number.
    assert {(r["row"]["at"], r["line"]) for r in got} == plain_removed(rows)
    assert len(got) == len(plain_removed(rows))


def test_lines_leave_other_columns(docs, rows):
    out = lines.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.where("n_chars != length(text)").count() == 0
    assert out.where("text is null").count() == 1
    assert lines.removed_lines(docs.limit(0)).count() == 0


def test_lines_of_a_very_long_document(spark, tmp_path):
    """100,000 lines in one text, half of them near copies of the one before."""
    draw = random.Random(4)
    lines_of = []
    for i in range(50_000):
        words = [f"w{draw.randrange(100_000)}" for _ in range(10)]
        lines_of += [" ".join(words), " ".join(words + [f"x{i}"])]
    spark.createDataFrame([(1, "\n".join(lines_of)), (2, "other words")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    out = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(docs).collect()}
    assert out == {1: "\n".join(lines_of[::2]), 2: "other words"}


def test_shorter_line_meets_longer_by_half_its_prefix(spark, tmp_path):
    """Lines just at and just below 4/5, short and over LONG words; the shorter ones bring fewer rows to the join."""
    draw = random.Random(11)
    texts = []
    for n in [*range(4, 40), 64, 65, lines.LONG, lines.LONG + 1, lines.LONG + 25]:
        words = [f"w{n}x{i}" if draw.random() < 0.5 else f"c{i}" for i in range(n)]
        for dropped in (n // 5, n // 5 + 1):
            texts.append(" ".join(draw.sample(words, n - dropped)))
        for other in (n // 9, n // 9 + 1):
            texts.append(" ".join(draw.sample(words, n - other) + [f"z{n}y{other}v{i}" for i in range(other)]))
        texts.append(" ".join(words))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for crowd in (3, 500):
        got = {(r["row"]["at"], r["line"]) for r in lines.repeated_lines(docs, crowd).collect()}
        assert got == plain_removed(rows)
    sets = lines.line_sets(docs.select("doc_id", "text", F.col("doc_id").alias("row")), lines.rarity_ranks(docs))
    words = sets.select("n", F.posexplode("prefix").alias("at", "word")).withColumn("place", F.col("at") + 1)
    assert words.where(lines._in_short_prefix()).count() < 0.7 * words.count()


def test_rows_stay_the_same_when_splits_change(spark, docs, rows, tmp_path):
    """Between the reads of a table Spark may cut its files anew, as after losing executors."""
    for i in range(4):
        part = spark.createDataFrame(rows[i::4], docs.schema).coalesce(1)
        part.write.mode("append").option("parquet.block.size", "4096").parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    makers = [lines.removed_lines, lines.without_repeated_lines, simhash.without_near_copies, mixing.mixture, identifiers.personal_data]
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    for make in makers:
        same = Counter(map(repr, make(docs).collect()))
        late = make(docs)
        try:
            for n in names:
                spark.conf.set(n, "2048")
            assert Counter(map(repr, late.collect())) == same, make.__name__
        finally:
            for n in names:
                spark.conf.set(n, before[n])


# --- 2 ----------------------------------------------------------------------------------


def vector_rows():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 16))
    out = [list(map(float, centres[i % 6] + draw.normal(size=16) * (0.05 if i % 2 else 0.5))) for i in range(300)]
    out += [out[0]] * 40 + [[x * 2 for x in out[1]]] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    return list(enumerate(out)) + [(0, out[0])]


@pytest.mark.parametrize("strip", [16, 4096])
def test_vectors_equal_brute_force(spark, monkeypatch, strip):
    monkeypatch.setattr(vectors, "STRIP", strip)
    data = vector_rows()
    good = [i for i, (_, v) in enumerate(data) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = []
    for a in good:
        for b in good:
            x, y = data[a][1], data[b][1]
            if a != b and len(x) == len(y) and np.dot(x, y) >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y):
                links.append((a, b))
    degree, root = Counter(a for a, _ in links), roots(len(data), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), data[i][0])
    expected = sorted((data[i][0], degree[i], least[root[i]]) for i in range(len(data)))
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = vectors.near_vectors(table).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_vectors_without_spread_are_not_sent_to_every_pair_of_tiles(spark, monkeypatch):
    """Shuffles and scratch together stay at some times the vectors; tasks compare blocks apart."""
    monkeypatch.setattr(vectors, "STRIP", 160)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(2560, 64))
    data = [list(map(float, v)) for v in np.concatenate([base, base + draw.normal(size=base.shape) * 0.01])]
    table = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [*(d.getPath() for d in local), spark.conf.get("spark.checkpoint.dir")]
    before, seen, over = set(), {}, threading.Event()

    def look():
        """Spark removes shuffles when a job is done, so files are noted while they are there."""
        for at, _, names in (x for f in folders for x in os.walk(f)):
            # Not under the names that files have while they are written.
            for path in (os.path.join(at, n) for n in names if "_temporary" not in at and not n.startswith("temp_")):
                with contextlib.suppress(OSError):
                    seen[path] = os.path.getsize(path)

    def watch():
        while not over.wait(0.02):
            look()

    look()
    before.update(seen)
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = vectors.near_vectors(table).collect()
    finally:
        over.set()
        watcher.join()
    look()
    new = {path: n for path, n in seen.items() if path not in before}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, 1, i % 2560) for i in range(5120)]
    assert sum(new.values()) < 8 * 5120 * 64 * 8
    assert sum("/links-" in path and path.endswith(".parquet") for path in new) >= 3


def test_vectors_whose_numbers_take_many_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "STRIP", 8)
    draw = np.random.default_rng(5)
    some = [list(map(float, v)) for v in draw.normal(size=(5, 12))]
    data = [(None if i % 9 == 0 else 1000 - i, some[0] if i < 90 else [-0.0 if c == 0 else c for c in [0.0] * 11 + [float(i % 2 or -1)]]) for i in range(130)]
    data += [(5, some[1]), (5, [c * 3 for c in some[1]]), (None, some[2]), (None, some[2])]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)).collect()
    finally:
        spark.conf.set(name, before)
    expected = Counter((data[i][0], 89, 911, data[i][0] in (None, 911)) for i in range(90))
    expected += Counter((data[i][0], 19, 871 + 1 - i % 2, data[i][0] in (None, 871 + 1 - i % 2)) for i in range(90, 130))
    expected += Counter({(5, 1, 5, True): 2, (None, 1, None, True): 2})
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == expected


def test_vectors_of_a_leaf_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "STRIP", 64)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 8 * 25)
    monkeypatch.setattr(vectors, "JOB", 10)
    draw = np.random.default_rng(8)
    data = np.concatenate([np.eye(8)[0] + draw.normal(size=(90, 8)) * 0.12, draw.normal(size=(30, 8))])
    near = vectors.unit(data) @ vectors.unit(data).T >= 0.9
    np.fill_diagonal(near, False)
    root = roots(len(data), np.argwhere(near).tolist())
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(table).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, near[i].sum(), root[i]) for i in range(120)]
    first, parts = vectors.deal(np.array([10, 60, 10, 10]), 25)
    assert (first.tolist(), parts.tolist()) == ([0, 1, 4, 4], [1, 3, 1, 1])


def test_bounds_in_single_precision_lose_no_pair():
    draw = np.random.default_rng(6)
    x, y = (vectors.unit(draw.normal(size=(500, 64))) for _ in range(2))
    for i in range(400):
        # Cosines around the threshold, some within the rounding of single precision.
        side = y[i] - (y[i] @ x[i]) * x[i]
        cosine = 0.9 + (i % 3 - 1) * 10.0 ** -(3 + i % 8)
        y[i] = cosine * x[i] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    for start in (8, 32, 64):
        rows, cols, _ = vectors.linked(vectors.Tile(x), vectors.Tile(y), 0.9, start)
        clear = [i for i in range(400) if i % 3 == 2]
        assert {(i, i) for i in clear} <= set(zip(rows.tolist(), cols.tolist(), strict=True))
        assert not {(i, i) for i in range(400) if i % 3 == 0} & set(zip(rows.tolist(), cols.tolist(), strict=True))


# --- 3 ----------------------------------------------------------------------------------

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [
        (n, m.start(), m.end(), k) for n, (k, p) in enumerate(FORMS.items()) for m in re.finditer(p, text or "") if plain_passes(k, m.group())
    ]
    return ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(found))


def test_identifiers_equal_the_forms(docs, rows):
    got = identifiers.personal_data(docs).collect()
    expected = Counter((r[0], hashlib.sha256(plain_spans(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == expected
    assert sum(r["n_email"] for r in got) == 2 and sum(r["n_phone"] for r in got) == 1
    assert identifiers.personal_data(docs.limit(0)).count() == 0


def test_patterns_discover_what_forms_miss(spark, tmp_path):
    texts = [f"please call me +1 555 010 {i:04}" for i in range(8)] + ["so call me 555-010-77-33, ok", "the year 2024 and 12345678901 too", "1" * 50_000, "+" * 9_000, "a@" * 9_000 + "b" + ".c" * 9_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {r["doc_id"]: r for r in identifiers.personal_data(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got[8]["spans"] == "phone:11:24" and got[8]["n_phone"] == 0
    assert got[9]["spans"] == "" and got[10]["spans"] == ""
    assert got[12]["n_email"] == 1
    assert all(got[i]["spans"] == plain_spans(texts[i]) for i in (*range(8), 12))


def spans_of(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = identifiers.personal_data(spark.read.parquet(str(tmp_path / "t"))).collect()
    return [r["spans"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_patterns_discover_identifiers_written_with_spaces(spark, tmp_path):
    seeds = [f"please call me +1 555 010 {i:04}" for i in range(8)] + [f"my card no {c}" for c in ("4111111111111111", "5500000000000004", "340000000000009", "30000000000004")]
    missed = [
        ("so call me (555) 010-7733, ok", "phone:11:25"), ("so call me 555 010 7733", "phone:11:23"),
        ("call me 555 - 010 - 7733. 24 hours", "phone:8:24"), ("call me 555 010 7733 +1 555 010 0000", "phone:8:20,phone:21:36"),
        ("call me 555-010-77-33 24 hours", "phone:8:21"), ("card no 4111 1111  1111 1112.", "card:8:28"),
        ("call me 555 010\n7733", ""), ("call me 1 2 3", ""), ("call me " + "12 " * 5000, ""),
    ]
    got = spans_of(spark, tmp_path, seeds + [t for t, _ in missed])
    assert got[: len(seeds)] == [plain_spans(t) for t in seeds]
    assert got[len(seeds) :] == [s for _, s in missed]


def test_patterns_are_the_two_words_before_whatever_they_hold(spark, tmp_path):
    far, cards = "x" * 90, ("4111111111111111", "5500000000000004", "340000000000009", "30000000000004")
    seeds = [f"24/7 hotline +1 555 010 {i:04}" for i in range(8)] + [f"mail me <u{i}@example.com>" for i in range(8)]
    seeds += [f"dial {far} +1 555 020 {i:04}" for i in range(8)] + [f"in 2024 card {c}" for c in cards] + [f"a1b22c a@b +1 555 030 {i:04}" for i in range(8)]
    missed = [
        ("24/7 hotline 555-010-77-33", "phone:13:26"), ("mail me <root@local>", "email:9:19"), ("mail me root@local", "email:8:18"),
        (f"dial {far} 555-010-77-33", "phone:96:109"), ("in 2024 card 4111.1111.1111.1112", "card:13:32"),
        ("a1b22c a@b 555-010-77-33", "phone:11:24"), ("b22c a@b 555-010-77-33", ""), (f"dial x{far} 555-010-77-33", ""), ("hotline 555-010-77-33", ""),
    ]
    got = spans_of(spark, tmp_path, seeds + [t for t, _ in missed])
    assert got[: len(seeds)] == [plain_spans(t) for t in seeds]
    assert got[len(seeds) :] == [s for _, s in missed]


# --- 4 ----------------------------------------------------------------------------------


def test_ids_are_those_of_tokenizers():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    slow, ours = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.tokenizer(ranks_file())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b ", "<|endoftext", "x  <|endoftext|>\n\n y", ""]
    for text in texts:
        assert ours.encode(text) == slow.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip(docs, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
    whole = {i: slow.encode(r[1] or "", add_special_tokens=False).ids + [2] for i, r in enumerate(rows) if i < 119}
    packed = packing.pack(packing.pieces(docs, ranks_file(), with_ids=True)).collect()
    by_doc = defaultdict(list)
    for r in packed:
        if r["doc_id"] is not None:
            by_doc[r["doc_id"]].append(r)
    for i, ids in whole.items():
        parts = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))
        if i != 5:
            assert [x for r in parts for x in r["ids"]] == ids
            assert all(r["length"] == 1024 for r in parts[1:])
        for r in parts:
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in packed)
    assert len(sequences) <= -(-total // 1024) + 2
    assert packing.pack(packing.pieces(docs.limit(0), ranks_file())).count() == 0


def test_sum_of_squares_rule():
    # Two open bins of one gap make a square of four; filling one of them is cheapest.
    assert packing.place([6, 6, 4], 10) == [(0, 0), (1, 0), (1, 6)]
    sizes = sorted((int(x) for x in np.random.default_rng(1).integers(1, 700, 3000)), reverse=True)
    places = packing.refit(sizes, packing.place(sizes))
    filled = Counter()
    for s, (number, offset) in zip(sizes, places, strict=True):
        assert offset >= 0 and offset + s <= 1024
        filled[number] += s
    assert max(filled.values()) <= 1024 and len(filled) <= -(-sum(sizes) // 1024) + 3


# --- 5 ----------------------------------------------------------------------------------


def plain_figures(text):
    text = text or ""
    words = WORD.findall(text)
    seen = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(seen) - len(set(seen)), len(covered)


def test_quality_figures_and_base_rules(docs, rows):
    got = quality.judge_documents(docs).collect()
    expected = Counter()
    for r in rows:
        f = plain_figures(r[1])
        expected[(r[0], *f, f[0] < 20 or 100 * f[4] > 30 * f[0])] += 1
    assert Counter((r["doc_id"], *[r[c] for c in quality.FIGURES], r["base_failed"]) for r in got) == expected
    kept = quality.passing(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got) > 50
    assert quality.host_rules(docs).count() == len(rows)
    assert quality.judge_documents(docs.limit(0)).count() == 0


def test_host_that_mostly_fails_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(30))
    data = [(i, good if i % 10 else "short", f"h{i % 20}") for i in range(400) if i % 20 != 10] + [(1000 + i, "short" if i else good, "bad") for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge_documents(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[1] and not got[1000]


# --- 6 ----------------------------------------------------------------------------------


def test_perspectives(spark):
    data = [(1, 0, "system", "S"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, "ann", "yo"), (2, None, None, "x"), (3, 0, "system", "only"), (None, 1, "zed", "q")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    got = chat.rotate_perspectives(table)
    texts = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(got).collect()}
    assert set(texts) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "zed")}
    one = texts[1, "ann"]
    assert one["text"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhé<|im_end|>\n" + "<|im_start|>user name=bob\n<|im_end|>\n" * 2 + "<|im_start|>assistant\nyo<|im_end|>\n"
    assert [one["text"][m["start"] : m["end_"]] for m in one["masks"]] == ["hé<|im_end|>\n", "yo<|im_end|>\n"]
    assert chat.rotate_perspectives(table.limit(0)).count() == 0


# --- 7 ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("paired", [1, 256])
def test_near_copies_equal_brute_force(spark, docs, rows, paired):
    prints = [plain_fingerprint(r[1]) for r in rows]
    # Fingerprints around one centre, so that keys are crowded.
    draw = np.random.default_rng(5)
    prints += [prints[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 64, (60, 2))]
    ids = [r[0] for r in rows] + list(range(10_000, 10_060))
    links = [(a, b) for a in range(len(prints)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    root, least = roots(len(prints), links), {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, 1 << 60), ids[i])
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.grouped(spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long"), paired).collect()
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == Counter((ids[i], signed[i], least[root[i]]) for i in range(len(ids)))
    named = simhash.near_copies(docs).collect()
    assert Counter(r["fingerprint"] for r in named) == Counter(f"{p:016x}" for p in prints[: len(rows)])


def test_one_of_each_group_stays(docs):
    out = simhash.without_near_copies(docs)
    groups = simhash.near_copies(docs).select("component_id").distinct().count()
    assert out.columns == docs.columns and out.count() == groups
    assert simhash.without_near_copies(docs.limit(0)).count() == 0


# --- 8 ----------------------------------------------------------------------------------


def test_mix_comes_near_its_targets(docs, rows):
    got = mixing.mix_documents(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    source = {r[0]: r[2] for r in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = None if r["doc_id"] is None else source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_documents(docs).collect()))
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.mix_documents(docs.limit(0)).count() == 0


# --- 9 ----------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    assert sharding.plan_transfers({0: 5, 1: 9}, {0: 7, 1: 3, 2: 4}) == [(0, 0, 5), (1, 0, 2), (1, 1, 3), (1, 2, 4)]
    # With other costs staying is not always best: the flow has to undo earlier choices.
    cost = {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 9}
    flows = sharding.plan_transfers({0: 4, 1: 4}, {0: 4, 1: 4}, lambda i, j: cost[i, j])
    assert flows == [(0, 1, 4), (1, 0, 4)]
    with pytest.raises(ValueError):
        sharding.plan_transfers({0: 1}, {0: 2})


def test_reshard_and_rewrite(spark, docs, rows, tmp_path):
    got = sharding.reshard_documents(docs, 3, 4, str(tmp_path / "all")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    largest = max(r["size"] for r in got)
    held = Counter()
    for shard in range(4):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        held[shard] = sum(r["size"] for r in own)
    assert max(held.values()) - min(held.values()) <= largest
    # The files hold the documents, whole, each file in the order of its slots.
    written = spark.read.parquet(str(tmp_path / "all"))
    changed = {r["to_shard"] for r in written.select("to_shard").distinct().collect()}
    assert changed
    whole = Counter(map(repr, written.select(docs.columns).collect()))
    assert not whole - Counter(map(repr, docs.collect()))
    assert sorted(map(tuple, written.select("to_shard", "to_slot", F.crc32(F.coalesce("text", F.lit(""))).alias("c")).collect())) == sorted(
        (r["shard"], r["slot"], r["text_crc32"]) for r in got if r["shard"] in changed
    )
    empty = sharding.reshard_documents(docs.limit(0), 3, 4, str(tmp_path / "none"))
    assert empty.count() == 0


def test_only_changed_shards_are_written(spark, tmp_path):
    path = str(tmp_path / "new")
    spark.range(16).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").alias("slot")).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    old = F.col("doc_id") % 2
    new = F.when(old == 0, 0).otherwise(1 + F.floor(F.col("doc_id") % 4 / 2)).cast("int")
    placed = docs.select(sharding.place_of(docs).alias("row"), old.alias("old"), new.alias("shard"), F.col("doc_id").alias("slot"))
    for _ in range(2):  # A repeated run replaces its files.
        assert sharding.rewrite(docs, placed, "old", path) == [1, 2]
        found = spark.read.parquet(path)
        assert sorted((r["to_shard"], r["doc_id"]) for r in found.collect()) == sorted((1 + i % 4 // 2, i) for i in range(1, 16, 2))
    assert sharding.changed_shards(placed.where("old = 0"), "old") == []


# --- 10 ---------------------------------------------------------------------------------


def plain_kept(texts, n=400):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + n, bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        gone = gone[: len(t)]
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 200_000])
def test_repeats_equal_brute_force(spark, docs, rows, crowd):
    got = repeats.without_repeats(docs, crowd).collect()
    expected = plain_kept([(r[1] or "").encode() for r in rows])
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter(
        (r[0], *e) for r, e in zip(rows, expected, strict=True)
    )
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_repeats_of_periodic_and_odd_text(spark):
    draw = np.random.default_rng(9)
    noise = ["".join(map(chr, draw.integers(97, 123, 500))) for _ in range(6)]
    texts = ["ab" * 260, noise[0] + "xy " * 300 + noise[1], noise[2] + "xy " * 200, noise[0][50:] + noise[3], noise[4][:399], noise[4][:400] + "é", noise[5] + noise[5][:401]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = plain_kept([t.encode() for t in texts])
    for crowd in (1, 200_000):
        got = sorted(repeats.without_repeats(table, crowd).collect(), key=lambda r: r["doc_id"])
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == expected


def test_maximal_repeats_have_all_occurrences():
    rights, lefts = [b"abcd", b"abce", b"abx"], [b"zy", b"zq", b"zy"]
    found = sorted(repeats.maximal_repeats(rights, lefts, 3))
    assert {(x, y, tuple(sorted(m))) for x, y, m in found} == {(1, 2, (0, 1, 2)), (1, 3, (0, 1)), (2, 2, (0, 2))}
