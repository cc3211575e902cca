import csv
import io
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tideguard.config import KeywordDictionary
from tideguard.functions import signals as S
from tideguard.functions import text as X
from tideguard.functions import vectors as V
from tideguard.sources import readers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_upload(spark, tmp_path):
    path = write(
        tmp_path / "a.jsonl",
        '{"text": "今天"}\n\n{"id": "x", "text": "b"}\nnot json\n{"id": 7}\n[1]\n{"text": "d"}\n',
    )
    got = sorted(tuple(r) for r in readers.read_batch_jsonl(spark, path).collect())
    assert got == [("7", ""), ("b0", "今天"), ("b3", "d"), ("x", "b")]


def test_csv_upload(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Text,id\n a ,1\n\n"b, ""c""", k \n   ,z\nd\n')
    got = sorted(tuple(r) for r in readers.read_batch_csv(spark, path).collect())
    assert got == [("1", "a"), ("b5", "d"), ("k", 'b, "c"')]


def plain_csv(content):
    rows = []
    for i, row in enumerate(csv.reader(io.StringIO(content))):
        header = i == 0 and row and row[0].lower() in readers.CSV_HEADERS
        if not header and row and row[0].strip():
            rows.append((row[1].strip() if len(row) > 1 else f"b{i}", row[0].strip()))
    return sorted(rows)


@pytest.mark.parametrize("block", [16, 100, 1 << 20])
def test_csv_texts_with_line_breaks(spark, tmp_path, block):
    some = [
        'text,id\n', '"hello\nworld",1\n', '"a ""b"",\n\n\n""\n c",2\n', '\n', 'plain "x" y,3\n', '"one\r\ntwo"\r\n', '"\n"",\n",4\n',
        'p,"q\nr"\n', '5" disk\n', '"",6\n', '"x,y\n1,""\n2""",7\n', 'é "ü\n', '""""\n', '"l\n"\n',
    ]
    content = "".join(some) * 20 + '"last\nline",9'
    path = tmp_path / "a.csv"
    path.write_bytes(content.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(tuple(r) for r in readers.read_batch_csv(spark, str(path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == plain_csv(content)


def test_positions_run_over_partitions(spark, tmp_path):
    path = write(tmp_path / "n.txt", "".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = spark.read.text(path)
        assert lines.rdd.getNumPartitions() > 2
        got = readers.with_position(lines).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(int(r["value"]) == r["position"] for r in got) and len(got) == 5000


def test_events_skip_malformed_lines(spark, tmp_path):
    lines = [json.dumps({"event_id": f"e{i}", "timestamp": float(i)}) for i in range(5)]
    path = write(tmp_path / "e.jsonl", "\n".join([*lines, "{broken", ""]))
    got = readers.read_events(spark, path, limit=2).collect()
    assert sorted(r["event_id"] for r in got) == ["e3", "e4"]
    assert readers.count_events(readers.read_events(spark, path).cache()).first()["n"] == 5


def test_dictionary_file(spark, tmp_path):
    data = {
        "politics": ["A", "b"],
        "toxic": ["B", "c"],
        "combos": [{"words": ["X", "y"], "label": "porn", "note": "n"}],
    }
    path = write(tmp_path / "d.json", json.dumps(data))
    loaded = readers.load_dictionary(spark, path)
    assert loaded.word_category == {"a": "politics", "b": "toxic", "c": "toxic"}
    assert loaded.combos[0].words == ("x", "y")
    table = readers.dictionary_table(spark, path).collect()
    assert {r["word"]: r["category"] for r in table} == loaded.word_category
    assert readers.combos_table(spark, path).first()["label"] == "porn"
    assert readers.load_dictionary(spark, None).word_category == KeywordDictionary.default().word_category
    assert "sb" in KeywordDictionary.default().word_category


AUDITS = [
    ('{"label": "porn", "confidence": 0.9, "reason": "r"}', ("porn", 0.9, "r", "direct")),
    ('{"label": "porn"}', ("porn", 0.8, "", "direct")),
    ('x\n```json\n{"label": "spam", "confidence": 1}\n```', ("spam", 1.0, "", "fenced")),
    ('So: {"label": "safe",\n "confidence": 0.2} ok', ("safe", 0.2, "", "braces")),
    ("clearly HARMFUL text", ("unsafe", 0.5, None, "heuristic")),
    ("内容违规", ("unsafe", 0.5, None, "heuristic")),
    ("all fine {", ("safe", 0.5, None, "heuristic")),
]


def test_audit_answers(spark):
    df = spark.createDataFrame([(a,) for a, _ in AUDITS], "raw string")
    got = df.select(S.parse_audit(F.col("raw")).alias("p")).select("p.*").collect()
    for r, (_, (label, confidence, reason, how)) in zip(got, AUDITS, strict=True):
        assert (r["label"], r["confidence"], r["parsed_as"]) == (label, confidence, how)
        assert reason is None or r["reason"] == reason


def test_audit_schema_problems(spark):
    rows = [
        ('{"label": "safe", "confidence": 0.5, "reason": "r"}', []),
        ('{"label": "odd", "confidence": 2, "reason": "r"}', ["label unknown", "confidence out of range"]),
        ('{"label": "safe"}', ["confidence missing", "reason missing"]),
        ("nothing", ["not an object"]),
    ]
    df = spark.createDataFrame([(a,) for a, _ in rows], "raw string")
    got = df.select(S.audit_problems(F.col("raw")).alias("p")).collect()
    assert [r["p"] for r in got] == [p for _, p in rows]


def test_guard_answers(spark):
    rows = [
        ("Safety: Safe\nCategories: None", ("safe", "safe", 0.99, [])),
        ("safety: UNSAFE\nCategories: Violent, PII", ("unsafe", "unsafe", 0.99, ["Violent", "PII"])),
        ("Safety: Controversial\nSuicide & Self-Harm", ("controversial", "unsafe", 0.7, ["Suicide & Self-Harm"])),
        ("it looks unsafe", (None, "unsafe", 0.7, [])),
        ("it looks safe", (None, "safe", 0.7, [])),
        ("no idea", (None, "safe", 0.5, [])),
    ]
    df = spark.createDataFrame([(a,) for a, _ in rows], "raw string")
    got = df.select(S.parse_guard(F.col("raw")).alias("g")).select("g.*").collect()
    assert [(r["safety"], r["label"], r["confidence"], r["categories"]) for r in got] == [w for _, w in rows]


def test_classifier_verdicts(spark):
    rows = [
        ([("toxic", 0.3)], ("unsafe", 0.3)),
        ([("OK", 0.91234)], ("safe", 0.9123)),
        ([("LABEL_0", 0.9), ("threat", 0.6)], ("unsafe", 0.6)),
        ([("LABEL_0", 0.9), ("threat", 0.2)], ("safe", 0.8)),
        ([("LABEL_0", 0.9)], ("safe", 1.0)),
        ([], ("safe", 1.0)),
    ]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s array<struct<label:string,score:double>>")
    got = df.select(S.score_verdict(F.col("s")).alias("v")).select("v.*").collect()
    assert [(r["label"], r["confidence"]) for r in got] == [w for _, w in rows]


def test_texts_and_images(spark):
    df = spark.createDataFrame(
        [("", "http://i", "aGk="), (" a ", "", "data:image/png;base64,aGk="), ("b", None, "%%")],
        "text string, url string, b64 string",
    )
    got = df.select(
        X.resolve_text(F.col("text"), F.col("url")).alias("t"),
        X.image_bytes(F.col("b64")).alias("i"),
        X.route(X.resolve_text(F.col("text"), F.col("url")), F.lit(None).cast("string")).alias("r"),
    ).collect()
    assert [r["t"] for r in got] == ["[Image URL: http://i]", "a", "b"]
    assert [r["i"] and bytes(r["i"]) for r in got] == [b"hi", b"hi", None]
    assert [r["r"] for r in got] == ["decision", "text", "text"]
    ratio = spark.range(1).select(
        X.match_ratio(F.lit("a b C"), F.lit("cb")).alias("x"),
        X.match_ratio(F.lit(""), F.lit("c")).alias("y"),
        X.match_ratio(F.lit("c"), F.lit("")).alias("z"),
    ).first()
    assert (ratio["x"], ratio["y"], ratio["z"]) == (pytest.approx(2 / 3), 1.0, 0.0)


def bmp(width, height, grey):
    """A 24-bit bitmap from a function of (x, y)."""
    pad = (4 - width * 3 % 4) % 4
    rows = b"".join(
        b"".join(bytes([grey(x, y)] * 3) for x in range(width)) + b"\0" * pad
        for y in reversed(range(height))
    )
    head = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_image_files_to_hashes(spark, tmp_path):
    rise = lambda x, y: min(255, 3 * x + y)
    (tmp_path / "up.bmp").write_bytes(bmp(72, 64, rise))
    (tmp_path / "large.bmp").write_bytes(bmp(144, 128, lambda x, y: rise(x // 2, y // 2)))
    (tmp_path / "down.bmp").write_bytes(bmp(72, 64, lambda x, y: 255 - rise(x, y)))
    (tmp_path / "broken.bmp").write_bytes(b"no image")
    images = readers.read_images(spark, str(tmp_path))
    got = {
        os.path.basename(r["origin"]): (r["d"], r["phash"])
        for r in V.image_hashes(images)
        .select("origin", V.hash_hex(F.col("dhash")).alias("d"), "phash")
        .collect()
    }
    assert set(got) == {"up.bmp", "large.bmp", "down.bmp"}
    assert got["up.bmp"][0] == got["large.bmp"][0] == "f" * 16
    assert got["down.bmp"][0] == "0" * 16
    assert V.INVALID_DISTANCE == 999 and len(got["up.bmp"][1]) == 16
    near = (int(got["up.bmp"][1], 16) ^ int(got["large.bmp"][1], 16)).bit_count()
    far = (int(got["up.bmp"][1], 16) ^ int(got["down.bmp"][1], 16)).bit_count()
    assert near < 10 < far
