import pytest

from tideguard.config import DEFAULT_DECISION_PARAMETERS, DecisionConfig, merge_parameters
from tideguard.operators import decision
from tideguard.operators.decision import config_table, with_decision

# name, cached, keyword label, keyword confidence, text (label, conf), image (label, conf), expected
RULES = [
    ("cached pass", ("pass", 0.95), None, 0.0, None, None, "pass"),
    ("cached block", ("block", 1.0), None, 0.0, None, None, "block"),
    ("zero tolerance politics", None, "politics", 1.0, None, None, "block"),
    ("zero tolerance violence", None, "violence", 1.0, None, None, "block"),
    ("sure toxic keyword", None, "toxic", 1.0, None, None, "block"),
    ("text safe", None, None, 0.0, ("safe", 0.95), None, "pass"),
    ("text unsafe", None, None, 0.0, ("unsafe", 0.95), None, "block"),
    ("text safe, image nsfw", None, None, 0.0, ("safe", 0.9), ("nsfw", 0.8), "block"),
    ("both unsafe", None, None, 0.0, ("unsafe", 0.95), ("nsfw", 0.8), "block"),
    ("only image, nsfw", None, None, 0.0, None, ("nsfw", 0.8), "block"),
    ("only image, normal", None, None, 0.0, None, ("normal", 0.9), "pass"),
    ("only image, unsure nsfw", None, None, 0.0, None, ("nsfw", 0.4), "pass"),
    ("nothing", None, None, 0.0, None, None, "pass"),
    ("grey 0.50", None, None, 0.0, ("unsafe", 0.50), None, "review"),
    ("grey 0.30", None, None, 0.0, ("unsafe", 0.30), None, "review"),
    ("grey 0.70", None, None, 0.0, ("unsafe", 0.70), None, "review"),
    ("below 0.29", None, None, 0.0, ("unsafe", 0.29), None, "pass"),
    ("above 0.71", None, None, 0.0, ("unsafe", 0.71), None, "block"),
    ("deep below 0.20", None, None, 0.0, ("unsafe", 0.20), None, "pass"),
    ("deep above 0.95", None, None, 0.0, ("unsafe", 0.95), None, "block"),
    ("safe in the grey zone", None, None, 0.0, ("safe", 0.50), None, "pass"),
]
SCHEMA = (
    "name string, cached_decision string, cached_confidence double, keyword_label string, "
    "keyword_confidence double, text_label string, text_confidence double, image_label string, "
    "image_confidence double"
)


def frame(spark, rows):
    none = (None, None)
    flat = [(n, *(c or none), k, kc, *(t or none), *(i or none)) for n, c, k, kc, t, i, *_ in rows]
    return spark.createDataFrame(flat, SCHEMA)


def test_rule_table(spark):
    got = with_decision(frame(spark, RULES), placeholder_image=False).collect()
    assert {r["name"]: r["decision"] for r in got} == {r[0]: r[-1] for r in RULES}


def test_absent_image_dilutes_text(spark):
    rows = [
        ("politics", None, None, 0.0, ("politics", 0.99), None),
        ("toxic low", None, None, 0.0, ("toxic", 0.33), None),
    ]
    got = {r["name"]: r for r in with_decision(frame(spark, rows)).collect()}
    assert got["politics"]["agg_label"] == "gambling"
    assert got["politics"]["score"] == pytest.approx(0.528, abs=1e-6)
    assert got["toxic low"]["rule"] == "safe"


def test_decision_is_total_and_ordered(spark):
    rows = [(str(c), None, None, 0.0, ("unsafe", c / 100), None) for c in range(101)]
    got = with_decision(frame(spark, rows), placeholder_image=False).collect()
    rank = {"pass": 0, "review": 1, "block": 2}
    levels = [rank[r["decision"]] for r in sorted(got, key=lambda r: int(r["name"]))]
    assert levels == sorted(levels) and set(levels) == {0, 1, 2}


def test_parameters_merge_and_reset():
    base = DecisionConfig()
    changed = base.with_updates({"grey_zone": {"low": 0.1}, "zero_tolerance": ["porn"]})
    assert changed["grey_zone"] == {"low": 0.1, "high": 0.7}
    assert changed["zero_tolerance"] == ["porn"]
    assert DecisionConfig().values == DEFAULT_DECISION_PARAMETERS == base.values
    assert merge_parameters({"a": {"b": 1}}, {"a": 2}) == {"a": 2}


def test_tenant_parameters(spark):
    strict = DecisionConfig().with_updates({"grey_zone": {"low": 0.0}})
    rows = [("a", None, None, 0.0, ("unsafe", 0.2), None), ("b", None, None, 0.0, ("unsafe", 0.2), None)]
    table = config_table(spark, {"a": strict}).withColumnRenamed("tenant", "name")
    got = with_decision(frame(spark, rows).join(table, "name", "left"), placeholder_image=False)
    assert {r["name"]: r["decision"] for r in got.collect()} == {"a": "review", "b": "pass"}


def test_tenant_maps_decide_like_the_config_given_directly(spark):
    base = DecisionConfig()
    own = base.with_updates({
        "score_thresholds": {"toxic": 0.9, "spam": 0.9, "gambling": 0.95},
        "label_severity": {"unsafe": 0.55},
        "agent_weights": {"text": 0.1, "image": 0.9},
    })
    df = frame(spark, RULES)
    table = config_table(spark, {"a": own, "b": base}).where("tenant = 'a'")
    joined = df.crossJoin(table)
    for placeholder in (True, False):
        columns = ["name", "score", "agg_label", "decision", "confidence", "reason", "rule"]
        got = with_decision(joined, placeholder_image=placeholder).select(columns)
        direct = with_decision(df, own, placeholder_image=placeholder).select(columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, direct.collect()))
    assert {r["agg_label"] for r in got.collect()} != {
        r["agg_label"] for r in with_decision(df, base, placeholder_image=False).collect()
    }


def test_third_signal_weighs_in(spark):
    cfg = DecisionConfig()
    rows = [
        ("toxic", 0.8, "nsfw", 0.9, "violence", 0.7), ("safe", 0.9, None, None, "toxic", 0.6),
        (None, None, None, None, "toxic", 1.0), (None, None, "normal", 0.9, "odd", 0.4), (None,) * 6,
    ]
    kinds = "text_label string, text_confidence double, image_label string, image_confidence double, multimodal_label string, multimodal_confidence double"
    got = decision.aggregate_signals(spark.createDataFrame(rows, kinds), cfg, placeholder_image=False).collect()
    severity, weights = cfg["label_severity"], cfg["agent_weights"]
    for r, row in zip(got, rows, strict=True):
        seen = [
            (weights[name], severity.get(label, unknown) * conf, conf)
            for name, unknown, label, conf in zip(("text", "image", "multimodal"), (0.5, 0.0, 0.5), row[::2], row[1::2], strict=True)
            if label is not None
        ]
        total = sum(w for w, _, _ in seen) or 1.0
        assert r["score"] == pytest.approx(sum(w * s for w, s, _ in seen) / total)
        assert r["agg_confidence"] == min([1.0, *[c for _, _, c in seen]])
