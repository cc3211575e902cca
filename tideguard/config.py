"""Parameters of the engine.

Everything an operator can be tuned with is an immutable dataclass; operators turn the
values into literals, so one plan always carries the parameters it was built with.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

# --- fixed values -------------------------------------------------------------------
# Default decision parameters.
DEFAULT_DECISION_PARAMETERS: dict[str, Any] = {
    "agent_weights": {"text": 0.40, "image": 0.35, "multimodal": 0.25},
    "label_severity": {
        "safe": 0.0,
        "normal": 0.0,
        "spam": 0.3,
        "toxic": 0.5,
        "gambling": 0.6,
        "porn": 0.8,
        "nsfw": 0.85,
        "violence": 0.9,
        "politics": 1.0,
        "unsafe": 0.7,
    },
    "score_thresholds": {
        "politics": 0.85,
        "violence": 0.85,
        "porn": 0.65,
        "gambling": 0.45,
        "toxic": 0.25,
        "spam": 0.10,
    },
    "grey_zone": {"low": 0.30, "high": 0.70},
    "zero_tolerance": ["politics", "violence"],
    "bert_high_confidence": 0.95,
    "bert_low_confidence": 0.40,
}

# Most severe first.
SEVERITY_ORDER = ["politics", "violence", "porn", "gambling", "toxic"]

# Raw classifier labels and the side they stand for.
CLASSIFIER_LABELS = {
    "toxic": "unsafe",
    "severe_toxic": "unsafe",
    "obscene": "unsafe",
    "threat": "unsafe",
    "insult": "unsafe",
    "identity_hate": "unsafe",
    "OK": "safe",
    "H": "unsafe",
    "H2": "unsafe",
    "SH": "unsafe",
    "HR": "unsafe",
    "V": "unsafe",
    "V2": "unsafe",
    "S": "unsafe",
    "S3": "unsafe",
}

# Dictionary used when no dictionary file is given.
DEFAULT_KEYWORDS = {
    "toxic": [
        "傻逼", "SB", "傻比", "脑残", "弱智", "白痴", "废物", "垃圾", "狗屁", "去死", "滚蛋",
        "草泥马", "操你妈", "fuck", "shit", "damn", "idiot", "stupid",
    ],
    "politics": ["台独", "港独", "藏独", "疆独"],
    "violence": ["杀了你", "弄死你", "砍死", "炸了", "枪支", "炸弹"],
    "porn": ["裸照", "约炮", "一夜情", "援交"],
    "gambling": ["赌博", "赌场", "博彩", "下注", "盘口"],
}
DEFAULT_WHITELIST = ["接口交换", "性交朋友", "操场上", "操练", "人体艺术摄影", "赌博式"]

# Labels an audit may answer with, and words that make an unreadable answer unsafe.
AUDIT_LABELS = ["safe", "toxic", "violence", "politics", "porn", "gambling", "spam"]
AUDIT_UNSAFE_WORDS = [
    "toxic", "unsafe", "violence", "politics", "porn", "gambling", "spam", "block", "harmful",
    "违规", "不安全",
]

# Categories a guard model may list.
GUARD_CATEGORIES = [
    "Violent",
    "Non-violent Illegal Acts",
    "Sexual Content or Sexual Acts",
    "PII",
    "Suicide & Self-Harm",
    "Unethical Acts",
    "Politically Sensitive Topics",
    "Copyright Violation",
    "Jailbreak",
    "None",
]

# Order in which tiers are reported.
TIER_ORDER = [
    "L0_memory", "L0_redis", "L0_empty", "L0_whitelist", "L1_keyword", "L1_chroma", "L2_bert",
    "L3_llm",
]
CACHE_TIERS = ["L0_memory", "L0_redis", "L0_phash", "L0_empty", "L0_whitelist", "L1_chroma"]

# Reliability bins, price per call, acceptance targets, alert limits.
RELIABILITY_BINS = [(0.0, 0.5), (0.5, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 0.95), (0.95, 1.0)]
TIER_PRICES = {"L2_bert": 0.0001, "L3_llm": 0.002}
TOKENS_PER_AUDIT, PRICE_PER_1K_TOKENS = 300, 0.002
HASH_SWEEP_THRESHOLDS = [2, 5, 8, 10, 12, 15, 20]

HAMMING_THRESHOLD = 10
SIMILARITY_THRESHOLD = 0.95
LOCAL_TTL_SECONDS = 3600
SHARED_TTL_SECONDS = 7200
SHARED_KEY_PREFIX = "mod:v1:"
RETRAIN_LABELS = 5000
DRIFT_DROP = 0.05
HISTORY_LENGTH = 60
# --- end of fixed values ------------------------------------------------------------


def merge_parameters(base: Mapping[str, Any], updates: Mapping[str, Any]) -> dict[str, Any]:
    """`base` with `updates` laid over it; maps are merged key by key, all else replaced."""
    merged = {k: dict(v) if isinstance(v, Mapping) else v for k, v in base.items()}
    for name, value in updates.items():
        old = merged.get(name)
        both_maps = isinstance(old, Mapping) and isinstance(value, Mapping)
        merged[name] = merge_parameters(old, value) if both_maps else value
    return merged


@dataclass(frozen=True)
class DecisionConfig:
    """Decision parameters; `with_updates` is the deep merge, `DecisionConfig()` the reset."""

    values: Mapping[str, Any] = field(
        default_factory=lambda: merge_parameters(DEFAULT_DECISION_PARAMETERS, {})
    )

    def with_updates(self, updates: Mapping[str, Any]) -> DecisionConfig:
        return DecisionConfig(merge_parameters(self.values, updates))

    def __getitem__(self, name: str) -> Any:
        return self.values[name]


@dataclass(frozen=True)
class Combo:
    words: tuple[str, ...]
    label: str
    note: str = ""


@dataclass(frozen=True)
class KeywordDictionary:
    """Words by category, dangerous combinations and harmless phrases, all lower case.

    A word listed twice keeps the category listed last.
    """

    categories: Mapping[str, list[str]]
    combos: tuple[Combo, ...] = ()
    whitelist: tuple[str, ...] = tuple(DEFAULT_WHITELIST)

    @cached_property
    def word_category(self) -> dict[str, str]:
        return {w.lower(): c for c, words in self.categories.items() for w in words}

    @cached_property
    def whitelist_pattern(self) -> str:
        return "|".join(re.escape(p.lower()) for p in self.whitelist)

    @classmethod
    def default(cls) -> KeywordDictionary:
        return cls(DEFAULT_KEYWORDS)

    @classmethod
    def from_json(cls, data: Mapping[str, Any], whitelist=tuple(DEFAULT_WHITELIST)):
        """From the dictionary file's content: `{category: [words], "combos": [...]}`."""
        combos = tuple(
            Combo(tuple(w.lower() for w in c["words"]), c["label"], c.get("note", ""))
            for c in data.get("combos", [])
        )
        words = {k: v for k, v in data.items() if k != "combos"}
        return cls(words, combos, tuple(whitelist))
