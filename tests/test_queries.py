"""Registered queries against their SQL on the smallest tables."""

import importlib.util
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
SAMPLE = [
    "src_jsonl", "src_csv", "kw_verdict", "kw_whitelist", "reuse_two_tier", "hash_known", "gateway",
    "text_funnel", "decide", "review_resolve", "moderate_batch", "kw_discovery", "feedback_run",
    "eval_latency", "balanced_sample", "stream_stats", "finetune_trigger",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def check():
    spec = importlib.util.spec_from_file_location("check", os.path.join(ROOT, "tools", "check.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_sql_names_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, check, name):
    rows, problem = check.compare(
        entry.queries()[name](spark, SF), check.connect(SF), entry.oracle_sql()[name]
    )
    assert problem is None
    assert rows > 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n"] for r in rows) == 200
