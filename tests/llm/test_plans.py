"""What the plans of the operators must not hold."""

import os
import re

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NATIVE = ("op1_", "op5_", "op7_", "op9_")
OPS = sorted(q for q in entry.queries() if re.match(r"op\d+_", q))

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_there_is_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in OPS) == list(range(1, 11))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", OPS)
def test_plan(spark, name):
    text = plan(entry.queries()[name](spark, DIR))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    if name.startswith(NATIVE) or name.startswith("op6_"):
        assert not re.search("Python|Pandas|Arrow", text)


def test_scans_read_only_what_they_need(spark):
    text = plan(entry.queries()["op9_mixing"](spark, DIR))
    assert all("lang" not in s and "n_chars" not in s for s in re.findall(r"ReadSchema: \S+", text))


def test_pipeline_filter_stays_above_its_measures(spark):
    from corpus_pipeline import STAGES

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    text = plan(STAGES[0][1](spark, docs, DIR))
    assert "Generate explode" in text and text.count("regexp_replace") < 20
