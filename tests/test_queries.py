"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import os
import re

import pytest

import __spark_entry__ as entry
from labelweave.plans import catalog
from tools import check_oracles

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_oracles.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    assert check_oracles.compare(spark, con, name, SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "label_idx", "label_key", "category", "score"]
    assert df.count() > 0


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = [
    "multi_hot",
    "zero_shot_scores",
    "top_labels_per_category",
    "wide_scores",
    "category_rollup",
    "contrastive_pairs",
    "row_scores",
    "queue_head",
]


@pytest.mark.parametrize("name", NARROW)
def test_plans_move_no_score_rows(spark, name):
    """Only the join of the judgements may shuffle, and it is broadcast here."""
    plan = plan_of(entry.queries()[name](spark, SF))
    final = plan.split("== Initial Plan ==")[0]
    assert not re.search(r"\bExchange (hash|range|round)", final)
    assert "CartesianProduct" not in final and "BroadcastNestedLoopJoin" not in final


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(entry.queries()["label_progress"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("text" not in s for s in schemas)
