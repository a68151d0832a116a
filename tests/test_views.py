"""What the planner is told of the views."""

import pytest

from tessella.plans import views


def told(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


@pytest.mark.parametrize(("view", "times"), [("captions", 15), ("caption_facts", 7)])
def test_planner_knows_that_rows_are_copied(spark, small, view, times):
    rows, keys = getattr(views, view)(spark, small), views.read(spark, small, "customer").select("c_custkey")
    assert rows.count() == times * keys.count()
    assert told(rows) >= times * told(keys)


@pytest.mark.parametrize("view", ["captions", "caption_facts"])
def test_rows_are_made_by_many_tasks(spark, small, view):
    assert getattr(views, view)(spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
