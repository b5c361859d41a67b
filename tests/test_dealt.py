"""Tables are dealt by their size, so that a task's share doesn't grow with them."""

from conftest import DATA

from touchline.operators import lineage
from touchline.plans.registry import QUERIES


def test_tasks_follow_the_size_of_a_table(spark):
    path = f"{DATA}/lineitem.parquet"
    few, many = lineage.tasks_for(spark, path, 1e6), lineage.tasks_for(spark, path, 1e-3)
    assert few == 4 and many > 50


def test_queries_are_dealt_by_that_number(spark):
    for name, n in (("m22_design_products", 2), ("s06_statistics", 1)):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") >= n, name
        assert "ENSURE_REQUIREMENTS" not in plan, name
