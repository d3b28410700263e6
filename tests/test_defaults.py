"""Registered queries run at the operators' defaults."""

from meridia import queries
from meridia.operators import optimize

SF = "/root/testdata/sf0.001"


def test_every_method_walks_forward(spark):
    rows = queries.QUERIES["walk_forward_weights"](spark, SF).select("strategy").distinct().collect()
    assert {r.strategy for r in rows} == set(optimize.METHODS)


def test_paths_of_a_year(spark):
    assert queries.QUERIES["simulated_paths"](spark, SF).count() == 253
