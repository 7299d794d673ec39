"""Plan shape: what the optimizer must produce for the operators to scale."""

import pytest

import __spark_entry__ as entry
from tributary.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for k, f in entry.queries().items() if k in all_queries()}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def _formatted(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_flagship_pushes_range_and_prunes_columns(spark):
    plan = _formatted(spark, QUERIES["q_mean_features_mean_day"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)" in plan
    assert "LessThan(l_shipdate,1997-01-02T00:00)" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    assert "partial_avg" in plan          # map-side partial aggregation


def test_area_ids_are_a_semi_join(spark):
    plan = _plan(QUERIES["q_subset_ids"](spark, SF))
    assert "LeftSemi" in plan


def test_point_lookup_is_pushed(spark):
    plan = _formatted(spark, QUERIES["q_point_lookup"](spark, SF))
    assert "EqualTo(l_suppkey,42)" in plan


def test_rows_made_by_explode_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from tributary.operators import spatial as sp
    from tributary.sources import fixtures as fx

    rings = fx.catchments(spark, SF)
    assert "Broadcast" not in _plan(sp.ring_edges(rings, "catchment_id"))
    points = rings.select(F.struct("catchment_id", "v").alias("_pt"), F.col("x").alias("px"), F.col("y").alias("py"))
    edges = sp.kept_edges(fx.areas(spark, SF), "area_id")
    assert "Broadcast" not in _plan(sp.box_candidates(points, "_pt", edges, ["area_id"], 2.0))


def test_segments_meet_without_their_cells_loads(spark):
    """Dense cells are found ahead; the join of the pairs counts nothing."""
    from tributary.operators import spatial as sp
    a, b = (spark.createDataFrame([(k, float(k), 0.5, k + 0.5, 0.5) for k in range(9)], f"{n} long, x1 double, y1 double, x2 double, y2 double") for n in "ab")
    for per_key, least, most in ((10_000, 81, 81), (1, 9, 60)):
        got = sp.candidate_segments(a, ["a"], b, ["b"], 20.0, pairs_per_key=per_key)
        assert "Aggregate" not in _plan(got)
        pairs = {(r.a, r.b) for r in got.collect()}
        assert pairs >= {(i, i) for i in range(9)} and least <= len(pairs) <= most
