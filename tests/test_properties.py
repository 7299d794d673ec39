"""Property tests: distributed order statistics equal their single-machine
definitions on random inputs (few examples; each runs Spark jobs)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tributary.operators.ranking import dense_positions, exact_quantiles

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(vals=st.lists(st.integers(-50, 50), min_size=1, max_size=300), buckets=st.integers(1, 12))
def test_positions_are_dense_ranks(spark, vals, buckets):
    df = spark.createDataFrame([(v,) for v in vals], "t long")
    got = {r.t: r.pos for r in dense_positions(df, "t", "pos", n_buckets=buckets).collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(vals)))}


@SETTINGS
@given(vals=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=300),
       buckets=st.integers(1, 12))
def test_quantiles_equal_numpy_linear(spark, vals, buckets):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    row = exact_quantiles(df, "v", probs, ["q0", "q1", "q2", "q3", "q4"], n_buckets=buckets).first()
    want = np.quantile(np.array(vals), probs)
    assert np.allclose([row.q0, row.q1, row.q2, row.q3, row.q4], want, rtol=1e-12, atol=1e-9)
