"""Distribution expressions: gate, scaling, argmax, ordinal class (G5 + edges)."""
import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from calibra.functions import dist
from conftest import dist_df


def _one(spark, labels, probs, *cols):
    df = dist_df(spark, [(1, labels, probs, labels[0])])
    return df.select(*cols).first()


def test_gate_boundary_inclusive(spark):
    df = spark.createDataFrame([(0.90,), (0.85,), (0.84,), (None,)], "c DOUBLE")
    got = [r[0] for r in df.select(dist.gate("c", 0.85)).collect()]
    assert got == ["auto_route", "auto_route", "escalate_to_human", "escalate_to_human"]


def test_temperature_one_is_identity_and_scaling_sums_to_one(spark):
    r = _one(spark, ["a", "b", "c"], [0.7, 0.2, 0.1],
             dist.apply_temperature("probs", 1.0).alias("t1"),
             dist.apply_temperature("probs", 0.5).alias("t05"),
             dist.apply_temperature("probs", 3.0).alias("t3"),
             dist.argmax_label("labels", dist.apply_temperature("probs", 0.5)).alias("a05"),
             dist.argmax_label("labels", dist.apply_temperature("probs", 3.0)).alias("a3"))
    assert r.t1 == [0.7, 0.2, 0.1]
    assert abs(sum(r.t05) - 1) < 1e-12 and abs(sum(r.t3) - 1) < 1e-12
    assert r.t05[0] > 0.7 > r.t3[0]
    assert r.a05 == "a" and r.a3 == "a"


def test_temperature_column_matches_literal(spark):
    df = dist_df(spark, [(1, ["a", "b"], [0.9, 0.1], "a")]).withColumn("t", F.lit(2.0))
    a = df.select(dist.apply_temperature("probs", F.col("t"))).first()[0]
    b = df.select(dist.apply_temperature("probs", 2.0)).first()[0]
    assert a == b


def test_tie_first_label_wins(spark):
    r = _one(spark, ["a", "b", "c"], [0.4, 0.4, 0.2], dist.argmax_label("labels", "probs").alias("l"))
    assert r.l == "a"


def test_zero_probability_is_floored_before_log(spark):
    r = _one(spark, ["a", "b"], [1.0, 0.0], dist.apply_temperature("probs", 2.0).alias("p"))
    expect_b = math.sqrt(1e-9) / (1 + math.sqrt(1e-9))
    assert abs(r.p[1] - expect_b) < 1e-15


def test_expected_value_half_even_and_clamp(spark):
    rows = [(1, ["0", "1", "2"], [0.5, 0.5, 0.0], "0"),      # ev 0.5 -> 0
            (2, ["0", "1", "2"], [0.0, 0.5, 0.5], "0"),      # ev 1.5 -> 2
            (3, ["0", "1", "2"], [0.45, 0.1, 0.45], "0")]    # ev 1.0 -> 1, not the argmax
    df = dist_df(spark, rows)
    got = df.select(dist.ordinal_class(dist.expected_value("labels", "probs"), F.size("labels"))).collect()
    assert [r[0] for r in got] == [0, 2, 1]


def test_truth_absent_nll_is_floor(spark):
    df = dist_df(spark, [(1, ["a", "b"], [0.6, 0.4], "z")])
    v = df.select(dist.nll_term("labels", "probs", "truth", F.lit(2.0)),
                  dist.nll_term("labels", "probs", "truth", F.lit(1.0))).first()
    assert abs(v[0] - 20.7232658369) < 1e-9 and abs(v[1] - 20.7232658369) < 1e-9


def test_unnormalised_input_untouched_at_t1(spark):
    r = _one(spark, ["a", "b"], [0.3, 0.3], dist.apply_temperature("probs", 1.0).alias("p"),
             dist.top_prob("probs").alias("m"))
    assert r.p == [0.3, 0.3] and r.m == 0.3


probs_strategy = st.lists(st.floats(min_value=1e-6, max_value=1.0), min_size=2, max_size=6)


@settings(max_examples=25, deadline=None)
@given(raw=probs_strategy, t=st.floats(min_value=0.25, max_value=20.0))
def test_scaling_invariants(spark, raw, t):
    z = sum(raw)
    probs = [x / z for x in raw]
    labels = [str(i) for i in range(len(probs))]
    df = dist_df(spark, [(1, labels, probs, "0")]).select(dist.apply_temperature("probs", t).alias("p"))
    p = df.first().p
    assert abs(sum(p) - 1) < 1e-9
    if max(probs) - sorted(probs)[-2] > 1e-9:
        assert p.index(max(p)) == probs.index(max(probs))
    lo = _one(spark, labels, probs, dist.apply_temperature("probs", 0.5).alias("p")).p
    hi = _one(spark, labels, probs, dist.apply_temperature("probs", 5.0).alias("p")).p
    assert max(lo) >= max(probs) - 1e-12 >= max(hi) - 2e-12


def test_per_request_threshold_column(spark):
    df = spark.createDataFrame([(0.7, 0.6), (0.7, 0.8), (0.95, 0.99)], "c DOUBLE, th DOUBLE")
    got = [r[0] for r in df.select(dist.gate("c", F.col("th"))).collect()]
    assert got == ["auto_route", "escalate_to_human", "escalate_to_human"]


def test_unrolled_softmax_is_bit_identical(spark):
    """The fixed-label-count path gives exactly the lambda path's arrays, for
    literal and per-row temperatures (T = 1.0 passes through), and keeps a
    NULL distribution NULL."""
    rows = [([0.7, 0.2, 0.1, 0.0], 0.5), ([0.25, 0.25, 0.25, 0.25], 3.0), ([1.0, 0.0, 0.0, 0.0], 1.0),
            ([1e-12, 0.3, 0.6, 0.1], 0.05), (None, 2.0)]
    df = spark.createDataFrame(rows, "p ARRAY<DOUBLE>, t DOUBLE")
    for temp in (0.5, 2.0, "t"):
        a = dist.with_temperature(df, "p", temp, "a")
        both = dist.with_temperature(a, "p", temp, "b", 4)
        for r in both.collect():
            assert r.a == r.b
    sm = dist.with_softmax(dist.with_softmax(df, "p", "a"), "p", "b", 4)
    for r in sm.collect():
        assert r.a == r.b


def test_nan_confidence_escalates(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.85,), (0.84,)], "c DOUBLE")
    got = [r[0] for r in df.select(dist.gate("c")).collect()]
    assert got == [dist.ESCALATE, dist.ESCALATE, dist.AUTO_ROUTE, dist.ESCALATE]


def test_fixed_label_count_refuses_other_sizes(spark):
    import pytest

    df = spark.createDataFrame([([0.02] * 9 + [0.82],)], "p ARRAY<DOUBLE>")
    assert dist.with_temperature(df, "p", 2.0, "s", 10).first().s == dist.with_temperature(df, "p", 2.0, "s").first().s
    for n in (8, 11):
        with pytest.raises(Exception, match="does not have"):
            dist.with_temperature(df, "p", 2.0, "s", n).collect()
