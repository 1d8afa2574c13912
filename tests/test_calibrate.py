"""Temperature fit goldens (G2, G3) and edges."""
from calibra.operators import calibrate as cal
from conftest import dist_df


def _pairs(spark, n_x):
    rows = [(i, ["x", "y"], [0.95, 0.05], "x" if i < n_x else "y") for i in range(100)]
    return dist_df(spark, rows)


def test_over_confident_pair_hits_ceiling(spark):
    # Truth x on even rows, y on odd rows.
    rows = [(i, ["x", "y"], [0.95, 0.05], "x" if i % 2 == 0 else "y") for i in range(100)]
    r = cal.fit_temperature(dist_df(spark, rows), "labels", "probs", "truth", "q").first()
    assert r.t_coarse == 20.0
    assert abs(r.temperature - 20.23) < 1e-12
    assert r.hit_ceiling is True
    assert abs(r.nll_t1 - 1.5235127840) < 1e-9
    assert abs(r.nll_best - 0.6957928793) < 1e-9
    assert r.temperature > 1


def test_interior_optimum(spark):
    # Truth x on 70 of 100 rows.
    r = cal.fit_temperature(_pairs(spark, 70), "labels", "probs", "truth", "q").first()
    assert r.t_coarse == 3.5
    assert abs(r.temperature - 3.47) < 1e-12
    assert abs(r.nll_best - 0.6108644645) < 1e-9
    assert r.hit_ceiling is False


def test_empty_input_means_no_scaling(spark):
    empty = dist_df(spark, [])
    r = cal.fit_temperature(empty, "labels", "probs", "truth", "q").first()
    assert r.temperature == 1.0 and r.n == 0


def test_uniform_ties_keep_coarse_winner(spark):
    # NLL is ln(2) at every T: the first coarse point stays (strictly lower wins).
    rows = [(i, ["x", "y"], [0.5, 0.5], "x") for i in range(10)]
    r = cal.fit_temperature(dist_df(spark, rows), "labels", "probs", "truth", "q").first()
    assert r.t_coarse == 0.25 and r.temperature == 0.25


def test_calibrate_ordinal_uses_raw_class_scaled_confidence(spark):
    df = dist_df(spark, [(1, ["0", "1", "2"], [0.1, 0.2, 0.7], "2")])
    out = cal.calibrate_ordinal(df, "labels", "probs", {"urgency": 3.0}, "urgency", "c", "conf").first()
    assert out.c == 2
    assert 0.33 < out.conf < 0.7
