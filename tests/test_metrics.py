"""Metric goldens: the published evaluation (G1) and the metrics check."""
from pyspark.sql import functions as F

from calibra.operators import calibrate as cal
from calibra.operators import metrics
from calibra.operators.gate import gating_metrics, threshold_sweep
from calibra.operators.labels import DEPARTMENT_NAMES

DEPT_MATRIX = [
    [213, 1, 44, 3, 13, 1, 0, 7],
    [85, 4, 16, 2, 4, 0, 2, 3],
    [119, 0, 40, 5, 16, 1, 0, 2],
    [17, 0, 9, 64, 5, 0, 0, 0],
    [66, 3, 48, 13, 11, 0, 1, 1],
    [20, 0, 11, 3, 7, 7, 1, 0],
    [8, 0, 10, 1, 10, 0, 2, 0],
    [5, 2, 6, 0, 2, 0, 0, 25],
]
URG_MATRIX = [[0, 136, 39], [0, 266, 130], [0, 192, 176]]


def _expand(spark, matrix, labels, dtype):
    cells = [(labels[i], labels[j], n) for i, row in enumerate(matrix) for j, n in enumerate(row)]
    df = spark.createDataFrame(cells, f"t {dtype}, p {dtype}, n INT")
    return df.select("t", "p", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_")).drop("_")


def test_published_department_matrix(spark):
    df = _expand(spark, DEPT_MATRIX, DEPARTMENT_NAMES, "STRING")
    assert df.count() == 939
    acc = metrics.accuracy(df, "t", "p").first()[0]
    assert abs(acc - 366 / 939) < 1e-12 and round(acc * 100, 1) == 39.0
    rec = {r.label: (r.support, r.recall) for r in
           metrics.per_class_recall(df, spark, DEPARTMENT_NAMES, "t", "p").collect()}
    assert [rec[d][0] for d in DEPARTMENT_NAMES] == [282, 116, 183, 95, 143, 49, 31, 40]
    assert [round(rec[d][1] * 100, 1) for d in DEPARTMENT_NAMES] == [75.5, 3.4, 21.9, 67.4, 7.7, 14.3, 6.5, 62.5]
    conf = metrics.confusion(df, spark, DEPARTMENT_NAMES, "t", "p").orderBy("true_index", "pred_index")
    assert [r.n for r in conf.collect()] == [n for row in DEPT_MATRIX for n in row]
    pred_totals = conf.groupBy("pred_index").agg(F.sum("n").alias("s")).orderBy("pred_index")
    assert [r.s for r in pred_totals.collect()] == [533, 10, 184, 91, 68, 9, 6, 38]


def test_published_urgency_matrix(spark):
    df = _expand(spark, URG_MATRIX, [0, 1, 2], "INT")
    m = metrics.urgency_metrics(df, "t", "p").first()
    assert abs(m.accuracy - 442 / 939) < 1e-12 and round(m.accuracy * 100, 1) == 47.1
    assert abs(m.within_one_level - 900 / 939) < 1e-12 and round(m.within_one_level * 100, 1) == 95.8


def test_published_gating_aggregate(spark):
    # 67 auto (65 correct) and 872 escalated (301 correct); confidences on the
    # right side of 0.85 (the per-row values are not published).
    rows = ([("a", "a", 0.9)] * 65 + [("a", "b", 0.95)] * 2 + [("a", "a", 0.5)] * 301 + [("a", "b", 0.84)] * 571)
    df = spark.createDataFrame(rows, "t STRING, p STRING, c DOUBLE")
    g = gating_metrics(df, 0.85, "c", "t", "p").first()
    assert (g.auto_route_count, g.escalate_count) == (67, 872)
    assert round(g.auto_route_rate * 100, 1) == 7.1 and round(g.auto_route_accuracy * 100, 1) == 97.0
    assert round(g.escalate_rate * 100, 1) == 92.9 and round(g.escalate_accuracy * 100, 1) == 34.5


def _g4(spark):
    rows = [
        (["d0", "d1"], [0.95, 0.05], 2, [0.1, 0.2, 0.7]),
        (["d0", "d1"], [0.90, 0.10], 1, [0.2, 0.7, 0.1]),
        (["d1", "d0"], [0.92, 0.08], 0, [0.2, 0.5, 0.3]),
        (["d0", "d1"], [0.40, 0.60], 2, [0.1, 0.2, 0.7]),
    ]
    df = spark.createDataFrame(
        [(i, "d0", dl, dp, tu, ["0", "1", "2"], up) for i, (dl, dp, tu, up) in enumerate(rows)],
        "id INT, true_department STRING, dl ARRAY<STRING>, dp ARRAY<DOUBLE>, true_urgency INT, "
        "ul ARRAY<STRING>, up ARRAY<DOUBLE>")
    return cal.calibrate(df, {"department": 1.0, "urgency": 1.0}, ("dl", "dp"), ("ul", "up"))


def test_metrics_check_records(spark):
    df = _g4(spark)
    assert [r.cal_urgency for r in df.orderBy("id").collect()] == [2, 1, 1, 2]
    assert metrics.accuracy(df, "true_department", "cal_department").first()[0] == 0.5
    conf = metrics.confusion(df, spark, ["d0", "d1"], "true_department", "cal_department")
    assert conf.where("true_index = 0 AND pred_index = 0").first().n == 2
    u = metrics.urgency_metrics(df).first()
    assert u.accuracy == 0.75 and u.within_one_level == 1.0
    g = gating_metrics(df, 0.85).first()
    assert (g.auto_route_count, g.escalate_count) == (3, 1)
    assert abs(g.auto_route_accuracy - 2 / 3) < 1e-12 and g.escalate_accuracy == 0.0


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "true_department STRING, cal_department STRING, "
                                      "cal_department_confidence DOUBLE")
    g = gating_metrics(empty).first()
    assert g.auto_route_count == 0 and g.auto_route_rate == 0.0 and g.overall_accuracy == 0.0
    assert metrics.accuracy(empty, "true_department", "cal_department").first()[0] == 0.0
    sweep = threshold_sweep(empty, spark).collect()
    assert len(sweep) == 25 and all(r.auto_route_rate == 0.0 and r.auto_route_accuracy is None for r in sweep)


def test_sweep_matches_gate_and_is_monotone(spark):
    rows = [("a", "a" if i % 3 else "b", (i % 50) / 49.0) for i in range(500)]
    df = spark.createDataFrame(rows, "true_department STRING, cal_department STRING, cal_department_confidence DOUBLE")
    sweep = {round(r.threshold, 2): r for r in threshold_sweep(df, spark).collect()}
    counts = [sweep[k].auto_route_count for k in sorted(sweep)]
    assert counts == sorted(counts, reverse=True)
    g = gating_metrics(df, 0.86).first()
    assert sweep[0.86].auto_route_count == g.auto_route_count
    assert abs(sweep[0.86].auto_route_accuracy / 100 - g.auto_route_accuracy) < 1e-12
