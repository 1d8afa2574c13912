"""The report of one pass against the single metrics; measured times against the clock; NULL rules of A5 and A6."""
import time

import pytest
from pyspark.sql import functions as F

from calibra.operators import metrics
from calibra.operators.gate import gating_metrics
from calibra.operators.labels import level_names
from calibra.operators.report import report
from calibra.operators.score import LexicalModel
from calibra.plans import catalog, jobs
from conftest import SF_SMALL

LABELS = ["a", "b", "c"]
SCHEMA = "true_department STRING, cal_department STRING, cal_department_confidence DOUBLE, true_urgency INT, cal_urgency INT"
ROWS = [("a", "a", 0.9, 0, 0), ("a", "b", 0.9, 0, 2), ("a", None, 0.2, 1, None), ("b", "b", float("nan"), 2, 1), ("x", "x", 0.95, None, None),
        (None, None, None, 1, 1), ("b", "x", 0.85, 5, 5), ("b", "b", 0.86, None, 1)]


def figures(df):
    return {(r["section"], r["key"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("rows", [ROWS, []])
def test_report_equals_single_metrics(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = figures(report(df, LABELS, seconds=2.0, busy_seconds=1.5, meta={"n_test": len(rows)}))
    assert got["department", "accuracy"] == metrics.accuracy(df, "true_department", "cal_department").first()[0]
    for r in metrics.per_class_recall(df, spark, LABELS, "true_department", "cal_department").collect():
        assert (got["department", f"support:{r.label}"], got["department", f"recall:{r.label}"]) == (r.support, r.recall)
    for r in metrics.confusion(df, spark, LABELS, "true_department", "cal_department").collect():
        assert got["department", f"confusion:{r.true_label}|{r.pred_label}"] == r.n
    names = level_names()
    assert names == ["0:low", "1:medium", "2:high"]
    for r in metrics.confusion(df, spark, [0, 1, 2], "true_urgency", "cal_urgency", dtype="INT").collect():
        assert got["urgency", f"confusion:{names[r.true_label]}|{names[r.pred_label]}"] == r.n
    u = metrics.urgency_metrics(df).first()
    assert (got["urgency", "n"], got["urgency", "accuracy"], got["urgency", "within_one_level"]) == (u.n, u.accuracy, u.within_one_level)
    g = gating_metrics(df, 0.85).first().asDict()
    assert {k: got["gating", k] for k in g} == g
    n = len(rows)
    assert (got["latency", "tickets"], got["latency", "total_seconds"], got["latency", "scorer_seconds"]) == (n, 2.0, 1.5)
    assert (got["latency", "ms_per_ticket"], got["latency", "tickets_per_second"]) == (2000.0 / max(1, n), max(1, n) / 2.0)
    assert got["meta", "n_test"] == n and len(got) == 1 + 6 + 9 + 3 + 9 + 8 + 5 + 1


def test_null_predictions_are_misses(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, None), (0, None)], "true_urgency INT, cal_urgency INT")
    m = metrics.urgency_metrics(df).first()
    assert (m.n, m.accuracy, m.within_one_level) == (4, 0.25, 0.25)


def test_report_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/p")
    plan = report(spark.read.parquet(f"{tmp_path}/p"), LABELS, seconds=1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("scorer", ["lexical", LexicalModel])
def test_measured_time_is_bounded_by_the_clock(spark, scorer):
    t = catalog.tickets(spark, SF_SMALL).withColumn("text", F.repeat("text", 20)).repartition(4)
    begun = time.perf_counter()
    recs, took = jobs.score_split(t, catalog.ticket_spec(), scorer, ("ticket_id",))
    clock = time.perf_counter() - begun
    per_row = [r[0] for r in recs.select("scoring_seconds").collect()]
    assert took.tickets == len(per_row) > 0 and all(x > 0 for x in per_row)
    assert took.busy_seconds == pytest.approx(sum(per_row))
    assert 0 < took.seconds <= clock and took.busy_seconds <= took.seconds * spark.sparkContext.defaultParallelism
    long = spark.createDataFrame([("word " * 10,), ("word " * 300_000,)], "text STRING").coalesce(1)
    short_ms, long_ms = [r.latency_ms for r in long.transform(jobs.triage(catalog.ticket_spec(), scorer, timed=True)).collect()]
    assert 0 < short_ms <= long_ms and long_ms > 1.0      # the time lies in the scoring, not in reading a clock twice
    assert scorer != "lexical" or short_ms < long_ms / 10         # a model's batch shares its time


def test_evaluation_report_holds_measured_times(spark):
    begun = time.perf_counter()
    got = figures(catalog.q_measured_report(spark, SF_SMALL))
    assert 0 < got["latency", "total_seconds"] < time.perf_counter() - begun
    assert got["latency", "ms_per_ticket"] * got["latency", "tickets"] == pytest.approx(1000 * got["latency", "total_seconds"])
    assert got["latency", "scorer_seconds"] > 0 and got["meta", "n_test"] == got["latency", "tickets"]
