"""Decision log: appenders, staged replace; flags (G6), ids, backfill replacing only the eval partition."""
import datetime as dt
import threading

from pyspark.sql import functions as F

from calibra.session import fresh_path
from calibra.sources import decision_log as dlog
from calibra.sources.versioned import Versions


def _rows(spark, data, source):
    df = spark.createDataFrame(data, "k INT, text STRING, pred_department STRING, department_confidence DOUBLE, "
                                     "pred_urgency INT, urgency_confidence DOUBLE, churn_risk DOUBLE, "
                                     "refund_requested DOUBLE, gate_decision STRING, true_department STRING, "
                                     "true_urgency INT")
    return dlog.log_rows(df, source, F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"), carry=("k",))


def test_flags_and_counts(spark):
    path = fresh_path(spark, "log-test")
    data = [
        (1, "refund please", "Billing and Payments", 0.9, 2, 0.5, 0.1, 0.9, "auto_route", "Billing and Payments", 1),
        (2, "vpn down", "Technical Support", 0.4, 1, 0.5, 0.1, 0.1, "escalate_to_human", "IT Support", 1),
        (3, "hello", "Customer Service", 0.3, 0, 0.5, 0.1, 0.1, "escalate_to_human", None, None),
    ]
    dlog.append_log(spark, path, _rows(spark, data[:2], "eval"), ["k"])
    dlog.append_log(spark, path, _rows(spark, data[2:], "live"), ["k"])
    log = dlog.open_log(spark, path).orderBy("id").collect()
    assert [r.id for r in log] == [1, 2, 3]
    assert (log[0].department_correct, log[0].urgency_correct, log[0].gate_decision) == (1, 0, "auto_route")
    assert log[1].department_correct == 0
    assert (log[2].department_correct, log[2].urgency_correct) == (None, None)
    c = dlog.counts(dlog.open_log(spark, path)).first()
    assert (c.total, c.escalated) == (3, 2)
    recent = dlog.recent(dlog.open_log(spark, path), "escalate_to_human", 10).collect()
    assert [r.id for r in recent] == [3, 2] and [r.mark for r in recent] == ["MISS", "MISS"]


def test_backfill_replaces_only_eval(spark):
    path = fresh_path(spark, "log-backfill")
    live = [(9, "live one", "IT Support", 0.5, 1, 0.5, 0.1, 0.1, "escalate_to_human", None, None)]
    dlog.append_log(spark, path, _rows(spark, live, "live"), ["k"])
    preds = spark.createDataFrame(
        [(i, f"t{i}", "IT Support", 0.9, 1, 0.4, 0.1, 0.2, "auto_route", "IT Support", 1) for i in range(5)],
        "ticket_id INT, text STRING, cal_department STRING, cal_department_confidence DOUBLE, cal_urgency INT, "
        "cal_urgency_confidence DOUBLE, churn_risk DOUBLE, refund_requested DOUBLE, gate_decision STRING, "
        "true_department STRING, true_urgency INT")
    assert dlog.backfill_from_predictions(spark, path, preds, ["ticket_id"]) == 5
    assert dlog.backfill_from_predictions(spark, path, preds, ["ticket_id"]) == 5   # idempotent
    log = dlog.open_log(spark, path)
    by_src = {r.source: r.n for r in log.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert by_src == {"live": 1, "eval": 5}
    assert sorted(r.id for r in log.where("source = 'eval'").collect()) == [7, 8, 9, 10, 11]
    assert dlog.backfill_from_predictions(spark, path, None, ["ticket_id"]) == 0
    acc = {r.gate_decision: r.dept_acc for r in dlog.by_decision(log).collect()}
    assert acc == {"auto_route": 100.0, "escalate_to_human": None}


def test_empty_backfill_empties_eval_and_appends_read_no_rows(spark):
    path = fresh_path(spark, "log-empty")
    live = [(9, "live one", "IT Support", 0.5, 1, 0.5, 0.1, 0.1, "escalate_to_human", None, None)]
    dlog.append_log(spark, path, _rows(spark, live, "live"), ["k"])
    dlog.append_log(spark, path, _rows(spark, live * 3, "eval"), ["k"])
    none = spark.createDataFrame([], "ticket_id INT, text STRING, cal_department STRING, cal_department_confidence DOUBLE, "
                                     "cal_urgency INT, cal_urgency_confidence DOUBLE, churn_risk DOUBLE, refund_requested DOUBLE, "
                                     "gate_decision STRING, true_department STRING, true_urgency INT")
    assert dlog.backfill_from_predictions(spark, path, none, ["ticket_id"]) == 0
    assert [r.source for r in dlog.open_log(spark, path).collect()] == ["live"]
    assert dlog.max_id(spark, path) == 4 and {s["source"] for s in dlog.segments(spark, path)} == {"live"}
    dlog.append_log(spark, path, _rows(spark, live, "live"), ["k"])
    assert sorted(r.id for r in dlog.open_log(spark, path).collect()) == [1, 5]


def test_log_query_pushes_filter_to_scan(spark):
    path = fresh_path(spark, "log-plan")
    live = [(1, "x", "IT Support", 0.5, 1, 0.5, 0.1, 0.1, "escalate_to_human", None, None)]
    dlog.append_log(spark, path, _rows(spark, live, "live"), ["k"])
    plan = dlog.recent(dlog.open_log(spark, path), "escalate_to_human")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gate_decision), EqualTo(gate_decision,escalate_to_human)]" in plan
    assert "TakeOrderedAndProject" in plan


LIVE = [(9, "live one", "IT Support", 0.5, 1, 0.5, 0.1, 0.1, "escalate_to_human", None, None)]


def _marks(spark, path):
    return Versions(spark, f"{path}/_ids").versions()


def test_two_interleaved_appenders_share_no_id(spark):
    path, failed = fresh_path(spark, "log-two"), []

    def append(source, times):
        try:
            for _ in range(times):
                dlog.append_log(spark, path, _rows(spark, LIVE * 3, source), ["k"], source)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=append, args=(s, 4)) for s in ("live", "batch")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ids = [r.id for r in dlog.open_log(spark, path).collect()]
    assert not failed and sorted(ids) == list(range(1, 25))
    assert len(_marks(spark, path)) == 1
    assert {r.source: r["count"] for r in dlog.open_log(spark, path).groupBy("source").count().collect()} == {"live": 12, "batch": 12}


def test_many_writers_of_a_version(spark):
    folder, done = fresh_path(spark, "versions"), []

    def add(k):
        for i in range(8):
            done.append(Versions(spark, folder).update(lambda d: {"n": d.get("n", 0) + 1, "by": [*d.get("by", []), f"{k}.{i}"]})["n"])

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = Versions(spark, folder).read()
    assert got["n"] == 32 and sorted(done) == list(range(1, 33)) and len(set(got["by"])) == 32


def test_a_deleted_number_is_not_valid(spark):
    v = Versions(spark, fresh_path(spark, "stale"))
    for _ in range(3):
        v.update(lambda d: {"n": d.get("n", 0) + 1})
    assert v.versions() == [3]
    newest, seen = v._newest, []

    def slow():
        got = newest()
        if not seen:
            seen.append(got)
            return 1, {"body": {"n": 1}}        # what a writer read that then slept through two versions
        return got

    v._newest = slow
    assert v.update(lambda d: {"n": d.get("n", 0) + 1}) == {"n": 4}
    v._newest = newest
    assert v.read() == {"n": 4} and v.versions() == [4]


def test_backfill_is_one_swap(spark, monkeypatch):
    path = fresh_path(spark, "log-swap")
    dlog.append_log(spark, path, _rows(spark, LIVE * 2, "live"), ["k"], "live")
    dlog.append_log(spark, path, _rows(spark, LIVE * 3, "eval"), ["k"], "eval")
    seen, swap = [], dlog._swap

    def watched(*args):
        seen.append(sorted(r.source for r in dlog.open_log(spark, path).collect()))      # new rows are written, nothing is swapped
        return swap(*args)

    monkeypatch.setattr(dlog, "_swap", watched)
    preds = spark.createDataFrame([(1, "t", "IT Support", 0.9, 1, 0.4, 0.1, 0.2, "auto_route", "IT Support", 1)],
                                  "ticket_id INT, text STRING, cal_department STRING, cal_department_confidence DOUBLE, cal_urgency INT, "
                                  "cal_urgency_confidence DOUBLE, churn_risk DOUBLE, refund_requested DOUBLE, gate_decision STRING, "
                                  "true_department STRING, true_urgency INT")
    before = dlog.open_log(spark, path)
    assert dlog.backfill_from_predictions(spark, path, preds, ["ticket_id"]) == 1
    assert seen == [["eval"] * 3 + ["live"] * 2]
    assert sorted(r.source for r in dlog.open_log(spark, path).collect()) == ["eval", "live", "live"]
    assert sorted(r.source for r in before.collect()) == ["eval"] * 3 + ["live"] * 2      # an open reader keeps its state
    assert [r.source for r in dlog.open_log(spark, path, ("eval",)).collect()] == ["eval"]


def test_a_write_is_one_file(spark):
    path = fresh_path(spark, "log-files")
    dlog.append_log(spark, path, _rows(spark, LIVE * 50, "live"), ["k"], "live")
    assert len(dlog.open_log(spark, path).inputFiles()) == 1
