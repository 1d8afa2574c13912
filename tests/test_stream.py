"""The live stream: same rows as the batch transform, settings per micro-batch, failures, replays, compaction."""
import pytest
from pyspark.sql import functions as F

from calibra.operators.questions import build_questions
from calibra.plans import catalog
from calibra.session import fresh_path
from calibra.sources import decision_log as dlog
from calibra.sources.predictions import write_temperatures
from calibra.sources.tables import table_path
from calibra.streaming import live
from conftest import SF_SMALL

TICKETS = "ticket_id INT, text STRING"


def job_of(spark, **more):
    return live.LiveJob(build_questions(), fresh_path(spark, "ticket-log"), ("ticket_id",), **more)


def batch_of(spark, *rows):
    return spark.createDataFrame(list(rows), TICKETS)


def test_stream_equals_batch(spark):
    job = live.LiveJob(catalog.ticket_spec(), fresh_path(spark, "log"), ("doc_id",))
    path = table_path(SF_SMALL, "documents")
    live.start(job, live.text_stream(spark, path, spark.read.parquet(path).schema), fresh_path(spark, "ckpt")).awaitTermination()
    log = dlog.open_log(spark, job.log_path)
    columns = ["text", "pred_department", "department_confidence", "pred_urgency", "urgency_confidence", "churn_risk",
               "refund_requested", "gate_decision"]
    want = live.live_ticket_rows(spark.read.parquet(path), job.spec)
    assert sorted(tuple(r) for r in log.select(columns).collect()) == sorted(tuple(r) for r in want.select(columns).collect())
    got = log.orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, len(got) + 1)) and {r.source for r in got} == {"live"}
    assert all(r.true_department is None and r.department_correct is None for r in got)


def test_ticket_stream_scores_text_and_survives_replays(spark):
    source, job = fresh_path(spark, "tickets"), job_of(spark)
    batch_of(spark, (1, "please refund my invoice"), (2, " \n\t "), (3, "cancel now, refund"), (4, None)).write.parquet(source)
    for runs in (1, 2):                                                    # a new checkpoint is a new run
        live.start(job, live.text_stream(spark, source, TICKETS, 100), fresh_path(spark, "ckpt")).awaitTermination()
        got = dlog.open_log(spark, job.log_path).collect()
        assert sorted({r.text for r in got}) == ["cancel now, refund", "please refund my invoice"] and len(got) == 2 * runs
        assert all(None not in (r.pred_department, r.pred_urgency, r.churn_risk, r.refund_requested) for r in got)
    for _ in range(2):                                                     # a replayed batch replaces itself
        live.write_batch(job, batch_of(spark, (1, "invoice"), (2, "refund")), "replayed", 7)
    assert dlog.open_log(spark, job.log_path).count() == 6


def test_settings_are_read_for_each_batch(spark):
    settings = fresh_path(spark, "settings")
    job = job_of(spark, settings_path=settings)
    texts = [(1, "refund invoice payments"), (2, "vpn network access")]
    decided = []
    for epoch, (temperature, threshold) in enumerate([(None, None), (0.25, 0.5), (20.0, 0.5), (0.25, 0.999999)]):
        if temperature:
            write_temperatures(spark.createDataFrame([("department", temperature)], "question STRING, temperature DOUBLE"), f"{settings}/temperatures")
            live.write_threshold(spark, settings, threshold)
        live.write_batch(job, batch_of(spark, *texts), "run", epoch)
        new = dlog.open_log(spark, job.log_path).where(F.col("id") > 2 * epoch).collect()
        decided.append((min(r.department_confidence for r in new), {r.gate_decision for r in new}))
    assert decided[1][0] >= decided[0][0] > decided[2][0]
    assert decided[1][1] == {"auto_route"} and decided[2][1] == {"escalate_to_human"}
    own = spark.createDataFrame([(1, "refund", 0.0), (2, "refund", 1.1), (3, "refund", None)], f"{TICKETS}, limit DOUBLE")
    live.write_batch(job_of(spark, threshold_col="limit"), own, "own", 0)


@pytest.mark.parametrize("lost", [1, 2])
def test_failed_log_write_loses_and_doubles_nothing(spark, monkeypatch, lost):
    job = job_of(spark, results_path=fresh_path(spark, "results"))
    write, calls = dlog.write_epoch, []

    def failing(*args):
        calls.append(args)
        if len(calls) <= lost:
            raise OSError("store is away")
        return write(*args)

    monkeypatch.setattr(dlog, "write_epoch", failing)
    for epoch in range(4):
        done = live.write_batch(job, batch_of(spark, (2 * epoch, f"refund {epoch}"), (2 * epoch + 1, f"invoice {epoch}")), "run", epoch)
        assert done == (epoch >= lost)
        assert spark.read.parquet(f"{job.results_path}/run=run/epoch={epoch}").count() == 2       # the triage itself never fails
    assert live.failed_epochs(spark, job) == []
    got = dlog.open_log(spark, job.log_path).collect()
    assert sorted(r.text for r in got) == sorted(f"{w} {e}" for e in range(4) for w in ("refund", "invoice"))
    assert len({r.id for r in got}) == 8
    live.write_batch(job, batch_of(spark, (0, "refund 0"), (1, "invoice 0")), "run", 0)           # a replay of a retried epoch
    assert dlog.open_log(spark, job.log_path).count() == 8


def test_compaction_keeps_rows_and_ids(spark):
    job = job_of(spark)
    for epoch in range(6):
        live.write_batch(job, batch_of(spark, (2 * epoch, f"refund {epoch}"), (2 * epoch + 1, f"invoice {epoch}")), "run", epoch)
    before = sorted(tuple(r) for r in dlog.open_log(spark, job.log_path).collect())
    assert len(dlog.segments(spark, job.log_path)) == 6
    old = dlog.open_log(spark, job.log_path)                       # resolved before: its files stay until vacuum
    assert dlog.compact(spark, job.log_path) == 5
    assert [s["epoch"] for s in dlog.segments(spark, job.log_path)] == [5, None]
    files = dlog.open_log(spark, job.log_path).inputFiles()
    assert len(files) == 2
    assert sorted(tuple(r) for r in dlog.open_log(spark, job.log_path).collect()) == before == sorted(tuple(r) for r in old.collect())
    assert live.write_batch(job, batch_of(spark, (0, "refund 0")), "run", 0)                  # closed: not written again
    live.write_batch(job, batch_of(spark, (10, "refund 5"), (11, "invoice 5")), "run", 5)     # the newest can be replayed
    assert sorted(r.text for r in dlog.open_log(spark, job.log_path).collect()) == sorted(r[3] for r in before)
    assert dlog.vacuum(spark, job.log_path) == 0 and dlog.vacuum(spark, job.log_path, 0.0) == 6
    assert dlog.open_log(spark, job.log_path).count() == 12
