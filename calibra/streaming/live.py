"""Live triage as Structured Streaming.

New ticket files go through the same stateless transform as the batch job
(:func:`live_ticket_rows`: score, calibrate, class, gate). Each micro-batch reads the
fitted temperatures (S9) and the threshold anew, so a new fit or threshold takes
effect with the next batch and no restart, and joins them to the rows as scalar
subqueries.

A micro-batch has two sinks: its triaged rows are the result, and the decision log
takes them with ids. A failed log write does not fail the triage: the rows go to a
retry table keyed by run and epoch, and the next micro-batch (or
:func:`retry_failed`) writes them as the same epoch, so nothing is lost or doubled,
however often a batch or a retry is replayed. A stream with a new checkpoint is a
new run. The query checkpoint lives in the shared folder.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.dist import DEFAULT_THRESHOLD
from calibra.operators.prepare import nonblank
from calibra.operators.questions import QuestionSpec
from calibra.plans import jobs
from calibra.session import materialize
from calibra.sources import decision_log as dlog
from calibra.sources.predictions import read_temperatures


@dataclass(frozen=True)
class LiveJob:
    """What a live triage needs; every path is a folder on the shared store."""

    spec: QuestionSpec
    log_path: str
    order_cols: tuple[str, ...]                 # a total order of a micro-batch's rows; carried to the log's order
    settings_path: str | None = None            # temperatures (S8) in ``temperatures``, threshold in ``threshold``
    results_path: str | None = None             # the triaged rows, by run and epoch
    retry_path: str | None = None               # beside the log when not given
    scorer: object = "lexical"
    text_col: str = "text"
    threshold_col: str | None = None            # a threshold of each ticket's own (F2); null: the setting
    created_at: Column | None = field(default=None, compare=False)

    @property
    def retries(self) -> str:
        return self.retry_path or f"{self.log_path.rstrip('/')}-retry"


def write_threshold(spark: SparkSession, settings_path: str, threshold: float) -> None:
    spark.createDataFrame([(float(threshold),)], "threshold DOUBLE").coalesce(1).write.mode("overwrite").json(f"{settings_path}/threshold")


def read_settings(spark: SparkSession, settings_path: str | None) -> tuple[DataFrame | None, Column]:
    """Temperatures by question and the threshold as they are now; 1.0 and the default where nothing is stored."""
    if settings_path is None:
        return None, F.lit(DEFAULT_THRESHOLD)
    try:
        stored = spark.read.schema("threshold DOUBLE").json(f"{settings_path}/threshold")
        threshold = F.coalesce(stored.agg(F.max("threshold")).scalar(), F.lit(DEFAULT_THRESHOLD))
    except AnalysisException:
        threshold = F.lit(DEFAULT_THRESHOLD)
    return read_temperatures(spark, f"{settings_path}/temperatures"), threshold


def live_ticket_rows(stream: DataFrame, spec, scorer="lexical", temps=None, threshold=DEFAULT_THRESHOLD,
                     text_col: str = "text", carry=(), created_at: Column | None = None) -> DataFrame:
    """Stateless triage of a stream (or table) of tickets into log rows: text scored, urgency, churn and refund
    filled, blank texts left out (P16)."""
    given = stream.where(nonblank(text_col)).withColumn("text", F.col(text_col))
    done = given.transform(jobs.triage(spec, scorer, temps, threshold, "text"))
    shaped = done.select(*carry, "text", F.col("department").alias("pred_department"), "department_confidence",
                         F.col("urgency_class").alias("pred_urgency"), "urgency_confidence", "churn_risk",
                         "refund_requested", "gate_decision")
    return dlog.log_rows(shaped, "live", created_at, carry=carry)


def _epoch_path(folder: str, run: str, epoch: int) -> str:
    return f"{folder.rstrip('/')}/run={run}/epoch={int(epoch)}"


def run_name(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def write_batch(job: LiveJob, batch: DataFrame, run: str, epoch: int) -> bool:
    """Triage one micro-batch into both sinks; False when its log rows wait in the retry table."""
    spark = batch.sparkSession
    temps, threshold = read_settings(spark, job.settings_path)
    if job.threshold_col:
        threshold = F.coalesce(F.col(job.threshold_col), threshold)
    rows = materialize(live_ticket_rows(batch, job.spec, job.scorer, temps, threshold, job.text_col, job.order_cols, job.created_at))
    if job.results_path:
        rows.write.mode("overwrite").parquet(_epoch_path(job.results_path, run, epoch))
    try:
        retry_failed(spark, job)
        dlog.write_epoch(spark, job.log_path, rows, job.order_cols, run, epoch)
        return True
    except Exception:  # noqa: BLE001  the triage goes on whatever the log's store says; a failing retry table does fail it
        rows.write.mode("overwrite").parquet(_epoch_path(job.retries, run, epoch))
        return False


def failed_epochs(spark: SparkSession, job: LiveJob) -> list[tuple[str, int]]:
    """Runs and epochs whose log rows wait in the retry table (whole writes only)."""
    sc = spark.sparkContext
    pattern = sc._jvm.org.apache.hadoop.fs.Path(f"{job.retries}/run=*/epoch=*/_SUCCESS")
    found = pattern.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = [s.getPath().getParent() for s in found]
    return sorted((p.getParent().getName().partition("=")[2], int(p.getName().partition("=")[2])) for p in names)


def retry_failed(spark: SparkSession, job: LiveJob) -> int:
    """Write waiting epochs to the log in order; each leaves the retry table once it is in. Returns how many went."""
    sc, n = spark.sparkContext, 0
    for run, epoch in failed_epochs(spark, job):
        path = _epoch_path(job.retries, run, epoch)
        dlog.write_epoch(spark, job.log_path, spark.read.parquet(path), job.order_cols, run, epoch)
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
        n += 1
    return n


def start(job: LiveJob, stream: DataFrame, checkpoint: str, available_now: bool = True):
    """Start the triage of a stream of tickets; returns the StreamingQuery. The run is named by the checkpoint."""
    run = run_name(checkpoint)
    w = stream.writeStream.foreachBatch(lambda batch, epoch: write_batch(job, batch, run, epoch) and None)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def text_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """New parquet files at ``path``, a folder or a file (as a pattern, since a streaming source takes no plain file)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")
