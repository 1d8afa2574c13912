"""End-to-end jobs: score -> calibrate -> gate -> evaluate -> persist.

``triage`` is one DataFrame -> DataFrame function used by the batch job, the
evaluation and the stream alike (U10). The scorer is the expensive stage, so
jobs score once and let the caller persist/write before the several metric
aggregates read the calibrated rows.
"""
from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from calibra.functions import dist
from calibra.functions import text as tx
from calibra.operators import calibrate as cal
from calibra.operators.gate import add_gate
from calibra.operators.labels import urgency_class_name
from calibra.operators.questions import QuestionSpec
from calibra.operators.report import report
from calibra.operators.score import lexical_score, score_with_model, timed_lexical_score
from calibra.session import materialize
from calibra.sources.predictions import write_predictions

DEPT = ("department_labels", "department_probs")
URG = ("urgency_labels", "urgency_probs")


def score(df: DataFrame, spec: QuestionSpec, scorer="lexical", text_col: str = "text",
          batch_size: int = 8, timed: bool = False, **kw) -> DataFrame:
    """Adds ``answers``/``routing`` with the native scorer or a user model; ``timed`` adds ``scoring_seconds``, measured per row."""
    if scorer == "lexical":
        return (timed_lexical_score if timed else lexical_score)(df, spec, text_col, **kw)
    if callable(scorer):
        return score_with_model(df, scorer, spec, text_col, batch_size, timed)
    raise ValueError(f"unknown scorer {scorer!r}")


@dataclass(frozen=True)
class Elapsed:
    """Measured time of a scoring job."""

    tickets: int
    seconds: float          # of the sink action that scored and stored the records, by the driver's clock
    busy_seconds: float     # of the scorer, summed over all rows and tasks, carried by an Observation


def score_split(df: DataFrame, spec: QuestionSpec, scorer="lexical", keep=()) -> tuple[DataFrame, Elapsed]:
    """Score a whole split, store its records, and say how long that took (U5): one job."""
    seen = Observation("scoring")
    timed = records(score(df, spec, scorer, timed=True), (*keep, "scoring_seconds")).observe(
        seen, F.count(F.lit(1)).alias("tickets"), F.coalesce(F.sum("scoring_seconds"), F.lit(0.0)).alias("busy"))
    begun = time.perf_counter()
    stored = materialize(timed)
    seconds = time.perf_counter() - begun
    return stored, Elapsed(int(seen.get["tickets"]), seconds, float(seen.get["busy"]))


def records(scored: DataFrame, keep=()) -> DataFrame:
    """Flat record per ticket, truth kept in the same row.

    Expects ``text``, ``department`` and ``urgency_score`` truth columns.
    """
    a = F.col("answers")
    return scored.select(
        *keep,
        "text",
        F.col("department").alias("true_department"),
        F.col("urgency_score").cast("int").alias("true_urgency"),
        a["department"]["choice"].alias("pred_department"),
        a["department"]["confidence"].alias("department_confidence"),
        a["department"]["labels"].alias(DEPT[0]),
        a["department"]["probs"].alias(DEPT[1]),
        dist.ordinal_class(a["urgency"]["score"], F.lit(3)).alias("pred_urgency"),
        a["urgency"]["score"].alias("urgency_score_raw"),
        a["urgency"]["confidence"].alias("urgency_confidence"),
        a["urgency"]["labels"].alias(URG[0]),
        a["urgency"]["probs"].alias(URG[1]),
        a["churn_risk"]["noul"].alias("churn_risk"),
        a["refund_requested"]["noul"].alias("refund_requested"),
    )


def calibrated(recs: DataFrame, temps, threshold=dist.DEFAULT_THRESHOLD,
               n_department: int | None = None, n_urgency: int | None = None) -> DataFrame:
    """Records + ``cal_*`` columns + the gate decision (C8, F1). Label counts, when
    a spec fixes them, unroll the scaling; a row of another size is an error."""
    out = cal.calibrate(recs, temps, DEPT, URG, n_department, n_urgency)
    return add_gate(out, "cal_department_confidence", threshold)


def fit_job(cal_records: DataFrame, n_department: int | None = None, n_urgency: int | None = None) -> DataFrame:
    """One temperature per scored question on the calibration split."""
    return cal.fit_temperatures({
        "department": (cal_records, DEPT[0], DEPT[1], "true_department", n_department),
        "urgency": (cal_records, URG[0], URG[1], "true_urgency", n_urgency),
    })


def temperatures_dict(temps: DataFrame) -> dict:
    """The fitted ``(question, temperature)`` rows (one per question -- bounded
    by the spec, not the data) as a driver-side dict."""
    return {r["question"]: float(r["temperature"]) for r in temps.select("question", "temperature").collect()}


def evaluate(tickets: DataFrame, spec: QuestionSpec, scorer="lexical", temps=None, path: str | None = None,
             keep=("ticket_id", "split"), threshold=dist.DEFAULT_THRESHOLD) -> DataFrame:
    """Evaluate job (U12): score once, fit on the ``cal`` rows, calibrate and gate ALL other rows.

    ``tickets`` has ``text``, the truth columns ``department`` and
    ``urgency_score`` and a ``split``; ``cal`` is the one bounded sample.
    With ``temps`` nothing is fitted. With ``path`` the predictions are stored.
    """
    return evaluate_timed(tickets, spec, scorer, temps, path, keep, threshold)[0].drop("scoring_seconds")


def evaluate_timed(tickets: DataFrame, spec: QuestionSpec, scorer="lexical", temps=None, path: str | None = None,
                   keep=("ticket_id", "split"), threshold=dist.DEFAULT_THRESHOLD) -> tuple[DataFrame, Elapsed, dict]:
    """:func:`evaluate` with the measured time of the scoring and the temperatures used."""
    recs, elapsed = score_split(tickets, spec, scorer, keep)
    in_cal = F.coalesce(F.col("split") == "cal", F.lit(False))
    if temps is None:
        temps = temperatures_dict(fit_job(recs.where(in_cal), len(spec["department"].options), len(spec["urgency"].options)))
    out = calibrated(recs.where(~in_cal), temps, threshold, len(spec["department"].options), len(spec["urgency"].options))
    if path:
        write_predictions(out.drop("scoring_seconds"), path)
    return out, elapsed, temps


def evaluation_report(tickets: DataFrame, spec: QuestionSpec, scorer="lexical", temps=None,
                      threshold: float = dist.DEFAULT_THRESHOLD) -> DataFrame:
    """Score, fit, calibrate, gate and report, with measured times and the run's metadata.

    The scoring job's time is that of all scored tickets; the report has the share of those evaluated, by their number.
    """
    out, elapsed, used = evaluate_timed(tickets, spec, scorer, temps, threshold=threshold)
    labels = spec["department"].labels
    own = out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("scoring_seconds"), F.lit(0.0)).alias("busy")).first()
    meta = {"n_test": own["n"], "departments": len(labels), **{f"t_{q}": used.get(q, 1.0) for q in ("department", "urgency")}}
    return report(out, labels, threshold=threshold, seconds=elapsed.seconds * own["n"] / max(1, elapsed.tickets),
                  busy_seconds=own["busy"], meta=meta)


def triage(spec: QuestionSpec, scorer="lexical", temps=None,
           threshold=dist.DEFAULT_THRESHOLD, text_col: str = "text", timed: bool = False) -> Callable[[DataFrame], DataFrame]:
    """``df.transform(triage(...))``: score, calibrate, classify, gate (U10); ``timed`` adds ``latency_ms``, the row's measured
    time in the scorer.

    Urgency class from the raw expected value (one rule everywhere);
    confidence from the scaled distribution.
    """
    def run(df: DataFrame) -> DataFrame:
        a = F.col("answers")
        scored = score(df, spec, scorer, text_col, timed=timed)
        if timed:
            scored = scored.withColumn("latency_ms", F.col("scoring_seconds") * 1000.0).drop("scoring_seconds")
        scored = scored.select(
            "*",
            a["department"]["labels"].alias(DEPT[0]), a["department"]["probs"].alias(DEPT[1]),
            a["urgency"]["labels"].alias(URG[0]), a["urgency"]["probs"].alias(URG[1]),
            a["churn_risk"]["noul"].alias("churn_risk"),
            a["refund_requested"]["noul"].alias("refund_requested"))
        out = calibrated(scored, temps, threshold,
                         len(spec["department"].options), len(spec["urgency"].options))
        return (out.withColumnRenamed("cal_department", "department")
                   .withColumnRenamed("cal_department_confidence", "department_confidence")
                   .withColumnRenamed("cal_urgency", "urgency_class")
                   .withColumnRenamed("cal_urgency_confidence", "urgency_confidence")
                   .withColumn("urgency_label", urgency_class_name("urgency_class"))
                   .drop("answers", "routing"))
    return run


def batch_output(triaged: DataFrame, keep=()) -> DataFrame:
    """The 7-column batch result (U11, P12, P15): 90-char text (newlines
    kept), confidence to 3 dp, churn and refund to 2 dp (half-even)."""
    return triaged.select(
        *keep,
        tx.preview("text", 90, newline_to_space=False).alias("text"),
        "department",
        tx.round_half_even("department_confidence", 3).alias("dept_conf"),
        F.col("urgency_label").alias("urgency"),
        F.col("gate_decision").alias("decision"),
        tx.round_half_even("churn_risk", 2).alias("churn"),
        tx.round_half_even("refund_requested", 2).alias("refund"),
    )
