"""Confidence gate, gating metrics and the coverage-vs-accuracy sweep."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.functions import dist
from calibra.functions.dist import AUTO_ROUTE, DEFAULT_THRESHOLD, ESCALATE

# Sweep thresholds 0.50 .. 0.98 in steps of 0.02 (i / 100).
SWEEP_PERCENTS = list(range(50, 100, 2))


def add_gate(df: DataFrame, conf_col: str = "cal_department_confidence",
             threshold=DEFAULT_THRESHOLD, out: str = "gate_decision") -> DataFrame:
    """Adds the auto-route / escalate decision (F1). ``threshold`` may be a
    float or a Column, so a per-row or per-request threshold works (F2)."""
    return df.withColumn(out, dist.gate(conf_col, threshold))


def _eq(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def gating_metrics(df: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                   conf_col: str = "cal_department_confidence",
                   truth: str = "true_department", pred: str = "cal_department") -> DataFrame:
    """Auto-route count/rate/accuracy vs escalated, one pass.

    Ratios are 0.0 for an empty side or an empty input, as in the reference.
    """
    auto = dist.passes(conf_col, F.lit(float(threshold)))
    ok = _eq(truth, pred)
    s = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(auto).alias("auto_n"),
        F.count_if(auto & ok).alias("auto_ok"),
        F.count_if(~auto & ok).alias("esc_ok"),
    )
    total, auto_n, esc_n = F.col("total"), F.col("auto_n"), F.col("total") - F.col("auto_n")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return s.select(
        F.lit(float(threshold)).alias("threshold"),
        auto_n.alias("auto_route_count"),
        ratio(auto_n, total).alias("auto_route_rate"),
        ratio(F.col("auto_ok"), auto_n).alias("auto_route_accuracy"),
        esc_n.alias("escalate_count"),
        ratio(esc_n, total).alias("escalate_rate"),
        ratio(F.col("esc_ok"), esc_n).alias("escalate_accuracy"),
        ratio(F.col("auto_ok") + F.col("esc_ok"), total).alias("overall_accuracy"),
    )


def threshold_sweep(df: DataFrame, spark: SparkSession,
                    conf_col: str = "cal_department_confidence",
                    truth: str = "true_department", pred: str = "cal_department",
                    percents=None) -> DataFrame:
    """Auto-route rate (%) and accuracy (%) among ``conf >= th`` for each
    threshold (A14; the per-threshold range of J4 without a theta join).

    Each row is bucketed to the highest threshold it passes, so one
    ``groupBy(bucket)`` (<= 26 groups, partial aggregation map-side) replaces
    a theta join; a reverse running sum over the <= 25 threshold rows then
    gives ``count(conf >= th)``. Empty subset -> NULL accuracy (the reference's
    NaN); empty input -> rate 0.
    """
    percents = list(percents or SWEEP_PERCENTS)
    conf = F.nanvl(F.col(conf_col).cast("double"), F.lit(None).cast("double"))
    # Flat expression (codegen, no lambda): greatest() skips the NULLs of
    # thresholds the row does not pass; NULL when it passes none.
    bucket = F.greatest(*[F.when(conf >= F.lit(p / 100), F.lit(p / 100)) for p in percents]) \
        if len(percents) > 1 else F.when(conf >= F.lit(percents[0] / 100), F.lit(percents[0] / 100))
    hist = (df.select(bucket.alias("threshold"), _eq(truth, pred).cast("int").alias("ok"))
              .groupBy("threshold")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("k")))
    hist = hist.withColumn("total", F.sum("n").over(Window.partitionBy()))      # <= 26 rows
    grid = spark.createDataFrame([(p / 100,) for p in percents], "threshold DOUBLE")
    w = Window.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = (grid.join(F.broadcast(hist), "threshold", "left")
             .select("threshold",
                     F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n_auto"),
                     F.sum(F.coalesce("k", F.lit(0))).over(w).alias("k_auto"),
                     F.max("total").over(Window.partitionBy()).alias("total")))
    return j.select(
        "threshold",
        F.col("n_auto").cast("bigint").alias("auto_route_count"),
        F.coalesce(F.try_divide(F.col("n_auto").cast("double"), F.col("total").cast("double")) * 100.0,
                   F.lit(0.0)).alias("auto_route_rate"),
        (F.try_divide(F.col("k_auto").cast("double"), F.col("n_auto").cast("double")) * 100.0)
        .alias("auto_route_accuracy"),
    )


__all__ = ["AUTO_ROUTE", "ESCALATE", "add_gate", "gating_metrics", "threshold_sweep"]
