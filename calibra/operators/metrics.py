"""Evaluation metrics: accuracy, dense confusion, recall, ordinal metrics.

Every metric is one aggregate over the fact rows with at most (#labels)^2
groups, so the shuffle after the map-side partial aggregation is tiny and
independent of the data size. Dense matrices are a label-space grid (built
from the label list, bounded by configuration) left-joined to the counts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _eq(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def accuracy(df: DataFrame, truth: str, pred: str, out: str = "accuracy") -> DataFrame:
    """Share of equal (truth, pred) pairs; 0.0 for an empty input (A1, A2, A5)."""
    return df.agg(F.coalesce(F.avg(_eq(truth, pred).cast("int").cast("double")),
                             F.lit(0.0)).alias(out))


def urgency_hits(truth: str, pred: str):
    """Equal levels, and levels at most one apart (``abs`` difference, C12); NULL equals NULL alone, as in accuracy."""
    t, p = F.col(truth).cast("int"), F.col(pred).cast("int")
    same = t.eqNullSafe(p)
    return same, same | F.coalesce(F.abs(t - p) <= 1, F.lit(False))


def urgency_metrics(df: DataFrame, truth: str = "true_urgency", pred: str = "cal_urgency") -> DataFrame:
    """Exact accuracy and within-one-level share, one pass."""
    same, near = urgency_hits(truth, pred)
    share = lambda c: F.coalesce(F.avg(c.cast("int").cast("double")), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("n"), share(same).alias("accuracy"), share(near).alias("within_one_level"))


def _grid(spark: SparkSession, labels, truth_name: str, pred_name: str, dtype: str) -> DataFrame:
    labels = list(labels)
    rows = [(i, a, j, b) for i, a in enumerate(labels) for j, b in enumerate(labels)]
    return spark.createDataFrame(
        rows, f"true_index INT, {truth_name} {dtype}, pred_index INT, {pred_name} {dtype}")


def confusion(df: DataFrame, spark: SparkSession, labels, truth: str, pred: str,
              truth_name: str = "true_label", pred_name: str = "pred_label",
              dtype: str = "STRING") -> DataFrame:
    """Dense confusion in long form, rows = truth, declared order.

    Only in-space (truth, pred) pairs are counted (F5): the label grid is the
    left side, so out-of-space pairs fall away in the join.
    """
    labels = list(labels)
    t, p = F.col(truth).cast(dtype), F.col(pred).cast(dtype)
    # Only in-space pairs can land in the grid; filtering first also makes the
    # broadcast bound (#labels^2 rows) hold whatever the data contains.
    counts = (df.where(t.isin(labels) & p.isin(labels))
                .groupBy(t.alias(truth_name), p.alias(pred_name))
                .agg(F.count(F.lit(1)).alias("n")))
    grid = _grid(spark, labels, truth_name, pred_name, dtype)
    return (grid.join(counts, [truth_name, pred_name], "left")
                .select("true_index", truth_name, "pred_index", pred_name,
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_peak(long: DataFrame) -> DataFrame:
    """Peak cell (at least 1) and the "above half of peak" flag.

    The peak is a scalar subquery over the (#labels)^2-row matrix.
    """
    peak = long.agg(F.greatest(F.max("n"), F.lit(1)).alias("peak")).scalar()
    return long.withColumn("peak", peak).withColumn("above_half", F.col("n") > F.col("peak") / 2.0)


def per_class_recall(df: DataFrame, spark: SparkSession, labels, truth: str, pred: str,
                     label_name: str = "label") -> DataFrame:
    """Support and recall for every declared class; zero support -> recall
    0.0 (A4). Predictions outside the space still count in the support."""
    labels = list(labels)
    per = (df.where(F.col(truth).isin(labels))
             .groupBy(F.col(truth).alias(label_name))
             .agg(F.count(F.lit(1)).alias("support"),
                  F.avg(_eq(truth, pred).cast("int").cast("double")).alias("recall")))
    dim = spark.createDataFrame(list(enumerate(labels)), f"ordinal INT, {label_name} STRING")
    return (dim.join(per, label_name, "left")
               .select("ordinal", label_name,
                       F.coalesce("support", F.lit(0)).cast("bigint").alias("support"),
                       F.coalesce("recall", F.lit(0.0)).alias("recall")))


def recall_table(df: DataFrame, labels, truth: str, pred: str, label_name: str = "department") -> DataFrame:
    """Dashboard recall table: declared classes with support only, recall in %
    rounded to 1 dp, highest recall first (A22, F8, T5)."""
    labels = list(labels)
    return (df.where(F.col(truth).isin(labels))
              .groupBy(F.col(truth).alias(label_name))
              .agg(F.count(F.lit(1)).alias("support"),
                   F.round(F.avg(_eq(pred, truth).cast("int").cast("double")) * 100.0, 1)
                   .alias("recall_pct"))
              .orderBy(F.col("recall_pct").desc(), F.col(label_name)))


def latency_metrics(df: DataFrame, total_seconds) -> DataFrame:
    """Tickets, total seconds, ms per ticket (divisor max(1, n)), tickets per
    second (0 when no time was measured) (A9). ``total_seconds`` is a measured
    number or an aggregate over the rows (say, of their times)."""
    total = F.coalesce(total_seconds, F.lit(0.0)) if isinstance(total_seconds, Column) else F.lit(float(total_seconds))
    secs, n1 = F.col("total_seconds"), F.greatest(F.col("tickets"), F.lit(1)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("tickets"), total.alias("total_seconds")).select(
        "tickets",
        "total_seconds",
        (secs / n1 * 1000.0).alias("ms_per_ticket"),
        F.when(secs != 0.0, n1 / secs).otherwise(F.lit(0.0)).alias("tickets_per_second"),
    )


def evaluation_rollup(pred: DataFrame) -> DataFrame:
    """Headline roll-up of stored predictions, using the STORED gate decision
    (A21): totals, accuracies, auto rate, gain of auto accuracy in points."""
    ok = F.col("cal_department") == F.col("true_department")
    auto = F.col("gate_decision") == F.lit("auto_route")
    esc = F.col("gate_decision") == F.lit("escalate_to_human")
    okd = F.coalesce(ok, F.lit(False)).cast("int")
    s = pred.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(okd).alias("ok"),
        F.sum(urgency_hits("true_urgency", "cal_urgency")[0].cast("int")).alias("urg_ok"),
        F.count_if(auto).alias("auto_n"),
        F.sum(F.when(auto, okd)).alias("auto_ok"),
        F.count_if(esc).alias("esc_n"),
        F.sum(F.when(esc, okd)).alias("esc_ok"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return s.select(
        "total",
        ratio("ok", "total").alias("department_accuracy"),
        ratio("urg_ok", "total").alias("urgency_accuracy"),
        F.col("auto_n").alias("auto_route_count"),
        ratio("auto_n", "total").alias("auto_route_rate"),
        ratio("auto_ok", "auto_n").alias("auto_route_accuracy"),
        F.col("esc_n").alias("escalate_count"),
        ratio("esc_ok", "esc_n").alias("escalate_accuracy"),
    ).withColumn("accuracy_gain_pts",
                 (F.col("auto_route_accuracy") - F.col("department_accuracy")) * 100.0)
