"""Case pulls, rankings and batch roll-ups."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions import dist


def confident_correct(pred: DataFrame, n: int = 6, min_conf: float = 0.85,
                      id_col: str = "ticket_id") -> DataFrame:
    """Calibrated label equals truth and confidence >= 0.85, top n by
    confidence (F6, T2). Plans as TakeOrderedAndProject: each task keeps its
    own top n, the driver merges n x tasks rows."""
    return (pred.where((F.col("cal_department") == F.col("true_department"))
                       & dist.passes("cal_department_confidence", F.lit(min_conf)))
                .orderBy(F.col("cal_department_confidence").desc(), F.col(id_col))
                .limit(n))


def confident_disagreements(pred: DataFrame, n: int = 6, min_conf: float = 0.6,
                            id_col: str = "ticket_id") -> DataFrame:
    """Calibrated label differs from truth at confidence >= 0.6."""
    return (pred.where(~F.col("cal_department").eqNullSafe(F.col("true_department"))
                       & dist.passes("cal_department_confidence", F.lit(min_conf)))
                .orderBy(F.col("cal_department_confidence").desc(), F.col(id_col))
                .limit(n))


def option_ranking(df: DataFrame, labels: str, probs: str, keep=()) -> DataFrame:
    """Options of each row by probability, descending; ties keep option
    order (T1). The ranking is an ``array_sort`` inside the row: no window,
    no shuffle."""
    zipped = F.arrays_zip(F.col(labels).alias("label"), F.col(probs).alias("prob"),
                          F.sequence(F.lit(1), F.size(labels)).alias("pos"))
    ranked = F.array_sort(zipped, lambda a, b: F.when(a["prob"] > b["prob"], -1)
                          .when(a["prob"] < b["prob"], 1)
                          .otherwise(a["pos"] - b["pos"]))
    return (df.select(*keep, F.posexplode(ranked).alias("rank0", "o"))
              .select(*keep, (F.col("rank0") + 1).alias("rank"), F.col("o.label").alias("label"),
                      F.col("o.prob").alias("prob")))


def department_volume(out: DataFrame, col: str = "department") -> DataFrame:
    """Volume by department, NULLs excluded, largest first."""
    return (out.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.col("n").desc(), F.col(col)))


def batch_rollup(out: DataFrame, decision_col: str = "decision") -> DataFrame:
    """Tickets triaged and share auto-routed in percent."""
    return out.agg(
        F.count(F.lit(1)).alias("tickets"),
        F.coalesce(F.avg((F.col(decision_col) == F.lit("auto_route")).cast("int").cast("double")) * 100.0,
                   F.lit(0.0)).alias("auto_route_pct"))


__all__ = ["batch_rollup", "confident_correct", "confident_disagreements",
           "department_volume", "option_ranking"]
