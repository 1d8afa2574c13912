"""The evaluation report from one pass over the predictions.

Predictions are counted once into cells: true and predicted department (labels
outside the declared space fall into one cell), whether they agree, true and
predicted urgency, whether they agree exactly or within one level, and the gate's
decision. The cells are at most some thousands, whatever the rows, and every figure
is a ratio or a count of sums over them. All declared labels, levels and matrix
cells appear, zero where nothing was counted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import dist
from calibra.operators.labels import URGENCY_RUBRIC, level_names
from calibra.operators.metrics import urgency_hits

OUTSIDE = "\u0000outside"
KEYS = "section STRING, key STRING, ratio BOOLEAN"


def report_cells(pred: DataFrame, labels, levels: int = len(URGENCY_RUBRIC), threshold: float | Column = dist.DEFAULT_THRESHOLD,
                 truth: str = "true_department", guess: str = "cal_department", conf: str = "cal_department_confidence",
                 true_urgency: str = "true_urgency", urgency: str = "cal_urgency") -> DataFrame:
    """Sufficient statistics: one row for each combination, with its number of predictions."""
    inside = lambda c: F.when(F.col(c).isin(list(labels)), F.col(c)).otherwise(F.lit(OUTSIDE))
    level = lambda c: F.when(F.col(c).cast("int").between(0, levels - 1), F.col(c).cast("int")).otherwise(F.lit(-1))
    same, near = urgency_hits(true_urgency, urgency)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return pred.groupBy(
        inside(truth).alias("truth"), inside(guess).alias("guess"), F.col(truth).eqNullSafe(F.col(guess)).alias("hit"),
        level(true_urgency).alias("true_level"), level(urgency).alias("level"), same.alias("same"), near.alias("near"),
        dist.passes(conf, limit).alias("auto")).agg(F.count(F.lit(1)).alias("n"))


def report_keys(labels, levels) -> list[tuple[str, str, bool]]:
    """Section, key and kind (ratio or count) of every figure, in the order of the report."""
    labels, levels = list(labels), list(levels)
    return ([("department", "accuracy", True)] + [("department", f"{k}:{x}", k == "recall") for x in labels for k in ("recall", "support")]
            + [("department", f"confusion:{a}|{b}", False) for a in labels for b in labels]
            + [("urgency", "n", False), ("urgency", "accuracy", True), ("urgency", "within_one_level", True)]
            + [("urgency", f"confusion:{a}|{b}", False) for a in levels for b in levels]
            + [("gating", k, not k.endswith("count")) for k in ("auto_route_count", "auto_route_rate", "auto_route_accuracy", "escalate_count",
                                                                 "escalate_rate", "escalate_accuracy", "overall_accuracy")]
            + [("latency", "tickets", False)])


def report(pred: DataFrame, labels, rubric=URGENCY_RUBRIC, threshold: float = dist.DEFAULT_THRESHOLD, seconds: float | None = None,
           busy_seconds: float | None = None, meta: dict | None = None, **columns) -> DataFrame:
    """Long-format report (section, key, value DOUBLE). ``seconds``: measured time of the scoring job; ``busy_seconds``: the
    scorers' own time summed over tasks; ``meta``: numbers of the run (S14)."""
    spark, levels = pred.sparkSession, level_names(rubric)
    cells = report_cells(pred, labels, len(levels), threshold, **columns)
    n, zero = F.col("n"), F.lit(0)
    when = lambda c: F.when(c, n).otherwise(zero)
    name = F.array(*[F.lit(x) for x in levels])
    known = lambda *c: F.lit(True) if not c else (F.col(c[0]) != OUTSIDE if len(c) == 1 else (F.col(c[0]) != OUTSIDE) & (F.col(c[1]) != OUTSIDE))
    part = lambda section, key, num, den=zero, only=F.lit(True): F.struct(
        F.lit(section).alias("section"), F.when(only, key if isinstance(key, Column) else F.lit(key)).alias("key"),
        num.cast("bigint").alias("num"), den.cast("bigint").alias("den"))
    hit, auto, in_space = F.col("hit"), F.col("auto"), (F.col("true_level") >= 0) & (F.col("level") >= 0)
    parts = [
        part("department", "accuracy", when(hit), n),
        part("department", F.concat(F.lit("recall:"), F.col("truth")), when(hit), n, known("truth")),
        part("department", F.concat(F.lit("support:"), F.col("truth")), n, only=known("truth")),
        part("department", F.concat(F.lit("confusion:"), F.col("truth"), F.lit("|"), F.col("guess")), n, only=known("truth", "guess")),
        part("urgency", "n", n),
        part("urgency", "accuracy", when(F.col("same")), n),
        part("urgency", "within_one_level", when(F.col("near")), n),
        part("urgency", F.concat(F.lit("confusion:"), F.get(name, F.col("true_level")), F.lit("|"), F.get(name, F.col("level"))), n, only=in_space),
        part("gating", "auto_route_count", when(auto)),
        part("gating", "auto_route_rate", when(auto), n),
        part("gating", "auto_route_accuracy", when(auto & hit), when(auto)),
        part("gating", "escalate_count", when(~auto)),
        part("gating", "escalate_rate", when(~auto), n),
        part("gating", "escalate_accuracy", when(~auto & hit), when(~auto)),
        part("gating", "overall_accuracy", when(hit), n),
        part("latency", "tickets", n),
    ]
    sums = (cells.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("key IS NOT NULL")
                 .groupBy("section", "key").agg(F.sum("num").alias("num"), F.sum("den").alias("den")))
    keys = spark.createDataFrame(report_keys(labels, levels), KEYS)
    count = F.coalesce("num", zero).cast("double")
    figures = keys.join(F.broadcast(sums), ["section", "key"], "left").select(
        "section", "key", F.when(F.col("ratio"), F.coalesce(F.try_divide(count, F.col("den").cast("double")), F.lit(0.0))).otherwise(count).alias("value"))
    given = [("gating", "threshold", float(threshold)), *[("meta", k, float(v)) for k, v in (meta or {}).items()]]
    if seconds is not None:
        given.append(("latency", "total_seconds", float(seconds)))
    if busy_seconds is not None:
        given.append(("latency", "scorer_seconds", float(busy_seconds)))
    out = figures.unionByName(spark.createDataFrame(given, "section STRING, key STRING, value DOUBLE"))
    if seconds is None:
        return out
    per = F.when(F.col("key") == "tickets", F.greatest(F.col("value"), F.lit(1.0)))
    rates = [F.struct(F.lit("latency").alias("section"), F.col("key"), F.col("value"))] + [
        F.struct(F.lit("latency").alias("section"), F.lit(k).alias("key"), v.alias("value"))
        for k, v in (("ms_per_ticket", F.lit(float(seconds) * 1000.0) / per),
                     ("tickets_per_second", per / F.lit(float(seconds)) if seconds else F.lit(0.0)))]
    tickets = F.struct("section", "key", "value")
    own = F.when((F.col("section") == "latency") & (F.col("key") == "tickets"), F.array(*rates)).otherwise(F.array(tickets))
    return out.select(F.explode(own).alias("r")).select("r.*")
