"""Registered queries over inputs the driver tables do not hold by themselves:
NULL and NaN values, NULL strata, blank texts, other label counts. The edge
values are derived from every row of a driver table."""
from __future__ import annotations

from pyspark.sql import functions as F

from calibra.operators import calibrate as cal
from calibra.operators import metrics
from calibra.operators.gate import add_gate, gating_metrics, threshold_sweep
from calibra.operators.prepare import fraction_split, nonblank, stratified_split
from calibra.plans import fixtures as fx
from calibra.sources.tables import read_table

LABEL_COUNTS = {10: (2, 3), 2: (4, 3)}      # multipliers of the derived weights
HOT_TEMPERATURES = (2.0, 20.0)
FRACTIONS = {"cal": 0.05, "test": 0.9}


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _scaling(n: int):
    """A head of ``n`` labels, scaled without a stated label count."""
    a, b = LABEL_COUNTS[n]

    def query(spark, sf):
        e = read_table(spark, sf, "events").select("event_id")
        w = [1 + (F.col("event_id") * F.lit(a * k + b)) % 17 for k in range(n)]
        total = sum(w[1:], w[0])
        head = e.select("event_id", F.array(*[F.lit(f"d{k}") for k in range(n)]).alias("labels"),
                        F.array(*[x.cast("double") / total for x in w]).alias("probs"))
        out = None
        for t in HOT_TEMPERATURES:
            part = cal.calibrate_choice(head, "labels", "probs", {"q": t}, "q", "label", "conf")
            part = part.select("event_id", F.lit(t).alias("temperature"), "label", r6("conf").alias("confidence"))
            out = part if out is None else out.unionByName(part)
        return out
    return query


def edge_events(spark, sf):
    """Events with a NULL or wrong prediction, a NaN or NULL confidence, and a threshold of their own."""
    i = F.col("event_id")
    return read_table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("truth"),
        F.when(i % 3 == 0, F.lit(None)).when(i % 2 == 0, F.col("event_type")).otherwise(F.lit("view")).alias("pred"),
        F.when(i % 5 == 0, F.lit(float("nan"))).when(i % 5 == 1, F.lit(None)).when(i % 5 == 2, F.lit(0.85))
         .when(i % 5 == 3, F.lit(0.8)).otherwise(F.lit(0.99)).alias("conf"),
        (F.lit(0.75) + (i % 4) / F.lit(20.0)).alias("limit_"))


def q_gate_nan_null(spark, sf):
    """fixed threshold and a threshold per row."""
    return add_gate(add_gate(edge_events(spark, sf), "conf", 0.85, "decision"), "conf", F.col("limit_"), "decision_own").select(
        "event_id", "decision", "decision_own")


def q_gating_metrics_nan_null(spark, sf):
    g = gating_metrics(edge_events(spark, sf), 0.85, "conf", "truth", "pred")
    return g.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])


def q_threshold_sweep_nan_null(spark, sf):
    return threshold_sweep(edge_events(spark, sf), spark, "conf", "truth", "pred").select("threshold", "auto_route_count")


def q_recall_null_predictions(spark, sf):
    return metrics.recall_table(edge_events(spark, sf), fx.EVENT_LABELS, "truth", "pred")


def q_split_null_strata(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("stratum"))
    return stratified_split(e, "event_id", "stratum")


def q_fraction_split(spark, sf):
    """P6 for large tables: map-only, no shuffle."""
    return fraction_split(read_table(spark, sf, "events").select("event_id"), "event_id", FRACTIONS)


def q_blank_texts(spark, sf):
    """White space of any kind is no text."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.lit("\n\t ")).when(k == 1, F.lit("")).when(k == 2, F.lit(None)).otherwise(F.col("text"))
    return read_table(spark, sf, "documents").select("doc_id", text.alias("text")).select("doc_id", nonblank().alias("has_text"))


EDGE_QUERIES = {
    "scaling_10_labels": _scaling(10),
    "scaling_2_labels": _scaling(2),
    "gate_nan_null": q_gate_nan_null,
    "gating_metrics_nan_null": q_gating_metrics_nan_null,
    "threshold_sweep_nan_null": q_threshold_sweep_nan_null,
    "recall_null_predictions": q_recall_null_predictions,
    "split_null_strata": q_split_null_strata,
    "fraction_split": q_fraction_split,
    "blank_texts": q_blank_texts,
}
