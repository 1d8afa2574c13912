"""Predictions parquet (S6, S7) and temperatures JSON.

Distributions are stored as JSON text only at this boundary; inside a job
they are parallel arrays in declared label order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from calibra.operators.calibrate import DEFAULT_TEMPERATURE
from calibra.session import barrier

PROB_COLUMNS = {"department_probs": "department_labels", "urgency_probs": "urgency_labels"}


def probs_to_json(labels, probs) -> Column:
    """``json.dumps(dict(zip(labels, probs)))``."""
    lab = F.col(labels) if isinstance(labels, str) else labels
    pr = F.col(probs) if isinstance(probs, str) else probs
    return F.to_json(F.map_from_arrays(lab, pr))


def with_json_probs(df: DataFrame, js: str, labels: list[str], out: str) -> DataFrame:
    """Staged decode: parse the JSON map once per row, then pick the labels in
    declared order."""
    tmp = f"_{out}_map"
    return barrier(df.withColumn(tmp, F.from_json(F.col(js), "MAP<STRING, DOUBLE>"))
                     .withColumn(out, F.array(*[F.try_element_at(F.col(tmp), F.lit(x)) for x in labels]))
                     .drop(tmp), "json_probs")


def write_predictions(pred: DataFrame, path: str) -> None:
    """Persist calibrated predictions; the two distributions become JSON."""
    out = pred
    for probs, labels in PROB_COLUMNS.items():
        if probs in pred.columns:
            out = out.withColumn(probs, probs_to_json(labels, probs)).drop(labels)
    out.write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str, department_labels: list[str],
                     urgency_labels: list[str]) -> DataFrame | None:
    """Stored predictions with distributions decoded back to arrays (S7);
    ``None`` when nothing was stored yet."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    for probs, labels, names in (("department_probs", "department_labels", department_labels),
                                 ("urgency_probs", "urgency_labels", urgency_labels)):
        if probs in df.columns and dict(df.dtypes)[probs] == "string":
            df = (with_json_probs(df, probs, names, probs)
                  .withColumn(labels, F.array(*[F.lit(x) for x in names])))
    return df


def write_temperatures(temps: DataFrame, path: str) -> None:
    """``(question, temperature)`` rows as JSON (S8); a handful of rows."""
    temps.select("question", "temperature").coalesce(1).write.mode("overwrite").json(path)


def read_temperatures(spark: SparkSession, path: str, questions=("department", "urgency")) -> DataFrame:
    """Fitted temperatures, 1.0 for any question not fitted."""
    dim = spark.createDataFrame([(q,) for q in questions], "question STRING")
    try:
        fitted = spark.read.schema("question STRING, temperature DOUBLE").json(path)
    except AnalysisException:
        fitted = spark.createDataFrame([], "question STRING, temperature DOUBLE")
    return (dim.join(F.broadcast(fitted.groupBy("question").agg(F.max("temperature").alias("temperature"))),
                     "question", "left")
               .select("question", F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE)).alias("temperature")))
