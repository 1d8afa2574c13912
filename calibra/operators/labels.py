"""Label spaces and label mapping (queue -> department, priority <-> score).

Label spaces are small dimension tables with an explicit ``ordinal``; joins to
them are broadcast because their size is fixed by configuration, never by data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The department label space, in declared order, with descriptions.
DEPARTMENTS = {
    "Technical Support": "software bugs, device errors, connectivity, troubleshooting",
    "IT Support": "internal IT, accounts, office equipment, network access",
    "Product Support": "product features, setup, integration, how-to questions",
    "Billing and Payments": "invoices, charges, payments, billing disputes",
    "Customer Service": "general account help, information requests, inquiries",
    "Returns and Exchanges": "returns, refunds, exchanges, product replacement",
    "Sales and Pre-Sales": "pricing, new contracts, product evaluation before buying",
    "Service Outages and Maintenance": "outages, downtime, scheduled maintenance windows",
}
DROPPED_QUEUES = ["Human Resources", "General Inquiry"]
# Dataset priority -> urgency score, and the 3-level rubric.
PRIORITY_TO_SCORE = {"low": 0, "medium": 1, "high": 2}
URGENCY_RUBRIC = [
    "low: routine request or general question, no time pressure",
    "medium: a normal issue affecting the user",
    "high: important, user is blocked, impacted, or urgent",
]
URGENCY_CLASS_NAMES = ["low", "medium", "high"]

DEPARTMENT_NAMES = list(DEPARTMENTS)
SCORE_TO_PRIORITY = {v: k for k, v in PRIORITY_TO_SCORE.items()}


def label_dim(spark: SparkSession, labels, descriptions=None, name: str = "label") -> DataFrame:
    """Dimension ``(ordinal INT, <name> STRING, description STRING)`` (P5)."""
    labels = list(labels)
    descriptions = list(descriptions) if descriptions is not None else [None] * len(labels)
    rows = [(i, lab, d) for i, (lab, d) in enumerate(zip(labels, descriptions))]
    return spark.createDataFrame(rows, f"ordinal INT, {name} STRING, description STRING")


def level_names(rubric=None) -> list[str]:
    """Display names ``i:name`` of ordinal levels, the name being what stands before the colon (P5)."""
    return [f"{i}:{line.split(':')[0]}" for i, line in enumerate(URGENCY_RUBRIC if rubric is None else rubric)]


def map_queue_to_department(df: DataFrame, spark: SparkSession, queue_col: str = "queue",
                            departments=None) -> DataFrame:
    """Keep rows whose queue is a department; others (dropped queues,
    website categories) are removed (P3, J1: inner join on a dimension of label-space size)."""
    names = list(departments) if departments is not None else DEPARTMENT_NAMES
    dim = label_dim(spark, names, name="department").select(
        F.col("department").alias(queue_col), F.col("department"))
    return df.join(dim, queue_col, "inner")


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def priority_to_score(priority, mapping: dict | None = None) -> Column:
    """Lower-cased priority -> 0/1/2, NULL when unknown."""
    m = literal_map(mapping or PRIORITY_TO_SCORE)
    p = F.col(priority) if isinstance(priority, str) else priority
    return F.try_element_at(m, F.lower(p))


def score_to_priority(score, mapping: dict | None = None) -> Column:
    """0/1/2 -> priority name, NULL when unknown (inverse of P4)."""
    m = literal_map(mapping or SCORE_TO_PRIORITY)
    s = F.col(score) if isinstance(score, str) else score
    return F.try_element_at(m, s.cast("int"))


def urgency_class_name(k) -> Column:
    """``["low","medium","high"][k]``, NULL when out of range."""
    c = F.col(k) if isinstance(k, str) else k
    return F.get(F.array(*[F.lit(x) for x in URGENCY_CLASS_NAMES]), c.cast("int"))
