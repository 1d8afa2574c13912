"""Deterministic projections of the driver tables into the triage data model.

* ``E`` -- ``events`` as a classified stream: a 5-class distribution per event
  (department-head stand-in), truth = ``event_type``.
* ``O`` -- ``orders`` as an ordinal head: a 3-class distribution per order
  (urgency-head stand-in), truth from ``o_orderpriority``.
* ``T`` -- all ``documents`` as raw support tickets with a queue (from the label of
  the embedding, NULL without one) and a priority (from ``documents.source``).

Weights are integers so Spark and an SQL oracle agree to the last bit. Every
projection is map-only except T's join, whose build side is the embeddings
table (one row per vector id).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.operators.labels import DEPARTMENT_NAMES, DROPPED_QUEUES
from calibra.sources.tables import read_table

# Label spaces of the stand-in heads, in declared order.
EVENT_LABELS = ["click", "error", "purchase", "signup", "view"]
ORDINAL_LABELS = ["0", "1", "2"]
ORDER_PRIORITY_TO_URGENCY = {
    "1-URGENT": 2, "2-HIGH": 2, "3-MEDIUM": 1, "4-NOT SPECIFIED": 1, "5-LOW": 0,
}
ORDER_MULTIPLIERS = [3, 5, 7]
# Queue ids 0..7 are the departments in declared order; 8 and 9 play the two
# dropped queues.
QUEUE_NAMES = list(DEPARTMENT_NAMES) + list(DROPPED_QUEUES)
PRIORITY_NAMES = ["low", "medium", "high"]

# Criteria words for the lexical scorer on the invented prose (parameters: the
# prose contains none of the support vocabulary, so fixtures use words it has).
TICKET_DEPARTMENT_CRITERIA = {
    "Technical Support": ["the"],
    "IT Support": ["of", "with"],
    "Product Support": ["and", "on"],
    "Billing and Payments": ["to", "by"],
    "Customer Service": ["a", "as"],
    "Returns and Exchanges": ["in", "be"],
    "Sales and Pre-Sales": ["is", "are"],
    "Service Outages and Maintenance": ["that", "it"],
}
TICKET_URGENCY_CRITERIA = [["for", "at"], ["was", "from"], ["this", "an"]]
TICKET_CHURN_CUES = ["or", "not"]
TICKET_REFUND_CUES = ["from", "at"]
QUERY_OPTIONS = {"a": ["the", "by", "of"], "b": ["and", "with", "in"], "c": ["on", "is", "that"]}


def _labels(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def events_distribution(events: DataFrame) -> DataFrame:
    """E on any frame with ``event_id, ts, event_type`` (batch or stream):
    event_id, ts, truth, labels, probs (p_k = w_k / sum(w)). Map-only."""
    e = F.col("event_id")
    idx0 = F.array_position(_labels(EVENT_LABELS), F.col("event_type")) - 1
    bk = F.when(e % 4 != 0, idx0).otherwise(F.expr("event_id div 4") % 5)
    weights = [1 + (e * F.lit(7 * k + 3)) % 7 + F.when(bk == F.lit(k), (e * 13) % 120).otherwise(0)
               for k in range(len(EVENT_LABELS))]
    return (events.select("event_id", "ts", F.col("event_type").alias("truth"), *_weight_cols(weights))
                  .select("event_id", "ts", "truth", _labels(EVENT_LABELS).alias("labels"),
                          _normalise(len(weights)).alias("probs")))


def events_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E over the events table."""
    return events_distribution(read_table(spark, sf_dir, "events"))


def orders_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: o_orderkey, truth (0..2), labels '0','1','2', probs."""
    k = F.col("o_orderkey")
    u = urgency_from_order_priority(F.col("o_orderpriority"))
    weights = [1 + (k * F.lit(m)) % 11 + F.when((u == F.lit(i)) & (k % 3 != 0), F.lit(14)).otherwise(0)
               for i, m in enumerate(ORDER_MULTIPLIERS)]
    return (
        read_table(spark, sf_dir, "orders")
        .select("o_orderkey", u.alias("truth"), *_weight_cols(weights))
        .select("o_orderkey", "truth", _labels(ORDINAL_LABELS).alias("labels"),
                _normalise(len(weights)).alias("probs"))
    )


def urgency_from_order_priority(priority: F.Column) -> F.Column:
    m = F.create_map(*[x for kv in ORDER_PRIORITY_TO_URGENCY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.try_element_at(m, priority)


def _weight_cols(weights) -> list[F.Column]:
    """One integer column ``_w0 .. _w{K-1}`` per label. The label count is
    fixed, so the weights are plain (code-generated) expressions rather than
    a lambda over an array, which Spark would interpret per element."""
    return [w.cast("bigint").alias(f"_w{k}") for k, w in enumerate(weights)]


def _normalise(n: int) -> F.Column:
    """``[w_k / sum(w)]`` over the ``_w*`` columns (integer sum, exact)."""
    total = F.lit(0).cast("bigint")
    for k in range(n):
        total = total + F.col(f"_w{k}")
    return F.array(*[F.col(f"_w{k}").cast("double") / total for k in range(n)])


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T, raw CSV shape: ticket_id, subject, body, queue, priority, language.

    ``subject`` is the first line of the document, ``body`` the rest (NULL when
    the document has one line). The queue comes from the embedding label, the
    priority from the digits of ``source`` modulo 3.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label"))
    nl = F.instr(F.col("text"), "\n")
    src_num = F.regexp_extract(F.col("source"), r"(\d+)", 1).try_cast("int")
    return (
        docs.join(emb, "doc_id", "left")
        .select(
            F.col("doc_id").alias("ticket_id"),
            F.substring_index(F.col("text"), "\n", 1).alias("subject"),
            F.when(nl > 0, F.expr("substr(text, instr(text, '\n') + 1)")).alias("body"),
            F.get(_labels(QUEUE_NAMES), F.col("label")).alias("queue"),
            F.get(_labels(PRIORITY_NAMES), src_num % 3).alias("priority"),
            F.col("lang").alias("language"),
        )
    )
