"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query runs over the whole driver tables (no id subsets, no row caps;
a LIMIT appears only where the top-k IS the feature). Output doubles are
rounded to 6 dp so an SQL oracle can compare values exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import dist
from calibra.functions import text as tx
from calibra.operators import calibrate as cal
from calibra.operators import cases, metrics
from calibra.operators.gate import add_gate, gating_metrics, threshold_sweep
from calibra.operators.labels import (DEPARTMENT_NAMES, label_dim, priority_to_score,
                                      score_to_priority, urgency_class_name)
from calibra.operators.prepare import prepare_tickets, split_overlap, stratified_split, head, ticket_text
from calibra.operators.questions import QuestionSpec, build_questions, spec_from_options, triage_preset
from calibra.operators.score import LexicalModel, answer_lines, flatten_answers, lexical_score, score_with_model
from calibra.plans import fixtures as fx
from calibra.plans import jobs
from calibra.plans.edges import EDGE_QUERIES
from calibra.sources import decision_log as dlog
from calibra.sources import predictions as pred
from calibra.sources import tickets as tk
from calibra.sources.predictions import probs_to_json, with_json_probs
from calibra.sources.tables import read_table, table_path
from calibra.streaming import live
from calibra.session import fresh_path, materialize

# Fixed parameters of the registered queries.
E_TEMPERATURE = 2.0          # temperature applied to the events head in scaling queries
E_SHARPEN = 0.5              # a sharpening temperature for the events head
O_TEMPERATURE = 3.68         # temperature applied to the orders (ordinal) head
CASES_N = 6
HEAD_N = 50
LOG_RECENT_N = 10
LOG_APPENDS = 5
UNICODE_OPTIONS = {"marked": ["FÜR", "é", "ción"], "folded": ["SS", "ä"], "sequence": ["of-the", "In The", "in-der"]}
LIVE_TEMPERATURES = {"department": 0.5, "urgency": 3.68}
LIVE_THRESHOLD = 0.6
LOG_CREATED_AT = "2024-01-01 00:00:00"
BATCH_CREATED_AT = "2024-01-02 00:00:00"


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


class OneByOne:
    """A user model without a batch call."""

    def __init__(self):
        self.model = LexicalModel()

    def predict(self, state: dict, spec: QuestionSpec) -> dict:
        return self.model.predict(state, spec)


# ---------------------------------------------------------------------------
# Shared frames
# ---------------------------------------------------------------------------
def events_calibrated(spark, sf, temperature=1.0) -> DataFrame:
    """E with calibrated label/confidence at T and the 0.85 gate."""
    e = fx.events_scored(spark, sf)
    out = cal.calibrate_choice(e, "labels", "probs", {"department": temperature}, "department",
                               "cal_department", "cal_department_confidence", len(fx.EVENT_LABELS))
    return add_gate(out.withColumnRenamed("truth", "true_department"), "cal_department_confidence")


def ticket_spec() -> QuestionSpec:
    return build_questions(fx.TICKET_DEPARTMENT_CRITERIA, fx.TICKET_URGENCY_CRITERIA,
                           fx.TICKET_CHURN_CUES, fx.TICKET_REFUND_CUES)


def tickets(spark, sf) -> DataFrame:
    """Prepared English tickets of fixture T with their split."""
    prepared = prepare_tickets(fx.raw_tickets(spark, sf), spark)
    return stratified_split(prepared, "ticket_id", "department")


def ticket_records(spark, sf) -> DataFrame:
    """Scored ticket records, scored ONCE and checkpointed to the shared
    folder (the scorer is the expensive stage; fit and evaluation reread)."""
    scored = lexical_score(tickets(spark, sf), ticket_spec())
    return materialize(jobs.records(scored, keep=("ticket_id", "split")))


def ticket_temperatures(spark, sf) -> DataFrame:
    recs = ticket_records(spark, sf)
    return jobs.fit_job(recs.where(F.col("split") == "cal"))


def ticket_predictions(spark, sf) -> DataFrame:
    """Fit on cal, calibrate + gate all other prepared tickets."""
    return jobs.evaluate(tickets(spark, sf), ticket_spec())


def user_messages(spark, sf) -> DataFrame:
    return (read_table(spark, sf, "conversations").where(F.col("role") == "user")
            .select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")))


def batch_triaged(spark, sf) -> DataFrame:
    return user_messages(spark, sf).transform(jobs.triage(ticket_spec(), "lexical", None))


def decision_log_path(spark, sf) -> str:
    """Write the log (batch rows appended, then the eval backfill) to a fresh
    folder below the shared folder."""
    path = fresh_path(spark, "decision-log")
    batch = batch_triaged(spark, sf).select(
        "conv_id", "turn", "text",
        F.col("department").alias("pred_department"), "department_confidence",
        F.col("urgency_class").alias("pred_urgency"), "urgency_confidence",
        "churn_risk", "refund_requested", "gate_decision")
    rows = dlog.log_rows(batch, "batch", F.lit(BATCH_CREATED_AT).cast("timestamp_ntz"),
                         carry=("conv_id", "turn"))
    dlog.append_log(spark, path, rows, ["conv_id", "turn"], "batch")
    dlog.backfill_from_predictions(spark, path, ticket_predictions(spark, sf), ["ticket_id"],
                                   F.lit(LOG_CREATED_AT).cast("timestamp_ntz"))
    return path


def decision_log(spark, sf) -> DataFrame:
    return dlog.open_log(spark, decision_log_path(spark, sf))


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------
def q_gate_decisions(spark, sf):
    d = events_calibrated(spark, sf)
    return d.select("event_id", F.col("cal_department").alias("label"),
                    r6("cal_department_confidence").alias("confidence"), "gate_decision")


def q_gating_metrics(spark, sf):
    g = gating_metrics(events_calibrated(spark, sf), 0.85)
    return g.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])


def q_apply_temperature_long(spark, sf):
    e = dist.with_temperature(fx.events_scored(spark, sf), "probs", E_TEMPERATURE, "p",
                             len(fx.EVENT_LABELS))
    return (e.select("event_id", "labels", F.posexplode("p").alias("pos", "p"))
             .select("event_id", (F.col("pos") + 1).alias("label_index"),
                     dist.at("labels", F.col("pos") + 1).alias("label"), r6("p").alias("p")))


def q_top_option(spark, sf):
    e = dist.with_temperature(fx.events_scored(spark, sf), "probs", E_SHARPEN, "sharp",
                             len(fx.EVENT_LABELS))
    return e.select("event_id",
                    dist.argmax_label("labels", "probs").alias("top_label"),
                    r6(dist.top_prob("probs")).alias("top_prob"),
                    dist.argmax_label("labels", "sharp").alias("cal_label"),
                    r6(dist.top_prob("sharp")).alias("cal_confidence"))


def q_option_ranking(spark, sf):
    r = cases.option_ranking(fx.events_scored(spark, sf), "labels", "probs", keep=("event_id",))
    return r.select("event_id", F.col("rank").cast("int").alias("rank"), "label", r6("prob").alias("prob"))


def q_nll_by_temperature(spark, sf):
    e = fx.events_scored(spark, sf)
    return cal.nll_by_temperature(e, "labels", "probs", "truth", n_labels=len(fx.EVENT_LABELS)) \
        .select("t", r6("nll").alias("nll"), "n")


def _fit_rows(df: DataFrame) -> DataFrame:
    return df.select("question", "n", "t_coarse", "temperature", r6("nll_best").alias("nll_best"),
                     r6("nll_t1").alias("nll_t1"), "hit_ceiling")


def q_fit_temperature(spark, sf):
    e = fx.events_scored(spark, sf)
    o = fx.orders_scored(spark, sf).withColumn("truth", F.col("truth").cast("string"))
    return _fit_rows(cal.fit_temperatures({
        "events": (e, "labels", "probs", "truth", len(fx.EVENT_LABELS)),
        "orders": (o, "labels", "probs", "truth", len(fx.ORDINAL_LABELS))}))


def q_mean_top_prob(spark, sf):
    e = cal.mean_top_prob(fx.events_scored(spark, sf), "probs", E_TEMPERATURE, "events")
    o = cal.mean_top_prob(fx.orders_scored(spark, sf), "probs", O_TEMPERATURE, "orders")
    return e.unionByName(o).select("question", r6("mean_top_before").alias("mean_top_before"),
                                   r6("mean_top_after").alias("mean_top_after"))


def q_department_accuracy(spark, sf):
    return metrics.accuracy(events_calibrated(spark, sf), "true_department", "cal_department") \
        .select(r6("accuracy").alias("accuracy"))


def q_department_confusion(spark, sf):
    return metrics.confusion(events_calibrated(spark, sf), spark, fx.EVENT_LABELS,
                             "true_department", "cal_department")


def q_per_class_recall(spark, sf):
    r = metrics.per_class_recall(events_calibrated(spark, sf), spark, fx.EVENT_LABELS,
                                 "true_department", "cal_department")
    return r.select("ordinal", "label", "support", r6("recall").alias("recall"))


def q_confusion_peak(spark, sf):
    long = metrics.confusion(events_calibrated(spark, sf), spark, fx.EVENT_LABELS,
                             "true_department", "cal_department")
    return metrics.confusion_peak(long)


def q_threshold_sweep(spark, sf):
    s = threshold_sweep(events_calibrated(spark, sf), spark)
    return s.select(r6("threshold").alias("threshold"), "auto_route_count",
                    r6("auto_route_rate").alias("auto_route_rate"),
                    r6("auto_route_accuracy").alias("auto_route_accuracy"))


def q_recall_table(spark, sf):
    return metrics.recall_table(events_calibrated(spark, sf), fx.EVENT_LABELS,
                                "true_department", "cal_department")


def q_confident_correct(spark, sf):
    c = cases.confident_correct(events_calibrated(spark, sf), CASES_N, id_col="event_id")
    return c.select("event_id", "cal_department", r6("cal_department_confidence").alias("conf"))


def q_confident_disagreements(spark, sf):
    c = cases.confident_disagreements(events_calibrated(spark, sf), CASES_N, id_col="event_id")
    return c.select("event_id", "cal_department", "true_department",
                    r6("cal_department_confidence").alias("conf"))


def q_latency_arithmetic(spark, sf):
    """A9 over the events, whose own times say how long they took."""
    took = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).cast("double") / 1e6
    m = metrics.latency_metrics(fx.events_scored(spark, sf), took)
    return m.select("tickets", r6("total_seconds").alias("total_seconds"), r6("ms_per_ticket").alias("ms_per_ticket"),
                    r6("tickets_per_second").alias("tickets_per_second"))


def q_stratified_split(spark, sf):
    e = fx.events_scored(spark, sf).select("event_id", "truth")
    return stratified_split(e, "event_id", "truth").select("event_id", "truth", "split")


def q_split_overlap(spark, sf):
    e = fx.events_scored(spark, sf).select("event_id", "truth")
    return split_overlap(stratified_split(e, "event_id", "truth"), "event_id")


def q_head_rows(spark, sf):
    e = fx.events_scored(spark, sf).select("event_id", "truth")
    return head(e, HEAD_N, ["event_id"])


def q_expected_value_class(spark, sf):
    o = fx.orders_scored(spark, sf)
    c = cal.calibrate_ordinal(o, "labels", "probs", {"urgency": O_TEMPERATURE}, "urgency",
                              "cal_urgency", "cal_urgency_confidence", raw_out="urgency_score_raw",
                              n_labels=len(fx.ORDINAL_LABELS))
    return c.select("o_orderkey", r6("urgency_score_raw").alias("urgency_score_raw"), "cal_urgency",
                    r6("cal_urgency_confidence").alias("cal_urgency_confidence"))


def _orders_classified(spark, sf):
    o = fx.orders_scored(spark, sf)
    return cal.calibrate_ordinal(o, "labels", "probs", {"urgency": O_TEMPERATURE}, "urgency",
                                 "cal_urgency", "cal_urgency_confidence", n_labels=len(fx.ORDINAL_LABELS)
                                 ).withColumnRenamed("truth", "true_urgency")


def q_urgency_metrics(spark, sf):
    m = metrics.urgency_metrics(_orders_classified(spark, sf))
    return m.select("n", r6("accuracy").alias("accuracy"), r6("within_one_level").alias("within_one_level"))


def q_urgency_confusion(spark, sf):
    return metrics.confusion(_orders_classified(spark, sf), spark, [0, 1, 2], "true_urgency", "cal_urgency",
                             "true_urgency", "pred_urgency", dtype="INT")


def q_priority_mapping(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    u = fx.urgency_from_order_priority(F.col("o_orderpriority"))
    return o.select("o_orderkey", "o_orderpriority", u.alias("urgency_score"),
                    score_to_priority(u).alias("priority"),
                    priority_to_score(score_to_priority(u)).alias("score_back"))


def q_prepared_tickets(spark, sf):
    return prepare_tickets(fx.raw_tickets(spark, sf), spark)


def q_label_mapping(spark, sf):
    t = prepare_tickets(fx.raw_tickets(spark, sf), spark)
    dim = label_dim(spark, DEPARTMENT_NAMES, name="department").select("ordinal", "department")
    return (t.groupBy("department").agg(F.count(F.lit(1)).alias("n"))
             .join(F.broadcast(dim), "department", "inner").select("ordinal", "department", "n"))


def q_ticket_split(spark, sf):
    return tickets(spark, sf).select("ticket_id", "department", "split")


def _query_options_scores(spark, sf):
    spec = spec_from_options("q", fx.QUERY_OPTIONS)
    return lexical_score(read_table(spark, sf, "documents").select("doc_id", "text"), spec)


def q_lexical_choice_scores(spark, sf):
    s = _query_options_scores(spark, sf)
    a = F.col("answers.q")
    return s.select("doc_id", a["choice"].alias("choice"), r6(a["confidence"]).alias("confidence"),
                    *[r6(dist.at(a["probs"], F.lit(i + 1))).alias(f"p_{k}")
                      for i, k in enumerate(fx.QUERY_OPTIONS)])


def q_unicode_criteria(spark, sf):
    """Words with marks, a folded sharp s, and hyphenated criteria that match as token sequences."""
    s = lexical_score(read_table(spark, sf, "documents").select("doc_id", "text"), spec_from_options("q", UNICODE_OPTIONS))
    a = F.col("answers.q")
    return s.select("doc_id", a["choice"].alias("choice"), *[r6(dist.at(a["probs"], F.lit(i + 1))).alias(f"p_{k}")
                                                            for i, k in enumerate(UNICODE_OPTIONS)])


def _ticket_doc_scores(spark, sf):
    return lexical_score(read_table(spark, sf, "documents").select("doc_id", "text"), ticket_spec())


def q_lexical_urgency_score(spark, sf):
    a = F.col("answers.urgency")
    s = _ticket_doc_scores(spark, sf)
    return s.select("doc_id", r6(a["score"]).alias("score"),
                    dist.ordinal_class(a["score"], F.lit(3)).alias("urgency_class"),
                    r6(a["confidence"]).alias("confidence"))


def q_noul_scores(spark, sf):
    s = _ticket_doc_scores(spark, sf)
    return s.select("doc_id", r6("answers.churn_risk.noul").alias("churn_risk"),
                    r6("answers.refund_requested.noul").alias("refund_requested"))


def q_flat_answers(spark, sf):
    s = lexical_score(tickets(spark, sf), ticket_spec())
    f = flatten_answers(s, keep=("ticket_id",))
    return f.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


def q_answer_lines(spark, sf):
    s = lexical_score(tickets(spark, sf), ticket_spec())
    return answer_lines(s, ticket_spec(), keep=("ticket_id",)).select(
        "ticket_id", F.col("question_index").cast("int").alias("question_index"), "question", "answer")


def q_model_scored(spark, sf):
    s = score_with_model(tickets(spark, sf).select("ticket_id", "text"), LexicalModel, ticket_spec())
    f = flatten_answers(s, keep=("ticket_id",))
    return f.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes
                      if c != "routed_model"])


def q_ticket_temperatures(spark, sf):
    return _fit_rows(ticket_temperatures(spark, sf))


def q_ticket_predictions(spark, sf):
    p = ticket_predictions(spark, sf)
    return p.select("ticket_id", "true_department", "cal_department",
                    r6("cal_department_confidence").alias("cal_department_confidence"),
                    "true_urgency", "cal_urgency", r6("cal_urgency_confidence").alias("cal_urgency_confidence"),
                    "gate_decision")


def q_evaluation_rollup(spark, sf):
    r = metrics.evaluation_rollup(ticket_predictions(spark, sf))
    return r.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


def q_metrics_report(spark, sf):
    """All figures of the ticket evaluation that do not depend on the clock."""
    r = q_measured_report(spark, sf)
    return r.where((F.col("section") != "latency") | (F.col("key") == "tickets")).select("section", "key", r6("value").alias("value"))


def q_measured_report(spark, sf):
    """S13 with A9 and U5: the whole report, its times measured."""
    return jobs.evaluation_report(tickets(spark, sf), ticket_spec())


def q_scoring_time(spark, sf):
    """Rows and time of both scorers, and whether the measured times fit the driver's clock."""
    out, texts = [], read_table(spark, sf, "documents").select(F.col("doc_id").alias("ticket_id"), F.coalesce("text", F.lit("")).alias("text"))
    cores = spark.sparkContext.defaultParallelism
    truth = texts.withColumns({"department": F.lit(None).cast("string"), "urgency_score": F.lit(None).cast("int")})
    for name, scorer in (("lexical", "lexical"), ("model", OneByOne)):
        recs, took = jobs.score_split(truth, ticket_spec(), scorer, ("ticket_id",))
        rows = recs.agg(F.count(F.lit(1)).alias("tickets"), F.count_if(F.col("scoring_seconds") > 0).alias("timed")).withColumns({
            "scorer": F.lit(name), "within_clock": F.lit(0 < took.busy_seconds <= took.seconds * cores)})
        out.append(rows)
    return out[0].unionByName(out[1])


def q_decision_log_backfill(spark, sf):
    log = decision_log(spark, sf)
    return log.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                      "source", "pred_department", r6("department_confidence").alias("department_confidence"),
                      "pred_urgency", "gate_decision", "true_department", "true_urgency",
                      "department_correct", "urgency_correct")


def q_log_by_decision(spark, sf):
    return dlog.by_decision(decision_log(spark, sf))


def q_log_by_department(spark, sf):
    return dlog.by_department(decision_log(spark, sf))


def q_log_counts(spark, sf):
    return dlog.counts(decision_log(spark, sf))


def q_log_recent(spark, sf):
    r = dlog.recent(decision_log(spark, sf), "escalate_to_human", LOG_RECENT_N)
    return r.select("id", "mark", "pred_department", r6("department_confidence").alias("department_confidence"),
                    "true_department", "preview")


def q_correctness_flags(spark, sf):
    p = ticket_predictions(spark, sf)
    return p.select("ticket_id",
                    tx.department_correct("cal_department", "true_department").alias("department_correct"),
                    tx.urgency_correct("cal_urgency", "true_urgency").alias("urgency_correct"),
                    tx.ok_mark("cal_department", "true_department").alias("mark"))


def q_batch_triage(spark, sf):
    return jobs.batch_output(batch_triaged(spark, sf), keep=("conv_id", "turn"))


def q_batch_rollup(spark, sf):
    out = jobs.batch_output(batch_triaged(spark, sf))
    return cases.batch_rollup(out).select("tickets", r6("auto_route_pct").alias("auto_route_pct"))


def q_department_volume(spark, sf):
    return cases.department_volume(jobs.batch_output(batch_triaged(spark, sf)))


def q_probs_json_roundtrip(spark, sf):
    e = fx.events_scored(spark, sf)
    js = e.select("event_id", probs_to_json("labels", "probs").alias("js"))
    back = with_json_probs(js, "js", fx.EVENT_LABELS, "p")
    return (back.select("event_id", F.posexplode("p").alias("pos", "p"))
                .select("event_id", (F.col("pos") + 1).alias("label_index"), r6("p").alias("p")))


def live_log_path(spark, sf) -> str:
    """Triage the documents' texts as a stream, with stored temperatures and threshold, into a log."""
    path, settings = table_path(sf, "documents"), fresh_path(spark, "live-settings")
    pred.write_temperatures(spark.createDataFrame(list(LIVE_TEMPERATURES.items()), "question STRING, temperature DOUBLE"),
                            f"{settings}/temperatures")
    live.write_threshold(spark, settings, LIVE_THRESHOLD)
    job = live.LiveJob(ticket_spec(), fresh_path(spark, "live-log"), ("doc_id",), settings)
    stream = live.text_stream(spark, path, spark.read.parquet(path).schema)
    live.start(job, stream, fresh_path(spark, "live-ckpt")).awaitTermination()
    return job.log_path


def q_live_triage_stream(spark, sf):
    """The stream's log, its times whole seconds of today."""
    now = F.current_timestamp().cast("timestamp_ntz")
    return dlog.open_log(spark, live_log_path(spark, sf)).select(
        "id", (F.col("created_at").eqNullSafe(F.date_trunc("second", "created_at").cast("timestamp_ntz"))
               & F.col("created_at").between(now - F.expr("interval 1 day"), now)).alias("fresh"),
        "source", "pred_department", r6("department_confidence").alias("department_confidence"), "pred_urgency",
        r6("urgency_confidence").alias("urgency_confidence"), r6("churn_risk").alias("churn_risk"),
        r6("refund_requested").alias("refund_requested"), "gate_decision", "department_correct")


def q_log_compaction(spark, sf):
    """Five appends, the segments before and after their compaction, and the rows with their ids."""
    path = fresh_path(spark, "compacted-log")
    triaged = batch_triaged(spark, sf).select(
        "conv_id", "turn", "text", F.col("department").alias("pred_department"), "department_confidence",
        F.col("urgency_class").alias("pred_urgency"), "urgency_confidence", "churn_risk", "refund_requested", "gate_decision")
    rows = materialize(dlog.log_rows(triaged, "batch", F.lit(BATCH_CREATED_AT).cast("timestamp_ntz"), carry=("conv_id", "turn")))
    for k in range(LOG_APPENDS):
        dlog.append_log(spark, path, rows.where(F.pmod("conv_id", F.lit(LOG_APPENDS)) == k), ["conv_id", "turn"], "batch")
    before = len(dlog.segments(spark, path))
    dlog.compact(spark, path)
    return dlog.open_log(spark, path).select("id", "text", "pred_department", F.lit(before).alias("segments_before"),
                                             F.lit(len(dlog.segments(spark, path))).alias("segments_after"))


def q_prediction_display(spark, sf):
    """P12, P13, P14 (display names), P17, P18 over the ticket predictions."""
    p = ticket_predictions(spark, sf)
    return p.select("ticket_id",
                    tx.short_label("cal_department", 10).alias("dept_short"),
                    tx.short_label("cal_department", 12).alias("dept_short12"),
                    urgency_class_name("cal_urgency").alias("urgency_name"),
                    tx.title(urgency_class_name("cal_urgency")).alias("urgency_title"),
                    tx.pct0("cal_department_confidence").alias("conf_pct"),
                    tx.preview("text", 80).alias("preview"))


def q_preset_answers(spark, sf):
    """A second question spec on the same texts, rendered generically."""
    spec = triage_preset()
    s = lexical_score(user_messages(spark, sf), spec)
    return answer_lines(s, spec, keep=("conv_id", "turn")).select(
        "conv_id", "turn", F.col("question_index").cast("int").alias("question_index"), "question", "answer")


def q_run_metadata(spark, sf):
    """One row -- rows evaluated, scorer, fitted temperatures."""
    recs = ticket_records(spark, sf)
    temps = jobs.temperatures_dict(jobs.fit_job(recs.where(F.col("split") == "cal")))
    return recs.where(F.col("split") != "cal").agg(F.count(F.lit(1)).alias("n_test")).select(
        "n_test", F.lit("lexical").alias("scorer"),
        F.lit(temps.get("department", 1.0)).alias("t_department"),
        F.lit(temps.get("urgency", 1.0)).alias("t_urgency"))


def q_log_by_source(spark, sf):
    """one source's rows, from its segments alone."""
    log = dlog.open_log(spark, decision_log_path(spark, sf), ("batch",))
    return dlog.counts(log).withColumn("source", F.lit("batch"))


def q_upload_csv_roundtrip(spark, sf):
    """All turns written as CSV (multi-line cells), read back with a chosen text column."""
    path = fresh_path(spark, "upload-csv")
    columns = ["conv_id", "turn", "role", "text"]
    tk.csv_writer(read_table(spark, sf, "conversations").select(*columns)).csv(path)
    back = tk.read_upload(spark, path, "text", columns)
    return back.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                       F.col("turn").cast("bigint").alias("turn"), "role", "text")


def q_raw_ticket_csv(spark, sf):
    """Every raw ticket, labelled or not, through the pinned 7-column CSV; ``tags`` has a hash of the text that went in."""
    path = fresh_path(spark, "raw-tickets")
    raw = fx.raw_tickets(spark, sf).withColumns({"type": F.lit(None).cast("string"), "tags": F.md5(ticket_text())})
    tk.csv_writer(raw.select("subject", "body", "queue", "priority", "language", "type", "tags")).csv(path)
    return tk.read_raw_tickets(spark, path)


def q_split_dataset(spark, sf):
    """Ticket splits written partitioned by split; the test split read
    back through partition pruning."""
    path = fresh_path(spark, "splits")
    tk.write_splits(tickets(spark, sf), path)
    return tk.read_split(spark, path, "test").select("ticket_id", "department", "urgency_score")


def q_batch_output_csv(spark, sf):
    """The 7-column batch result written as CSV and read back."""
    path = fresh_path(spark, "batch-csv")
    tk.write_batch_output(jobs.batch_output(batch_triaged(spark, sf), keep=("conv_id", "turn")), path)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema("conv_id BIGINT, turn BIGINT, text STRING, department STRING, dept_conf DOUBLE, "
                    "urgency STRING, decision STRING, churn DOUBLE, refund DOUBLE").csv(path))
    return back


def q_predictions_parquet(spark, sf):
    """Predictions persisted with JSON distributions, decoded back in
    declared label order."""
    path = fresh_path(spark, "predictions")
    pred.write_predictions(ticket_predictions(spark, sf).select(
        "ticket_id", "department_labels", "department_probs", "urgency_labels", "urgency_probs",
        "cal_department", "gate_decision"), path)
    spec = ticket_spec()
    back = pred.read_predictions(spark, path, spec["department"].labels, spec["urgency"].labels)
    return (back.select("ticket_id", F.posexplode("department_probs").alias("pos", "p"))
                .select("ticket_id", (F.col("pos") + 1).alias("label_index"), r6("p").alias("p")))


def q_temperatures_json(spark, sf):
    """Fitted temperatures written as JSON, read back with 1.0 for a
    question that was never fitted."""
    path = fresh_path(spark, "temperatures")
    recs = ticket_records(spark, sf)
    pred.write_temperatures(jobs.fit_job(recs.where(F.col("split") == "cal")), path)
    return pred.read_temperatures(spark, path, ("department", "urgency", "churn_risk"))


QUERIES = {
    "gating_metrics": q_gating_metrics,
    "gate_decisions": q_gate_decisions,
    "apply_temperature_long": q_apply_temperature_long,
    "top_option": q_top_option,
    "option_ranking": q_option_ranking,
    "expected_value_class": q_expected_value_class,
    "nll_by_temperature": q_nll_by_temperature,
    "fit_temperature": q_fit_temperature,
    "mean_top_prob": q_mean_top_prob,
    "department_accuracy": q_department_accuracy,
    "department_confusion": q_department_confusion,
    "per_class_recall": q_per_class_recall,
    "urgency_metrics": q_urgency_metrics,
    "urgency_confusion": q_urgency_confusion,
    "confusion_peak": q_confusion_peak,
    "threshold_sweep": q_threshold_sweep,
    "recall_table": q_recall_table,
    "confident_correct": q_confident_correct,
    "confident_disagreements": q_confident_disagreements,
    "latency_arithmetic": q_latency_arithmetic,
    "stratified_split": q_stratified_split,
    "split_overlap": q_split_overlap,
    "head_rows": q_head_rows,
    "priority_mapping": q_priority_mapping,
    "prepared_tickets": q_prepared_tickets,
    "label_mapping": q_label_mapping,
    "ticket_split": q_ticket_split,
    "lexical_choice_scores": q_lexical_choice_scores,
    "unicode_criteria": q_unicode_criteria,
    "lexical_urgency_score": q_lexical_urgency_score,
    "noul_scores": q_noul_scores,
    "flat_answers": q_flat_answers,
    "answer_lines": q_answer_lines,
    "model_scored": q_model_scored,
    "ticket_temperatures": q_ticket_temperatures,
    "ticket_predictions": q_ticket_predictions,
    "evaluation_rollup": q_evaluation_rollup,
    "metrics_report": q_metrics_report,
    "measured_report": q_measured_report,
    "scoring_time": q_scoring_time,
    "correctness_flags": q_correctness_flags,
    "decision_log_backfill": q_decision_log_backfill,
    "log_by_decision": q_log_by_decision,
    "log_by_department": q_log_by_department,
    "log_counts": q_log_counts,
    "log_recent": q_log_recent,
    "batch_triage": q_batch_triage,
    "batch_rollup": q_batch_rollup,
    "department_volume": q_department_volume,
    "probs_json_roundtrip": q_probs_json_roundtrip,
    "live_triage_stream": q_live_triage_stream,
    "log_compaction": q_log_compaction,
    "prediction_display": q_prediction_display,
    "preset_answers": q_preset_answers,
    "run_metadata": q_run_metadata,
    "log_by_source": q_log_by_source,
    "upload_csv_roundtrip": q_upload_csv_roundtrip,
    "raw_ticket_csv": q_raw_ticket_csv,
    "split_dataset": q_split_dataset,
    "batch_output_csv": q_batch_output_csv,
    "predictions_parquet": q_predictions_parquet,
    "temperatures_json": q_temperatures_json,
    **EDGE_QUERIES,
}

