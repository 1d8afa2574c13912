"""Sources and sinks: CSV upload round trip (B), predictions JSON, temperatures, splits."""
from pyspark.sql import functions as F

from calibra.operators import calibrate as cal
from calibra.plans import catalog, fixtures as fx
from calibra.session import fresh_path
from calibra.sources import predictions as pr
from calibra.sources import tickets as tk
from conftest import SF_MID


def test_upload_csv_round_trip_multiline_and_quotes(spark):
    users = catalog.user_messages(spark, SF_MID)
    # one hand-made double quote to exercise escaping
    users = users.withColumn("text", F.when(F.col("conv_id") == 0, F.concat(F.col("text"), F.lit(' say "hi"')))
                             .otherwise(F.col("text")))
    path = fresh_path(spark, "upload")
    tk.csv_writer(users).csv(path)
    back = tk.read_upload(spark, path, "text", ["conv_id", "turn", "text"])
    assert back.count() == users.count() == 279
    assert back.where(F.col("text").contains("\n")).count() == 133
    a = sorted((str(r.conv_id), str(r.turn), r.text) for r in users.collect())
    b = sorted((r.conv_id, r.turn, r.text) for r in back.collect())
    assert a == b


def test_upload_null_text_is_empty_not_nan(spark):
    path = fresh_path(spark, "upload-null")
    spark.createDataFrame([(1, None), (2, "hi")], "id INT, body STRING").write.option("header", True).csv(path)
    got = sorted((r.id, r.text) for r in tk.read_upload(spark, path, "body", ["id", "body"]).collect())
    assert got == [("1", ""), ("2", "hi")]


def test_raw_ticket_csv_schema(spark):
    path = fresh_path(spark, "raw-csv")
    spark.createDataFrame([("s", "b\nline", "IT Support", "High", "en", "Incident", None)],
                          tk.RAW_TICKET_SCHEMA).write.option("header", True).option("escape", '"').csv(path)
    r = tk.read_raw_tickets(spark, path).first()
    assert r.body == "b\nline" and r.priority == "High" and r.tags is None


def test_predictions_json_round_trip_keeps_label_order(spark):
    e = fx.events_scored(spark, SF_MID)
    p = cal.calibrate_choice(e, "labels", "probs", {"department": 1.5}, "department", "cal_department",
                             "cal_department_confidence").select(
        "event_id", F.col("labels").alias("department_labels"), F.col("probs").alias("department_probs"))
    path = fresh_path(spark, "preds")
    pr.write_predictions(p, path)
    assert dict(spark.read.parquet(path).dtypes)["department_probs"] == "string"
    back = pr.read_predictions(spark, path, fx.EVENT_LABELS, ["0", "1", "2"])
    a = {r.event_id: r.department_probs for r in p.collect()}
    b = {r.event_id: r.department_probs for r in back.collect()}
    assert a == b
    assert pr.read_predictions(spark, fresh_path(spark, "missing"), fx.EVENT_LABELS, []) is None


def test_temperatures_default_and_round_trip(spark):
    path = fresh_path(spark, "temps")
    got = {r.question: r.temperature for r in pr.read_temperatures(spark, path).collect()}
    assert got == {"department": 1.0, "urgency": 1.0}
    pr.write_temperatures(spark.createDataFrame([("department", 1.11)], "question STRING, temperature DOUBLE"), path)
    got = {r.question: r.temperature for r in pr.read_temperatures(spark, path).collect()}
    assert got == {"department": 1.11, "urgency": 1.0}


def test_split_dataset_partition_pruning(spark):
    t = catalog.tickets(spark, SF_MID)
    path = fresh_path(spark, "splits")
    tk.write_splits(t, path)
    test = tk.read_split(spark, path, "test")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan
    assert test.count() == t.where("split = 'test'").count() > 0


def test_batch_output_csv(spark):
    from calibra.plans import jobs
    out = jobs.batch_output(catalog.batch_triaged(spark, SF_MID))
    path = fresh_path(spark, "batch-out")
    tk.write_batch_output(out, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert back.columns == ["text", "department", "dept_conf", "urgency", "decision", "churn", "refund"]
    assert back.count() == out.count() == 279
