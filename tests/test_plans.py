"""Plan shape: no cartesian products, fit shuffles only partial aggregates,
scans read only the columns they need."""
import pytest
from pyspark.sql import functions as F

from calibra.plans.catalog import QUERIES
from calibra.operators import calibrate as cal
from calibra.operators import prepare
from calibra.plans import fixtures as fx
from calibra.session import fresh_path
from conftest import SF_SMALL

WRITES = {"decision_log_backfill", "log_by_decision", "log_by_department", "log_counts", "log_recent",
          "live_triage_stream", "log_compaction", "log_by_source", "upload_csv_roundtrip", "raw_ticket_csv", "split_dataset", "batch_output_csv",
          "predictions_parquet", "temperatures_json"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_fit_explodes_before_partial_aggregation(spark):
    e = fx.events_scored(spark, SF_SMALL)
    plan = _plan(cal.nll_by_temperature(e, "labels", "probs", "truth", n_labels=5))
    assert "Generate explode" in plan
    assert plan.count("HashAggregate") >= 2          # partial + final
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_lexical_scan_prunes_columns(spark):
    plan = _plan(QUERIES["lexical_choice_scores"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name,marker", [("apply_temperature_long", "EXP("),
                                         ("probs_json_roundtrip", "from_json")])
def test_explode_filter_does_not_inline_staged_columns(spark, name, marker):
    """The filter Catalyst infers for (pos)explode must stay above the
    barrier: no Filter may re-evaluate the softmax or re-parse the JSON."""
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    filters = [ln for ln in plan.splitlines() if "Filter" in ln]
    assert not [ln for ln in filters if marker in ln]


def _split_plan(spark, rows):
    path = fresh_path(spark, "split-rows")
    rows.write.parquet(path)
    return prepare.stratified_split(spark.read.parquet(path), "id", "stratum")


def test_split_ranks_boundary_buckets_only(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("stratum"))
    split = _split_plan(spark, rows)
    keyed = rows.withColumn("_h", prepare.split_hash("id")).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    got = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    want = {"cal": 500, "dev": 500, "test": 1000, "unused": 58_000}
    assert set(got) == set(want) and all(abs(got[k] - n) <= 6 for k, n in want.items())      # rounded in each of six strata
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1 and "Union" in plan
    ranked = prepare.split_bounds(keyed, "stratum", prepare.SPLIT_SIZES)
    open_rows = 0
    for r in keyed.join(ranked, F.col("stratum") == F.col("_s")).collect():
        open_rows += any(r["_b"] == r[f"_bucket{i}"] and not r[f"_end{i}"]["whole"] for i in range(3))
    assert 0 < open_rows < 60_000 * 3 * 4 / 4096        # at most a bucket a split of each stratum


def test_fit_scans_once_a_pass_for_all_questions(spark):
    """The jobs of a fit of two questions read their table twice in all."""
    path = fresh_path(spark, "fit-rows")
    head = lambda a, b: (F.array(F.lit(a), F.lit(b)))
    spark.range(500).select(head("x", "y").alias("l"), F.array(F.lit(0.3), F.lit(0.7)).alias("p"), F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(F.lit("y")).alias("t"),
                            F.array(F.lit("0"), F.lit("1"), F.lit("2")).alias("l3"), F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)).alias("p3"),
                            (F.col("id") % 3).cast("string").alias("t3")).write.parquet(path)
    df = spark.read.parquet(path)
    calls, nll = [], cal._heads_nll
    cal._heads_nll = lambda *a: calls.append(a) or nll(*a)
    try:
        both = cal.fit_temperatures({"a": (df, "l", "p", "t", 2), "b": (df, "l3", "p3", "t3", 3)}).collect()
    finally:
        cal._heads_nll = nll
    assert len(calls) == 2 and all(c[0]._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 for c in calls)
    alone = [cal.fit_temperature(df, *h).first() for h in (("l", "p", "t", "a"), ("l3", "p3", "t3", "b"))]
    assert [tuple(r) for r in both] == [tuple(r) for r in alone]
