"""The decision log: parquet segments named by a manifest.

* a write goes to a segment of its own (a folder with few files, sorted by id)
  and then into the manifest (:class:`calibra.sources.versioned.Versions`);
  readers resolve the manifest, so they see all of a write or nothing, and a
  source is read by its segments alone (F4).
* ids ascend in a stated order without a global window: rows are range-
  partitioned and sorted on the order key and each partition numbers its rows;
  offsets come from the counts, one for each partition. The numbered rows are
  checkpointed to the shared folder first, so a lost executor cannot renumber
  them. The range of ids is reserved before the rows are written, by a versioned
  document of its own, so several appenders never share an id (S11).
* the evaluation backfill writes beside and swaps the ``eval`` segments in one
  manifest version; no rows empty ``eval`` in the same way (S12).
* a micro-batch of a stream owns the segment of its run and epoch and replaces
  it, so a replayed batch replaces itself (R2).
* :func:`compact` rewrites the segments of closed epochs into few sorted files
  with the same ids; :func:`vacuum` deletes what no manifest names any more.
"""
from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions import text as tx
from calibra.session import shared_dir
from calibra.sources.versioned import Versions

ROWS_PER_FILE = 1_000_000
KEEP_SECONDS = 86_400.0      # unnamed segments younger than this may belong to a writer at work

# The columns of the log.
LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("pred_department", T.StringType()),
    T.StructField("department_confidence", T.DoubleType()),
    T.StructField("pred_urgency", T.IntegerType()),
    T.StructField("urgency_confidence", T.DoubleType()),
    T.StructField("churn_risk", T.DoubleType()),
    T.StructField("refund_requested", T.DoubleType()),
    T.StructField("gate_decision", T.StringType()),
    T.StructField("true_department", T.StringType()),
    T.StructField("true_urgency", T.IntegerType()),
    T.StructField("department_correct", T.IntegerType()),
    T.StructField("urgency_correct", T.IntegerType()),
])
LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]
SOURCES = ("eval", "live", "batch")


def _manifest(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, f"{path.rstrip('/')}/_manifest")


def _data(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/data/{name}"


def segments(spark: SparkSession, path: str) -> list[dict]:
    """Live segments: name, source, run, epoch (null but for a stream's micro-batch), rows, first and last id."""
    return _manifest(spark, path).read().get("segments", [])


def open_log(spark: SparkSession, path: str, sources=None) -> DataFrame:
    """The log table, or an empty frame with the fixed schema (S10); with ``sources`` only their segments are read."""
    live = [_data(path, s["name"]) for s in segments(spark, path) if sources is None or s["source"] in sources]
    if not live:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(*live)


def log_rows(df: DataFrame, source: str, created_at: Column | None = None, carry=()) -> DataFrame:
    """Shape triaged rows as log rows (no id yet): stamp the time, compute the
    correctness flags (C13, C14, C16). Truth columns may be absent (live).
    ``carry`` columns (e.g. the id order key) are passed through."""
    cols = set(df.columns)
    true_dep = F.col("true_department") if "true_department" in cols else F.lit(None).cast("string")
    true_urg = F.col("true_urgency").cast("int") if "true_urgency" in cols else F.lit(None).cast("int")
    return df.select(
        (created_at if created_at is not None else tx.now_seconds()).cast("timestamp_ntz").alias("created_at"),
        F.lit(source).alias("source"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("pred_department").cast("string").alias("pred_department"),
        F.col("department_confidence").cast("double").alias("department_confidence"),
        F.col("pred_urgency").cast("int").alias("pred_urgency"),
        F.col("urgency_confidence").cast("double").alias("urgency_confidence"),
        F.col("churn_risk").cast("double").alias("churn_risk"),
        F.col("refund_requested").cast("double").alias("refund_requested"),
        F.col("gate_decision").cast("string").alias("gate_decision"),
        true_dep.alias("true_department"),
        true_urg.alias("true_urgency"),
        tx.department_correct(F.col("pred_department"), true_dep).alias("department_correct"),
        tx.urgency_correct(F.col("pred_urgency"), true_urg).alias("urgency_correct"),
        *[F.col(c) for c in carry if c != "created_at"],
    )


def number_rows(df: DataFrame, order_cols, partitions: int | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows numbered within range partitions on ``order_cols`` (a total order), checkpointed, and the size of each partition."""
    order_cols = list(order_cols)
    spark = df.sparkSession
    shared_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (df.repartitionByRange(n_parts, *order_cols)
                  .sortWithinPartitions(*order_cols)
                  .withColumn("_pid", F.spark_partition_id())
                  .withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    numbered = numbered.checkpoint(eager=True)
    sizes = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()       # a number for each partition
    return numbered, sorted((r["_pid"], r["n"]) for r in sizes)


def with_dense_ids(df: DataFrame, order_cols, base: int = 0, partitions: int | None = None,
                   out: str = "id") -> DataFrame:
    """ids ``base+1 .. base+n`` following ``order_cols`` (a total order); no single-partition window over the rows."""
    return _ids(*number_rows(df, order_cols, partitions), base, out)


def _ids(numbered: DataFrame, sizes: list[tuple[int, int]], base: int, out: str = "id") -> DataFrame:
    before, rows = base, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = numbered.sparkSession.createDataFrame(rows, "_part INT, _before BIGINT")
    return (numbered.join(F.broadcast(offsets), F.col("_pid") == F.col("_part"))
                    .withColumn(out, F.col("_before") + F.col("_k") + F.lit(1)).drop("_pid", "_k", "_part", "_before"))


def reserve_ids(spark: SparkSession, path: str, n: int) -> int:
    """Reserve ``n`` ids; returns the id before the first. Ids are never handed out twice, as with AUTOINCREMENT."""
    marks = Versions(spark, f"{path.rstrip('/')}/_ids")
    return marks.update(lambda mark: {"top": mark.get("top", 0) + n})["top"] - n


def max_id(spark: SparkSession, path: str) -> int:
    """Largest id handed out."""
    return Versions(spark, f"{path.rstrip('/')}/_ids").read().get("top", 0)


def _files(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))


def _segment(spark: SparkSession, path: str, rows: DataFrame, order_cols) -> dict | None:
    """Write numbered rows beside the live segments; None without rows. The checkpointed rows are not recomputed."""
    numbered, sizes = number_rows(rows, order_cols)
    n = sum(size for _, size in sizes)
    if not n:
        return None
    base, name = reserve_ids(spark, path, n), uuid.uuid4().hex
    _ids(numbered, sizes, base).select(*LOG_COLUMNS).coalesce(_files(n)).write.parquet(_data(path, name))
    return {"name": name, "rows": n, "first": base + 1, "last": base + n, "run": None, "epoch": None}


def _swap(spark: SparkSession, path: str, added: list[dict], gone) -> dict:
    """One manifest version: ``added`` come in, segments for which ``gone`` holds go."""
    names = {s["name"] for s in added}

    def change(manifest: dict) -> dict:
        kept = [s for s in manifest.get("segments", []) if s["name"] not in names and not gone(s)]
        return {**manifest, "segments": [*kept, *added]}
    return _manifest(spark, path).update(change)


def append_log(spark: SparkSession, path: str, rows: DataFrame, order_cols, source: str | None = None) -> int:
    """Append log rows (from :func:`log_rows`, of one source) with fresh ascending ids; returns their number."""
    new = _segment(spark, path, rows, order_cols)
    if new is None:
        return 0
    new["source"] = source or _source_of(spark, path, new["name"])
    _swap(spark, path, [new], lambda s: False)
    return new["rows"]


def _source_of(spark: SparkSession, path: str, name: str) -> str | None:
    """The source of a segment's rows (None for a mixture, which every reader of a source must then filter)."""
    low, high = spark.read.schema(LOG_SCHEMA).parquet(_data(path, name)).agg(F.min("source"), F.max("source")).first()
    if low != high:
        raise ValueError(f"a segment holds one source, not {low!r} to {high!r}")
    return low


def write_epoch(spark: SparkSession, path: str, rows: DataFrame, order_cols, run: str, epoch: int, source: str = "live") -> int:
    """Write a micro-batch as the segment of its run and epoch; writing it again replaces it (R2).

    An epoch that has been compacted is closed: it is in the log already and is not written again.
    """
    if epoch <= _manifest(spark, path).read().get("closed", {}).get(run, -1):
        return 0
    new = _segment(spark, path, rows, order_cols)
    added = [{**new, "source": source, "run": run, "epoch": int(epoch)}] if new else []
    _swap(spark, path, added, lambda s: s["run"] == run and s["epoch"] == int(epoch))
    return new["rows"] if new else 0


def compact(spark: SparkSession, path: str, min_segments: int = 2) -> int:
    """Rewrite the small segments of each source into one with few files, sorted by id; returns how many went.

    Of each stream run the newest epoch stays as it is, since only that one can be
    replayed. A segment that a writer replaces meanwhile makes the rewrite of its
    source void; the rows that readers see and their ids are the same all along.
    """
    gone = 0
    live = segments(spark, path)
    newest = {s["run"]: max(x["epoch"] for x in live if x["run"] == s["run"]) for s in live if s["run"]}
    for source in sorted({s["source"] for s in live}):
        old = [s for s in live if s["source"] == source and (not s["run"] or s["epoch"] < newest[s["run"]]) and s["rows"] < ROWS_PER_FILE]
        if len(old) < min_segments:
            continue
        rows, names = sum(s["rows"] for s in old), {s["name"] for s in old}
        name, files = uuid.uuid4().hex, _files(rows)
        one = spark.read.schema(LOG_SCHEMA).parquet(*[_data(path, n) for n in sorted(names)])
        one.repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(_data(path, name))
        new = {"name": name, "source": source, "run": None, "epoch": None, "rows": rows,
               "first": min(s["first"] for s in old), "last": max(s["last"] for s in old)}
        closed: dict = {}
        for s in old:
            if s["run"]:
                closed[s["run"]] = max(closed.get(s["run"], -1), s["epoch"])

        def change(manifest: dict) -> dict:
            now = manifest.get("segments", [])
            if not names <= {s["name"] for s in now}:       # void, or done by a try before
                return manifest
            marks = {**manifest.get("closed", {})}
            for run, epoch in closed.items():
                marks[run] = max(marks.get(run, -1), epoch)
            return {"segments": [*[s for s in now if s["name"] not in names], new], "closed": marks}

        if name in {s["name"] for s in _manifest(spark, path).update(change)["segments"]}:
            gone += len(old)
    return gone


def vacuum(spark: SparkSession, path: str, older_than: float = KEEP_SECONDS) -> int:
    """Delete segments that the manifest does not name and that are older than ``older_than`` seconds (readers and writers
    at work are younger); returns how many."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(_data(path, "."))
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    live, n = {s["name"] for s in segments(spark, path)}, 0
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        if status.getPath().getName() not in live and status.getModificationTime() / 1000 <= time.time() - older_than:
            n += bool(fs.delete(status.getPath(), True))
    return n


def eval_rows(predictions: DataFrame, order_cols, created_at: Column | None = None) -> DataFrame:
    """Stored predictions as ``eval`` log rows: ``cal_*`` -> ``pred_*``."""
    carry = [c for c in order_cols if c != "created_at"]
    renamed = predictions.select(
        *carry, "text",
        F.col("cal_department").alias("pred_department"),
        F.col("cal_department_confidence").alias("department_confidence"),
        F.col("cal_urgency").alias("pred_urgency"),
        F.col("cal_urgency_confidence").alias("urgency_confidence"),
        "churn_risk", "refund_requested", "gate_decision", "true_department", "true_urgency")
    return log_rows(renamed, "eval", created_at, carry)


def backfill_from_predictions(spark: SparkSession, path: str, predictions: DataFrame | None,
                              order_cols, created_at: Column | None = None) -> int:
    """Replace all ``eval`` rows from stored predictions.

    Missing input -> 0 rows and no error; input without rows empties ``eval``. The new segment is written beside the
    old ones and swapped with them in one manifest version, so a reader sees the old rows or the new ones. Ids continue
    after the largest id ever handed out.
    """
    if predictions is None:
        return 0
    new = _segment(spark, path, eval_rows(predictions, order_cols, created_at), order_cols)
    _swap(spark, path, [{**new, "source": "eval"}] if new else [], lambda s: s["source"] == "eval")
    return new["rows"] if new else 0


# ---------------------------------------------------------------------------
# Log queries
# ---------------------------------------------------------------------------
def by_decision(log: DataFrame) -> DataFrame:
    """n and department accuracy % (1 dp, NULL truth ignored) per gate
    decision; a NULL decision is its own group (A15)."""
    return log.groupBy("gate_decision").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("department_correct").cast("double")) * 100.0, 1).alias("dept_acc"))


def by_department(log: DataFrame) -> DataFrame:
    """n and accuracy % per predicted department, largest first; NULL shown as
    ``(none)`` (A16, T4)."""
    return (log.groupBy("pred_department")
               .agg(F.count(F.lit(1)).alias("n"),
                    F.round(F.avg(F.col("department_correct").cast("double")) * 100.0, 1).alias("acc"))
               .select(F.coalesce("pred_department", F.lit("(none)")).alias("department"), "n", "acc")
               .orderBy(F.col("n").desc(), F.col("department")))


def counts(log: DataFrame) -> DataFrame:
    """Total rows and escalated rows."""
    return log.agg(F.count(F.lit(1)).alias("total"),
                   F.count_if(F.col("gate_decision") == F.lit("escalate_to_human")).alias("escalated"))


def recent(log: DataFrame, gate_decision: str, limit: int = 10) -> DataFrame:
    """Newest rows of one decision with an OK/MISS mark and a 70-char preview
    (T3, F3, C15, P12). The filter is pushed to the parquet scan."""
    return (log.where(F.col("gate_decision") == F.lit(gate_decision))
               .orderBy(F.col("id").desc()).limit(int(limit))
               .select("id", tx.ok_mark("pred_department", "true_department").alias("mark"),
                       "pred_department", "department_confidence", "true_department",
                       tx.preview("text", 70).alias("preview")))
