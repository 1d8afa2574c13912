"""Helpers shared by the operators: written cuts, clash-free input columns, components."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.session import fresh_path, ship_package
from calibra.sources.tables import read_table

BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def cut(df: DataFrame, name: str, *sort: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = fresh_path(df.sparkSession, f"llm-{name}")
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

def cut_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A cut whose rows lie in buckets of ``key``, so that grouping by it needs no shuffle of them.

    The rows are written where they are made (a bucket has a file from each task
    that has rows of it). The catalog's entry is dropped at once; the files stay.
    """
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    entry = "llm_" + path.rsplit("/", 1)[1].replace("-", "_")
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    (df.write.format("parquet").option("path", path).option("compression", "uncompressed")
     .bucketBy(max(1, min(buckets, most)), key).saveAsTable(entry))
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return out

def on_workers(spark: SparkSession) -> None:
    """Python mappers import this package on the workers."""
    ship_package(spark)

def bounded_batches(spark: SparkSession) -> None:
    """Texts go to the workers at most ``BATCH_BYTES`` at a time, unless the session sets a limit of its own.

    Spark's default is 10 000 rows or 64 MB, held by the executor on both ways and by the
    worker; what is kept of that between stages counts against the executor.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)

def id_and_body(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, under its own names, so other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))

def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds) == F.lit(fold)

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has columns ``a``, ``b`` (long). Returns ``node``, ``comp`` (the
    smallest node reachable) for every node that has an edge. Each step is a
    grouped minimum (combined before the shuffle) and a join; the edges stay in
    the shared folder and never reach the driver, which sees a count and a sum
    per round. The number of rounds is logarithmic in the size of a component.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = cut(small.where("a <> b").distinct(), "cc")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots).distinct()


def spread_ids(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and each column hangs together with through the links of one block."""
    top = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        na = np.minimum(a, np.where(linked, b[None, :], top).min(1))
        nb = np.minimum(b, np.where(linked, na[:, None], top).min(0))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb
