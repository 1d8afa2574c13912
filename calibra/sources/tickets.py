"""Ticket files: raw CSV scan, split dataset, user CSV upload, batch output CSV.

CSV is read with an explicit schema (never inferred), ``multiLine`` for
bodies with newlines and ``escape='"'`` for embedded quotes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TICKET_SCHEMA = ("subject STRING, body STRING, queue STRING, priority STRING, "
                     "language STRING, type STRING, tags STRING")


def _csv(spark: SparkSession, schema: str | None = None):
    r = (spark.read.option("header", True).option("multiLine", True)
         .option("escape", '"').option("quote", '"'))
    return r.schema(schema) if schema else r


def read_raw_tickets(spark: SparkSession, path: str) -> DataFrame:
    """The pinned 7-column ticket CSV."""
    return _csv(spark, RAW_TICKET_SCHEMA).csv(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One dataset partitioned by split (S3); later reads prune partitions."""
    df.where(F.col(split_col) != F.lit("unused")).write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split (S2): the equality filter on the partition column prunes
    every other split's files."""
    return spark.read.parquet(path).where(F.col("split") == F.lit(split))


def read_upload(spark: SparkSession, path: str, text_col: str, columns: list[str] | None = None) -> DataFrame:
    """A user CSV with a chosen text column (S4). Every column is read as
    text; a NULL cell gives the empty string (never the word "nan")."""
    reader = _csv(spark, ", ".join(f"`{c}` STRING" for c in columns) if columns else None)
    df = reader.csv(path)
    return df.withColumn("text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def csv_writer(df: DataFrame):
    """CSV writer that keeps cells byte-exact: header, quote escaping, and no
    trimming of leading/trailing whitespace (Spark trims on write by default)."""
    return (df.write.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_batch_output(out: DataFrame, path: str) -> None:
    """Batch triage results as CSV with a header, no index column."""
    csv_writer(out).mode("overwrite").csv(path)
