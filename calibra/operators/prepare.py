"""Ticket preparation: language filter, cleaning, label mapping, splitting.

The exact stratified split decides almost every row where it is read. Rows are
hashed (``md5(seed|id)``) into 4096 buckets per stratum; a small
(strata x buckets) count table gives the bucket in which each split ends. Rows of
other buckets need no rank; those of the few boundary buckets are ranked by
``row_number`` within (stratum, bucket) after the rows of the buckets before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.operators.labels import map_queue_to_department, priority_to_score

# Split sizes and seed.
SPLIT_SIZES = {"cal": 500, "dev": 500, "test": 1000}
SPLIT_SEED = 42
UNUSED = "unused"
HASH_BUCKET_HEX = 3            # 16^3 = 4096 buckets per stratum


def ticket_text(subject: str = "subject", body: str = "body") -> Column:
    """Ticket text = subject + newline + body; a NULL part is skipped."""
    return F.concat_ws("\n", F.col(subject), F.col(body))


def nonblank(col: str = "text") -> Column:
    """Text with something other than white space."""
    return F.col(col).rlike(r"\S")


def clean_tickets(raw: DataFrame, language: str | None = "en", lang_col: str = "language") -> DataFrame:
    """Language filter, text assembly, trim, drop NULL/blank text."""
    df = raw.where(F.col(lang_col) == F.lit(language)) if language else raw
    return (df.withColumn("text", F.trim(ticket_text()))
              .where(F.col("text").isNotNull() & nonblank("text")))


def prepare_tickets(raw: DataFrame, spark: SparkSession, language: str | None = "en",
                    id_col: str = "ticket_id") -> DataFrame:
    """Raw ticket rows -> ``(ticket_id, text, department, urgency_score)``.

    Cleaning (P1, P2, P16), queue -> department whitelist (P3, inner
    broadcast join on the label dimension), priority -> 0..2 (P4); rows whose
    priority does not map are dropped.
    """
    cleaned = clean_tickets(raw, language)
    mapped = map_queue_to_department(cleaned, spark, "queue")
    return (mapped.select(F.col(id_col), "text", "department",
                          priority_to_score("priority").cast("int").alias("urgency_score"))
                  .where(F.col("urgency_score").isNotNull()))


def split_hash(id_col: str, seed: int = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def split_bounds(keyed: DataFrame, stratum_col: str, sizes: dict) -> DataFrame:
    """One row per stratum: for each split the last rank it takes, the bucket where that rank lies, and whether the bucket
    ends with it (then no row of it needs a rank)."""
    total_size = sum(sizes.values())
    counts = keyed.groupBy(stratum_col, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    n_total = counts.agg(F.coalesce(F.sum("_nb"), F.lit(0))).scalar()
    denom = F.greatest(n_total, F.lit(total_size)).cast("double")
    upto = Window.partitionBy(stratum_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.select(
        F.col(stratum_col).alias("_s"), "_b", "_nb", F.sum("_nb").over(upto).alias("_upto"),
        F.sum("_nb").over(Window.partitionBy(stratum_col)).alias("_ns"))
    out, cum = [], 0
    for i, size in enumerate(sizes.values()):
        cum += size
        bound = F.round((F.col("_ns") * F.lit(cum)).cast("double") / denom, 0).cast("bigint")
        inside = F.col("_upto") >= bound
        out += [F.max(bound).alias(f"_rank{i}"),
                F.min(F.when(inside, F.col("_b"))).alias(f"_bucket{i}"),
                F.min(F.when(inside, F.struct("_b", (F.col("_upto") == bound).alias("whole")))).alias(f"_end{i}"),
                F.min(F.when(inside, F.struct("_b", (F.col("_upto") - F.col("_nb")).alias("before")))).alias(f"_before{i}")]
    return running.groupBy("_s").agg(*out)


def stratified_split(df: DataFrame, id_col: str, stratum_col: str, sizes: dict | None = None,
                     seed: int = SPLIT_SEED, out: str = "split") -> DataFrame:
    """Exact, seeded, stratified split.

    Within each stratum rows are ranked by ``(md5(seed|id), id)``; split j
    takes ranks in ``(round(n_s*C_{j-1}/D), round(n_s*C_j/D)]`` where C are
    cumulative sizes and ``D = max(n, sum(sizes))`` -- quotas proportional to
    the stratum, shrunk proportionally when the table is smaller than the
    requested total. Remaining rows get ``'unused'``. A NULL stratum is a
    stratum of its own; NULL ids are ranked like an empty one. No row is lost.

    The rows are neither shuffled nor sorted: counts by (stratum, hash bucket) tell
    for each split the bucket where it ends (a row per stratum, joined back), so
    a row's bucket decides its split in the scan. Only rows of those boundary
    buckets, one of 4096 a split and stratum, are ranked.
    """
    sizes = dict(sizes or SPLIT_SIZES)
    keyed = (df.withColumn("_h", split_hash(id_col, seed))
               .withColumn("_b", F.conv(F.substring("_h", 1, HASH_BUCKET_HEX), 16, 10).cast("int")))
    bounds = split_bounds(keyed, stratum_col, sizes)
    marked = keyed.join(bounds, F.col(stratum_col).eqNullSafe(F.col("_s")), "inner")
    boundary = F.lit(False)
    for i in range(len(sizes)):
        boundary = boundary | (F.coalesce(F.col("_b") == F.col(f"_bucket{i}"), F.lit(False)) & ~F.col(f"_end{i}.whole"))
    marked = marked.withColumn("_open", boundary)
    by_bucket = by_rank = None
    for i, name in enumerate(sizes):
        in_bucket, in_rank = F.col("_b") <= F.col(f"_bucket{i}"), F.col("_rank") <= F.col(f"_rank{i}")
        in_bucket = in_bucket & (F.col(f"_rank{i}") > 0)
        by_bucket = F.when(in_bucket, F.lit(name)) if by_bucket is None else by_bucket.when(in_bucket, F.lit(name))
        by_rank = F.when(in_rank, F.lit(name)) if by_rank is None else by_rank.when(in_rank, F.lit(name))
    before = F.coalesce(*[F.when(F.col("_b") == F.col(f"_bucket{i}"), F.col(f"_before{i}.before")) for i in range(len(sizes))])
    within = Window.partitionBy(stratum_col, "_b").orderBy("_h", id_col)
    columns = [F.col(c) for c in df.columns]
    sure = marked.where(~F.col("_open")).select(*columns, by_bucket.otherwise(F.lit(UNUSED)).alias(out))
    ranked = marked.where("_open").withColumn("_rank", before + F.row_number().over(within))
    return sure.unionByName(ranked.select(*columns, by_rank.otherwise(F.lit(UNUSED)).alias(out)))


def fraction_split(df: DataFrame, id_col: str, fractions: dict, seed: int = SPLIT_SEED,
                   out: str = "split") -> DataFrame:
    """Map-only split by a uniform hash of the id: no shuffle at all; each
    stratum is split in the given fractions in expectation."""
    u = (F.conv(F.substring(split_hash(id_col, seed), 1, 8), 16, 10).cast("bigint").cast("double")
         / F.lit(4294967296.0))
    assign = None
    cum = 0.0
    for name, frac in fractions.items():
        cum += float(frac)
        assign = (F.when(u < F.lit(cum), F.lit(name)) if assign is None
                  else assign.when(u < F.lit(cum), F.lit(name)))
    return df.withColumn(out, assign.otherwise(F.lit(UNUSED)))


def split_overlap(df: DataFrame, id_col: str, split_col: str = "split",
                  splits=("cal", "dev", "test")) -> DataFrame:
    """Hold-out honesty check (P7, J8): ids present in two splits, per pair.

    One ``groupBy(id)`` with map-side partial aggregation of per-split flags
    instead of one semi-join per pair; a hot id collapses map-side.
    """
    splits = list(splits)
    flags = (df.where(F.col(split_col).isin(splits))
               .groupBy(id_col)
               .agg(*[F.max((F.col(split_col) == s).cast("int")).alias(f"_in_{s}") for s in splits]))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    agg = flags.agg(*[F.coalesce(F.sum(F.col(f"_in_{a}") * F.col(f"_in_{b}")), F.lit(0))
                      .cast("bigint").alias(f"{a}|{b}") for a, b in pairs])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"`{a}|{b}`").alias("overlap"))
        for a, b in pairs]))
    return agg.select(stacked.alias("p")).select("p.*")


def head(df: DataFrame, n: int, order_by) -> DataFrame:
    """First n rows in a stated total order; 0 means all rows, unsorted."""
    if not n:
        return df
    ordered = df.orderBy(*order_by) if isinstance(order_by, (list, tuple)) else df.orderBy(order_by)
    return ordered.limit(int(n))
