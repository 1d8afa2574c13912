"""Mixing sources to target weights (operator 1, DataFrame functions only).

A source with share p of all tokens gets weight p ** a, normalised. The exponent
a is found by bisection to meet a target: the entropy of the weights, or a limit on
how often the documents of a source are repeated. One pass over the table of
source totals evaluates the 31 inner points of five bisection steps, so six
passes fix thirty binary digits; only those 31 sums reach the driver.

The weights are realised as block permutations under a token budget. Each
source's documents are dealt by hash into blocks of about ``BLOCK_ROWS``; in each
epoch the blocks, and the documents in a block, are ordered by a hash of the
epoch. A document's place is the tokens before it, so a budget is whole epochs
and a prefix of the last permutation. The place as a fraction of the source's
budget is its place in the mixture: all sources advance at the same rate, and
any stretch of the mixture (``mix_block``) holds them in their weights. Windows run
over one block only, so a source of any size is spread over the cluster.

Without a budget the smallest one is taken that keeps every document once.

A null source is a source of its own. Documents without text have no tokens
and come along in whole epochs; a source without any tokens gets one epoch. Rows
that share an id are placed one by one, by the same hash. An empty table gives
no rows. Extra columns are not read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import cut, free_name, table

BLOCK_ROWS = 4096
MIX_TOKENS = 1_000_000
STEPS = 5
PASSES = 6
MAX_REPETITION = 2.0
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, tokens (words of the whole text)."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("tokens"))


def source_totals(rows: DataFrame) -> DataFrame:
    """source, docs, size (tokens), share."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("size"))
    total = per.agg(F.sum("size")).first()[0] or 0
    return per.withColumn("share", F.col("size") / F.lit(float(max(total, 1))))


def _measures(totals: DataFrame, exponents: list[float]) -> list:
    """For each exponent: the entropy of the weights, and the largest and smallest weight / share."""
    a = F.col("a")
    grid = totals.where("size > 0").withColumn("a", F.explode(F.array(*[F.lit(x) for x in exponents])))
    w = F.pow(F.col("share"), a)
    sums = grid.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log("share")).alias("wl"),
                                 F.max(F.pow(F.col("share"), a - 1.0)).alias("hi"), F.min(F.pow(F.col("share"), a - 1.0)).alias("lo"))
    return {r["a"]: r for r in sums.collect()}


def find_exponent(totals: DataFrame, target: str = "repetition", value: float = MAX_REPETITION, budget: float | None = None,
                  total: float | None = None, highest: float = 1.0) -> float:
    """The smallest exponent in [0, highest] whose entropy is at most, or whose largest repetition is at most, ``value``
    (repetition falls towards exponent 1 and is sought up to there)."""
    if target not in ("repetition", "entropy"):
        raise ValueError("target is repetition or entropy")
    if target == "repetition":
        highest = min(highest, 1.0)

    def reached(r) -> bool:
        if target == "entropy":
            return math.log(r["z"]) - r["a"] * r["wl"] / r["z"] <= value
        most = r["hi"] / r["lo"] if budget is None else r["hi"] / r["z"] * budget / total
        return most <= value

    lo, hi = 0.0, highest
    ends = _measures(totals, [lo, hi])
    if not ends or reached(ends[lo]):
        return lo
    if not reached(ends[hi]):
        if target == "entropy":
            raise ValueError(f"no exponent up to {hi} brings the entropy down to {value}; give a larger ``highest``")
        return hi
    parts = 1 << STEPS
    for _ in range(PASSES):
        points = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        found = _measures(totals, points)
        met = [x for x in points if reached(found[x])]
        hi_new = min(met) if met else hi
        below = [x for x in points if x < hi_new]
        lo, hi = (max(below) if below else lo), hi_new
    return hi


def mixing_plan(rows: DataFrame, target: str = "repetition", value: float = MAX_REPETITION, budget: float | None = None,
                highest: float = 1.0) -> DataFrame:
    """One row per source: docs, size, share, weight, budget (tokens), epochs, mixture (tokens of all)."""
    totals = cut(source_totals(rows), "totals")
    total = totals.agg(F.sum("size")).first()[0] or 0
    a = find_exponent(totals, target, value, budget, total, highest)
    raw = F.when(F.col("size") > 0, F.pow(F.col("share"), F.lit(a))).otherwise(F.lit(0.0))
    sums = totals.agg(F.sum(raw), F.max(F.when(F.col("size") > 0, F.col("size") / raw))).first()
    z, need = sums[0] or 1.0, sums[1] or 0.0
    spend = budget if budget is not None else need * z
    plan = totals.withColumn("weight", raw / F.lit(z)).withColumn("budget", F.col("weight") * F.lit(float(spend)))
    epochs = F.when(F.col("size") > 0, F.col("budget") / F.col("size")).otherwise(F.lit(1.0))
    return plan.withColumn("epochs", epochs).withColumn("mixture", F.lit(float(spend)))


def _order(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts]))


def mixture(rows: DataFrame, plan: DataFrame, seed: int = 7, mix_tokens: int = MIX_TOKENS) -> DataFrame:
    """id, source, epoch, mix_block, place, tokens: every copy of every document in the mixture.

    ``rows`` has id, source, tokens; ``plan`` comes from :func:`mixing_plan`.
    """
    plan = plan.select(F.col("source").alias("of"), F.col("size").cast("double").alias("size"), "budget", "epochs", "mixture",
                       F.ceil(F.col("docs") / F.lit(BLOCK_ROWS)).cast("long").alias("blocks"))
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    code = F.conv(F.substring(_order(F.lit(str(seed)), "id"), 1, 8), 16, 10).cast("long")
    dealt = dealt.withColumn("block", F.pmod(code, F.col("blocks")))
    whole = F.floor(F.col("epochs") + F.lit(1e-6)).cast("long")
    last = F.when(F.col("budget") - whole * F.col("size") > 0.5, whole + 1).otherwise(whole)
    copies = dealt.where(last > 0).withColumn("whole", whole).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))

    keys = ["source", "epoch", "block"]
    sums = copies.groupBy(*keys).agg(F.sum("tokens").alias("held"))
    blocks = Window.partitionBy("source", "epoch").orderBy(_order(F.lit(str(seed)), "epoch", "block"), "block").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("held").over(blocks), F.lit(0))).select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("k"), "base")
    inside = Window.partitionBy(*keys).orderBy(_order(F.lit(str(seed)), "epoch", "id"), "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = placed.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("k")))
    start = F.col("epoch") * F.col("size") + F.col("base") + F.col("before")
    placed = placed.withColumn("start", start).where((F.col("epoch") < F.col("whole")) | (F.col("start") < F.col("budget") - 0.5))
    place = F.when(F.col("budget") > 0, F.least(F.col("start") / F.col("budget"), F.lit(1.0))).otherwise(F.lit(0.0))
    count = F.greatest(F.ceil(F.col("mixture") / F.lit(float(mix_tokens))), F.lit(1))
    return placed.select("id", "source", "epoch", F.least(F.floor(place * count), count - 1).cast("long").alias("mix_block"),
                         place.alias("place"), "tokens")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: str = "repetition",
        value: float = MAX_REPETITION, budget: float | None = None) -> DataFrame:
    """``docs`` with each row as often as the mixture holds its id (rows of one id go together)."""
    rows = cut(sized(docs, id_col, source_col, text_col), "sized")
    ours, copies = free_name(docs, "mixed_id"), free_name(docs, "mixed_copies")
    chosen = mixture(rows, mixing_plan(rows, target, value, budget)).select(F.col("id").alias(ours), "epoch").distinct()
    chosen = chosen.groupBy(ours).agg(F.count(F.lit(1)).cast("int").alias(copies))
    out = docs.join(chosen, F.col(id_col).eqNullSafe(F.col(ours)))
    return out.withColumn(ours, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[docs[c] for c in docs.columns])


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    rows = cut(sized(table(spark, sf_dir, "documents")), "sized")
    out = mixture(rows, mixing_plan(rows))
    return out.select(F.col("id").alias("doc_id"), "source", "epoch", "mix_block", F.col("tokens").alias("n_tokens"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
t AS (SELECT source, count(*) AS docs, sum(tokens)::DOUBLE AS size FROM d GROUP BY source),
x AS (SELECT sum(size) AS total, max(size) AS most, min(CASE WHEN size > 0 THEN size END) AS least FROM t),
e AS (SELECT CASE WHEN most / least <= {MAX_REPETITION} THEN 0.0 ELSE greatest(0.0, 1.0 - ln({MAX_REPETITION}) / ln(most / least)) END AS a, total FROM x),
r AS (SELECT t.*, CASE WHEN size > 0 THEN pow(size / total, a) ELSE 0.0 END AS raw FROM t, e),
z AS (SELECT sum(raw) AS z, max(CASE WHEN size > 0 THEN size / raw END) * sum(raw) AS spend FROM r),
p AS (SELECT source, size, raw / z * spend AS budget, spend, ceil(docs / {BLOCK_ROWS}.0)::BIGINT AS blocks,
        CASE WHEN size > 0 THEN raw / z * spend / size ELSE 1.0 END AS epochs FROM r, z),
c0 AS (SELECT d.id, d.source, d.tokens, p.size, p.budget, p.spend, floor(p.epochs + 1e-6)::BIGINT AS whole,
        ('0x' || substr(md5('7:' || coalesce(d.id::VARCHAR, '')), 1, 8))::BIGINT % p.blocks AS block
        FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, unnest(range(0, CASE WHEN budget - whole * size > 0.5 THEN whole + 1 ELSE whole END)) AS epoch FROM c0),
s AS (SELECT source, epoch, block, sum(tokens) AS held FROM c GROUP BY ALL),
b AS (SELECT source, epoch, block, coalesce(sum(held) OVER (PARTITION BY source, epoch
        ORDER BY md5('7:' || epoch || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s),
w AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch, block
        ORDER BY md5('7:' || epoch || ':' || coalesce(id::VARCHAR, '')), id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
q AS (SELECT w.*, w.epoch * size + base + before AS start FROM w JOIN b
        ON w.source IS NOT DISTINCT FROM b.source AND w.epoch = b.epoch AND w.block = b.block)
SELECT id AS doc_id, source, epoch,
       least(floor(CASE WHEN budget > 0 THEN least(start / budget, 1.0) ELSE 0.0 END * greatest(ceil(spend / {MIX_TOKENS}.0), 1)),
             greatest(ceil(spend / {MIX_TOKENS}.0), 1) - 1)::BIGINT AS mix_block, tokens AS n_tokens
FROM q WHERE epoch < whole OR start < budget - 0.5
"""
