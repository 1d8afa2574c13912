"""Temperature calibration: NLL, coarse-to-fine fit, and applying fitted T.

Plan shape of the fit: project each row once to
``(lp = ln(max(p,1e-9)), lmax, lp_true, p_true)`` for every question, explode the
grid inside the scan stage and partially aggregate, so each pass is one scan for
all questions and shuffles at most (#questions x #grid points) partial averages
per input partition. (Wide conditional sums instead of the explode take three
times as long: 80 unrolled sums are too much code to compile.) The log-sum-exp is
unrolled over the label count (a flat, code-generated expression, no lambda
per (row, T)). Two passes: the 80-point coarse grid, then the 25-point fine
grid around its winner; only the per-temperature averages (105 numbers,
bounded by the grid, never by the data) reach the driver to pick winners.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions import dist
from calibra.functions.dist import PROB_FLOOR
from calibra.session import barrier

# Fixed values of the search.
COARSE_GRID = [round(0.25 + 0.25 * i, 2) for i in range(80)]   # 0.25 .. 20.00
GRID_CEILING = 20.0
FINE_STEPS = 25            # best - 0.25 + 0.02 * i, i = 0..24, T > 0 only
NLL_TIE_DIGITS = 12        # NLLs equal to this many decimals are a tie
NLL_CEILING = -math.log(PROB_FLOOR)
DEFAULT_TEMPERATURE = 1.0

FIT_SCHEMA = ("question STRING, n BIGINT, t_coarse DOUBLE, temperature DOUBLE, nll_best DOUBLE, "
              "nll_t1 DOUBLE, hit_ceiling BOOLEAN")


def nll_inputs(df: DataFrame, labels: str, probs: str, truth: str) -> DataFrame:
    """Per-row inputs of the NLL that do not depend on T."""
    pos = dist.label_pos(labels, truth)
    lp = F.transform(F.col(probs), lambda x: dist.log_floor(x))
    return (df.select(lp.alias("lp"), pos.alias("pos"), dist.at(probs, pos).alias("p_true"))
              .select("lp", F.array_max("lp").alias("lmax"), dist.at("lp", "pos").alias("lp_true"),
                      "p_true"))


def nll_at(t: Column, n_labels: int | None = None) -> Column:
    """Row NLL at temperature ``t`` from :func:`nll_inputs` columns (A10 term).

    Max-shifted log-sum-exp; ``max(lp / t) == max(lp) / t`` for t > 0, so the
    shift is computed once per row. T = 1.0 takes the raw probability. With
    ``n_labels`` the sum over labels is unrolled into a flat expression over
    the scalar columns ``lp0 .. lp{K-1}`` (see :func:`_grid_nll`).
    """
    lmax = F.col("lmax")
    if n_labels:
        terms = [F.coalesce(F.exp((F.col(f"lp{k}") - lmax) / t), F.lit(0.0)) for k in range(n_labels)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
    else:
        total = F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp((x - lmax) / t))
    lse = lmax / t + F.log(total)
    scaled = F.least(F.lit(NLL_CEILING), lse - F.col("lp_true") / t)
    raw = -F.log(F.greatest(F.coalesce(F.col("p_true"), F.lit(PROB_FLOOR)), F.lit(PROB_FLOOR)))
    return F.coalesce(F.when(t == F.lit(1.0), raw).otherwise(scaled), F.lit(NLL_CEILING))


def _grid_nll(inputs: DataFrame, grid, n_labels: int | None = None) -> DataFrame:
    """(t, nll, n) per temperature of a literal grid (T > 0 only) -- the grid x
    records product of J5 as an in-stage explode +
    partial aggregate."""
    arr = F.array(*[F.lit(float(t)) for t in grid if t > 0])
    # With a known label count the array is unpacked to scalars BEFORE the
    # explode, so each generated (row, T) copy carries K + 3 doubles.
    if n_labels:        # more labels than stated would be cut from the sum: refuse them
        inputs = inputs.withColumn("lp", F.when(F.size("lp") <= n_labels, F.col("lp")).otherwise(
            F.raise_error(F.lit(f"distribution has more than {n_labels} labels")).cast("array<double>")))
    lp = ([F.get(F.col("lp"), F.lit(k)).alias(f"lp{k}") for k in range(n_labels)] if n_labels
          else ["lp"])
    return (inputs.select(F.explode(arr).alias("t"), *lp, "lmax", "lp_true", "p_true")
                  .groupBy("t")
                  .agg(F.avg(nll_at(F.col("t"), n_labels)).alias("nll"), F.count(F.lit(1)).alias("n")))


def _n_labels(inputs: DataFrame) -> int:
    return int(inputs.agg(F.max(F.size("lp"))).first()[0] or 0)


def nll_by_temperature(df: DataFrame, labels: str, probs: str, truth: str,
                       grid=None, n_labels: int | None = None) -> DataFrame:
    """Mean NLL for each temperature of a grid (default: the coarse grid)."""
    grid = grid if grid is not None else COARSE_GRID
    return _grid_nll(nll_inputs(df, labels, probs, truth), grid, n_labels)


def _tie_key(nll: float, stage: int, t: float):
    return (round(nll, NLL_TIE_DIGITS), stage, t)


def _head_inputs(df: DataFrame, heads: dict) -> DataFrame:
    """NLL inputs of several questions on the same rows, one row for each question: a single scan, whatever their number."""
    first, second = [], []
    for i, (_, labels, probs, truth, n_labels) in enumerate(heads.values()):
        lp = F.transform(F.col(probs), lambda x: dist.log_floor(x))
        if n_labels:        # more labels than stated would be cut from the sum: refuse them
            lp = F.when(F.size(probs) <= n_labels, lp).otherwise(F.raise_error(F.lit(f"distribution has more than {n_labels} labels")).cast("array<double>"))
            lp = F.when(F.col(probs).isNotNull(), lp)
        pos = dist.label_pos(labels, truth)
        first += [lp.alias(f"lp{i}"), pos.alias(f"pos{i}"), dist.at(probs, pos).alias(f"p{i}")]
    for i, question in enumerate(heads):
        second.append(F.struct(F.lit(i).alias("head"), F.col(f"lp{i}").alias("lp"), F.array_max(f"lp{i}").alias("lmax"),
                               dist.at(f"lp{i}", f"pos{i}").alias("lp_true"), F.col(f"p{i}").alias("p_true")))
    return df.select(*first).select(F.explode(F.array(*second)).alias("h")).select("h.*")


def _heads_nll(inputs: DataFrame, grids: dict[int, list[float]], n_labels: int) -> dict[int, list[tuple[float, float, int]]]:
    """(t, nll, n) by question, each with its own literal grid, in one pass: a (question, t) group is an average of partial
    averages. Labels are unpacked to scalars before the grid is exploded; a shorter head has nulls, which add nothing."""
    grid = None
    for i, values in grids.items():
        own = F.array(*[F.lit(float(t)) for t in values if t > 0])
        grid = F.when(F.col("head") == i, own) if grid is None else grid.when(F.col("head") == i, own)
    lp = [F.get(F.col("lp"), F.lit(k)).alias(f"lp{k}") for k in range(n_labels)]
    rows = (inputs.select("head", F.explode(grid).alias("t"), *lp, "lmax", "lp_true", "p_true").groupBy("head", "t")
                  .agg(F.avg(nll_at(F.col("t"), n_labels)).alias("nll"), F.count(F.lit(1)).alias("n")).collect())
    out: dict[int, list] = {i: [] for i in grids}
    for r in rows:
        out[r["head"]].append((r["t"], r["nll"], r["n"]))
    return out


def fit_heads(df: DataFrame, heads: dict) -> list[tuple]:
    """Coarse-to-fine NLL search (A11, A12) for all questions of the same rows: two scans in all.

    Strictly lower NLL wins: among ties the coarse winner stays, then the lowest T. Empty input -> T = 1.0 (no scaling).
    """
    inputs = _head_inputs(df, heads)
    known = [h[4] for h in heads.values()]
    n_labels = max(known) if all(known) else max(_n_labels(inputs), 1)
    coarse = _heads_nll(inputs, {i: COARSE_GRID for i in range(len(heads))}, n_labels)
    start = {i: min(found, key=lambda r: _tie_key(r[1], 0, r[0])) for i, found in coarse.items() if found}
    fine = _heads_nll(inputs, {i: [round(t0 - 0.25 + 0.02 * k, 3) for k in range(FINE_STEPS)] for i, (t0, _, _) in start.items()},
                      n_labels) if start else {}
    out = []
    for i, question in enumerate(heads):
        if i not in start:
            out.append((question, 0, None, DEFAULT_TEMPERATURE, None, None, False))
            continue
        t0, nll0, n = start[i]
        nll_t1 = next((v for t, v, _ in coarse[i] if t == 1.0), None)
        _, t_best, nll_best = min([(_tie_key(nll0, 0, t0), t0, nll0)] + [(_tie_key(v, 1, t), t, v) for t, v, _ in fine[i]])
        out.append((question, int(n), float(t0), float(t_best), float(nll_best), nll_t1, t_best >= GRID_CEILING - 0.25))
    return out


def fit_temperature(df: DataFrame, labels: str, probs: str, truth: str,
                    question: str | None = None, n_labels: int | None = None) -> DataFrame:
    """:func:`fit_heads` for one question. One row: ``question, n, t_coarse, temperature, nll_best, nll_t1, hit_ceiling``."""
    return df.sparkSession.createDataFrame(fit_heads(df, {question: (df, labels, probs, truth, n_labels)}), FIT_SCHEMA)


def fit_temperatures(heads: dict) -> DataFrame:
    """One row per question: ``{question: (df, labels, probs, truth[, n_labels])}`` (U13). Questions on the same DataFrame share
    their two scans."""
    groups: dict[int, dict] = {}
    for question, spec in heads.items():
        groups.setdefault(id(spec[0]), {})[question] = (*spec[:4], spec[4] if len(spec) > 4 else None)
    rows = {r[0]: r for group in groups.values() for r in fit_heads(next(iter(group.values()))[0], group)}
    spark = next(iter(heads.values()))[0].sparkSession
    return spark.createDataFrame([rows[q] for q in heads], FIT_SCHEMA)


def temperature_of(temps, question: str) -> Column:
    """T for a question: a float from a dict, or a scalar subquery over a
    ``(question, temperature)`` DataFrame; 1.0 when not fitted (S9)."""
    if temps is None:
        return F.lit(DEFAULT_TEMPERATURE)
    if isinstance(temps, dict):
        return F.lit(float(temps.get(question, DEFAULT_TEMPERATURE)))
    if isinstance(temps, DataFrame):
        v = temps.where(F.col("question") == question).agg(F.max("temperature")).scalar()
        return F.coalesce(v, F.lit(DEFAULT_TEMPERATURE))
    return F.lit(float(temps))


def _temp_value(temps, question):
    """Python float when known on the driver (enables the T = 1.0 shortcut)."""
    if temps is None:
        return DEFAULT_TEMPERATURE
    if isinstance(temps, dict):
        return float(temps.get(question, DEFAULT_TEMPERATURE))
    if isinstance(temps, (int, float)):
        return float(temps)
    return temperature_of(temps, question)


def calibrate_choice(df: DataFrame, labels: str, probs: str, temps, question: str,
                     label_out: str, conf_out: str, n_labels: int | None = None) -> DataFrame:
    """Calibrated argmax label + confidence of a choice head.
    ``n_labels`` (the fixed label count, when known) unrolls the scaling."""
    staged = dist.with_temperature(df, probs, _temp_value(temps, question), "_scaled", n_labels)
    return barrier(staged.withColumn(label_out, dist.argmax_label(labels, "_scaled"))
                         .withColumn(conf_out, dist.top_prob("_scaled"))
                         .drop("_scaled"), "calibrated_choice")


def calibrate_ordinal(df: DataFrame, labels: str, probs: str, temps, question: str,
                      class_out: str, conf_out: str, raw_out: str | None = None,
                      n_labels: int | None = None) -> DataFrame:
    """Ordinal class from the RAW expected value; confidence from the SCALED
    distribution at that class, 0.0 when absent (C5, C6, C7)."""
    out = df.withColumn("_ev", dist.expected_value(labels, probs))
    if raw_out:
        out = out.withColumn(raw_out, F.col("_ev"))
    out = dist.with_temperature(out, probs, _temp_value(temps, question), "_uscaled", n_labels)
    return barrier(out.withColumn(class_out, dist.ordinal_class("_ev", F.size(labels)))
                      .withColumn(conf_out, dist.prob_of(labels, "_uscaled", F.col(class_out), 0.0))
                      .drop("_ev", "_uscaled"), "calibrated_ordinal")


def calibrate(df: DataFrame, temps, dept=("department_labels", "department_probs"),
              urg=("urgency_labels", "urgency_probs"), n_department: int | None = None,
              n_urgency: int | None = None) -> DataFrame:
    """Composite calibration of a scored frame -> four ``cal_*`` columns."""
    out = calibrate_choice(df, dept[0], dept[1], temps, "department",
                           "cal_department", "cal_department_confidence", n_department)
    return calibrate_ordinal(out, urg[0], urg[1], temps, "urgency",
                             "cal_urgency", "cal_urgency_confidence", n_labels=n_urgency)


def mean_top_prob(df: DataFrame, probs: str, temperature, question: str | None = None) -> DataFrame:
    """Mean top probability before and after scaling."""
    t = temperature if not isinstance(temperature, DataFrame) else temperature_of(temperature, question)
    staged = dist.with_temperature(df.select(F.col(probs).alias("_probs")), "_probs", t, "_after")
    return staged.agg(F.avg(dist.top_prob("_probs")).alias("mean_top_before"),
                      F.avg(dist.top_prob("_after")).alias("mean_top_after")).select(
        F.lit(question).cast("string").alias("question"), "mean_top_before", "mean_top_after")
