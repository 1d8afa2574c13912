"""Column expressions over a categorical distribution.

A distribution is two parallel arrays in declared label order:
``labels ARRAY<STRING>`` and ``probs ARRAY<DOUBLE>``. Order matters: the first
maximum wins an argmax tie, and a map collected to Python loses its order.
All functions return Columns, so they compile into the surrounding
whole-stage-codegen projection; nothing here leaves the JVM.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.session import barrier

# Fixed values shared with the scoring semantics being reproduced.
PROB_FLOOR = 1e-9            # probabilities are floored here before ln()
DEFAULT_THRESHOLD = 0.85     # auto-route when calibrated confidence >= this
AUTO_ROUTE = "auto_route"
ESCALATE = "escalate_to_human"


def _c(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def dsum(arr) -> Column:
    """Sum of a DOUBLE array (0.0 when empty)."""
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x)


def at(arr, pos) -> Column:
    """1-based element access that is NULL for position 0 / out of range."""
    return F.get(_c(arr), _c(pos).cast("int") - 1)


def softmax(logits) -> Column:
    """Max-shifted softmax of a DOUBLE array."""
    lg = _c(logits)
    m = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - m))
    return F.transform(ex, lambda x: x / dsum(ex))


def with_softmax(df: DataFrame, logits, out: str, n: int | None = None) -> DataFrame:
    """``df`` + column ``out`` = softmax(logits), staged in separate
    projections so each exponential is computed once per element (a single
    nested Column expression re-evaluates the normaliser per element).

    With ``n`` (the fixed label count) the softmax is unrolled over scalar
    columns -- code-generated arithmetic instead of array lambdas, which Spark
    interprets per element -- with the same operations in the same order
    (so bit-identical results)."""
    tmp = f"_{out}__"
    if n:
        staged = df.withColumn(tmp + "l", _c(logits))
        lg = F.col(tmp + "l")
        return _flat_softmax(staged, [F.get(lg, F.lit(k)) for k in range(n)], lg, out, [tmp + "l"])
    lg = F.col(tmp + "l")
    staged = (df.withColumn(tmp + "l", _c(logits))
                .withColumn(tmp + "m", F.array_max(lg))
                .withColumn(tmp + "e", F.transform(lg, lambda x: F.exp(x - F.col(tmp + "m"))))
                .withColumn(tmp + "z", dsum(tmp + "e"))
                .withColumn(out, F.transform(tmp + "e", lambda x: x / F.col(tmp + "z")))
                .drop(tmp + "l", tmp + "m", tmp + "e", tmp + "z"))
    # A later filter on ``out`` (also the one Catalyst infers for an explode)
    # would otherwise be pushed below these projections with every stage
    # inlined; the barrier keeps the softmax computed once per row.
    return barrier(staged, "softmax")


def _flat_softmax(df: DataFrame, logits: list, given: Column, out: str, drop: list) -> DataFrame:
    """Softmax over a fixed list of scalar logit expressions (see with_softmax);
    a row whose array ``given`` has another size raises instead of being cut."""
    tmp = f"_{out}__"
    n = len(logits)
    xs = [f"{tmp}x{k}" for k in range(n)]
    es = [f"{tmp}e{k}" for k in range(n)]
    staged = df.select("*", *[c.alias(x) for c, x in zip(logits, xs)])
    staged = staged.withColumn(tmp + "m", F.greatest(*xs) if n > 1 else F.col(xs[0]))
    staged = staged.select("*", *[F.exp(F.col(x) - F.col(tmp + "m")).alias(e) for x, e in zip(xs, es)])
    z = F.lit(0.0)
    for e in es:
        z = z + F.col(e)
    staged = staged.withColumn(tmp + "z", z)
    res = F.array(*[F.col(e) / F.col(tmp + "z") for e in es])
    staged = (staged.withColumn(out, F.when(given.isNull(), F.lit(None)).when(F.size(given) == n, res)
                                     .otherwise(F.raise_error(F.lit(f"distribution does not have {n} labels")).cast("array<double>")))
                    .drop(*drop, *xs, *es, tmp + "m", tmp + "z"))
    return barrier(staged, "softmax")


def with_temperature(df: DataFrame, probs, temperature, out: str, n: int | None = None) -> DataFrame:
    """``df`` + column ``out`` = :func:`apply_temperature`, staged (unrolled
    over ``n`` labels when the label count is given)."""
    if isinstance(temperature, (int, float)) and not isinstance(temperature, bool):
        if float(temperature) == 1.0:
            return df.withColumn(out, _c(probs))
        if n:
            t = F.lit(float(temperature))
            return _flat_softmax(df, [log_floor(F.get(_c(probs), F.lit(k))) / t for k in range(n)],
                                 _c(probs), out, [])
        return with_softmax(df, scaled_logits(probs, F.lit(float(temperature))), out)
    t = _c(temperature)
    tcol = F.col(f"_{out}__t")
    df = df.withColumn(f"_{out}__t", t)
    if n:
        staged = _flat_softmax(df, [log_floor(F.get(_c(probs), F.lit(k))) / tcol for k in range(n)],
                               _c(probs), out, [])
    else:
        staged = with_softmax(df, scaled_logits(probs, tcol), out)
    return (staged.withColumn(out, F.when(tcol == F.lit(1.0), _c(probs)).otherwise(F.col(out)))
                  .drop(f"_{out}__t"))


def log_floor(p) -> Column:
    return F.log(F.greatest(_c(p), F.lit(PROB_FLOOR)))


def scaled_logits(probs, temperature) -> Column:
    t = _c(temperature)
    return F.transform(_c(probs), lambda x: log_floor(x) / t)


def apply_temperature(probs, temperature) -> Column:
    """Temperature scaling ``softmax(ln(max(p, 1e-9)) / T)``.

    T = 1.0 returns the input untouched (no floor, no renormalising), exactly
    as the reference does. No guard for T <= 0 (the fit never produces one).
    """
    if isinstance(temperature, (int, float)) and not isinstance(temperature, bool):
        if float(temperature) == 1.0:
            return _c(probs)
        return softmax(scaled_logits(probs, F.lit(float(temperature))))
    t = _c(temperature)
    return F.when(t == F.lit(1.0), _c(probs)).otherwise(softmax(scaled_logits(probs, t)))


def top_prob(probs) -> Column:
    """Largest probability (C4)."""
    return F.array_max(_c(probs))


def argmax_pos(probs) -> Column:
    """1-based position of the first maximum."""
    p = _c(probs)
    return F.array_position(p, F.array_max(p))


def argmax_label(labels, probs) -> Column:
    """Label of the first maximum (C3); NULL for an empty distribution."""
    return at(labels, argmax_pos(probs))


def label_pos(labels, label) -> Column:
    """1-based position of a label, 0 when absent (truth is compared as text)."""
    return F.array_position(_c(labels), _c(label).cast("string"))


def prob_of(labels, probs, label, default: float | None = None) -> Column:
    """``probs.get(str(label), default)``."""
    v = at(probs, label_pos(labels, label))
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def expected_value(labels, probs) -> Column:
    """Sum of int(label) * p over an ordinal distribution."""
    terms = F.zip_with(_c(labels), _c(probs), lambda k, p: k.try_cast("int") * p)
    return dsum(terms)


def ordinal_class(ev, n_levels) -> Column:
    """Half-to-even rounding of the expected value, clamped to [0, n-1]."""
    n = _c(n_levels)
    return F.greatest(F.lit(0), F.least(n - 1, F.bround(_c(ev), 0).cast("int")))


def gate(confidence, threshold=DEFAULT_THRESHOLD) -> Column:
    """auto_route when confidence >= threshold, else escalate (F1).

    Boundary inclusive; a NULL or NaN confidence escalates.
    """
    return F.when(passes(confidence, threshold), F.lit(AUTO_ROUTE)).otherwise(F.lit(ESCALATE))


def passes(confidence, threshold) -> Column:
    """confidence >= threshold; false for NULL and NaN (Spark orders NaN above every number)."""
    c = _c(confidence)
    return F.coalesce((c >= _c(threshold)) & ~F.isnan(c), F.lit(False))


def nll_term(labels, probs, truth, temperature) -> Column:
    """Per-row ``-ln(max(p_T(truth), 1e-9))`` (inner term of A10).

    Computed in log space (``m - x_true + ln(sum(exp(x - m)))``) so tiny
    probabilities at small T cannot underflow to 0/0. T = 1.0 uses the raw
    probability, matching the bypass of :func:`apply_temperature`; a truth
    label outside the distribution scores ``-ln(1e-9)``.
    """
    t = _c(temperature)
    pos = label_pos(labels, truth)
    lg = scaled_logits(probs, t)
    m = F.array_max(lg)
    lse = m + F.log(F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    ceiling = F.lit(-math.log(PROB_FLOOR))
    scaled = F.least(ceiling, lse - at(lg, pos))
    raw = -log_floor(at(probs, pos))
    return F.coalesce(F.when(t == F.lit(1.0), raw).otherwise(scaled), ceiling)
