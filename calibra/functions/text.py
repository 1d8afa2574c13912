"""Display-side column expressions: previews, short labels, rounding, flags."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def preview(text, n: int, newline_to_space: bool = True) -> Column:
    """First ``n`` characters; newlines become spaces unless told otherwise."""
    s = F.substring(_c(text), 1, n)
    return F.translate(s, "\n", " ") if newline_to_space else s


def short_label(label, n: int = 10) -> Column:
    """First ``n`` characters of a label."""
    return F.substring(_c(label), 1, n)


def round_half_even(x, digits: int) -> Column:
    """Python-style ``round(x, d)`` for display."""
    return F.bround(_c(x), digits)


def title(x) -> Column:
    """Title-case a label."""
    return F.initcap(_c(x))


def pct0(x) -> Column:
    """``f"{x:.0%}"`` -- whole percent with a sign."""
    return F.concat(F.call_function("format_number", _c(x) * 100.0, F.lit("0")), F.lit("%"))


def department_correct(pred, truth) -> Column:
    """1/0 when truth is known (a NULL prediction counts as wrong), else NULL (C13;
    the null-safe predicted-vs-truth match of J7)."""
    return F.when(_c(truth).isNotNull(), _c(pred).eqNullSafe(_c(truth)).cast("int"))


def urgency_correct(pred, truth) -> Column:
    """1/0 when both sides are known, else NULL (C14)."""
    return (_c(pred).cast("int") == _c(truth).cast("int")).cast("int")


def ok_mark(pred, truth) -> Column:
    """``OK`` when equal (both NULL included), else ``MISS``."""
    return F.when(_c(pred).eqNullSafe(_c(truth)), F.lit("OK")).otherwise(F.lit("MISS"))


def now_seconds() -> Column:
    """Current time truncated to the second, as TIMESTAMP_NTZ."""
    return F.date_trunc("second", F.localtimestamp()).cast("timestamp_ntz")
