"""Contracts shared by all operators.

C1 ties: every ordering is ``measure DESC, name ASC``; row-level arg-max is
``measure DESC, row order ASC``.
C2 money: sums run on DECIMAL, never DOUBLE, so results do not depend on how the
data is partitioned.  Values leave as DOUBLE only after rounding.
C3 rounding: round half-up on the exact decimal, then format.
C5 nulls: category keys drop nulls, item keys keep them.
C6 ANSI: ``try_*`` only where the reference coerces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_units(c) -> Column:
    """Python ``int(x)``: truncate toward zero."""
    return col_(c).cast("bigint")


def money_out(c, scale: int = 2) -> Column:
    """Python ``round(x, 2)`` on an exact decimal, handed out as DOUBLE."""
    return F.round(col_(c), scale).cast("double")


def mean_out(total, count, scale: int = 2) -> Column:
    """Mean of a decimal column from its exact sum and count, rounded half-up."""
    return F.round(col_(total) / col_(count), scale).cast("double")


def ratio_pct(num, den) -> Column:
    """``num / den * 100`` in DOUBLE from exact sums; null when ``den`` is 0."""
    d = col_(den).cast("double")
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(col_(num).cast("double") / d * 100)


def by_measure_then_name(measure: str, name: str) -> list[Column]:
    """Contract C1 ordering for item / category lists."""
    return [F.col(measure).desc(), F.col(name).asc_nulls_last()]


def pct_change(prev, curr) -> Column:
    """``(curr - prev) / prev * 100``; null when prev is 0 (no rounding)."""
    p = col_(prev).cast("double")
    c = col_(curr).cast("double")
    return F.when(p == 0, F.lit(None).cast("double")).otherwise((c - p) / p * 100)
