"""Text formatters (F5, F8-F15, F19-F21) as built-in column expressions.

Rounding rule (contract C3): money is rounded half-up on the exact DECIMAL and
then printed, so no second rounding happens in the formatter.  Ratios are
DOUBLE; ``format_number`` rounds them half-even on the binary value, which is
what Python's ``f'{x:.0f}'`` / ``f'{x:.1f}'`` do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import col_


# The characters Python's ``str.strip()`` removes (``str.isspace``).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_text(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace (no regex)."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def money_text(c) -> Column:
    """``f'${x:,.2f}'`` for a non-negative decimal amount (F8)."""
    return F.concat(F.lit("$"), F.format_number(F.round(col_(c), 2), 2))


def plain_money_text(c) -> Column:
    """``f'${x:.2f}'`` without thousands separators."""
    return F.concat(F.lit("$"), F.round(col_(c), 2).cast("decimal(38,2)").cast("string"))


def fixed_text(c, places: int) -> Column:
    """``f'{x:.Nf}'`` for a DOUBLE (no grouping), half-even on the binary value."""
    return F.regexp_replace(F.format_number(col_(c).cast("double"), places), ",", "")


def currency_text(c) -> Column:
    """en-US USD currency text, ``-$1,234.56`` for negatives, null stays null."""
    x = F.round(col_(c).cast("decimal(38,6)"), 2)
    body = F.concat(F.lit("$"), F.format_number(F.abs(x), 2))
    return F.when(x.isNull(), F.lit(None).cast("string")) \
        .when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)


def signed_pct_text(c) -> Column:
    """``+12.3%`` / ``-4.0%`` / ``0.0%``; null or NaN -> ``—``."""
    x = col_(c).cast("double")
    body = F.concat(F.when(x > 0, F.lit("+")).otherwise(F.lit("")), fixed_text(x, 1), F.lit("%"))
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).otherwise(body)


def sign_class(c, good: str = "good", bad: str = "bad", neutral: str = "neutral") -> Column:
    """class by sign; null -> neutral."""
    x = col_(c).cast("double")
    return F.when(x > 0, F.lit(good)).when(x < 0, F.lit(bad)).otherwise(F.lit(neutral))


def status_class(c) -> Column:
    """W6 consumer: still -> good, dropped -> bad, entered/new -> info, else neutral."""
    s = F.lower(col_(c))
    return (F.when(col_(c).isNull(), F.lit("status-neutral"))
            .when(s.contains("still"), F.lit("status-good"))
            .when(s.contains("dropped"), F.lit("status-bad"))
            .when(s.contains("entered") | s.contains("new"), F.lit("status-info"))
            .otherwise(F.lit("status-neutral")))


def date_text_short(c) -> Column:
    """``%b %d, %Y`` -> ``Mar 01, 2025``."""
    return F.date_format(col_(c), "MMM dd, yyyy")


def date_text_long(c) -> Column:
    """``March 1, 2025`` (F5, no leading zero)."""
    return F.date_format(col_(c), "MMMM d, yyyy")


def period_text(d_min, d_max) -> Column:
    """A10: one date when first = last, else ``first – last`` (en dash)."""
    return F.when(col_(d_min) == col_(d_max), date_text_long(d_min)).otherwise(
        F.concat(date_text_long(d_min), F.lit(" – "), date_text_long(d_max)))


def post_text(caption, hashtags) -> Column:
    """caption, blank line, hashtags joined by a space."""
    return F.concat(col_(caption), F.lit("\n\n"), F.array_join(col_(hashtags), " "))


def join_idea_texts(ideas, sep: str = " | ") -> Column:
    """the ``text`` of each idea joined by ``sep``."""
    return F.array_join(F.transform(col_(ideas), lambda i: i["text"]), sep)


def actions_to_ideas(actions, reason: str = "Refreshed suggestion") -> Column:
    """list of action strings -> list of ``{text, reason}`` ideas."""
    return F.transform(col_(actions),
                       lambda a: F.struct(a.alias("text"), F.lit(reason).alias("reason")))
