"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_dp(c: Column | str, digits: int) -> Column:
    """Round a double half up on its decimal form.

    The detour over a six-digit decimal makes the result independent of binary
    representation error. A double too large for it (1e32 and more) has no fraction.
    """
    x = _col(c)
    return F.coalesce(F.round(x.try_cast("decimal(38,6)"), digits).cast("double"), x)


def mean_dp(c: Column | str, digits: int = 2) -> Column:
    """Rounded average; a plain double sum keeps the hash aggregate in fast code."""
    return round_dp(F.avg(_col(c)), digits)


def row_count(n: int | None, default: int) -> int:
    """A requested number of rows, the default for None. No upper limit: nothing is cut silently."""
    n = default if n is None else int(n)
    if n < 1:
        raise ValueError("ask for one row at least")
    return n


def plain_number(c: Column | str) -> Column:
    """A double as plain decimal text without trailing zeros: 0.0005, 12345678.5, 40.

    Text of a double is plain from 1e-3 to 1e7 only; outside, a decimal gives the digits. Values of 1e21 and more,
    and of less than 1e-6, keep their exponent.
    """
    x = _col(c)
    text, size = x.cast("string"), F.abs(x)
    digits = F.regexp_replace(x.try_cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    plain = F.when(text.contains("E") & (size >= 1e-6) & (size < 1e21), digits).otherwise(text)
    return F.regexp_replace(plain, r"\.0$", "")

