"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends (plain `trim` removes blanks only)."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def is_blank(c: Column | str) -> Column:
    """True where there is nothing but white space."""
    return strip(c) == ""


def canon_router_id(c: Column | str) -> Column:
    """Router ids of the registry and of fault schedules: stripped, upper case."""
    return F.upper(strip(c))
