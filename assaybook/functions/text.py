"""Text helpers that reproduce the source database's string comparison.

The source compares strings case-insensitively and ignores trailing blanks.
That matters on predicates and join keys, never on output values, so the
helpers here normalise only what is compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ci(c: str | Column) -> Column:
    """Comparison key: lower case, trailing blanks removed (spaces only)."""
    return F.lower(F.rtrim(col_(c)))


def ci_eq(c: str | Column, value: str) -> Column:
    return ci(c) == value.rstrip(" ").lower()


def ci_ne(c: str | Column, value: str) -> Column:
    return ci(c) != value.rstrip(" ").lower()


def ci_in(c: str | Column, values) -> Column:
    return ci(c).isin([v.rstrip(" ").lower() for v in values])


def ci_startswith(c: str | Column, prefix: str) -> Column:
    """``c LIKE 'prefix%'``; a NULL input stays NULL (rejected by WHERE)."""
    return F.lower(col_(c)).startswith(prefix.lower())


def ci_contains(c: str | Column, part: str) -> Column:
    return F.lower(col_(c)).contains(part.lower())


def trim_blanks(c: str | Column) -> Column:
    """LTRIM(RTRIM(x)): spaces only."""
    return F.trim(col_(c))


def rtrim_blanks(c: str | Column) -> Column:
    return F.rtrim(col_(c))


def strip_newlines_rtrim(c: str | Column) -> Column:
    """RTRIM(REPLACE(x, CHAR(10), ''))."""
    return F.rtrim(F.replace(col_(c), F.lit("\n"), F.lit("")))
