"""Row filters of the report (P1-P8)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaybook.functions import codes
from assaybook.functions.text import ci, ci_in, ci_ne, ci_startswith, col_


def ts(value) -> Column:
    """A timestamp_ntz literal from a date/datetime/ISO string."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat() + " 00:00:00"
    return F.lit(str(value)).cast("timestamp_ntz")


def in_window(c, start, end) -> Column:
    """Closed window ``start <= c <= end`` (end at midnight keeps that instant
    only, as the source does)."""
    c = col_(c)
    return (c >= ts(start)) & (c <= ts(end))


def window_filter(results: DataFrame, start, end, col: str = "DATEENTER") -> DataFrame:
    return results.where(in_window(col, start, end))


def billable_client(compname="COMPNAME", category="CATEGORY") -> Column:
    """P2 + P5: company exclusions and non-internal category. NULL company or
    category rejects the row, like the source's NOT LIKE / NOT IN / <>."""
    c = col_(compname)
    keep = ~ci_in(c, codes.EXCLUDED_COMPANIES)
    for prefix in codes.EXCLUDED_COMPANY_PREFIXES:
        keep = keep & ~ci_startswith(c, prefix)
    return keep & ci_ne(category, codes.INTERNAL_CATEGORY)


def billable_clients(clients: DataFrame) -> DataFrame:
    return clients.where(billable_client())


def valid_result(numres="NUMRES", status="S", testcode="TESTCODE") -> Column:
    """P3 + P4 + P6: a real result, not cancelled, billable code."""
    return (~ci_in(numres, codes.NO_RESULT_VALUES)
            & ci_ne(status, codes.CANCEL)
            & ~col_(testcode).isin(codes.EXCLUDED_TESTCODES))


def valid_results(results: DataFrame) -> DataFrame:
    return results.where(valid_result())


def special_client(compname="COMPNAME", testcode="TESTCODE",
                   prefix: str = codes.SPECIAL_CLIENT_PREFIX,
                   code: int = codes.SPECIAL_CLIENT_TESTCODE) -> Column:
    """P8: the special client's samples for one test code."""
    return ci_startswith(compname, prefix) & (col_(testcode) == code)


def is_pending_status(status="S") -> Column:
    return ci_in(status, codes.PENDING_STATUSES)


def month_key_between(start, end, year="year", month="month") -> Column:
    """P13: partition predicate on year/month columns only, exact (no
    superset), so it lands in PartitionFilters."""
    s = _as_date(start)
    e = _as_date(end)
    k = col_(year) * 100 + col_(month)
    return k.between(s.year * 100 + s.month, e.year * 100 + e.month)


def _as_date(v) -> dt.date:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v)[:10])


__all__ = ["ts", "in_window", "window_filter", "billable_client", "billable_clients",
           "valid_result", "valid_results", "special_client", "is_pending_status",
           "month_key_between", "ci"]
