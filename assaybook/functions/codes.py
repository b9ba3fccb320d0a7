"""Test-code rules, status rules and guarded numeric parsing."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaybook.functions.text import ci, ci_eq, col_

# Fixed values that must equal the source system's (from the legacy report).
# Source test code -> billing test code, applied when no usable group test exists.
REMAP_PAIRS = [
    (318, 316), (457, 331), (465, 402), (459, 332), (460, 315), (461, 316),
    (462, 320), (463, 321), (467, 403), (469, 404), (466, 405), (468, 406),
]
# Test codes never billed, result values meaning "no result",
# pending result statuses, and companies never billed.
EXCLUDED_TESTCODES = [432, 429, 443, 440]
NO_RESULT_VALUES = ["QNS", "C", "U"]
PENDING_STATUSES = ["Logged", "Draft"]
EXCLUDED_COMPANIES = [
    "Test RightFax 2", "Test RightFax 1", "Test RightFax 4", "ACCL0933",
    "RESEARCH ONLY", "MiraVista Quality System", "Greater Than",
    "Additional Positive Unconfirmed",
]
EXCLUDED_COMPANY_PREFIXES = ["zzz", "RESEARCH ONLY"]
INTERNAL_CATEGORY = "Internal"
CANCEL = "Cancel"
SPECIAL_CLIENT_PREFIX = "Santa Clara"
SPECIAL_CLIENT_TESTCODE = 315

_INT_TEXT = r"^\s*[-+]?\d+\s*$"
_DEC_TEXT = r"^\s*[-+]?\d+(\.\d+)?\s*$"


def remap_code(code: str | Column) -> Column:
    """Apply the 12-pair remap; unmapped codes pass through."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(REMAP_PAIRS)])
    c = col_(code)
    return F.coalesce(m[c], c).cast("int")


def parse_int(text: str | Column) -> Column:
    t = col_(text)
    return F.when(t.rlike(_INT_TEXT), F.trim(t).try_cast("int"))


def parse_price(text: str | Column) -> Column:
    """TRY_CAST(text AS DECIMAL(8,2)) restricted to plain decimal text."""
    t = col_(text)
    return F.when(t.rlike(_DEC_TEXT), F.trim(t).try_cast("decimal(8,2)"))


def is_int_text(text: str | Column) -> Column:
    return F.coalesce(col_(text).rlike(_INT_TEXT), F.lit(False))


def is_price_text(text: str | Column) -> Column:
    return parse_price(text).isNotNull()


def no_usable_group_test(testno: str | Column, group_testcode: str | Column) -> Column:
    """``t.TESTNO IS NULL OR t.TESTCODE = ''`` (blank-insensitive)."""
    return col_(testno).isNull() | F.coalesce(F.rtrim(col_(group_testcode)) == "",
                                              F.lit(False))


def resolved_testcode(source_code, testno, group_testcode, legacy_testcode) -> Column:
    """Billing code of one result: remapped source code when the folder's test
    group has no usable test, else the group's legacy code."""
    return F.when(no_usable_group_test(testno, group_testcode),
                  remap_code(source_code)).otherwise(parse_int(legacy_testcode))


def pricing_code(source_code, testno, group_testcode, legacy_testcode=None,
                 rule: str = "test") -> Column:
    """Code used to look up the price: the source code when the group has no
    usable test, else the group's test code (``rule='test'``, the legacy
    report's form) or its legacy code (``rule='legacy'``)."""
    group_code = legacy_testcode if rule == "legacy" and legacy_testcode is not None else group_testcode
    return F.when(no_usable_group_test(testno, group_testcode),
                  col_(source_code).cast("int")).otherwise(parse_int(group_code))


def cancel_status(status: str | Column, rn3: str | Column, blank: str = "") -> Column:
    """'Cancel' for cancelled status or RN3 = 'C', else ``blank``."""
    return (F.when(ci_eq(status, CANCEL), F.lit(CANCEL))
            .when(ci_eq(rn3, "C"), F.lit(CANCEL))
            .otherwise(F.lit(blank)))


def is_panel(group_name: str | Column, testpanel: str | Column | None = None,
             rule: str = "either") -> Column:
    """Panel detection: 'name' (name contains 'panel'), 'flag' (TESTPANEL='Y')
    or 'either'."""
    by_name = F.coalesce(F.lower(col_(group_name)).contains("panel"), F.lit(False))
    if testpanel is None or rule == "name":
        return by_name
    by_flag = F.coalesce(ci(testpanel) == "y", F.lit(False))
    return by_flag if rule == "flag" else (by_flag | by_name)
