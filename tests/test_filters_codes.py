import datetime as dt

import pytest
from pyspark.sql import functions as F

from assaybook.functions import codes
from assaybook.operators.filters import (billable_clients, in_window, month_key_between,
                                         valid_results)
from assaybook.plans.report import validate_request
from conftest import T


def test_closed_window_keeps_end_midnight_only(spark):
    df = spark.createDataFrame([(T("1998-01-31 00:00:00"),), (T("1998-01-31 00:01:00"),),
                                (T("1998-01-01 00:00:00"),), (T("1997-12-31 23:59:59"),)],
                               "d timestamp_ntz")
    got = sorted(r.d for r in df.where(in_window("d", "1998-01-01", "1998-01-31")).collect())
    assert got == [T("1998-01-01"), T("1998-01-31")]


def test_billable_clients_collation_and_nulls(spark):
    rows = [("1", "zzz x", "Clinical"), ("2", "ZZZ x", "Clinical"), ("3", "Research Only ", "Clinical"),
            ("4", "GREATER THAN ", "Clinical"), ("5", "Acme", "Internal "), ("6", "Acme", None),
            ("7", None, "Clinical"), ("8", "Acme", "Clinical"), ("9", "research only lab", "X"),
            ("10", "Test RightFax 2", "Clinical")]
    df = spark.createDataFrame([(r[0], r[1], r[2], "", "", "", "PL1") for r in rows],
                               "RASCLIENTID string, COMPNAME string, CATEGORY string, STATE string, CITY string, ZIP string, PRICELISTID string")
    assert [r.RASCLIENTID for r in billable_clients(df).collect()] == ["8"]


def test_valid_results_rules(spark):
    base = (1, 1, "1", 300, "A", "F", "5", " O ", "N", "Released", T("1998-01-01"))
    rows = [base,
            base[:6] + ("qns",) + base[7:],          # no result (case-insensitive)
            base[:6] + (None,) + base[7:],           # NULL NUMRES drops
            base[:9] + ("CANCEL",) + base[10:],      # cancelled
            base[:9] + (None,) + base[10:],          # NULL status drops
            base[:3] + (432,) + base[4:]]            # excluded code
    from assaybook import schemas
    df = spark.createDataFrame(rows, schemas.RESULTS)
    assert valid_results(df).count() == 1


def test_month_key_is_exact_range():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(1997, 12), (1998, 1), (1998, 12), (1999, 1)], "year int, month int")
    got = df.where(month_key_between("1997-12-15", "1998-12-31")).collect()
    assert [(r.year, r.month) for r in got] == [(1997, 12), (1998, 1), (1998, 12)]


def test_remap_all_pairs_and_passthrough(spark):
    codes_in = [a for a, _ in codes.REMAP_PAIRS] + [315, 999]
    df = spark.createDataFrame([(c,) for c in codes_in], "c int")
    got = dict((r.c, r.m) for r in df.select("c", codes.remap_code("c").alias("m")).collect())
    assert got == {**dict(codes.REMAP_PAIRS), 315: 315, 999: 999}


def test_resolved_and_pricing_code(spark):
    df = spark.createDataFrame([
        (318, None, None, None),        # no test -> remapped source code
        (318, "GRP0", "", "331"),       # blank test code -> remapped source code
        (318, "GRP0", "  ", "331"),     # blanks only -> same
        (318, "GRP1", "316", "332"),    # test with codes -> legacy code / test code
    ], "src int, tno string, tc string, leg string")
    got = [(r.res, r.pc) for r in df.select(
        codes.resolved_testcode("src", "tno", "tc", "leg").alias("res"),
        codes.pricing_code("src", "tno", "tc").alias("pc")).collect()]
    assert got == [(316, 318), (316, 318), (316, 318), (332, 316)]


def test_numeric_guards(spark):
    df = spark.createDataFrame([("",), (" 401 ",), ("abc",), ("1e3",), ("150.555",), (None,)], "t string")
    got = [(r.i, r.p) for r in df.select(codes.parse_int("t").alias("i"),
                                         codes.parse_price("t").alias("p")).collect()]
    from decimal import Decimal as D
    assert got == [(None, None), (401, D("401.00")), (None, None), (None, None),
                   (None, D("150.56")), (None, None)]


def test_cancel_status(spark):
    df = spark.createDataFrame([("Released", "C"), ("Released", "N"), ("cancel", "N"), (None, None)],
                               "s string, rn3 string")
    got = [r.c for r in df.select(codes.cancel_status("s", "rn3").alias("c")).collect()]
    assert got == ["Cancel", "", "Cancel", ""]


def test_request_validation():
    assert validate_request("1998-01-01", "1999-01-02")[0] == dt.date(1998, 1, 1)   # 366 days
    with pytest.raises(ValueError):
        validate_request("1998-01-01", "1999-01-03")                                   # 367 days
    with pytest.raises(ValueError):
        validate_request("1998-02-01", "1998-01-01")
    with pytest.raises(ValueError):
        validate_request("1998-01-01", None)
    with pytest.raises(ValueError):
        validate_request("1998/01/01", "1998-01-02")
    with pytest.raises(ValueError):
        validate_request("1998-01-01", "1998-01-02", "XYZ")
    with pytest.raises(ValueError):
        validate_request("1998-01-01", "1998-01-02", "RWP", "pdf")
    assert validate_request("1998-01-01", "1998-01-02", "rwpcfo", "CSV")[2:] == ("RWPCFO", "csv")
