from decimal import Decimal as D

from pyspark.sql import functions as F

from assaybook.operators import asof
from conftest import T


def _lists(spark, rows):
    return spark.createDataFrame(rows, "PRICELISTID string, PRICELISTVERSION int, STARTDDATE timestamp_ntz, STATUS string, EXPDATE timestamp_ntz")


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id int, PRICELISTID string, DATEENTER timestamp_ntz, code int")


LISTS = [
    ("PL1", 1, T("2020-01-01"), "Retired", None),
    ("PL1", 2, T("2021-01-01"), "Retired", None),
    ("PL1", 3, T("2022-01-01"), "Released", None),
    ("PL1", 4, T("2022-01-01"), "Released", None),   # same start: higher wins
    ("PL1", 9, None, "Released", None),               # never matches
    ("PL2", 1, T("2021-06-01"), "Released", None),
]
ROWS = [
    (1, "PL1", T("2021-01-01 00:00:00"), 300),   # exactly at start -> v2
    (2, "PL1", T("2020-12-31 23:59:59"), 300),   # one second before -> v1
    (3, "PL1", T("2023-05-05"), 300),            # tie at 2022 -> v4
    (4, "PL1", T("2019-01-01"), 300),            # before first start -> none
    (5, "pl1  ", T("2021-03-03"), 300),          # case/blank-insensitive key -> v2
    (6, "PL2", T("2021-05-31"), 300),            # before list start -> none
    (7, "PL3", T("2021-05-31"), 300),            # unknown list -> none
    (8, None, T("2021-05-31"), 300),             # no list -> none
]
EXPECT = {1: 2, 2: 1, 3: 4, 4: None, 5: 2, 6: None, 7: None, 8: None}


def _versions(df):
    return {r["id"]: r["PriceListVersion"] for r in df.collect()}


def test_asof_version(spark):
    out = asof.asof_version(_rows(spark, ROWS), _lists(spark, LISTS))
    assert _versions(out) == EXPECT
    assert out.count() == len(ROWS)   # at most one match per row


def test_asof_version_without_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = asof.asof_version(_rows(spark, ROWS), _lists(spark, LISTS))
        assert _versions(out) == EXPECT
        assert out.count() == len(ROWS)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_asof_price_and_per_test(spark):
    prices = spark.createDataFrame([
        ("PL1", 2, 300, D("10.00")), ("PL1", 4, 300, D("40.00")), ("PL1", 3, 301, D("30.00")),
    ], "PRICELISTID string, PRICELISTVERSION int, TESTCODE int, PRICE decimal(8,2)")
    rows = _rows(spark, [(1, "PL1", T("2021-02-01"), 300), (2, "PL1", T("2023-01-01"), 301),
                         (3, "PL1", T("2023-01-01"), 300)])
    got = {r["id"]: (r["PriceListVersion"], r["Price"]) for r in
           asof.asof_price(rows, _lists(spark, LISTS), prices, code_col="code").collect()}
    # list-level version: 2023 -> v4, which has no price for code 301
    assert got == {1: (2, D("10.00")), 2: (4, None), 3: (4, D("40.00"))}
    per_test = {r["id"]: (r["PriceListVersion"], r["Price"]) for r in
                asof.asof_price(rows, _lists(spark, LISTS), prices, code_col="code",
                                per_test=True).collect()}
    assert per_test == {1: (2, D("10.00")), 2: (3, D("30.00")), 3: (4, D("40.00"))}


def test_intervals_drop_null_start_and_tie(spark):
    iv = asof.price_intervals(_lists(spark, LISTS)).where(F.col("_list_key") == "pl1")
    got = sorted((r["PRICELISTVERSION"], r["_from"], r["_until"]) for r in iv.collect())
    assert [g[0] for g in got] == [1, 2, 3, 4]
    v3 = [g for g in got if g[0] == 3][0]
    assert v3[1] == v3[2]          # empty interval for the lower tied version
