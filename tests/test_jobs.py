import datetime as dt
import json

from assaybook.operators import changes
from assaybook.plans import fact as fact_plan
from assaybook.plans import jobs
from assaybook.sources import audit, extract, store
from conftest import T, make_sources
from test_semantics import (CLIENTS, FOLDERS, GROUPS, LISTS, LOOKUP, PRICES, RESULTS, SAMPLES,
                            TESTS)


def _src(spark):
    return make_sources(spark, results=RESULTS, folders=FOLDERS, samples=SAMPLES, clients=CLIENTS,
                        groups=GROUPS, tests=TESTS, price_lists=LISTS, prices=PRICES, lookup=LOOKUP)


def test_nightly_then_report(spark, tmp_path):
    src = _src(spark)
    read = extract.fixture_reader(src, split_partitions=3)
    staging, fact = str(tmp_path / "staging"), str(tmp_path / "fact")
    jobs.backfill_years(spark, read, staging, fact, [1997])
    n = jobs.nightly_build(spark, read, staging, fact, now=dt.date(1998, 6, 30))
    assert n == 8                                   # prior year (1997: O7) + current year (7 rows)
    years = {r.year for r in store.read_fact(spark, fact).select("year").distinct().collect()}
    assert years == {1997, 1998}
    out, aud = str(tmp_path / "rep"), str(tmp_path / "audit")
    rows = jobs.report_request(spark, fact, staging, "1998-01-01", "1998-12-31", "RWP", "json",
                               out, aud, user="me")
    assert rows == 2
    recs = [json.loads(x) for p in sorted((tmp_path / "rep").glob("part-*")) for x in p.read_text().splitlines()]
    assert [r["ORDNO"] for r in recs] == ["O1", "O2"] and "Test Code" in recs[0]
    month = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m")
    logged = audit.audit_query(audit.read_audit(spark, aud), month).collect()
    assert logged[0].RowCount == 2 and logged[0].Version == "RWP" and logged[0].Action == "view"
    rows = jobs.report_request(spark, fact, staging, "1998-01-01", "1998-12-31", "RWPCFO", "xlsx",
                               str(tmp_path / "tabs"))
    assert rows == 2
    sheets = [p.name for p in (tmp_path / "tabs").glob("tab=*")]
    assert sheets == ["tab=Results With Pricing"]


def test_price_code_rule_legacy(spark):
    src = _src(spark)
    rows = {(x.ORDNO, x.DateEnter): x for x in fact_plan.build_fact(src, price_code_rule="legacy",
                                                                    keep_pricing_code=True).collect()}
    assert rows[("O1", T("1998-03-01"))].PricingCode == 332      # legacy code of the group test
    assert rows[("O1", T("1998-03-01"))].Price is None            # no price row for 332


def test_change_capture_time_and_audit_columns(spark):
    old = spark.createDataFrame([("1", T("2020-01-02 03:04:05"))], "k string, START_DATE timestamp_ntz")
    new = spark.createDataFrame([("1", T("2020-01-02 03:04:06"))], "k string, START_DATE timestamp_ntz")
    r = changes.snapshot_diff(old, new, ["k"], "T", utc_offset_hours=-5,
                              audit={"user": "job", "at": "2024-01-01 00:00:00"}).collect()[0]
    assert "<START_DATE>2020-01-02 03:04:06.000-5:00</START_DATE>" in r.ROW_DATA
    assert (r.DB_USER, r.APP_NAME, r.AUDIT_DT_OFFSET) == ("job", "SQLSERVER", -300)


def test_nightly_pending_flag_sees_older_results(spark, tmp_path):
    # folder 6: released result in 1999, a Draft result in 1997 (before the rolling start)
    results = [r for r in RESULTS if r[1] != 6] + [
        (20, 6, "O6", 300, "A1", "F", "5", " x ", "N", "Released", T("1999-03-01")),
        (21, 6, "O6", 300, "A1", "F", "5", " x ", "N", "Draft", T("1997-03-01"))]
    src = make_sources(spark, results=results, folders=FOLDERS, samples=SAMPLES, clients=CLIENTS,
                       groups=GROUPS, tests=TESTS, price_lists=LISTS, prices=PRICES, lookup=LOOKUP)
    staging, fact = str(tmp_path / "staging"), str(tmp_path / "fact")
    jobs.nightly_build(spark, extract.fixture_reader(src), staging, fact, now=dt.date(1999, 6, 30))
    o6 = [r for r in store.read_fact(spark, fact).collect() if r.ORDNO == "O6"]
    assert len(o6) == 1 and o6[0].HasPendingResults is True


def test_change_capture_origrec_and_sid(spark):
    old = spark.createDataFrame([(7, "1", "a")], "ORIGREC int, k string, v string")
    new = spark.createDataFrame([(7, "1", "b")], "ORIGREC int, k string, v string")
    r = changes.snapshot_diff(old, new, ["k"], "T", audit={"user": "job", "sid": 55}).collect()[0]
    assert (r.ORIGINAL_ORIGREC, r.DB_SID, r.EVENT_TYPE) == (7, 55, "Edit")
