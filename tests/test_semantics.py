"""End-to-end semantics on hand-made rows (FIXTURES.md section C)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from assaybook.plans import fact as fact_plan
from assaybook.plans import legacy, quality, views
from assaybook.plans import report as report_plan
from assaybook.sources import store
from assaybook.sources.gate import EmptyOutputError
from conftest import T, make_sources

A, B = dt.date(1998, 1, 1), dt.date(1998, 12, 31)


def r(orig, folder, ordno, code, numres, status, when, rn3="N"):
    return (orig, folder, ordno, code, "A1", "F", numres, " x ", rn3, status, T(when))


RESULTS = [
    r(1, 1, "O1", 300, "5", "Released", "1998-03-01"),   # group test -> 332 / priced as 316, v1
    r(2, 1, "O1", 300, "6", "Released", "1998-07-01"),   # v2
    r(3, 2, "O2", 300, "5", "Released", "1998-03-01"),   # panel
    r(4, 3, "O3", 315, "5", "Released", "1998-03-01"),   # special client sample
    r(5, 4, "O4", 300, "5", "Released", "1998-03-01"),
    r(6, 4, "O4", 300, "QNS", "Cancel", "1999-02-01"),   # later result, itself invalid
    r(8, 6, "O6", 300, "5", "Released", "1998-03-01"),
    r(9, 6, "O6", 300, "5", "Draft", "1998-03-02"),      # pending folder
    r(10, 5, "O5", 300, "5", "Released", "1998-03-01"),  # excluded company
    r(11, 1, "O7", 300, "5", "Released", "1997-06-01"),  # before first price version
]
FOLDERS = [(1, "E1", "GRP1"), (2, "E2", "Histo Panel"), (3, "E3", None), (4, "E4", "grp1 "),
           (5, "E5", None), (6, "E1", "GRP1")]
SAMPLES = [(i, f"E{i}", T("1960-01-01"), f"CS{i}", T("1998-01-01"), "F", "L", "Blood", c)
           for i, c in [(1, "C1"), (2, "C1"), (3, "C2"), (4, "C1"), (5, "C3")]]
CLIENTS = [("C1", "Acme Labs", "Clinical", "IN", "Indy  ", "46201\n", "PL1"),
           ("C2", "Santa Clara County", "Veterinary", "CA", "SC", "95050", "PL1"),
           ("C3", "ZZZ test", "Clinical", "IN", "Indy", "46201", "PL1")]
GROUPS = [("GRP1", "N"), ("Histo Panel", "Y")]
TESTS = [("GRP1", "316", "332")]
LISTS = [("PL1", 1, T("1998-01-01"), "Retired", None), ("PL1", 2, T("1998-06-01"), "Released", None)]
PRICES = [("PL1", 1, 316, D("10.00")), ("PL1", 2, 316, D("20.00")), ("PL1", 1, 300, D("5.00")),
          ("PL1", 2, 300, D("6.00")), ("PL1", 1, 315, D("7.00")), ("PL1", 2, 315, D("8.00"))]
LOOKUP = [("PanelPricing", "401", "Histo Panel"), ("PanelPricing", "Histo Panel", "150.00")]


@pytest.fixture(scope="module")
def src(spark):
    return make_sources(spark, results=RESULTS, folders=FOLDERS, samples=SAMPLES, clients=CLIENTS,
                        groups=GROUPS, tests=TESTS, price_lists=LISTS, prices=PRICES, lookup=LOOKUP)


@pytest.fixture(scope="module")
def fact_dir(spark, src, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("fact") / "fact")
    store.publish(spark, fact_plan.build_fact(src), d)
    return d


def test_fact_rows(src):
    rows = {(x.ORDNO, x.DateEnter): x for x in fact_plan.build_fact(src).collect()}
    assert ("O5", T("1998-03-01")) not in rows                 # excluded company
    assert ("O4", T("1999-02-01")) not in rows                 # cancelled / QNS result
    o1a, o1b = rows[("O1", T("1998-03-01"))], rows[("O1", T("1998-07-01"))]
    assert (o1a.PriceListVersion, o1a.Price, o1a.ResolvedTestCode) == (1, D("10.00"), 332)
    assert (o1b.PriceListVersion, o1b.Price) == (2, D("20.00"))
    assert o1a.LatestResultDate == T("1998-07-01")
    o4 = rows[("O4", T("1998-03-01"))]
    assert o4.LatestResultDate == T("1999-02-01")              # flag on raw results
    assert o4.ResolvedTestCode == 332                          # 'grp1 ' matches 'GRP1'
    o2 = rows[("O2", T("1998-03-01"))]
    assert o2.IsPanel and o2.PricingMethod == "PANEL"
    assert all(rows[("O6", t)].HasPendingResults for t in (T("1998-03-01"), T("1998-03-02")))
    o7 = rows[("O7", T("1997-06-01"))]
    assert o7.Price is None and o7.PriceListVersion is None    # kept in the fact
    assert len(rows) == 8


def test_view_and_report(spark, src, fact_dir):
    fact = store.read_fact(spark, fact_dir)
    view = views.priced_view(fact, src.lookup)
    in_view = {x.ORDNO for x in view.collect()}
    assert "O6" not in in_view and "O7" not in in_view          # pending, unpriced
    panel = [x for x in view.collect() if x.ORDNO == "O2"][0]
    assert (panel.TESTCODE, panel.PRICE) == (401, D("150.00"))
    rep = {x.ORDNO: x for x in report_plan.report(view, A, B).collect()}
    assert set(rep) == {"O1", "O2"}                            # O3 special, O4 later result
    assert (rep["O1"].PRICE, rep["O1"].DATEENTER, rep["O1"].TESTCODE) == (D("10.00"), T("1998-07-01"), 332)
    assert (rep["O1"].RN2, rep["O1"].CITY, rep["O1"].ZIP) == ("x", "Indy", "46201")
    cfo = report_plan.report(views.priced_view(fact, src.lookup, pii=False), A, B, "RWPCFO")
    quality.assert_no_pii(cfo)
    with pytest.raises(AssertionError):
        quality.assert_no_pii(view)


def test_view_does_not_shuffle_the_fact_by_panel(spark, src, fact_dir):
    from assaybook.sources import fixtures
    lookup = fixtures.lookup(spark, "")
    assert [tuple(r) for r in lookup.collect()] == fixtures.LOOKUP_ROWS
    view = views.priced_view(store.read_fact(spark, fact_dir), lookup)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan, plan


def test_latest_date_joins_the_results_before_they_are_wide(src):
    plan = fact_plan.build_fact(src)._jdf.queryExecution().optimizedPlan().toString()
    order, folder = plan.index("Join LeftOuter, (ORDNO#"), plan.index("Join Inner, (FOLDERNO#")
    assert folder < order, plan  # the order's join lies below


def test_report_uses_partition_filters(spark, src, fact_dir):
    view = views.priced_view(store.read_fact(spark, fact_dir), src.lookup)
    plan = report_plan.report(view, A, B)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters" in plan


def test_legacy_report(spark, src):
    rep = {x.ORDNO: x for x in legacy.legacy_report(src, A, B).collect()}
    assert set(rep) == {"O1", "O2"}
    assert rep["O1"].PRICE == D("20.00")                       # only the released version
    assert (rep["O2"].TESTCODE, rep["O2"].PRICE) == (401, D("150.00"))
    assert rep["O1"].CANCEL_STATUS == " "
    assert "BIRTH_DATE" not in legacy.legacy_report(src, A, B, pii=False).columns


def test_reconcile(spark, src, fact_dir):
    view = views.priced_view(store.read_fact(spark, fact_dir), src.lookup)
    new = report_plan.report(view, A, B)
    old = legacy.legacy_report(src, A, B)
    diff = {x.ORDNO: (x.STATUS, x.PRICE_DIFF) for x in quality.reconcile_price(old, new).collect()}
    assert diff == {"O1": ("diff", D("10.00"))}
    cols = quality.reconcile_columns(old, new).collect()
    assert cols == []                                          # ' ' equals '' for cancel status
    counts = quality.reconcile_counts(old, new, view, A, B).collect()[0]
    assert (counts.OLD_ROWS, counts.NEW_ROWS) == (2, 2)


def test_reload_clears_empty_month_and_keeps_other_years(spark, src, tmp_path):
    d = str(tmp_path / "fact")
    store.publish(spark, fact_plan.build_fact(src), d)
    before = {(x.year, x.month) for x in store.read_fact(spark, d).select("year", "month").distinct().collect()}
    assert (1998, 7) in before and (1997, 6) in before
    # the July result disappears from the source; reload 1998 + 1999
    src2 = make_sources(spark, results=[x for x in RESULTS if x[0] != 2], folders=FOLDERS,
                        samples=SAMPLES, clients=CLIENTS, groups=GROUPS, tests=TESTS,
                        price_lists=LISTS, prices=PRICES, lookup=LOOKUP)
    store.reload_window(spark, src2, d, dt.date(1999, 6, 30))
    after = {(x.year, x.month) for x in store.read_fact(spark, d).select("year", "month").distinct().collect()}
    assert (1998, 7) not in after and (1997, 6) in after and (1998, 3) in after


def test_empty_output_leaves_table(spark, src, tmp_path):
    d = str(tmp_path / "fact")
    store.publish(spark, fact_plan.build_fact(src), d)
    n = store.read_fact(spark, d).count()
    with pytest.raises(EmptyOutputError):
        store.publish(spark, fact_plan.build_fact(src).where(F.lit(False)), d)
    assert store.read_fact(spark, d).count() == n


def test_backfill_years(spark, src, tmp_path):
    d = str(tmp_path / "fact")
    store.backfill(spark, src, d, [1997])
    got = {x.year for x in store.read_fact(spark, d).select("year").distinct().collect()}
    assert got == {1997}


def test_quality_listings(spark, src, fact_dir):
    fact = store.read_fact(spark, fact_dir)
    assert quality.unpriced_results(fact, A, B).count() == 0
    assert {x.ORDNO for x in quality.unpriced_results(fact, dt.date(1997, 1, 1), B).collect()} == {"O7"}
    multi = {x.ORDNO: x.ResultCount for x in quality.multi_row_orders(fact, A, B).collect()}
    assert multi == {"O1": 2, "O6": 2}
    pc = quality.pending_counts(fact, src.lookup).collect()[0]
    assert (pc.PendingInFact, pc.TotalInFact) == (2, 8) and pc.RowsInView <= pc.TotalInFact
    b = {x.ORDNO for x in quality.boundary_results(fact, src.price_lists, dt.date(1990, 1, 1)).collect()}
    assert b == set()
    vc = quality.version_changes(src.price_lists, dt.date(1998, 5, 1), B).collect()
    assert [(x.PRICELISTID, x.PRICELISTVERSION) for x in vc] == [("PL1", 2)]


def test_reload_rerun_is_idempotent(spark, src, tmp_path):
    d = str(tmp_path / "fact")
    store.publish(spark, fact_plan.build_fact(src), d)

    def snapshot():
        return sorted(tuple(r) for r in store.read_fact(spark, d).drop("ETL_LoadDate").collect())

    store.reload_window(spark, src, d, dt.date(1998, 6, 30))
    first = snapshot()
    store.reload_window(spark, src, d, dt.date(1998, 6, 30))
    assert snapshot() == first
    full = sorted(tuple(r) for r in store.with_partitions(fact_plan.build_fact(src))
                  .drop("ETL_LoadDate").collect())
    assert first == full                      # reload of 1997-1998 leaves the same table
