"""Monthly partials: the same report, with rows read at the window's ends only."""

import datetime as dt
import random
import re

import pytest

from assaybook.plans import report as report_plan
from assaybook.plans import views
from assaybook.sources import partials, store
from conftest import T, make_sources
from test_semantics import CLIENTS, FOLDERS, GROUPS, LISTS, PRICES, SAMPLES, TESTS
from test_store import _build

DAYS = [dt.datetime(1997, 11, 1) + dt.timedelta(hours=7 * i) for i in range(1400)]
LOOKUP = [("PanelPricing", "401", "Histo Panel"), ("PanelPricing", "Histo Panel", "150.00")]


def _src(spark, lookup=LOOKUP):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        folder = rng.choice([1, 2, 3, 4, 6])
        day = rng.choice(DAYS)
        if rng.random() < 0.1:
            day = dt.datetime(day.year, day.month, 1)  # midnight at the start of a month
        rows.append((i, folder, f"O{folder}-{rng.randrange(60)}", rng.choice([300, 315, 316, 999]), rng.choice("AB"),
                     rng.choice("FGH"), rng.choice(["5", "6"]), rng.choice([" x ", "y", None]), "N", "Released", day))
    rows.append((9000, 6, "P", 300, "A", "F", "5", "x", "N", "Draft", T("1998-05-05")))  # folder 6 is pending
    return make_sources(spark, results=rows, folders=FOLDERS, samples=SAMPLES, clients=CLIENTS, groups=GROUPS,
                        tests=TESTS, price_lists=LISTS, prices=PRICES, lookup=lookup)


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("partials") / "fact")
    src = _src(spark)
    store.publish(spark, _build(src), d, partials=True, lookup=src.lookup)
    return d, src


def _report(fact_rows, lookup, start, end, kind="RWP"):
    view = views.priced_view(fact_rows, lookup, pii=kind == "RWP")
    return sorted((tuple(r) for r in report_plan.report(view, start, end, kind).collect()), key=repr)


@pytest.mark.parametrize("start, end", [
    ("1998-01-01", "1998-12-31"), ("1998-01-01", "1999-01-01"), ("1998-01-15", "1998-06-10"), ("1998-03-02", "1998-03-20"),
    ("1998-03-01", "1998-03-01"), ("1997-11-01", "1998-10-31"), ("1998-02-28", "1998-03-31"), ("1990-01-01", "1990-12-31")])
def test_partials_give_the_report(spark, fact, start, end):
    d, src = fact
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    for kind in ("RWP", "RWPCFO"):
        want = _report(store.read_fact(spark, d, a, b), src.lookup, start, end, kind)
        assert _report(partials.window_fact(spark, d, a, b), src.lookup, start, end, kind) == want
    assert want or a.year < 1997 or a == b


def test_rows_are_read_in_the_edge_months_only(spark, fact):
    d, src = fact
    rows = partials.window_fact(spark, d, dt.date(1998, 1, 15), dt.date(1998, 12, 31))
    read = {f: re.search(r"/year=(\d+)/month=(\d+)/", f).groups() for f in rows.inputFiles()}
    assert {m for f, m in read.items() if partials.FOLDER not in f} == {("1998", "1"), ("1998", "12")}
    assert {m for f, m in read.items() if partials.FOLDER in f} == {("1998", str(m)) for m in range(2, 12)}
    stored = store.read_fact(spark, d, dt.date(1998, 1, 1), dt.date(1998, 12, 31)).count()
    assert rows.count() < stored


def test_prices_of_panels_come_from_the_lookup_of_the_day(spark, fact):
    d, src = fact
    other = make_sources(spark, lookup=[("PanelPricing", "402", "histo panel "), ("PanelPricing", "HISTO PANEL", "9.50")]).lookup
    a, b = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
    want = _report(store.read_fact(spark, d, a, b), other, a, b)
    assert _report(partials.window_fact(spark, d, a, b), other, a, b) == want
    assert want != _report(store.read_fact(spark, d, a, b), src.lookup, a, b)
    none = make_sources(spark).lookup
    assert _report(partials.window_fact(spark, d, a, b), none, a, b) == _report(store.read_fact(spark, d, a, b), none, a, b)


def test_partials_are_merged_and_written_with_one_shuffle(spark, fact):
    d, _ = fact
    merged = partials.monthly_partials(store.read_fact(spark, d, internal=True)).sortWithinPartitions("year", "month")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange \w+\((\w+)#", plan) == ["year"], plan
    rows = merged.collect()
    keys = {(r.year, r.month, r.ORDNO, r.LatestResultDate, r.IsPanel, r.COMPNAME.lower(), r.ExternalId.lower(),
             r.TestGroupName.lower() if r.IsPanel else None) for r in rows}
    assert len(keys) == len(rows) > 0


def test_a_run_without_partials_is_read_row_by_row(spark, fact, tmp_path):
    _, src = fact
    d = str(tmp_path / "fact")
    store.publish(spark, _build(src), d)
    a, b = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
    assert _report(partials.window_fact(spark, d, a, b), src.lookup, a, b) == _report(
        store.read_fact(spark, d, a, b), src.lookup, a, b)
    with pytest.raises(FileNotFoundError):
        partials.window_fact(spark, str(tmp_path / "none"), a, b)


def test_whole_months():
    d = dt.date
    assert partials.whole_months(d(1998, 1, 1), d(1998, 1, 31)) == []   # results later on the 31st are not in the window
    assert partials.whole_months(d(1998, 1, 1), d(1998, 2, 1)) == [(1998, 1)]
    assert partials.whole_months(d(1997, 11, 2), d(1998, 2, 28)) == [(1997, 12), (1998, 1)]
