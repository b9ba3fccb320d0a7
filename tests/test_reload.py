"""Reload of the rolling window: only the years with stale flags are read; the publish gate."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from assaybook.plans import fact as fact_plan
from assaybook.plans import quality
from assaybook.sources import fact_index, store
from assaybook.sources.gate import EmptyOutputError, Gate, GateError, Watch
from conftest import T
from test_store import _build, _rows, _src

YEARS = range(1990, 2001)


def _result(n, order, folder, day, status="Released"):
    return (n, folder, order, 300, "A1", "F", "5", " x ", "N", status, T(day))


def _history():
    """A result a year in each of two folders; every order stays in its year."""
    return [_result(10 * y + f, f"O{y}-{f}", f, f"{y}-03-0{f}") for y in YEARS for f in (1, 2, 3)]


def _wide_years(df):
    """Years of the fact files (all columns) that the plan of ``df`` reads."""
    return {int(m) for f in df.inputFiles() if store.fact_index.FOLDER not in f for m in re.findall(r"/year=(\d+)/", f)}


@pytest.fixture
def watched(monkeypatch):
    """Years whose fact files are read by what is published."""
    seen, real = [], store._write_partitioned

    def write(df, *a, **k):
        seen.append(_wide_years(df))
        return real(df, *a, **k)
    monkeypatch.setattr(store, "_write_partitioned", write)
    return seen


def _reload(spark, d, rows, **k):
    store.reload_window(spark, _src(spark, rows), d, dt.date(2000, 6, 30), grace_s=0, **k)


def _want(spark, rows, d):
    want = _build(_src(spark, rows)).drop("ETL_LoadDate", "FolderNo")
    return sorted(map(tuple, store.with_partitions(want).collect())) == _rows(spark, d)


@pytest.mark.parametrize("indexed", [True, False])
def test_changes_in_one_older_year_read_that_years_files_only(spark, tmp_path, watched, indexed):
    d = str(tmp_path / "fact")
    old = _history()
    store.publish(spark, _build(_src(spark, old)), d, index=indexed)
    before = store.current_years(spark, d)
    watched.clear()
    later = [*old, _result(900, "O1994-2", 2, "2000-05-01")]  # an old order's new result
    _reload(spark, d, later)
    assert watched == [{1994}] and _want(spark, later, d)
    now = store.current_years(spark, d)
    assert {y for y in now if now[y] != before[y]} == {1994, 1999, 2000}
    watched.clear()
    _reload(spark, d, later)  # nothing is stale any more
    assert watched == [set()] and _want(spark, later, d)


def test_folders_become_pending_and_final_again(spark, tmp_path, watched):
    d = str(tmp_path / "fact")
    old = [r for r in _history() if r[1] != 3] + [_result(30 + y, f"P{y}", 3, f"{y}-04-01") for y in (1991, 1996)]
    store.publish(spark, _build(_src(spark, old)), d)
    watched.clear()
    pending = [*old, _result(901, "NEW", 3, "2000-02-01", "Draft")]
    _reload(spark, d, pending)
    assert watched == [{1991, 1996}] and _want(spark, pending, d)
    watched.clear()
    final = [*old, _result(901, "NEW", 3, "2000-02-01")]
    _reload(spark, d, final)
    assert watched == [{1991, 1996}] and _want(spark, final, d)


def test_a_reload_that_stops_leaves_no_keys_behind(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "fact")
    store.publish(spark, _build(_src(spark, _history())), d)
    before = _rows(spark, d)

    def lost(*a, **k):
        raise OSError("lost")
    monkeypatch.setattr(fact_index, "write_index", lost)
    with pytest.raises(OSError):
        _reload(spark, d, [*_history(), _result(900, "O1994-2", 2, "2000-05-01")])
    assert _rows(spark, d) == before
    assert not list((tmp_path / "fact").glob("run-keys-*")) and len(list((tmp_path / "fact").glob("run-*"))) == 1


def test_index_holds_a_row_per_order_and_folder(spark, tmp_path):
    d = str(tmp_path / "fact")
    store.publish(spark, _build(_src(spark, _history() * 3)), d)
    years = store.current_years(spark, d)
    for kind, key in (("orders", "ORDNO"), ("folders", "FolderNo")):
        got = fact_index.read_index(spark, d, kind, years, None)
        want = store.read_fact(spark, d, internal=True).select(*fact_index.KINDS[kind], "year").distinct()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.groupBy(key, "year").count().where("count > 1").isEmpty()


def test_index_takes_one_shuffle(spark):
    rows = store.with_partitions(_build(_src(spark, _history()))).localCheckpoint()
    for kind in fact_index.KINDS:
        plan = fact_index.index_rows(rows, kind)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan


@pytest.mark.parametrize("indexed", [True, False])
def test_latest_dates_are_found_once_a_reload(spark, tmp_path, monkeypatch, indexed):
    d, calls, real = str(tmp_path / "fact"), [], store.flags.latest_result
    store.publish(spark, _build(_src(spark, _history())), d, index=indexed)
    monkeypatch.setattr(store.flags, "latest_result", lambda *a: calls.append(a) or real(*a))
    later = [*_history(), _result(900, "O1994-2", 2, "2000-05-01")]
    _reload(spark, d, later)
    assert len(calls) == 1 and _want(spark, later, d)
    assert not list((tmp_path / "fact").glob("run-keys-*"))


def test_refresh_moves_the_wide_rows_once(spark):
    rows = spark.createDataFrame(
        [(1998, 1, "A", False, T("1998-01-01"), "x"), (1998, 1, None, False, None, "x"), (1998, None, "B", False, T("1998-01-02"), "x"),
         (1998, 2, "C", True, T("1998-01-03"), "x"), (1999, 1, "A", False, T("1999-01-01"), "x")],
        "year int, FolderNo long, ORDNO string, HasPendingResults boolean, LatestResultDate timestamp_ntz, Wide string").localCheckpoint()
    folders = spark.createDataFrame([(1998, 1, True), (1998, 2, False)], "year int, FolderNo long, _p boolean")
    orders = spark.createDataFrame([(1998, "B", T("2000-01-01")), (1998, "A", T("2000-02-01"))], "year int, ORDNO string, _l timestamp_ntz")
    pairs = fact_index.stale_pairs(rows, orders, folders).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fact_index.refreshed(rows, pairs)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 2, plan   # the rows, and the pairs
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        (1998, 1, "A", True, T("2000-02-01"), "x"), (1998, 1, None, True, None, "x"), (1998, None, "B", False, T("2000-01-01"), "x"),
        (1998, 2, "C", False, T("1998-01-03"), "x"), (1999, 1, "A", False, T("1999-01-01"), "x")], key=repr)


def test_a_window_takes_its_folders_only(spark, monkeypatch):
    seen, real = [], fact_plan.folder_dimension
    monkeypatch.setattr(fact_plan, "folder_dimension", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    rows = [*_history(), _result(900, "N", 1, "2000-05-01")]
    rows = [r for r in rows if r[1] != 2 or r[-1].year < 2000]
    src = _src(spark, rows)
    whole = fact_plan.build_fact(src, load_ts="2000-01-01")
    part = fact_plan.build_fact(src, start=dt.date(2000, 1, 1), load_ts="2000-01-01")
    folders = [{r.FOLDERNO for r in d.select("FOLDERNO").collect()} for d in seen]
    assert folders[1] == {1, 3} < folders[0]
    assert sorted(map(tuple, part.collect())) == sorted(tuple(r) for r in whole.collect() if r.DateEnter.year == 2000)


# ---------------------------------------------------------------- gate
def test_gate_counts_what_the_view_would_have(spark, tmp_path):
    src = _src(spark)
    watch = Watch(src.lookup)
    out = watch.observe(store.with_partitions(_build(src)))
    assert out.columns == store.with_partitions(_build(src)).columns
    n = len(out.collect())
    m, want = watch.metrics(), quality.pending_counts(_build(src), src.lookup).first()
    assert (m.rows, m.pending, m.view_rows) == (n, want.PendingInFact, want.RowsInView)
    assert m.unpriced == _build(src).where("Price is null and not IsPanel").count()


@pytest.mark.parametrize("rule", ["empty", "unpriced", "fan-out"])
def test_a_broken_rule_leaves_the_old_fact(spark, tmp_path, rule):
    d, src = str(tmp_path / "fact"), _src(spark)
    store.publish(spark, _build(src), d, lookup=src.lookup)
    before, live = _rows(spark, d), store.current_years(spark, d)
    df, lookup, gate, error = _build(src), src.lookup, None, GateError
    if rule == "empty":
        df, error = _build(_src(spark, [])), EmptyOutputError
    elif rule == "unpriced":
        df, gate = df.withColumn("Price", F.lit(None).cast("decimal(8,2)")), Gate(max_unpriced=0.2)
    else:  # every panel has three codes: the view would multiply its rows
        df = df.withColumns({"IsPanel": F.lit(True), "TestGroupName": F.lit("Histo Panel"),
                             "HasPendingResults": F.lit(False)})
        lookup = lookup.limit(0).unionByName(spark.createDataFrame(
            [("PanelPricing", "Histo Panel", "9.00"), *[("PanelPricing", str(c), "Histo Panel") for c in (1, 2, 3)]],
            lookup.schema))
    with pytest.raises(error):
        store.publish(spark, df, d, lookup=lookup, gate=gate)
    assert _rows(spark, d) == before and store.current_years(spark, d) == live
    assert len(list((tmp_path / "fact").glob("run-*"))) == 1
    assert store.publish(spark, _build(src), d, lookup=src.lookup, gate=Gate(max_unpriced=1.0)) == len(before)


def test_the_gate_scans_nothing_again(spark, tmp_path):
    """All figures come from the plan that writes the rows."""
    src = _src(spark)
    out = Watch(src.lookup).observe(_build(src))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("CollectMetrics") == 1

