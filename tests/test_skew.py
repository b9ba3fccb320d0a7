"""Hot keys with sort-merge joins and AQE skew splitting forced at test scale:
one folder with a third of all results in distinct orders, and one order with a
third. Results must equal the default plan's, and the join of the result rows on
the folder must be split."""

import contextlib
import datetime as dt
import re
from decimal import Decimal as D

from assaybook.operators import flags
from assaybook.plans import fact as fact_plan
from assaybook.plans import legacy
from conftest import T, make_sources

SKEW_CONFS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def forced(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONFS}
    try:
        for k, v in SKEW_CONFS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _sources(spark, hot_order=True, hot=90):
    results = []
    n = 0
    for folder in range(1, 61):
        for k in range(3):
            n += 1
            results.append((n, folder, f"O{folder}", 300, "5", " x ", "N", "Released",
                            T("1998-03-01") + dt.timedelta(days=k)))
    for k in range(hot):                                  # hot folder, in one order or in many
        n += 1
        results.append((n, 1, "O1" if hot_order else f"H{k}", 300, "5", " x ", "N", "Released",
                        T("1998-01-01") + dt.timedelta(hours=k)))
    results = [(a, b, c, d, "A", "F", e, f, g, h, i) for a, b, c, d, e, f, g, h, i in results]
    folders = [(f, f"E{f}", "GRP1") for f in range(1, 61)]
    samples = [(f, f"E{f}", None, None, None, None, None, None, "C1") for f in range(1, 61)]
    return make_sources(
        spark, results=results, folders=folders, samples=samples,
        clients=[("C1", "Acme", "Clinical", "IN", "X", "1", "PL1")],
        groups=[("GRP1", "N")], tests=[("GRP1", "316", "332")],
        price_lists=[("PL1", 1, T("1990-01-01"), "Released", None)],
        prices=[("PL1", 1, 316, D("10.00")), ("PL1", 1, 300, D("9.00"))], lookup=[])


def test_hot_folder_is_split(spark):
    src = _sources(spark, hot_order=False, hot=3000)
    expected = sorted(tuple(r) for r in fact_plan.build_fact(src, load_ts="2000-01-01").collect())
    with forced(spark):
        df = fact_plan.build_fact(src, load_ts="2000-01-01")
        got = sorted(tuple(r) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert got == expected and len(got) == 3180
    # the inner join on FOLDERNO is the one of the result rows with the folder dimension
    assert re.search(r"SortMergeJoin\(skew=true\) \[FOLDERNO#\d+L\], \[FOLDERNO#\d+L\], Inner", plan), plan


def test_hot_order_is_aggregated_before_the_later_results_rule(spark):
    src = _sources(spark, hot=900)
    report = legacy.legacy_report(src, dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    expected = sorted(tuple(r) for r in report.collect())
    with forced(spark):
        again = legacy.legacy_report(src, dt.date(1998, 1, 1), dt.date(1998, 12, 31))
        assert sorted(tuple(r) for r in again.collect()) == expected and len(expected) == 60
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    rule = re.search(r"Join LeftAnti, \(ORDNO#\d+ = ORDNO#\d+\)", plan)
    grouped = re.search(r"Aggregate \[ORDNO#\d+, ", plan)
    assert rule and grouped and rule.start() < grouped.start(), plan  # the rule stands above the aggregate


def test_latest_result_shuffles_results_by_folder_then_by_order(spark):
    src = _sources(spark, hot_order=False, hot=3000)
    expected = sorted(map(tuple, flags.latest_result(src.results, src.folders).collect()))
    with forced(spark):
        df = flags.latest_result(src.results, src.folders)
        got = sorted(map(tuple, df.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert got == expected and len(got) == 3060
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == ["FOLDERNO", "FOLDERNO", "ORDNO"], plan
    assert re.search(r"SortMergeJoin\(skew=true\) \[FOLDERNO#\d+L\], \[FOLDERNO#\d+L\], LeftSemi", plan), plan
