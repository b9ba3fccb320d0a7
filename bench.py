"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.

Queries: every row with every column goes to the no-op sink, so no payload
from the raw tables (nothing staged, no stored fact); its scratch timings used
4 CPUs, the line "cpus" says how many this run had.
  fact_1998_raw   transform for results entered in 1998
  view_1998_raw   priced view over that transform
  report_1998_raw windowed report over the view
  extract_stage   extract the nine source tables (RESULTS, FOLDERS and
                  CENTRALRECEIVING split into parallel reads on their keys, like
                  the JDBC extract) to staged snappy Parquet;
                  everything below reads the staged tables
  fact_1998       transform for results entered in 1998 (as-of price, flags)
  view_1998       priced view over the stored fact, 1998 rows
  report_1998     windowed report with the special-client anti-join
  report_request  one report request end to end: validate, report, display
                  names, sorted JSON lines written, audit row appended
  fact_publish    full-history transform written partitioned by year/month
  legacy_1998     legacy released-price report
  reconcile_1998  legacy vs new report, full outer join
  client_changes  snapshot diff of the client table (raw tables)
  reload          nightly reload of the last two years of the stored history (seven
                  years here), flags of the older years included
  report_partials the windowed report from monthly partials and the last month's rows
                  aggregated row, 4 CPUs (a session of its own, warmed up again)
Each query is timed once on a warm
included; the warm-up runs generic joins/aggregates, not these plans).
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import time
import traceback
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from assaybook.operators import changes  # noqa: E402
from assaybook.plans import fact as fact_plan  # noqa: E402
from assaybook.plans import jobs, legacy, quality, views  # noqa: E402
from assaybook.plans import report as report_plan  # noqa: E402
from assaybook.session import local_session, work_dir  # noqa: E402
from assaybook.sources import extract, fixtures, partials, store  # noqa: E402
from assaybook.sources.tables import read_staged  # noqa: E402

START, END = dt.date(1998, 1, 1), dt.date(1998, 12, 31)


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def one_row(df, price, day):
    df.agg(F.count("*"), F.sum(price), F.max(day), F.countDistinct("ORDNO")).collect()


def warm_up(spark, sf_dir):
    """Generic JVM warm-up (scan, shuffle and broadcast joins, aggregates, a
    window) on the raw driver tables — none of the benchmarked plans, so each
    query below still pays its own first compile."""
    from pyspark.sql import Window
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    od = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nat = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(F.broadcast(cu.join(nat, cu.c_nationkey == nat.n_nationkey)),
                 od.o_custkey == F.col("c_custkey")))
    consume(j.groupBy("n_name", F.year("l_shipdate").alias("y"))
             .agg(F.sum("l_quantity").alias("q"), F.min("c_name").alias("m"),
                  F.max("l_shipdate").alias("d")))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    consume(od.select("o_custkey", F.lead("o_orderdate").over(w).alias("nx")))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          event_log_dir=os.environ.get("BENCH_EVENTLOG"))
    warm_up(spark, sf_dir)
    run = f"{work_dir(spark)}/assaybook/bench-{uuid.uuid4().hex[:8]}"
    fact_dir, staging_dir = f"{run}/fact", f"{run}/staging"
    timings: dict[str, float] = {}

    errors: dict[str, str] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        try:
            fn()
        except Exception as exc:  # keep going; report the failure in the JSON line
            traceback.print_exc(file=sys.stderr)
            errors[name] = f"{type(exc).__name__}: {exc}"[:300]
            return
        timings[name] = round(time.perf_counter() - t0, 3)

    raw = fixtures.load_cached(spark, sf_dir)
    one_year = dict(start=START, end=END + dt.timedelta(days=1))

    def raw_view():
        return views.priced_view(store.with_partitions(fact_plan.build_fact(raw, **one_year)), raw.lookup)

    timed("fact_1998_raw", lambda: consume(fact_plan.build_fact(raw, **one_year)))
    timed("view_1998_raw", lambda: consume(report_plan.window_rows(raw_view(), START, END)))
    timed("report_1998_raw", lambda: consume(report_plan.report(raw_view(), START, END, "RWP")))

    n_files = 2 * (int(cpus) if cpus.isdigit() else 8)
    timed("extract_stage", lambda: extract.stage_all(extract.extract_all(
        extract.fixture_reader(fixtures.load_cached(spark, sf_dir), split_partitions=n_files)),
        staging_dir))
    src = read_staged(spark, staging_dir)

    timed("fact_1998", lambda: consume(fact_plan.build_fact(src, **one_year)))
    timed("fact_publish", lambda: store.publish(spark, fact_plan.build_fact(src, keep_folder=True), fact_dir))
    timed("reload", lambda: store.reload_window(spark, src, fact_dir, dt.date(1998, 6, 30), partials=True))
    fact = store.read_fact(spark, fact_dir, START, END)
    view = views.priced_view(fact, src.lookup)
    timed("view_1998", lambda: consume(report_plan.window_rows(view, START, END)))
    timed("report_1998", lambda: consume(report_plan.report(view, START, END, "RWP")))
    timed("report_partials", lambda: consume(report_plan.report(views.priced_view(
        partials.window_fact(spark, fact_dir, START, END), src.lookup), START, END, "RWP")))
    timed("report_request", lambda: jobs.report_request(
        spark, fact_dir, staging_dir, START, END, "RWP", "json", f"{run}/report.json",
        f"{run}/audit", user="bench"))
    leg = legacy.legacy_report(src, START, END)
    timed("legacy_1998", lambda: consume(leg))
    timed("reconcile_1998", lambda: consume(quality.reconcile_price(
        leg, report_plan.report(view, START, END, "RWP"))))
    old, new = fixtures.client_snapshots(spark, sf_dir)
    timed("client_changes", lambda: consume(changes.snapshot_diff(old, new, ["RASCLIENTID"], "RASCLIENTS")))

    spark.stop()
    spark = local_session(4, shuffle_partitions=8)
    warm_up(spark, sf_dir)
    raw = fixtures.load(spark, sf_dir)
    timed("agg_fact_1998_4cpu", lambda: one_row(fact_plan.build_fact(raw, **one_year), "Price", "DateEnter"))
    timed("agg_view_1998_4cpu", lambda: one_row(report_plan.window_rows(raw_view(), START, END), "PRICE", "DATEENTER"))
    timed("agg_report_1998_4cpu", lambda: one_row(report_plan.report(raw_view(), START, END, "RWP"), "PRICE", "DATEENTER"))

    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "total_sec", "value": round(sum(timings.values()), 3),
           "unit": "sec", "queries": timings,
           "cpus": cpus, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
