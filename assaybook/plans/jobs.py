"""Top-level jobs: the nightly build (E1), the backfill (E4) and one report
request (E2). Each is a few Spark jobs composed from the plans; nothing is
collected except row counts."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from assaybook.plans import report as report_plan
from assaybook.plans import views
from assaybook.sources import audit, extract, partials, sinks, store
from assaybook.sources.tables import read_staged, read_table

log = logging.getLogger("assaybook.jobs")


def nightly_build(spark: SparkSession, read: extract.Reader, staging_dir: str, fact_dir: str,
                  now: dt.date | None = None, audit_dir: str | None = None, **fact_opts) -> int:
    """Extract (RESULTS from Jan 1 of the prior year, other tables whole, plus
    the pending-status rows of all history), stage, then rebuild the prior
    and current year of the fact. Latest-result needs no older rows: an
    order's later results are always inside the window. The audit table's
    single files are folded afterwards, which never fails the build."""
    now = now or dt.datetime.now(dt.timezone.utc).date()
    src, pending = _stage_with_pending(spark, read, staging_dir, store.rolling_start(now))
    rows = store.reload_window(spark, src, fact_dir, now, pending_results=pending, partials=True, **fact_opts)
    if audit_dir:
        try:
            audit.audit_compact_all(spark, audit_dir)
        except Exception:
            log.exception("audit table was not compacted")
    return rows


def _stage_with_pending(spark: SparkSession, read: extract.Reader, staging_dir: str,
                        start: dt.date):
    """Stage the tables (RESULTS from ``start``) plus the pending-status rows
    of all history as one snapshot; returns that snapshot's tables and pending
    rows, whatever another run publishes meanwhile."""
    tables = extract.extract_all(read, start)
    tables[extract.PENDING_TABLE] = extract.extract_pending(read)
    snapshot = extract.stage_snapshot(tables, staging_dir)
    return (read_staged(spark, staging_dir, snapshot),
            read_table(spark, staging_dir, extract.PENDING_TABLE, extract.PENDING_SCHEMA, snapshot))


def backfill_years(spark: SparkSession, read: extract.Reader, staging_dir: str, fact_dir: str,
                   years, **fact_opts) -> int:
    """Extract everything from the first year on (plus all-history pending
    rows), then rebuild those years (each replaced whole, half-open
    [Y-01-01, Y+1-01-01))."""
    years = sorted(set(int(y) for y in years))
    src, pending = _stage_with_pending(spark, read, staging_dir, dt.date(years[0], 1, 1))
    return store.backfill(spark, src, fact_dir, years, pending_results=pending, partials=True, **fact_opts)


def report_request(spark: SparkSession, fact_dir: str, staging_dir: str, cal_date, cal_end,
                   report_type: str = "RWP", fmt: str = "json", out_path: str | None = None,
                   audit_dir: str | None = None, user: str = "") -> int:
    """Validate, build the report, write it in the requested format and log
    the request. ``xlsx`` writes the spreadsheet's tab split as CSV folders
    (the styled workbook itself is not built). Returns the row count."""
    cal_date, cal_end, report_type, fmt = report_plan.validate_request(
        cal_date, cal_end, report_type, fmt)
    lookup = read_table(spark, staging_dir, "METADATA_LOOKUP_VALUES")
    fact = partials.window_fact(spark, fact_dir, cal_date, cal_end)  # lists the window's years only
    view = views.priced_view(fact, lookup, pii=report_type == "RWP")
    rep = report_plan.report(view, cal_date, cal_end, report_type)
    if report_type == "RWP":
        rep = report_plan.display(rep)
    action = "view" if fmt == "json" else "download"
    status, rows = "success", 0
    obs = Observation("report_rows")
    try:
        if fmt == "xlsx":
            names = report_plan.sheet_names(cal_date, report_type)
            rows = sinks.write_tabs(report_plan.tabs(rep, cal_date, report_type), out_path, names)[names[0]]
        else:
            # observe above the sort: the sort's sampling pass must not count rows
            counted = sinks.sort_report(rep).observe(obs, F.count(F.lit(1)).alias("rows"))
            (sinks.write_csv if fmt == "csv" else sinks.write_json)(counted, out_path, sort=False)
            rows = int(obs.get["rows"])
    except Exception:
        status = "error"
        log.exception("report failed")
        raise
    finally:
        if audit_dir:
            audit.audit_append(spark, audit_dir, user=user, year=cal_date.year,
                               month=cal_date.month, action=action, version=report_type,
                               filename="screen" if fmt == "json" else (out_path or ""),
                               row_count=rows, status=status)
    return rows
