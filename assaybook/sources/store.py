"""Gold fact store: partitioned Parquet by year/month of DateEnter.

Every write goes to a new run folder; readers follow a pointer that maps each
year to the run holding it. Publishing is one small file: the next numbered
pointer, created only if that number is free. Live data is never moved or
deleted before the switch, so a run that fails at any step leaves the old fact
whole, and a pointer that was cut short is passed over for the one before it.
Runs that the last pointers no longer name are removed afterwards, and so are
older pointers (see ``manifest``).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook import schemas
from assaybook.operators import flags
from assaybook.operators.filters import ts
from assaybook.sources import fact_index, files
from assaybook.sources.gate import Gate, Metrics, Watch
from assaybook.sources.manifest import GRACE_S, KEEP, Manifest

POINTERS = "_pointers"


def with_partitions(df: DataFrame, col: str = "DateEnter") -> DataFrame:
    return (df.withColumn("year", F.year(col).cast("int"))
              .withColumn("month", F.month(col).cast("int")))


def source_version(spark: SparkSession, path: str) -> str:
    """Version of a source folder: the marker that staging writes last, or, for
    a folder without one, its own entries (one listing, not recursive)."""
    marker = files.read_text(spark, f"{path}/_VERSION")
    return marker if marker is not None else json.dumps(files.entries(spark, path))


# ---------------------------------------------------------------- pointer
def _log(spark: SparkSession, fact_dir: str) -> Manifest:
    """Pointers: year -> run of every live year."""
    return Manifest(spark, f"{fact_dir.rstrip('/')}/{POINTERS}",
                    lambda e: {int(y): run for y, run in e["years"].items()})


def current_years(spark: SparkSession, fact_dir: str) -> dict[int, str] | None:
    """Year -> run of the live fact; None if nothing is published."""
    found = _log(spark, fact_dir).newest()
    return found[1] if found else None


def _switch(spark: SparkSession, fact_dir: str, years: dict[int, str], seen: int) -> None:
    """Publish ``years`` as the pointer after number ``seen``."""
    _log(spark, fact_dir).append({"years": {str(y): r for y, r in sorted(years.items())}}, seen)


def remove_old_runs(spark: SparkSession, fact_dir: str, *, keep: int = KEEP,
                    grace_s: float = GRACE_S) -> list[str]:
    """Remove run folders that the last ``keep`` pointers do not name and that
    are older than ``grace_s``, and the pointers before those."""
    fact_dir = fact_dir.rstrip("/")
    kept, _ = _log(spark, fact_dir).trim(keep=keep, grace_s=grace_s)
    return files.remove_unnamed(spark, fact_dir, "run-", {run for years in kept for run in years.values()}, grace_s)


# ---------------------------------------------------------------- write
def _laid_out(out: DataFrame, by_month: bool) -> DataFrame:
    """Rows (with year and month) in the order of the files. Every task writes its
    own part of each month: the rows are wide, and moving them to one task a month
    would cost more disk than all the transform's other shuffles of result rows.
    ``by_month`` does move them, for few large files: REBALANCE lets AQE split a hot
    month over several tasks and coalesce small ones. Sorting each task's rows by
    (year, month, DateEnter) is the order the partitioned writer needs anyway, and
    gives tight DateEnter min/max per row group, so a window ending mid-month skips
    row groups inside its edge months."""
    if by_month:
        out = out.hint("rebalance", "year", "month")
    return out.sortWithinPartitions("year", "month", "DateEnter")


def _write_partitioned(df: DataFrame, path: str, max_records_per_file: int,
                       lookup: DataFrame | None = None, by_month: bool = False) -> Metrics:
    watch = Watch(lookup)
    out = watch.observe(with_partitions(df))
    (_laid_out(out, by_month)
        .write.mode("error")
        .option("maxRecordsPerFile", max_records_per_file)
        .option("compression", "snappy")
        .partitionBy("year", "month")
        .parquet(path))
    return watch.metrics()


def read_run(spark: SparkSession, fact_dir: str, run: str, years) -> DataFrame:
    """Stored rows of some years of one run."""
    return (spark.read.schema(schemas.FACT_STORED).option("basePath", f"{fact_dir}/{run}")
            .parquet(*[f"{fact_dir}/{run}/year={y}" for y in sorted(years)]))


def publish(spark: SparkSession, df: DataFrame, fact_dir: str, years=None, *,
            gate: Gate | None = None, lookup: DataFrame | None = None, index: bool = True,
            partials: bool = False, by_month: bool = False, max_records_per_file: int = 5_000_000,
            replace: bool = True, grace_s: float = GRACE_S) -> int:
    """Write ``df`` as a new run and switch ``fact_dir`` to it.

    ``years=None`` replaces the whole table; otherwise exactly those years (a
    year without rows is cleared). ``replace=False`` (whole table only) keeps a
    table that another run published meanwhile and discards this copy. The run
    must pass ``gate`` first; with ``lookup`` the gate knows the rows that the
    priced view will have. ``index`` stores the flags' key-to-year index that a
    reload probes (fact rows with FolderNo only), ``partials`` the report's monthly
    partials. ``by_month`` shuffles the rows by month before the write: a file or a few
    a month, where each task otherwise writes its own. Returns the rows written."""
    from assaybook.sources.partials import write_partials
    fact_dir = fact_dir.rstrip("/")
    seen = _log(spark, fact_dir).last_number()
    run = f"run-{uuid.uuid4().hex[:12]}"
    path = f"{fact_dir}/{run}"
    try:
        m = _write_partitioned(df, path, max_records_per_file, lookup, by_month)
        (gate or Gate()).check(m)
        live = current_years(spark, fact_dir)
        if years is None and not replace and live is not None:
            files.remove(spark, path)
            return m.rows
        wrote = {int(name[5:]): run for name, _, _ in files.entries(spark, path)
                 if name.startswith("year=") and name[5:].isdigit()}
        if index and wrote and "FolderNo" in df.columns:
            fact_index.write_index(read_run(spark, fact_dir, run, wrote), path)
        if partials and wrote:
            write_partials(read_run(spark, fact_dir, run, wrote), path)
        if years is None:
            now = wrote
        else:
            chosen = {int(y) for y in years}
            now = {y: r for y, r in (live or {}).items() if y not in chosen}
            now |= {y: r for y, r in wrote.items() if y in chosen}
        _switch(spark, fact_dir, now, seen)
    except Exception:
        files.remove(spark, path)
        raise
    remove_old_runs(spark, fact_dir, grace_s=grace_s)
    return m.rows


# ---------------------------------------------------------------- read
def read_fact(spark: SparkSession, fact_dir: str, start=None, end=None, *, years=None,
              internal: bool = False) -> DataFrame:
    """External-table read: explicit schema, year/month from the folder names.

    Only the year folders between ``start`` and ``end`` (or in ``years``) are
    listed. ``internal`` keeps FolderNo, which the flags' refresh needs."""
    fact_dir = fact_dir.rstrip("/")
    live = current_years(spark, fact_dir)
    if live is None:
        raise FileNotFoundError(f"no fact is published in {fact_dir}")
    lo, hi = getattr(start, "year", None), getattr(end, "year", None)
    by_run: dict[str, list[int]] = {}
    for y, run in sorted(live.items()):
        if (lo is None or y >= lo) and (hi is None or y <= hi) and (years is None or y in years):
            by_run.setdefault(run, []).append(y)
    parts = [read_run(spark, fact_dir, run, ys) for run, ys in by_run.items()]
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.FACT_STORED)
    return out if internal else out.drop("FolderNo")


# ---------------------------------------------------------------- reload
def rolling_years(now: dt.date) -> list[int]:
    return [now.year - 1, now.year]


def rolling_start(now: dt.date) -> dt.date:
    """Jan 1 of the prior year."""
    return dt.date(now.year - 1, 1, 1)


def _stale_rows(spark: SparkSession, fact_dir: str, older: dict[int, str], latest: DataFrame,
                pending: DataFrame, work: str) -> tuple[DataFrame | None, list[int]]:
    """Rows of the older years whose stored flags are stale, brought up to date,
    and those years. The stale keys are written to ``work``, which tells the planner
    their size: they are read to find the years and the (folder, order) pairs of their
    rows, and the pairs to refresh the wide rows with one join."""
    def derived(years):
        return read_fact(spark, fact_dir, years=years, internal=True)

    found = {
        "orders": fact_index.stale_orders(fact_index.read_index(spark, fact_dir, "orders", older, derived), latest),
        "folders": fact_index.stale_folders(fact_index.read_index(spark, fact_dir, "folders", older, derived), pending)}
    def kept(kind, df):
        df.write.parquet(f"{work}/{kind}")
        return spark.read.schema(df.schema).parquet(f"{work}/{kind}")

    found = {kind: kept(kind, df) for kind, df in found.items()}
    years = sorted({r["year"] for df in found.values() for r in df.select("year").distinct().collect()})
    if not years:
        return None, []
    stored = read_fact(spark, fact_dir, years=years, internal=True)
    pairs = kept("pairs", fact_index.stale_pairs(stored, found["orders"], found["folders"]))
    rows = fact_index.refreshed(stored, pairs)
    return rows.drop("year", "month"), years


def reload_window(spark: SparkSession, src, fact_dir: str, now: dt.date, *,
                  grace_s: float = GRACE_S, gate: Gate | None = None, partials: bool = False,
                  **fact_opts) -> int:
    """Nightly reload: rebuild prior + current year, and refresh the flags of
    the older years. Those years' results do not change, but a new result can
    be an old order's latest, and a folder can become pending or final. The
    index of the older years tells which ones own such a row; only those are
    read, and rewritten with the same switch."""
    from assaybook.plans.fact import build_fact
    start = rolling_start(now)
    end = dt.date(now.year + 1, 1, 1)
    fact_dir = fact_dir.rstrip("/")
    years = rolling_years(now)
    older = {y: run for y, run in (current_years(spark, fact_dir) or {}).items() if y not in years}
    work = f"{fact_dir}/run-keys-{uuid.uuid4().hex[:12]}"
    try:
        latest = flags.latest_result(src.results.where(F.col("DATEENTER") >= ts(start)), src.folders)
        if older:  # the new rows and the stale keys both take the latest dates
            latest.write.parquet(f"{work}/latest")
            latest = spark.read.schema(latest.schema).parquet(f"{work}/latest")
        df = build_fact(src, start=start, end=end, keep_folder=True, latest=latest, **fact_opts)
        if older:
            raw = fact_opts.get("pending_results")
            redo, stale = _stale_rows(
                spark, fact_dir, older, latest,
                flags.pending_folders(src.results if raw is None else raw), work)
            if redo is not None:
                df = df.unionByName(redo)
                years = sorted({*years, *stale})
        return publish(spark, df, fact_dir, years=years, grace_s=grace_s, gate=gate, lookup=src.lookup,
                       partials=partials)
    finally:
        files.remove(spark, work)


def backfill(spark: SparkSession, src, fact_dir: str, years, *, grace_s: float = GRACE_S,
             gate: Gate | None = None, partials: bool = False, **fact_opts) -> int:
    """Rebuild the given years in one job (each year half-open [Y, Y+1))."""
    from assaybook.plans.fact import build_fact
    years = sorted(set(int(y) for y in years))
    df = build_fact(src, start=dt.date(years[0], 1, 1),
                    end=dt.date(years[-1] + 1, 1, 1), keep_folder=True, **fact_opts)
    if years != list(range(years[0], years[-1] + 1)):
        df = df.where(F.year("DateEnter").isin(years))
    return publish(spark, df, fact_dir, years=years, grace_s=grace_s, gate=gate, lookup=src.lookup,
                       partials=partials)
