"""Run-audit table (S14, S15): one row per report request, kept by UTC month;
reads return one month newest first.

An append writes its row aside and moves the one file into the month's folder, so
requests that run at once do not share a commit folder. Compaction folds the files
of a month into a base and publishes that with one manifest entry, which names the
base and the files it holds. Readers take the base and the files it does not
hold, so a row is read once before, during and after a compaction, and appends
go on meanwhile, in the current month too. Folded files are removed by a later
compaction, when no reader of the entry before can need them."""

from __future__ import annotations

import datetime as dt
import logging
import re
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.sources import files
from assaybook.sources.manifest import GRACE_S, Manifest

log = logging.getLogger("assaybook.audit")

# The audit table's columns.
AUDIT_SCHEMA = ("RowKey string, User string, Timestamp_UTC timestamp_ntz, ReportYear int, "
                "ReportMonth int, Action string, Version string, FileName string, "
                "RowCount bigint, Status string, month string")
AUDIT_COLUMNS = ["RowKey", "User", "Timestamp_UTC", "ReportYear", "ReportMonth", "Action",
                 "Version", "FileName", "RowCount", "Status"]
_MONTH = re.compile(r"^\d{4}-\d{2}$")
#: A month with fewer single files is left as it is.
LEAST_FILES = 32
# Fixed value: the key counts down from 2^63 in 100-ns ticks.
_TICKS_TOP = 2 ** 63


def reverse_ticks(ts_col) -> F.Column:
    """Newest-first sort key: 2^63 minus 100-ns ticks since the epoch (one more
    than a 64-bit integer holds, so the last unit is added after the subtraction)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts_col)
    return (F.lit(_TICKS_TOP - 1) - micros * 10 + 1).cast("string")


def audit_append(spark: SparkSession, audit_dir: str, *, user: str, year: int, month: int,
                 action: str, version: str, filename: str, row_count: int, status: str,
                 now: dt.datetime | None = None) -> bool:
    """Append one audit row; never raises (returns False on failure)."""
    try:
        audit_dir = audit_dir.rstrip("/")
        now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        key = uuid.uuid4().hex
        row = [(None, user, now, int(year), int(month), action, version, filename,
                int(row_count), status, now.strftime("%Y-%m"))]
        df = spark.createDataFrame(row, AUDIT_SCHEMA).withColumn(
            "RowKey", F.concat(reverse_ticks(F.col("Timestamp_UTC")), F.lit("_"), F.lit(key[:8])))
        aside = f"{audit_dir}/_incoming/{key}"
        df.drop("month").coalesce(1).write.parquet(aside)
        part = next(name for name, _, _ in files.entries(spark, aside) if name.startswith("part-"))
        files.move(spark, f"{aside}/{part}", f"{audit_dir}/month={now:%Y-%m}/row-{key}.parquet")
        files.remove(spark, aside)
        return True
    except Exception:  # audit must never fail the report
        log.exception("run of %s by %s is missing from the audit table", action, user)
        return False


def audit_query(audit: DataFrame, month: str) -> DataFrame:
    """One month's entries, newest first. The month partition prunes the
    stored table; the equivalent Timestamp_UTC range (a row's month is the
    UTC month of its timestamp) also reaches scans where month is derived."""
    if not _MONTH.match(month or ""):
        raise ValueError("Month must be in YYYY-MM format")
    y, m = int(month[:4]), int(month[5:])
    start = dt.datetime(y, m, 1)
    end = dt.datetime(y + (m == 12), m % 12 + 1, 1)
    ts = F.col("Timestamp_UTC")
    in_month = ((F.col("month") == month)
                & (ts >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
                & (ts < F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")))
    return (audit.where(in_month)
            .select(*AUDIT_COLUMNS).orderBy(ts.desc(), F.col("RowKey")))


# ---------------------------------------------------------------- storage
@dataclass(frozen=True)
class Folded:
    """What a manifest entry says of a month."""
    base: str                       # folder of the compacted rows
    names: frozenset[str]           # files of the month's folder that the base holds
    at: float                       # when it was published


def _log(spark: SparkSession, audit_dir: str) -> Manifest:
    return Manifest(spark, f"{audit_dir}/_compactions", lambda e: {
        m: Folded(f["base"], frozenset(f["names"]), float(f["at"])) for m, f in e["months"].items()})


def _months(spark: SparkSession, audit_dir: str, folded: dict[str, Folded]) -> list[str]:
    stored = {name[6:] for name, _, _ in files.entries(spark, audit_dir) if name.startswith("month=")}
    return sorted(stored | set(folded))


def _loose(spark: SparkSession, audit_dir: str, month: str, folded: Folded | None) -> list[str]:
    """Files of a month's folder that no base holds."""
    held = folded.names if folded else frozenset()
    return [name for name, _, _ in files.entries(spark, f"{audit_dir}/month={month}")
            if name.endswith(".parquet") and name not in held]


def _read(spark: SparkSession, audit_dir: str, months: list[str], state: dict[str, Folded],
          loose: dict[str, list[str]]) -> DataFrame:
    bases = [f"{audit_dir}/{state[m].base}" for m in months if m in state]
    single = [f"{audit_dir}/month={m}/{name}" for m in months for name in loose[m]]
    parts = [spark.read.schema(AUDIT_SCHEMA).parquet(*bases)] if bases else []
    if single:
        parts.append(spark.read.schema(AUDIT_SCHEMA).option("basePath", audit_dir).parquet(*single))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], AUDIT_SCHEMA)


def read_audit(spark: SparkSession, audit_dir: str, month: str | None = None) -> DataFrame:
    """The audit table, or one month of it: each month's base and the files
    appended since."""
    audit_dir = audit_dir.rstrip("/")
    found = _log(spark, audit_dir).newest()
    state = found[1] if found else {}
    months = [month] if month else _months(spark, audit_dir, state)
    return _read(spark, audit_dir, months, state, {m: _loose(spark, audit_dir, m, state.get(m)) for m in months})


def audit_compact(spark: SparkSession, audit_dir: str, month: str, *, least_files: int = LEAST_FILES,
                  grace_s: float = GRACE_S) -> int:
    """Fold the single files of a month into its base; returns how many were
    folded (0 if there are fewer than ``least_files``). Stopped at any step, every
    row is still read once."""
    if not _MONTH.match(month or ""):
        raise ValueError("Month must be in YYYY-MM format")
    audit_dir = audit_dir.rstrip("/")
    manifest = _log(spark, audit_dir)
    found = manifest.newest()
    seen, state = manifest.last_number(), dict(found[1]) if found else {}
    old = state.get(month)
    if old and time.time() - old.at >= grace_s:  # no reader needs these any more
        for name in old.names:
            files.remove(spark, f"{audit_dir}/month={month}/{name}")
    loose = _loose(spark, audit_dir, month, old)
    if len(loose) < max(1, least_files):
        return 0
    base = f"_base/{month}-{uuid.uuid4().hex[:12]}"
    rows = _read(spark, audit_dir, [month], {month: old} if old else {}, {month: loose})
    try:
        rows.sort("RowKey").write.parquet(f"{audit_dir}/{base}")
        there = {name for name, _, _ in files.entries(spark, f"{audit_dir}/month={month}")}
        names = sorted((old.names & there if old else set()) | set(loose))
        state[month] = Folded(base, frozenset(names), time.time())
        manifest.append({"months": {m: {"base": f.base, "names": sorted(f.names), "at": f.at}
                                    for m, f in sorted(state.items())}}, seen)
    except Exception:
        files.remove(spark, f"{audit_dir}/{base}")
        raise
    kept, _ = manifest.trim(grace_s=grace_s)
    named = {f.base.split("/")[1] for entry in kept for f in entry.values()}
    files.remove_unnamed(spark, f"{audit_dir}/_base", "", named, grace_s)
    return len(loose)


def audit_compact_all(spark: SparkSession, audit_dir: str, **how) -> dict[str, int]:
    """Compact every month that has enough single files, the current one too."""
    audit_dir = audit_dir.rstrip("/")
    stored = [name[6:] for name, _, _ in files.entries(spark, audit_dir) if name.startswith("month=")]
    return {m: n for m in stored if _MONTH.match(m) and (n := audit_compact(spark, audit_dir, m, **how))}


def audit_from_events(events: DataFrame) -> DataFrame:
    """Demo audit table derived from the driver's event stream."""
    ts = F.col("ts").cast("timestamp_ntz")
    return events.select(
        F.concat(reverse_ticks(ts), F.lit("_"), F.lpad(F.hex("event_id"), 8, "0")).alias("RowKey"),
        F.col("user_id").cast("string").alias("User"), ts.alias("Timestamp_UTC"),
        F.year(ts).alias("ReportYear"), F.month(ts).alias("ReportMonth"),
        F.col("event_type").alias("Action"), F.lit("RWP").alias("Version"),
        F.lit("screen").alias("FileName"), F.floor("value").cast("bigint").alias("RowCount"),
        F.lit("success").alias("Status"), F.date_format(ts, "yyyy-MM").alias("month"))
