"""Source extract (S1-S4): column-pruned reads of the nine source tables
over JDBC, RESULTS split by ORIGREC range and limited to the rolling window,
and the staging write (one snapshot of snappy Parquet folders, one per table).

The reader is injected: production passes ``jdbc_reader``; tests pass the
fixture tables, which expose the same projection."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook import schemas
from assaybook.sources import files, snapshots
from assaybook.sources.manifest import GRACE_S
from assaybook.sources.tables import Sources, as_dict

log = logging.getLogger("assaybook.extract")

Reader = Callable[[str, "str | None"], DataFrame]

# The extracted column list of each source table.
EXTRACT_COLUMNS = {name: [f.name for f in st.fields] for name, st in schemas.SOURCES.items()}
LOOKUP_FILTER = "LOOKUP_NAME = 'PanelPricing'"


# Large and medium tables are read in parallel, cut on an integer key.
SPLIT_COLUMNS = {"RESULTS": "ORIGREC", "FOLDERS": "FOLDERNO", "CENTRALRECEIVING": "ORIGREC"}


def boundary_query(table: str, key: str, where: str | None, rows_per_task: int) -> str:
    """Every ``rows_per_task``-th key in key order, as the source counts them:
    one short row per task, however uneven the keys are."""
    cond = f" WHERE {where}" if where else ""
    return (f"SELECT k FROM (SELECT {key} AS k, ROW_NUMBER() OVER (ORDER BY {key}) AS r FROM {table}{cond}) q "
            f"WHERE r % {rows_per_task} = {1 % rows_per_task}")


def split_predicates(key: str, boundaries) -> list[str]:
    """Ranges of ``key`` that begin at the boundaries. Together they cover every
    key once, also keys that appear below, above or between them later, and null."""
    cuts = sorted({b for b in boundaries if b is not None})[1:]
    if not cuts:
        return ["1 = 1"]
    middle = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *middle, f"{key} >= {cuts[-1]}"]


def jdbc_reader(spark: SparkSession, url: str, properties: dict | None = None, *,
                rows_per_task: int = 1_000_000, fetchsize: int = 10_000,
                query_timeout_s: int = 3600) -> Reader:
    """Reader over a SQL Server style JDBC source, read-uncommitted, each
    statement limited to ``query_timeout_s`` (task retries cover transient
    failures, ``stage`` those of a whole copy). Split tables are read by as many
    tasks as their row count needs, cut where the source counts ``rows_per_task``
    keys, so gaps in the keys leave no task empty and none full. Date-times
    come without a zone, as the source stores them."""
    props = dict(properties or {})

    def base():
        r = (spark.read.format("jdbc").option("url", url).option("fetchsize", fetchsize)
             .option("queryTimeout", query_timeout_s).option("preferTimestampNTZ", True)
             .option("sessionInitStatement",
                     "SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED"))
        for k, v in props.items():
            r = r.option(k, v)
        return r

    def read(table: str, where: str | None = None) -> DataFrame:
        cols = ", ".join(EXTRACT_COLUMNS[table])
        split = SPLIT_COLUMNS.get(table)
        if split:
            found = base().option("query", boundary_query(table, split, where, rows_per_task)).load().collect()
            cond = f" WHERE {where}" if where else ""
            return base().jdbc(url, f"(SELECT {cols} FROM {table}{cond}) t",
                               predicates=split_predicates(split, [r[0] for r in found]))
        q = f"SELECT {cols} FROM {table}" + (f" WHERE {where}" if where else "")
        return base().option("query", q).load()

    return read


def fixture_reader(src: Sources, split_partitions: int | None = None) -> Reader:
    """Reader over in-memory/test tables. ``split_partitions`` mimics the JDBC
    extract's parallel reads of ``SPLIT_COLUMNS`` (one output file per read);
    a hash split on the key avoids range sampling, the files are as parallel."""
    tables = as_dict(src)

    def read(table: str, where: str | None = None) -> DataFrame:
        df = tables[table].select(*EXTRACT_COLUMNS[table])
        if where:
            df = df.where(F.expr(where))
        if table in SPLIT_COLUMNS and split_partitions:
            df = df.repartition(split_partitions, SPLIT_COLUMNS[table])
        return df

    return read


def extract_results(read: Reader, start: dt.date | None = None) -> DataFrame:
    """RESULTS, optionally limited to DATEENTER >= start (rolling window).
    The predicate goes to the reader, so a range-split source read takes its
    split bounds from the window rows only."""
    if start is None:
        return read("RESULTS", None)
    return read("RESULTS", f"DATEENTER >= '{start.isoformat()}'")


PENDING_FILTER = "S IN ('Logged', 'Draft')"
PENDING_TABLE = "RESULTS_PENDING"


def extract_pending(read: Reader) -> DataFrame:
    """(FOLDERNO, S) of every pending-status result, all history: the pending
    flag needs results older than the rolling window, but only these rows.
    The status filter is pushed to the source."""
    return read("RESULTS", PENDING_FILTER).select("FOLDERNO", "S")


def extract_all(read: Reader, rolling_start: dt.date | None = None) -> dict[str, DataFrame]:
    out = {}
    for name in schemas.SOURCES:
        if name == "RESULTS":
            out[name] = extract_results(read, rolling_start)
        elif name == "METADATA_LOOKUP_VALUES":
            out[name] = read(name, LOOKUP_FILTER)
        else:
            out[name] = read(name, None)
    return out


PENDING_SCHEMA = T.StructType([f for f in schemas.RESULTS.fields if f.name in ("FOLDERNO", "S")])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the staged table's columns and types. The source's integer
    and text keys, date-times and money become the declared types; a value
    that does not fit raises (ANSI casts) instead of being staged as null."""
    def typed(f):
        c = F.col(f.name)
        have = df.schema[f.name].dataType
        if isinstance(f.dataType, T.TimestampNTZType) and isinstance(have, T.TimestampType):
            raise TypeError(f"{f.name} was read with a time zone; read it with preferTimestampNTZ")
        return c.cast(f.dataType).alias(f.name)
    return df.select(*map(typed, schema.fields))


#: Fixed values of the copies: attempts after the first, and seconds between them.
COPY_RETRIES, RETRY_WAIT_S = 2, 30


def stage(df: DataFrame, path: str, schema: T.StructType | None = None, *, retries: int = COPY_RETRIES,
          wait_s: float = RETRY_WAIT_S) -> int:
    """Write one staged table under its declared types; returns its row count,
    observed by the write. A copy that fails is tried again as a whole, as the
    source's state may have changed in between; a table that does not have the
    declared columns or types fails at once."""
    out = df if schema is None else conform(df, schema)
    for attempt in range(retries + 1):
        obs = Observation(f"stage:{path}:{attempt}")
        try:
            (out.observe(obs, F.count(F.lit(1)).alias("rows"))
                .write.mode("overwrite").option("compression", "snappy").parquet(path))
            return int(obs.get["rows"])
        except AnalysisException:
            raise
        except Exception:
            if attempt == retries:
                raise
            log.warning("copy to %s failed, attempt %d of %d follows", path, attempt + 2, retries + 1, exc_info=True)
            time.sleep(wait_s)
    raise AssertionError("unreachable")


def stage_snapshot(tables: dict[str, DataFrame], staging_dir: str, parallel: int = 9, *,
                   grace_s: float = GRACE_S, wait_s: float = RETRY_WAIT_S) -> snapshots.Snapshot:
    """Stage every table as one new snapshot. The copies are independent, so
    their jobs are submitted concurrently and Spark interleaves their tasks; only
    when all are written does the set go live. A failure leaves the set before it."""
    if not tables:
        raise ValueError("no table to stage")
    spark = next(iter(tables.values())).sparkSession
    staging_dir = staging_dir.rstrip("/")
    kinds = schemas.SOURCES | {PENDING_TABLE: PENDING_SCHEMA}
    seen, version = snapshots.last_number(spark, staging_dir), snapshots.new_snapshot(staging_dir)
    folder = f"{staging_dir}/{version}"
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            futures = {name: pool.submit(stage, df, f"{folder}/{name}", kinds.get(name), wait_s=wait_s)
                       for name, df in tables.items()}
            counts = {name: f.result() for name, f in futures.items()}
        # what is derived from the staged tables is kept by this marker
        files.write_text(spark, f"{folder}/_VERSION", version)
        return snapshots.publish_snapshot(spark, staging_dir, version, counts, seen, grace_s=grace_s)
    except Exception:
        files.remove(spark, folder)
        raise


def stage_all(tables: dict[str, DataFrame], staging_dir: str, parallel: int = 9) -> dict[str, int]:
    """``stage_snapshot``; returns the rows of each table."""
    return stage_snapshot(tables, staging_dir, parallel).rows
