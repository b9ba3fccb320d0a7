"""Monthly partials of the report, stored with each run of the fact.

The report takes a MIN (the entry date a MAX) per order and company, which can be
merged. A partial holds these for the rows of one month, order, company and
sample, for each panel by itself, as the panel's code and price come from the
lookup when the report runs. Rows that no view can show (folder pending, or a
test without a price) are left out. A partial has the columns of a fact row, so
the view and the report take it as one; only the months at a window's ends are
read row by row.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook import schemas
from assaybook.functions import codes
from assaybook.functions.text import ci
from assaybook.sources import files, store

FOLDER = "_partials"
#: Parts of a month: rows meet by month and part, so one shuffle serves the merge and the files.
BUCKETS = 16
_SCHEMA = T.StructType([f for f in schemas.FACT_STORED.fields if f.name != "FolderNo"])


def monthly_partials(fact: DataFrame) -> DataFrame:
    """Partials of fact rows (with year and month), in the fact's columns."""
    rows = fact.where((F.col("HasPendingResults") == F.lit(False)) & (F.col("IsPanel") | F.col("Price").isNotNull()))
    keys = {"_comp": ci("COMPNAME"), "_sample": ci("ExternalId"),
            "_panel": F.when(F.col("IsPanel"), ci("TestGroupName"))}
    grouped = ["year", "month", "_bucket", "ORDNO", "LatestResultDate", "IsPanel"]
    special = codes.SPECIAL_CLIENT_TESTCODE
    how = {"DateEnter": F.max("DateEnter"), "ETL_LoadDate": F.max("ETL_LoadDate"),
           # the special client's samples are those with one code: it must not hide behind a smaller one
           "SourceTestCode": F.when(F.bool_or(F.col("SourceTestCode") == special), special)
           .otherwise(F.min("SourceTestCode"))}
    values = [c for c in _SCHEMA.names if c not in grouped]
    rows = rows.withColumn("_bucket", F.pmod(F.hash("ORDNO"), F.lit(BUCKETS))).repartition("year", "month", "_bucket")
    out = rows.withColumns(keys).groupBy(*grouped, *keys).agg(*[how.get(c, F.min(c)).alias(c) for c in values])
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _SCHEMA.fields])


def write_partials(rows: DataFrame, run_dir: str) -> None:
    """Partials of a written run: one more read of its rows."""
    (monthly_partials(rows).sortWithinPartitions("year", "month", "ORDNO")
     .write.mode("overwrite").option("compression", "snappy").partitionBy("year", "month").parquet(f"{run_dir}/{FOLDER}"))


def whole_months(start: dt.date, end: dt.date) -> list[tuple[int, int]]:
    """Months that the closed window from ``start`` to ``end`` (each at midnight)
    holds whole."""
    out, (y, m) = [], (start.year, start.month)
    while dt.date(y, m, 1) <= end:
        after = dt.date(y + m // 12, m % 12 + 1, 1)
        if dt.date(y, m, 1) >= start and after <= end:
            out.append((y, m))
        y, m = after.year, after.month
    return out


def window_fact(spark: SparkSession, fact_dir: str, start: dt.date, end: dt.date) -> DataFrame:
    """What the report of a window reads: partials of its whole months, rows of the
    others. A year whose run has no partials is read row by row. All parts come
    from one pointer."""
    fact_dir = fact_dir.rstrip("/")
    live = store.current_years(spark, fact_dir)
    if live is None:
        raise FileNotFoundError(f"no fact is published in {fact_dir}")
    years = {y: run for y, run in live.items() if start.year <= y <= end.year}
    stored = {run: {name for name, _, _ in files.entries(spark, f"{fact_dir}/{run}/{FOLDER}")} for run in set(years.values())}
    whole: dict[int, list[int]] = {}
    for y, m in whole_months(start, end):
        if y in years and stored[years[y]]:
            whole.setdefault(y, []).append(m)
    parts = []
    for y, run in sorted(years.items()):
        merged = set(whole.get(y, []))
        present = {int(name[6:]) for name, _, _ in files.entries(spark, f"{fact_dir}/{run}/year={y}")
                   if name.startswith("month=")}
        asked = {m for m in present if (start.year, start.month) <= (y, m) <= (end.year, end.month)}
        for base, schema, months in ((f"{fact_dir}/{run}/{FOLDER}", _SCHEMA, _partial_months(spark, fact_dir, run, y) & merged),
                                     (f"{fact_dir}/{run}", schemas.FACT_STORED, asked - merged)):
            if months:
                part = (spark.read.schema(schema).option("basePath", base)
                        .parquet(*[f"{base}/year={y}/month={m}" for m in sorted(months)]))
                parts.append(part.select(*_SCHEMA.names))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _SCHEMA)


def _partial_months(spark: SparkSession, fact_dir: str, run: str, year: int) -> set[int]:
    """Months with partials: one whose rows no view can show has none."""
    return {int(name[6:]) for name, _, _ in files.entries(spark, f"{fact_dir}/{run}/{FOLDER}/year={year}")
            if name.startswith("month=")}
