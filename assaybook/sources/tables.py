"""The nine staged source tables as one value passed to every plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from assaybook import schemas
from assaybook.sources.snapshots import Snapshot, live_snapshot


@dataclass(frozen=True)
class Sources:
    results: DataFrame
    folders: DataFrame
    samples: DataFrame          # CENTRALRECEIVING
    clients: DataFrame          # RASCLIENTS
    groups: DataFrame           # TESTGROUPNAMES
    tests: DataFrame            # TESTS
    price_lists: DataFrame      # RASPRICELIST
    prices: DataFrame           # RASTESTPRICES
    lookup: DataFrame           # METADATA_LOOKUP_VALUES
    origin: str = ""            # where the tables came from (cache key)


_ORDER = ["RESULTS", "FOLDERS", "CENTRALRECEIVING", "RASCLIENTS",
          "TESTGROUPNAMES", "TESTS", "RASPRICELIST", "RASTESTPRICES",
          "METADATA_LOOKUP_VALUES"]


def read_staged(spark: SparkSession, staging_dir: str, snapshot: Snapshot | None = None) -> Sources:
    """The nine staged tables with explicit schemas, all from one snapshot: the
    live one, or the one given. A folder without snapshots holds the tables itself."""
    snapshot = snapshot or live_snapshot(spark, staging_dir)
    path = snapshot.path if snapshot else (lambda table: f"{staging_dir}/{table}")
    dfs = [spark.read.schema(schemas.SOURCES[n]).parquet(path(n)) for n in _ORDER]
    return Sources(*dfs, origin=snapshot.folder if snapshot else staging_dir)


def read_table(spark: SparkSession, staging_dir: str, table: str, schema: T.StructType | None = None,
               snapshot: Snapshot | None = None) -> DataFrame:
    """One table of the live snapshot, or of the one given."""
    snapshot = snapshot or live_snapshot(spark, staging_dir)
    path = snapshot.path(table) if snapshot else f"{staging_dir}/{table}"
    return spark.read.schema(schema or schemas.SOURCES[table]).parquet(path)


def as_dict(src: Sources) -> dict[str, DataFrame]:
    return dict(zip(_ORDER, [src.results, src.folders, src.samples, src.clients,
                             src.groups, src.tests, src.price_lists, src.prices,
                             src.lookup]))
