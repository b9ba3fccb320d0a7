from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from assaybook import schemas  # noqa: E402
from assaybook.sources.tables import Sources  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


def T(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


_counter = [0]


def make_sources(spark, *, results=(), folders=(), samples=(), clients=(), groups=(),
                 tests=(), price_lists=(), prices=(), lookup=()) -> Sources:
    """Sources from lists of tuples in the staged schemas' column order."""
    _counter[0] += 1

    def df(rows, st):
        return spark.createDataFrame(list(rows), st)

    return Sources(
        results=df(results, schemas.RESULTS), folders=df(folders, schemas.FOLDERS),
        samples=df(samples, schemas.CENTRALRECEIVING), clients=df(clients, schemas.RASCLIENTS),
        groups=df(groups, schemas.TESTGROUPNAMES), tests=df(tests, schemas.TESTS),
        price_lists=df(price_lists, schemas.RASPRICELIST), prices=df(prices, schemas.RASTESTPRICES),
        lookup=df(lookup, schemas.METADATA_LOOKUP_VALUES), origin=f"unit-{_counter[0]}")
