"""Materialised fact for the report side.

The report reads the priced view twice (rows + special-client anti-join);
over raw tables that would plan the whole transform twice. The fact is
therefore written once, partitioned by year/month, into the shared folder
named by ``spark.checkpoint.dir`` and read back with partition pruning.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from assaybook import schemas
from assaybook.plans.fact import build_fact
from assaybook.session import work_dir
from assaybook.sources import files, store
from assaybook.sources.manifest import GRACE_S
from assaybook.sources.tables import Sources

#: Raised with every change of the transform's rules, so old facts are not reused.
FACT_VERSION = 2


def _digest(key) -> str:
    return hashlib.sha1(json.dumps(key).encode()).hexdigest()[:16]


def fact_location(spark: SparkSession, src: Sources, **fact_opts) -> str:
    """Cache folder: by the source's location and the transform's options, and in
    it by the source's version, the transform's version and the stored schema."""
    if not src.origin:
        raise ValueError("a source without an origin has no identity to cache a fact under")
    place = _digest([src.origin, sorted((k, repr(v)) for k, v in fact_opts.items())])
    version = _digest([store.source_version(spark, src.origin), FACT_VERSION, schemas.FACT_STORED.simpleString()])
    return f"{work_dir(spark)}/assaybook/facts/{place}/v-{version}"


def materialized_fact(spark: SparkSession, src: Sources, *, grace_s: float = GRACE_S, **fact_opts) -> DataFrame:
    """Read the stored fact for ``src``, building it first if absent. Facts of the
    source's earlier versions go once they are older than ``grace_s``."""
    path = fact_location(spark, src, **fact_opts)
    if store.current_years(spark, path) is None:
        store.publish(spark, build_fact(src, keep_folder=True, **fact_opts), path, replace=False,
                      index=False)
        place, version = path.rsplit("/", 1)
        files.remove_unnamed(spark, place, "v-", {version}, grace_s)
    return store.read_fact(spark, path)
