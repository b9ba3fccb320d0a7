"""Training-data operators on Spark.

Thirteen operators over the tables ``documents``, ``pages``, ``labels`` and
``benchmark``; each module holds one operator with its own general interface,
the query that applies it to its whole table, and the oracle SQL where SQL can
express the result. Nothing outside this package imports it except the guard
in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""

from __future__ import annotations

import sys
from importlib import import_module

from pyspark import cloudpickle

# functions of this package travel to the executors by value: nothing to install there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = ("lang_id", "html_wrapper", "license_scan", "bin_packing", "exact_dedup", "simhash_dedup",
           "decontaminate", "quality_rank", "warc_zip", "substring_dedup", "periodic_runs",
           "importance_resample", "pii_bootstrap")


def queries() -> dict:
    """Registered queries of the operators, by name."""
    out = {}
    for m in MODULES:
        out.update(import_module(f"{__name__}.{m}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    out = {}
    for m in MODULES:
        out.update(import_module(f"{__name__}.{m}").ORACLE)
    return out
