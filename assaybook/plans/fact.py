"""The transform: one fact row per billable result, priced at the version
in force when it was entered (the job the nightly pipeline runs).

Plan shape (one lazy DataFrame; Catalyst prunes and pushes filters, and picks
broadcast or shuffle joins by the tables' true sizes):

  folder dimension   folders ⟕ pending folders (FOLDERNO) ⋈ samples (EXTERNAL_ID)
                     ⋈ billable clients ⟕ test groups ⟕ tests
  result rows        valid results ⟕ latest result per order (ORDNO)
                     ⋈ folder dimension (FOLDERNO; nothing else shares this
                     stage, so AQE can split a hot folder)
                     → as-of version + price

Shuffles that see result rows: one on ORDNO and one on FOLDERNO for the fact
rows, both before the folder dimension makes them wide; for the latest result one
of three columns on FOLDERNO, then one on ORDNO after a map-side aggregate. Flags are
computed from raw results (before any filter), as the report requires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.functions import codes
from assaybook.functions.text import ci
from assaybook.operators import asof, flags
from assaybook.operators.filters import billable_clients, ts, valid_results
from assaybook.sources.tables import Sources


def folder_dimension(src: Sources, *, billable_only: bool = True,
                     pending: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """One row per (folder, sample, client) with test-group/test attributes.
    ``pending`` (FOLDERNO) adds ``_pending``, true for its folders; ``only`` (FOLDERNO)
    are the folders asked for (all if None)."""
    f = src.folders.select("FOLDERNO", ci("EXTERNAL_ID").alias("_sample_key"),
                           F.col("TESTGROUPNAME"))
    if only is not None:
        f = f.join(only, "FOLDERNO", "left_semi")
    if pending is not None:
        f = f.join(pending.withColumn("_pending", F.lit(True)), "FOLDERNO", "left")
    s = src.samples.select(
        ci("EXTERNAL_ID").alias("_sample_key"),
        F.col("EXTERNAL_ID").alias("ExternalId"), F.col("BIRTH_DATE").alias("BirthDate"),
        F.col("CLIENT_SAMPLE_ID").alias("ClientSampleId"),
        F.col("FIRST_NAME").alias("FirstName"), F.col("LAST_NAME").alias("LastName"),
        F.col("DATE_COLLECTED").alias("DateCollected"),
        F.col("SPEC_SOURCE").alias("SpecSource"), ci("RASCLIENTID").alias("_client_key"))
    clients = billable_clients(src.clients) if billable_only else src.clients
    c = clients.select(ci("RASCLIENTID").alias("_client_key"), "COMPNAME",
                 F.col("CATEGORY").alias("Category"), F.col("STATE").alias("State"),
                 F.col("CITY").alias("City"), F.col("ZIP").alias("Zip"),
                 F.col("PRICELISTID").alias("PriceListId"))
    g = src.groups.select(ci("TESTGROUPNAME").alias("_group_key"), "TESTPANEL",
                          F.lit(True).alias("_group_hit"))
    t = src.tests.select(ci("TESTNO").alias("_test_key"), F.col("TESTNO").alias("_testno"),
                         F.col("TESTCODE").alias("_group_testcode"),
                         F.col("LEGACY_TESTCODE").alias("_legacy_testcode"))
    dim = (f.join(s, "_sample_key")
           .join(c, "_client_key")
           .withColumn("_group_key", ci("TESTGROUPNAME"))
           .join(g, "_group_key", "left"))
    # tests hang off the matched test-group row, not the folder's raw name
    dim = dim.join(t, F.col("_group_hit") & (dim["_group_key"] == t["_test_key"]), "left")
    return dim.drop("_sample_key", "_client_key", "_test_key", "_group_hit")


def build_fact(src: Sources, *, start=None, end=None, load_ts=None,
               panel_rule: str = "either", per_test_version: bool = False,
               price_code_rule: str = "test", keep_pricing_code: bool = False,
               keep_folder: bool = False, latest: DataFrame | None = None,
               pending_results: DataFrame | None = None) -> DataFrame:
    """Fact rows for results entered in ``[start, end)`` (unbounded if None).

    Options (SURVEY decisions): ``panel_rule`` 'either' | 'flag' | 'name';
    ``per_test_version`` picks the latest version pricing the row's code;
    ``price_code_rule`` 'test' | 'legacy' picks the group code used for the
    price lookup. ``pending_results`` (FOLDERNO, S) replaces the results as
    the source of the pending flag when those cover only a rolling window;
    ``latest`` (ORDNO, LatestResultDate) are the latest dates if they are known already;
    ``keep_folder`` adds FolderNo, which the stored fact keeps for its flags."""
    raw = src.results
    rows = valid_results(raw)
    if start is not None:
        rows = rows.where(F.col("DATEENTER") >= ts(start))
    if end is not None:
        rows = rows.where(F.col("DATEENTER") < ts(end))
    # Latest entry per order: any order in the fact has a result >= start, so
    # results before start cannot be its latest — that scan skips them.
    # Pending folders need every result (a pending result may be older), but
    # only two columns and a selective status filter.
    if latest is None:
        latest = flags.latest_result(raw if start is None else raw.where(F.col("DATEENTER") >= ts(start)), src.folders)
    pending = flags.pending_folders(raw if pending_results is None else pending_results)

    # a window has results of few folders: the others drop out before they get their columns
    only = None if start is None and end is None else rows.select("FOLDERNO").distinct()
    dim = folder_dimension(src, pending=pending, only=only)
    # the order's latest date joins the narrow results, before the folder's columns
    x = rows.join(latest, "ORDNO", "left").join(dim, "FOLDERNO")
    x = (x.withColumn("IsPanel", codes.is_panel("TESTGROUPNAME", "TESTPANEL", panel_rule))
          .withColumn("ResolvedTestCode", codes.resolved_testcode(
              "TESTCODE", "_testno", "_group_testcode", "_legacy_testcode"))
          .withColumn("_pricing_code", codes.pricing_code(
              "TESTCODE", "_testno", "_group_testcode", "_legacy_testcode", price_code_rule)))
    x = asof.asof_price(x, src.price_lists, src.prices, per_test=per_test_version,
                        list_col="PriceListId", time_col="DATEENTER",
                        code_col="_pricing_code")
    load = (F.current_timestamp().cast("timestamp_ntz") if load_ts is None else ts(load_ts))
    return x.select(
        "ORDNO", "COMPNAME", "ExternalId", "BirthDate", "ClientSampleId", "FirstName",
        "LastName", "DateCollected", "SpecSource",
        F.col("DATEENTER").alias("DateEnter"),
        F.col("TESTCODE").alias("SourceTestCode"), "ResolvedTestCode",
        F.col("TESTGROUPNAME").alias("TestGroupName"), "IsPanel",
        F.col("ANALYTE").alias("Analyte"), F.col("FINAL").alias("Final"),
        F.col("NUMRES").alias("NumRes"), "RN2",
        codes.cancel_status("S", "RN3").alias("CancelStatus"),
        F.coalesce("_pending", F.lit(False)).alias("HasPendingResults"),
        "Price", "PriceListId", "PriceListVersion",
        F.when(F.col("IsPanel"), F.lit("PANEL")).otherwise(F.lit("TEST")).alias("PricingMethod"),
        "Category", "State", "City", "Zip", "LatestResultDate",
        load.alias("ETL_LoadDate"),
        *([F.col("_pricing_code").alias("PricingCode")] if keep_pricing_code else []),
        *([F.col("FOLDERNO").alias("FolderNo")] if keep_folder else []),
    )
