"""The legacy released-price report (E3), kept alongside the new report
for reconciliation. Differences from the new report are intended:

* price = MIN over *released* versions of the test price, no point in time;
* panel code/price come from the whole lookup table (no typed filter);
* pending folders and orders with later results are removed with
  NOT EXISTS on raw results, not with precomputed flags;
* the special client's samples are removed after aggregation, on the
  group's MIN(EXTERNAL_ID).

The source fans out over every price version and lookup row and relies on
MIN to hide it; here the released prices and the two lookups are first
reduced to one row per join key (exact for MIN/MAX), so no row multiplies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook import schemas
from assaybook.functions import codes
from assaybook.functions.text import ci, ci_contains, ci_in, ci_ne, ci_startswith
from assaybook.operators import flags
from assaybook.operators.filters import billable_client, in_window
from assaybook.operators.panels import legacy_lookup_by_text, legacy_lookup_by_value
from assaybook.plans.fact import folder_dimension
from assaybook.sources.tables import Sources

# The company list of the special-client selection (note the
# literal 'ZZZ%' inside NOT IN, which matches nothing).
SPECIAL_SET_EXCLUDED = [
    "Test RightFax 1", "Test RightFax 4", "ACCL0933", "RESEARCH ONLY",
    "MiraVista Quality System", "Greater Than", "Additional Positive Unconfirmed", "ZZZ%",
]


def released_prices(src: Sources) -> DataFrame:
    """(list key, code) -> MIN(PRICE) over versions with status Released."""
    pl = (src.price_lists.where(ci("STATUS") == "released")
          .select(ci("PRICELISTID").alias("_rl"), F.col("PRICELISTVERSION").alias("_rv")))
    p = src.prices.select(ci("PRICELISTID").alias("_pl"), "PRICELISTVERSION", "TESTCODE", "PRICE")
    j = p.join(pl, (p["_pl"] == pl["_rl"]) & (p["PRICELISTVERSION"] == pl["_rv"]))
    return (j.groupBy(F.col("_pl").alias("_lp_list"), F.col("TESTCODE").alias("_lp_code"))
            .agg(F.min("PRICE").alias("_released_price")))


def _with_released_price(rows: DataFrame, src: Sources) -> DataFrame:
    rp = released_prices(src)
    cond = (ci(rows["PriceListId"]) == rp["_lp_list"]) & (rows["_pricing_code"] == rp["_lp_code"])
    return rows.join(rp, cond).drop("_lp_list", "_lp_code")


def special_client_rows(compname="COMPNAME") -> "F.Column":
    return (~ci_in(compname, SPECIAL_SET_EXCLUDED)
            & ci_startswith(compname, codes.SPECIAL_CLIENT_PREFIX))


def special_clients(src: Sources) -> DataFrame:
    return src.clients.where(special_client_rows())


def _base_rows(src: Sources, cal_date, cal_end, pending: DataFrame | None = None) -> DataFrame:
    """Window results with a real result and a billable code, joined to
    folder/sample/any client/test group/test, priced at a released version.
    With ``pending`` the folders carry that flag, so the pending rule costs no
    join of the result rows."""
    r = src.results.where(in_window("DATEENTER", cal_date, cal_end)
                          & ~ci_in("NUMRES", codes.NO_RESULT_VALUES)
                          & ~F.col("TESTCODE").isin(codes.EXCLUDED_TESTCODES))
    md, nd = legacy_lookup_by_value(src.lookup), legacy_lookup_by_text(src.lookup)
    fd = folder_dimension(src, billable_only=False, pending=pending)
    fd = fd.withColumn("_gk", ci("TESTGROUPNAME"))
    fd = (fd.join(md, fd["_gk"] == md["_md_key"], "left")
            .join(nd, fd["_gk"] == nd["_nd_key"], "left")
            .drop("_gk", "_md_key", "_nd_key"))
    x = r.join(fd, "FOLDERNO")
    x = x.withColumn("_pricing_code", codes.pricing_code("TESTCODE", "_testno", "_group_testcode"))
    return _with_released_price(x, src)


def special_samples(src: Sources, cal_date, cal_end) -> DataFrame:
    """Distinct samples of the special client (J14): no status, category,
    pending or later-result rule applies to this set. Its own scan of the
    window: the client and code filters reach the tables before the shuffle."""
    base = _base_rows(src, cal_date, cal_end)
    return (base.where(special_client_rows() & (F.col("TESTCODE") == codes.SPECIAL_CLIENT_TESTCODE))
            .select("ExternalId").distinct())


def legacy_rows(src: Sources, cal_date, cal_end) -> DataFrame:
    """Result rows entering the legacy aggregate (pending folders removed)."""
    base = _base_rows(src, cal_date, cal_end, flags.pending_folders(src.results))
    return base.where(F.col("_pending").isNull() & ci_ne("S", codes.CANCEL)
                      & billable_client("COMPNAME", "Category"))


def legacy_report(src: Sources, cal_date, cal_end, *, pii: bool = True) -> DataFrame:
    # grouped under the collation, aggregated map-side first: a hot order is a
    # few rows before the later-results rule, which depends on ORDNO only
    g = legacy_rows(src, cal_date, cal_end).groupBy("ORDNO", ci("COMPNAME").alias("_comp")).agg(
        F.min("COMPNAME").alias("COMPNAME"),
        F.min("BirthDate").alias("BIRTH_DATE"),
        F.min("ClientSampleId").alias("CLIENT_SAMPLE_ID"),
        F.min("DateCollected").alias("DATE_COLLECTED"),
        F.min("ExternalId").alias("EXTERNAL_ID"),
        F.min("FirstName").alias("FIRST_NAME"), F.min("LastName").alias("LAST_NAME"),
        F.min("SpecSource").alias("SPEC_SOURCE"),
        F.min("TESTGROUPNAME").alias("_g"), F.min("_testno").alias("_tno"),
        F.min("_group_testcode").alias("_gtc"), F.min("TESTCODE").alias("_src"),
        F.min("_legacy_testcode").alias("_leg"),
        F.min("nd_value").alias("_ndv"), F.min("nd_text").alias("_ndt"),
        F.min("md_value").alias("_mdv"), F.min("md_text").alias("_mdt"),
        F.min("_released_price").alias("_price"),
        F.min("Category").alias("CATEGORY"), F.max("DATEENTER").alias("DATEENTER"),
        F.min("FINAL").alias("FINAL"), F.min("NUMRES").alias("NUMRES"),
        F.min("RN2").alias("RN2"), F.min("PriceListId").alias("PRICELISTID"),
        F.min("State").alias("STATE"), F.min("City").alias("CITY"),
        F.min("Zip").alias("ZIP"), F.min("S").alias("_s"), F.min("RN3").alias("_rn3"))
    g = flags.drop_orders_with_later_results(g, src.results, src.folders, cal_end)
    panel = F.coalesce(ci_contains("_g", "panel"), F.lit(False))
    testcode = F.when(panel, F.when(ci("_ndt") == ci("_g"), codes.parse_int("_ndv"))).otherwise(
        codes.resolved_testcode("_src", "_tno", "_gtc", "_leg"))
    price = F.when(panel, F.when(ci("_mdv") == ci("_g"), codes.parse_price("_mdt"))).otherwise(
        F.col("_price"))
    cancel = (F.when(ci("_s") == "cancel", F.col("_s"))
              .when(ci("_rn3") == "c", F.lit(codes.CANCEL)).otherwise(F.lit(" ")))
    out = g.select(
        "BIRTH_DATE", "CLIENT_SAMPLE_ID", "DATE_COLLECTED", "EXTERNAL_ID", "FIRST_NAME",
        "LAST_NAME", "SPEC_SOURCE", testcode.alias("TESTCODE"), "CATEGORY", "COMPNAME",
        "DATEENTER", "FINAL", "NUMRES", "RN2", price.alias("PRICE"), "PRICELISTID", "ORDNO",
        "STATE", "CITY", "ZIP", cancel.alias("CANCEL_STATUS"))
    # the anti-join runs on aggregated rows, one per order and company
    sk = special_samples(src, cal_date, cal_end).select(ci("ExternalId").alias("_sk")).distinct()
    out = out.join(sk, ci(out["EXTERNAL_ID"]) == sk["_sk"], "left_anti")
    return out if pii else out.drop(*schemas.PII)
