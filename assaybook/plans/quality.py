"""Reconciliation between the legacy and the new report, and data-quality
listings (J15-J18, A7-A10, D-a ... D-f)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.functions.text import ci
from assaybook.operators.filters import in_window, month_key_between, ts
from assaybook.plans.legacy import released_prices
from assaybook.plans.views import view_keeps
from assaybook.schemas import PII
from assaybook.operators.panels import with_panel_lookups

STATUS_OLD_ONLY, STATUS_NEW_ONLY, STATUS_DIFF = "old_only", "new_only", "diff"


def _keyed(df: DataFrame, prefix: str, cols) -> DataFrame:
    return df.select(F.col("ORDNO").alias(f"_{prefix}_ordno"),
                     ci("COMPNAME").alias(f"_{prefix}_comp"),
                     *[F.col(c).alias(f"{prefix.upper()}_{c}") for c in cols])


def reconcile_price(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both reports of one window, full outer join on (ORDNO, COMPNAME): rows
    only in one, or with a different price (J15, intended form)."""
    o = _keyed(old, "old", ["COMPNAME", "TESTCODE", "DATEENTER", "PRICE", "PRICELISTID"])
    n = _keyed(new, "new", ["COMPNAME", "TESTCODE", "DATEENTER", "PRICE"])
    j = o.join(n, (o["_old_ordno"] == n["_new_ordno"]) & (o["_old_comp"] == n["_new_comp"]),
               "full_outer")
    status = (F.when(F.col("_old_ordno").isNull(), F.lit(STATUS_NEW_ONLY))
              .when(F.col("_new_ordno").isNull(), F.lit(STATUS_OLD_ONLY))
              .when(F.coalesce("OLD_PRICE", F.lit(-1)) != F.coalesce("NEW_PRICE", F.lit(-1)),
                    F.lit(STATUS_DIFF)))
    diff = F.abs(F.coalesce("OLD_PRICE", F.lit(0)) - F.coalesce("NEW_PRICE", F.lit(0)))
    return (j.select(
        F.coalesce("_old_ordno", "_new_ordno").alias("ORDNO"),
        F.coalesce("OLD_COMPNAME", "NEW_COMPNAME").alias("COMPNAME"),
        "OLD_TESTCODE", "NEW_TESTCODE", "OLD_DATEENTER", "NEW_DATEENTER",
        "OLD_PRICE", "NEW_PRICE", F.col("OLD_PRICELISTID").alias("PRICELISTID"),
        diff.cast("decimal(10,2)").alias("PRICE_DIFF"), status.alias("STATUS"))
        .where(F.col("STATUS").isNotNull()))


def panel_rows_in_order(rows: DataFrame) -> DataFrame:
    """O5: the panel listing by company, then order."""
    return rows.orderBy("COMPNAME", "ORDNO", "TESTCODE", "PRICE")


def unpriced_in_order(rows: DataFrame) -> DataFrame:
    """O5: the unpriced listing by company."""
    return rows.orderBy("COMPNAME", "ORDNO", "DateEnter")


def most_results_first(orders: DataFrame) -> DataFrame:
    """O5: the multi-row orders, most results first."""
    return orders.orderBy(F.col("ResultCount").desc(), "ORDNO", "COMPNAME")


def largest_differences_first(diffs: DataFrame) -> DataFrame:
    """O3: the reconciliation listing ordered by |price difference|, largest
    first (a global sort, applied only where the listing is written)."""
    return diffs.orderBy(F.col("PRICE_DIFF").desc(), F.col("ORDNO"), F.col("COMPNAME"))


def reconcile_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Orders in both reports whose test code or cancel status differ (J16).
    Cancel statuses compare blank-insensitively (' ' equals '')."""
    o = _keyed(old, "old", ["COMPNAME", "TESTCODE", "CANCEL_STATUS"])
    n = _keyed(new, "new", ["TESTCODE", "CANCEL_STATUS"])
    j = o.join(n, (o["_old_ordno"] == n["_new_ordno"]) & (o["_old_comp"] == n["_new_comp"]))
    tc = F.coalesce(F.col("OLD_TESTCODE") != F.col("NEW_TESTCODE"), F.lit(False))
    cs = (F.rtrim(F.coalesce("OLD_CANCEL_STATUS", F.lit("")))
          != F.rtrim(F.coalesce("NEW_CANCEL_STATUS", F.lit(""))))
    return (j.select(F.col("_old_ordno").alias("ORDNO"), F.col("OLD_COMPNAME").alias("COMPNAME"),
                     "OLD_TESTCODE", "NEW_TESTCODE", "OLD_CANCEL_STATUS", "NEW_CANCEL_STATUS",
                     tc.alias("TESTCODE_DIFFERS"), cs.alias("CANCEL_DIFFERS"))
            .where(F.col("TESTCODE_DIFFERS") | F.col("CANCEL_DIFFERS")))


def reconcile_counts(old: DataFrame, new: DataFrame, view: DataFrame, cal_date, cal_end) -> DataFrame:
    """Row counts of both reports and of the view rows in the window (A7):
    one union of tagged rows, one aggregate, one output row."""
    win = view.where(month_key_between(cal_date, cal_end, "_partition_year", "_partition_month")
                     & in_window("DATEENTER", cal_date, cal_end))
    tagged = (old.select(F.lit(0).alias("_src"))
              .unionAll(new.select(F.lit(1).alias("_src")))
              .unionAll(win.select(F.lit(2).alias("_src"))))
    return tagged.agg(F.count_if(F.col("_src") == 0).alias("OLD_ROWS"),
                      F.count_if(F.col("_src") == 1).alias("NEW_ROWS"),
                      F.count_if(F.col("_src") == 2).alias("VIEW_ROWS"))


def pending_counts(fact: DataFrame, lookup: DataFrame) -> DataFrame:
    """PendingInFact, RowsInView, TotalInFact in one pass over the fact (A9);
    RowsInView <= TotalInFact is the D-d invariant."""
    x = with_panel_lookups(fact, lookup)
    return x.agg(F.count_if(F.col("HasPendingResults")).alias("PendingInFact"),
                 F.count_if(view_keeps()).alias("RowsInView"),
                 F.count(F.lit(1)).alias("TotalInFact"))


def fact_window(fact: DataFrame, cal_date, cal_end) -> DataFrame:
    return fact.where(month_key_between(cal_date, cal_end) & in_window("DateEnter", cal_date, cal_end))


def unpriced_results(fact: DataFrame, cal_date, cal_end) -> DataFrame:
    """Fact rows without a point-in-time price (D-a; reads the fact, since the
    view already drops them)."""
    return (fact_window(fact, cal_date, cal_end).where(F.col("Price").isNull())
            .select("ORDNO", "COMPNAME", F.col("ResolvedTestCode").alias("TESTCODE"),
                    "DateEnter", "PriceListId", "PricingMethod"))


def panel_rows(view: DataFrame, cal_date, cal_end) -> DataFrame:
    """Panel rows of the view with price and method (D-b)."""
    win = view.where(month_key_between(cal_date, cal_end, "_partition_year", "_partition_month")
                     & in_window("DATEENTER", cal_date, cal_end))
    return (win.where(F.col("IsPanel") == F.lit(True))
            .select("ORDNO", "COMPNAME", "TESTCODE", "PRICE", "PricingMethod", "IsPanel"))


def multi_row_orders(fact: DataFrame, cal_date, cal_end) -> DataFrame:
    """(ORDNO, COMPNAME) with more than one fact row in the window (A8)."""
    return (fact_window(fact, cal_date, cal_end).groupBy("ORDNO", ci("COMPNAME").alias("_comp"))
            .agg(F.min("COMPNAME").alias("COMPNAME"), F.count(F.lit(1)).alias("ResultCount"))
            .where(F.col("ResultCount") > 1).drop("_comp"))


def boundary_results(fact: DataFrame, price_lists: DataFrame, since) -> DataFrame:
    """Results entered on a calendar day some price version started (J18)."""
    days = (price_lists.where(F.col("STARTDDATE").isNotNull())
            .select(F.to_date("STARTDDATE").alias("_day")).distinct())
    f = fact.where(F.col("DateEnter") >= ts(since))
    if "year" in fact.columns and "month" in fact.columns:
        d = since if isinstance(since, dt.date) else dt.date.fromisoformat(str(since)[:10])
        f = f.where(F.col("year") * 100 + F.col("month") >= d.year * 100 + d.month)
    return (f.join(days, F.to_date(f["DateEnter"]) == days["_day"], "left_semi")
            .select("ORDNO", "DateEnter", "Price", "PriceListId", "PriceListVersion"))


def version_changes(price_lists: DataFrame, start, end) -> DataFrame:
    """Price-list versions that started inside the window (D-c)."""
    return (price_lists.where(F.col("STARTDDATE").between(ts(start), ts(end)))
            .select("PRICELISTID", "PRICELISTVERSION", "STARTDDATE", "STATUS"))


def versions_in_order(versions: DataFrame) -> DataFrame:
    """O5: the price-version listing by list, then version. Lists are one under the
    collation; spellings of one list and version keep a fixed order."""
    return versions.orderBy(ci("PRICELISTID"), "PRICELISTVERSION", "PRICELISTID")


def price_drift(fact_with_code: DataFrame, src, cal_date, cal_end) -> DataFrame:
    """Per result in the window: point-in-time price vs the legacy released
    price of the same code (D-f); rows where they differ."""
    rp = released_prices(src)
    f = fact_with_code.where(in_window("DateEnter", cal_date, cal_end))
    j = f.join(rp, (ci(f["PriceListId"]) == rp["_lp_list"]) & (f["PricingCode"] == rp["_lp_code"]),
               "left")
    out = j.select("ORDNO", "COMPNAME", "DateEnter", "PriceListId", "PriceListVersion",
                   "PricingCode", F.col("Price").alias("ASOF_PRICE"),
                   F.col("_released_price").alias("RELEASED_PRICE"))
    return out.where(~F.col("ASOF_PRICE").eqNullSafe(F.col("RELEASED_PRICE")))


def assert_no_pii(df: DataFrame) -> None:
    """A10: the no-PII frame must not carry any PII column."""
    leaked = sorted(set(c.upper() for c in df.columns) & set(PII))
    if leaked:
        raise AssertionError(f"PII columns present: {leaked}")
