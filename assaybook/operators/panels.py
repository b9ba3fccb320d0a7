"""Panel code and panel price lookups over the dual-row key/value table.

Rows are either (code -> panel name) or (panel name -> price). Names that
differ only in case or trailing blanks are one name, so each key yields one
row per value and no fact row multiplies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.functions.codes import is_int_text, parse_int, parse_price
from assaybook.functions.text import ci, ci_eq

PANEL_LOOKUP = "PanelPricing"


def panel_codes(lookup: DataFrame, name: str = PANEL_LOOKUP) -> DataFrame:
    """DISTINCT (TEXT, code): VALUE is an integer and TEXT is not (J7)."""
    rows = lookup.where(ci_eq("LOOKUP_NAME", name) & parse_int("VALUE").isNotNull()
                        & parse_int("TEXT").isNull())
    return (rows.groupBy(ci("TEXT").alias("_key"), parse_int("VALUE").alias("PanelCode"))
            .agg(F.min("TEXT").alias("PanelName")).select("PanelName", "PanelCode"))


def panel_prices(lookup: DataFrame, name: str = PANEL_LOOKUP) -> DataFrame:
    """DISTINCT (panel name, price text): VALUE not an integer, TEXT a price (J8)."""
    rows = lookup.where(ci_eq("LOOKUP_NAME", name) & parse_int("VALUE").isNull()
                        & parse_price("TEXT").isNotNull())
    return (rows.groupBy(ci("VALUE").alias("_key"), ci("TEXT").alias("_price"))
            .agg(F.min("VALUE").alias("PanelName"), F.min("TEXT").alias("PanelPriceText"))
            .select("PanelName", "PanelPriceText"))


def with_panel_lookups(fact: DataFrame, lookup: DataFrame, *,
                       group_col="TestGroupName", panel_col="IsPanel") -> DataFrame:
    """Left-join PanelCode and PanelPrice onto panel rows only."""
    pc = panel_codes(lookup).select(ci("PanelName").alias("_pc_key"), "PanelCode")
    pp = panel_prices(lookup).select(ci("PanelName").alias("_pp_key"),
                                     parse_price("PanelPriceText").alias("PanelPrice"))
    key = ci(group_col)
    out = fact.join(pc, (key == pc["_pc_key"]) & F.col(panel_col), "left")
    out = out.join(pp, (key == pp["_pp_key"]) & F.col(panel_col), "left")
    return out.drop("_pc_key", "_pp_key")


def panel_price_book(lookup: DataFrame, name: str = PANEL_LOOKUP) -> DataFrame:
    """Code row joined to its price row (J17): PanelCode, PanelName, ExpectedPrice."""
    code_rows = lookup.where(ci_eq("LOOKUP_NAME", name)
                             & parse_price("VALUE").isNotNull()).alias("c")
    price_rows = lookup.where(ci_eq("LOOKUP_NAME", name)).alias("p")
    out = code_rows.join(price_rows, ci(F.col("c.TEXT")) == ci(F.col("p.VALUE")))
    return out.select(F.col("c.VALUE").alias("PanelCode"),
                      F.col("c.TEXT").alias("PanelName"),
                      F.col("p.TEXT").alias("ExpectedPrice"))


def legacy_lookup_by_value(lookup: DataFrame) -> DataFrame:
    """Whole table keyed on VALUE, reduced to MIN(VALUE), MIN(TEXT) per key —
    exact for the legacy report, which only takes MINs of this join (J9)."""
    return (lookup.groupBy(ci("VALUE").alias("_md_key"))
            .agg(F.min("VALUE").alias("md_value"), F.min("TEXT").alias("md_text")))


def legacy_lookup_by_text(lookup: DataFrame) -> DataFrame:
    return (lookup.groupBy(ci("TEXT").alias("_nd_key"))
            .agg(F.min("VALUE").alias("nd_value"), F.min("TEXT").alias("nd_text")))


__all__ = ["panel_codes", "panel_prices", "with_panel_lookups", "panel_price_book",
           "legacy_lookup_by_value", "legacy_lookup_by_text", "is_int_text"]
