"""Publish gate: what a fact must satisfy before it goes live.

All figures are observed by the one job that writes the rows, so the check costs
no second scan, and it runs before the switch: a broken rule leaves the old fact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from assaybook.functions.codes import parse_price
from assaybook.functions.text import ci
from assaybook.operators.panels import panel_codes, panel_prices


class GateError(RuntimeError):
    """A written run broke a rule; it was not published."""


class EmptyOutputError(GateError):
    """The transform produced no rows; nothing was published."""


@dataclass(frozen=True)
class Metrics:
    rows: int
    pending: int
    unpriced: int
    view_rows: int | None      # None: no lookup was given


@dataclass(frozen=True)
class Gate:
    """Rules on the metrics of a run. ``max_unpriced`` is the largest share of
    rows without a price (None: any)."""
    allow_empty: bool = False
    max_unpriced: float | None = None

    def check(self, m: Metrics) -> None:
        if m.rows == 0 and not self.allow_empty:
            raise EmptyOutputError("transform produced 0 rows")
        if m.view_rows is not None and m.view_rows > m.rows:
            raise GateError(f"the view would have {m.view_rows} rows of {m.rows} in the fact: "
                            "a panel has more than one code or price")
        if self.max_unpriced is not None and m.rows and m.unpriced > self.max_unpriced * m.rows:
            raise GateError(f"{m.unpriced} of {m.rows} rows have no price, more than {self.max_unpriced:.0%}")


def _view_rows(df: DataFrame, lookup: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` with the number of codes and prices of its panel, and the rows that
    the priced view makes of each row. A lookup row per panel: nothing multiplies."""
    codes = panel_codes(lookup).groupBy(ci("PanelName").alias("_gate_c")).agg(F.count("*").alias("_gate_codes"))
    prices = (panel_prices(lookup).where(parse_price("PanelPriceText").isNotNull())
              .groupBy(ci("PanelName").alias("_gate_p")).agg(F.count("*").alias("_gate_prices")))
    key = ci("TestGroupName")
    out = (df.join(codes, (key == codes["_gate_c"]) & F.col("IsPanel"), "left")
           .join(prices, (key == prices["_gate_p"]) & F.col("IsPanel"), "left"))
    made = (F.when(F.col("HasPendingResults"), 0)
            .when(F.col("IsPanel"), F.coalesce("_gate_codes", F.lit(1)) * F.coalesce("_gate_prices", F.lit(0)))
            .when(F.col("Price").isNotNull(), 1).otherwise(0))
    return out, made


class Watch:
    """Observation of the rows on their way to the files."""

    def __init__(self, lookup: DataFrame | None = None):
        self._obs, self._lookup = Observation("fact_write"), lookup

    def observe(self, df: DataFrame) -> DataFrame:
        cols = df.columns
        what = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("HasPendingResults")).alias("pending"),
                F.count_if(F.col("Price").isNull() & ~F.col("IsPanel")).alias("unpriced")]
        if self._lookup is not None:
            df, made = _view_rows(df, self._lookup)
            what.append(F.sum(made).alias("view_rows"))
        return df.observe(self._obs, *what).select(*cols)

    def metrics(self) -> Metrics:
        got = self._obs.get
        view = int(got["view_rows"] or 0) if self._lookup is not None else None
        return Metrics(int(got["rows"]), int(got["pending"]), int(got["unpriced"]), view)
