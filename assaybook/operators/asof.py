"""Point-in-time price: the price-list version in force when a result was
entered (an as-of join), then the test price of that version.

Versions become validity intervals ``[STARTDDATE, next STARTDDATE)`` per list
(``lead`` over the small version table). Versions sharing a start date give
the lower version an empty interval, so the highest version wins; versions
without a start date never match. A result matches at most one interval.

Physical plan: intervals are cut into (list, year) buckets and joined on the
bucket with the time range as a residual, a plain equi-join. Spark sends the
intervals to every task where the table's true size allows it and otherwise
shuffles by bucket, where AQE can split a hot one. A result is compared with
the versions of one list and year only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaybook.functions.text import ci


def price_intervals(price_lists: DataFrame, by_code: DataFrame | None = None) -> DataFrame:
    """(``_list_key``, PRICELISTVERSION, ``_from``, ``_until``) per version.

    With ``by_code`` (prices), intervals are built per (list, test code) from
    the versions that price that code (option ``per_test``)."""
    pl = (price_lists.where(F.col("STARTDDATE").isNotNull())
          .select(ci("PRICELISTID").alias("_list_key"), "PRICELISTVERSION",
                  F.col("STARTDDATE").alias("_from")))
    keys = ["_list_key"]
    if by_code is not None:
        codes = by_code.select(ci("PRICELISTID").alias("_list_key"), "PRICELISTVERSION",
                               F.col("TESTCODE").alias("_code")).distinct()
        pl = pl.join(codes, ["_list_key", "PRICELISTVERSION"])
        keys = ["_list_key", "_code"]
    w = Window.partitionBy(*keys).orderBy("_from", "PRICELISTVERSION")
    return pl.withColumn("_until", F.lead("_from").over(w))


def _covers(t, iv: DataFrame):
    return (t >= iv["_from"]) & (iv["_until"].isNull() | (t < iv["_until"]))


def asof_version(rows: DataFrame, price_lists: DataFrame, *, list_col="PRICELISTID",
                 time_col="DATEENTER", out_col="PriceListVersion",
                 code_col: str | None = None, prices: DataFrame | None = None) -> DataFrame:
    """Left-join the version in force at ``time_col`` onto every row."""
    iv = price_intervals(price_lists, prices if code_col else None)
    key_cols = ["_list_key"] + (["_code"] if code_col else [])
    iv = iv.select(*[F.col(k).alias("_iv" + k) for k in key_cols],
                   F.col("PRICELISTVERSION").alias(out_col), "_from", "_until")
    keyed = rows.withColumn("_list_key", ci(list_col))
    if code_col:
        keyed = keyed.withColumn("_code", F.col(code_col))
    return (_bucketed_join(keyed, iv, key_cols, time_col)
            .drop("_from", "_until", "_bucket", "_rbucket",
                  *key_cols, *["_iv" + k for k in key_cols]))


def _bucketed_join(keyed: DataFrame, iv: DataFrame, key_cols, time_col) -> DataFrame:
    """Range join as an equi-join on (key, year bucket) + range residual."""
    cap = dt.date.today().year + 1
    y_from = F.least(F.year("_from"), F.lit(cap))
    y_until = F.least(F.coalesce(F.year("_until"), F.lit(cap)), F.lit(cap))
    ivx = iv.withColumn("_rbucket",
                        F.explode(F.sequence(y_from, F.greatest(y_from, y_until))))
    lhs = keyed.withColumn("_bucket", F.least(F.year(time_col), F.lit(cap)))
    cond = [lhs[k] == ivx["_iv" + k] for k in key_cols]
    cond.append(lhs["_bucket"] == ivx["_rbucket"])
    cond.append(_covers(lhs[time_col], ivx))
    return lhs.join(ivx, cond, "left")


def test_price(rows: DataFrame, prices: DataFrame, *, list_col="PRICELISTID",
               version_col="PriceListVersion", code_col="_pricing_code",
               out_col="Price") -> DataFrame:
    """Left-join the price of (list, version, code)."""
    p = prices.select(ci("PRICELISTID").alias("_pk_list"),
                      F.col("PRICELISTVERSION").alias("_pk_version"),
                      F.col("TESTCODE").alias("_pk_code"),
                      F.col("PRICE").alias(out_col))
    cond = [ci(rows[list_col]) == p["_pk_list"],
            rows[version_col] == p["_pk_version"],
            rows[code_col] == p["_pk_code"]]
    return rows.join(p, cond, "left").drop("_pk_list", "_pk_version", "_pk_code")


def asof_price(rows: DataFrame, price_lists: DataFrame, prices: DataFrame, *,
               per_test: bool = False, list_col="PRICELISTID", time_col="DATEENTER",
               code_col="_pricing_code") -> DataFrame:
    """Version in force + its test price (J6). ``per_test`` picks the latest
    version that prices the row's code instead of the latest list version."""
    v = asof_version(rows, price_lists, list_col=list_col, time_col=time_col,
                     code_col=code_col if per_test else None,
                     prices=prices if per_test else None)
    return test_price(v, prices, list_col=list_col, code_col=code_col)
