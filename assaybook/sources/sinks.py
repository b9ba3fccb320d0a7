"""Report sinks: CSV and JSON records formatted like the report service
(NULL -> empty / null, ISO timestamps, decimals as text), and the tab split
of the spreadsheet export. Each formatter is a column expression, so the
formatting runs in the executors and the write is a normal distributed
write; the final ORDER BY happens only here (O1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso(c: Column) -> Column:
    """Python-style isoformat: seconds, plus .ffffff only when non-zero."""
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", base).otherwise(
        F.concat(base, F.lit("."), F.date_format(c, "SSSSSS")))


def _text(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return iso(c)
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit("False"))
    return c.cast("string")


def csv_field(df: DataFrame, name: str) -> Column:
    s = _text(df, name)
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    needs = s.contains(",") | s.contains('"') | s.contains("\n")
    return F.coalesce(F.when(needs, quoted).otherwise(s), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV text line per row (no header): leading/trailing blanks kept,
    NULL empty, fields quoted only for comma, quote or newline."""
    return df.select(F.concat_ws(",", *[csv_field(df, c) for c in df.columns]).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row: every key present (null kept), timestamps ISO
    text, decimals as text, numbers and booleans native."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType)):
            c = _text(df, f.name)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def _order(df: DataFrame) -> list[str]:
    return ["Facility" if "Facility" in df.columns else "COMPNAME", "ORDNO"]


def sort_report(df: DataFrame) -> DataFrame:
    return df.orderBy(*_order(df))


def write_csv(df: DataFrame, path: str, sort: bool = True) -> None:
    """CSV text exactly as ``csv_lines`` has it. The first file holds the header
    alone, so the files in name order are the whole document and an empty
    report still has its header."""
    rows = sort_report(df) if sort else df
    header = df.sparkSession.range(1).select(F.lit(csv_header(df)).alias("line"))
    header.coalesce(1).union(csv_lines(rows)).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, sort: bool = True) -> None:
    (sort_report(df) if sort else df).transform(json_records).write.mode("overwrite").text(path)


def write_tabs(tabbed: DataFrame, path: str, names: list[str]) -> dict[str, int]:
    """One folder per tab (the spreadsheet's sheets), each CSV text as
    ``write_csv`` writes it, empty tabs included; returns the rows of each.

    The order is asked for at the write itself: rows are range-partitioned and
    sorted on (tab, header first, Facility, ORDNO). That begins with the folder's
    column, which is the order a partitioned write needs, so it adds no sort of
    its own that could undo ours; the files of a tab in name order are sorted
    however many tasks write them."""
    body = tabbed.drop("tab")
    keys = _order(body)
    lines = tabbed.select("tab", F.lit(1).alias("_part"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                          F.concat_ws(",", *[csv_field(body, c) for c in body.columns]).alias("line"))
    nothing = [F.lit(None).cast(body.schema[k].dataType).alias(f"_k{i}") for i, k in enumerate(keys)]
    headers = (tabbed.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("tab"),
                                                   F.lit(0).alias("_part"), *nothing,
                                                   F.lit(csv_header(body)).alias("line")))
    obs = Observation("tab_rows")
    ordered = (headers.union(lines).orderBy("tab", "_part", *[f"_k{i}" for i in range(len(keys))])
               .observe(obs, *[F.count_if((F.col("tab") == n) & (F.col("_part") == 1)).alias(f"n{i}")
                               for i, n in enumerate(names)]))
    ordered.select("tab", "line").write.mode("overwrite").partitionBy("tab").text(path)
    return {n: int(obs.get[f"n{i}"]) for i, n in enumerate(names)}
