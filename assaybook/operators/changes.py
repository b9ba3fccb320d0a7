"""Snapshot change capture (C1-C3, X1): the audit rows the source's
delete/insert/update triggers would write, derived by comparing two
snapshots of a table in one full outer join on the key.

* Delete — key only in the old snapshot, old row image;
* Create — key only in the new snapshot, new row image;
* Edit   — key in both and any column changed (NULL-safe, like EXCEPT), new row image.
           Text keys and cells compare as the source does: a change of case or of trailing
           blanks alone is no Edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaybook.functions.text import ci

# Fixed values of the trail: line end and the frame of a row image.
CRLF = "\r\n"


def xml_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, esc in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def _text(c: Column, is_time: bool, utc_offset_hours: int) -> Column:
    """Column value as text; timestamps as 'yyyy-MM-dd HH:mm:ss.SSS' followed
    by the UTC offset in hours and ':00'."""
    if is_time:
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS"),
                        F.lit(f"{utc_offset_hours}:00"))
    return c.cast("string")


def row_xml(cols, prefix: str, time_cols=(), utc_offset_hours: int = 0) -> Column:
    """``<?xml …?><ROWSET><ROW><COL>value</COL>…</ROW></ROWSET>`` with CRLF
    line ends, columns in name order, NULL as empty content."""
    parts = [F.lit(f"<?xml version = '1.0'?>{CRLF}<ROWSET>{CRLF} <ROW>{CRLF}")]
    for c in sorted(cols):
        raw = _text(F.col(f"{prefix}{c}"), c in time_cols, utc_offset_hours)
        v = F.coalesce(xml_escape(raw), F.lit(""))
        parts += [F.lit(f"  <{c}>"), v, F.lit(f"</{c}>{CRLF}")]
    parts.append(F.lit(f" </ROW>{CRLF}</ROWSET>{CRLF}"))
    return F.concat(*parts)


def row_cells(df: DataFrame, cols, prefix: str) -> Column:
    """A row as EXCEPT compares it: text cells under the source's collation (case
    and trailing blanks do not count), all others as they are; null equals null."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "varchar", "char")}
    return F.struct(*[(ci(f"{prefix}{c}") if c in text else F.col(f"{prefix}{c}")).alias(c) for c in cols])


def snapshot_diff(old: DataFrame, new: DataFrame, keys, table: str, cols=None, *,
                  utc_offset_hours: int = 0, audit: dict | None = None) -> DataFrame:
    """(keys…, TABLENAME, EVENT_TYPE, EVENTCODE, ROW_DATA) per changed key.

    ``audit`` adds the trail's job-level columns: DB_USER, APP_NAME,
    APP_USERNAME, AUDIT_DT (a timestamp), AUDIT_DT_OFFSET (minutes) and
    DB_SID; a snapshot with ORIGREC also gets ORIGINAL_ORIGREC."""
    keys = list(keys)
    cols = list(cols or [c for c in new.columns])
    time_cols = {f.name for f in new.schema.fields
                 if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")}
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_in_old"))
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_in_new"))
    cond = None
    for k in keys:
        a, b = o[f"_o_{k}"], n[f"_n_{k}"]
        e = ci(a) == ci(b) if new.schema[k].dataType.typeName() == "string" else a == b
        cond = e if cond is None else cond & e
    j = o.join(n, cond, "full_outer")
    same = row_cells(new, cols, "_o_").eqNullSafe(row_cells(new, cols, "_n_"))
    event = (F.when(F.col("_in_new").isNull(), F.lit("Delete"))
             .when(F.col("_in_old").isNull(), F.lit("Create"))
             .when(~same, F.lit("Edit")))
    data = F.when(F.col("_in_new").isNull(),
                  row_xml(cols, "_o_", time_cols, utc_offset_hours)).otherwise(
                  row_xml(cols, "_n_", time_cols, utc_offset_hours))
    extra = []
    if "ORIGREC" in cols:
        extra.append(F.coalesce("_n_ORIGREC", "_o_ORIGREC").alias("ORIGINAL_ORIGREC"))
    if audit is not None:
        extra += [F.lit(audit.get("user")).cast("string").alias("DB_USER"),
                 F.lit(audit.get("app", "SQLSERVER")).cast("string").alias("APP_NAME"),
                 F.lit(audit.get("user")).cast("string").alias("APP_USERNAME"),
                 F.lit(audit.get("at")).cast("timestamp_ntz").alias("AUDIT_DT"),
                 F.lit(int(utc_offset_hours) * 60).alias("AUDIT_DT_OFFSET"),
                 F.lit(audit.get("sid")).cast("int").alias("DB_SID")]
    return (j.select(*[F.coalesce(f"_n_{k}", f"_o_{k}").alias(k) for k in keys], *extra,
                     F.lit(table).alias("TABLENAME"), event.alias("EVENT_TYPE"),
                     F.lit("N/A").alias("EVENTCODE"), data.alias("ROW_DATA"))
            .where(F.col("EVENT_TYPE").isNotNull()))
