"""The JDBC reader's generated queries and split options, checked against a
recording stand-in for ``spark.read`` (no database is available here)."""

import datetime as dt

from assaybook.sources import extract


class _Rows(list):
    def collect(self):
        return self


class _Reader:
    """Answers the boundary query from ``source`` (a DuckDB connection, or none)."""

    def __init__(self, log, source):
        self.log, self.source, self.opts = log, source, {}

    def format(self, f):
        self.opts["format"] = f
        return self

    def option(self, k, v):
        self.opts[k] = v
        return self

    def load(self):
        self.log.append(dict(self.opts))
        q = str(self.opts.get("query", ""))
        if "ROW_NUMBER()" in q:
            return _Rows(self.source.execute(q).fetchall() if self.source else [(10,), (40,), (70,)])
        return "df"

    def jdbc(self, url, table, predicates):
        self.log.append(self.opts | {"dbtable": table, "predicates": predicates, "url": url})
        return "df"


class _Spark:
    def __init__(self, source=None):
        self.log, self.source = [], source

    @property
    def read(self):
        return _Reader(self.log, self.source)


def test_jdbc_reader_split_and_pushdown():
    spark = _Spark()
    read = extract.jdbc_reader(spark, "jdbc:sqlserver://db", {"user": "u"}, rows_per_task=100_000)
    assert extract.extract_results(read, dt.date(1997, 1, 1)) == "df"
    bounds, data = spark.log[-2], spark.log[-1]
    assert bounds["query"] == ("SELECT k FROM (SELECT ORIGREC AS k, ROW_NUMBER() OVER (ORDER BY ORIGREC) AS r FROM RESULTS "
                               "WHERE DATEENTER >= '1997-01-01') q WHERE r % 100000 = 1")
    assert data["dbtable"].startswith("(SELECT ORIGREC, FOLDERNO, ORDNO, TESTCODE")
    assert data["dbtable"].endswith("FROM RESULTS WHERE DATEENTER >= '1997-01-01') t")
    assert data["predicates"] == ["ORIGREC < 40 OR ORIGREC IS NULL", "ORIGREC >= 40 AND ORIGREC < 70", "ORIGREC >= 70"]
    assert data["sessionInitStatement"] == "SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED"
    assert data["queryTimeout"] == 3600 and data["preferTimestampNTZ"] is True
    assert data["user"] == "u" and data["format"] == "jdbc"
    read("FOLDERS")
    assert len(spark.log[-1]["predicates"]) == 3 and "FOLDERNO" in spark.log[-1]["predicates"][0]
    read("METADATA_LOOKUP_VALUES", extract.LOOKUP_FILTER)
    assert spark.log[-1]["query"] == ("SELECT LOOKUP_NAME, VALUE, TEXT FROM METADATA_LOOKUP_VALUES "
                                      "WHERE LOOKUP_NAME = 'PanelPricing'")
    tables = extract.extract_all(read, dt.date(1997, 1, 1))
    assert sorted(tables) == sorted(extract.EXTRACT_COLUMNS)


def test_split_covers_every_key_once_and_evenly_under_gaps():
    """The recorded statements run on keys with gaps: no row is lost or read twice,
    no task reads more than twice its share."""
    import duckdb
    con = duckdb.connect()
    cols = ", ".join(f"{c} VARCHAR" for c in extract.EXTRACT_COLUMNS["RESULTS"] if c != "ORIGREC")
    con.execute(f"CREATE TABLE RESULTS (ORIGREC BIGINT, {cols})")
    # a dense head, a gap of a billion, a sparse tail; two rows without a key
    con.execute("INSERT INTO RESULTS (ORIGREC) SELECT i FROM range(9000) t(i) UNION ALL "
                "SELECT 1000000000 + i * 977 FROM range(1003) t(i) UNION ALL SELECT NULL FROM range(2)")
    spark = _Spark(con)
    extract.jdbc_reader(spark, "jdbc:x", rows_per_task=500)("RESULTS")
    data = spark.log[-1]
    where = data["dbtable"]
    each = [con.execute(f"SELECT count(*) FROM {where} WHERE {p}").fetchone()[0] for p in data["predicates"]]
    assert sum(each) == 10005 and len(each) == 21 and max(each) <= 2 * 500
    twice = " UNION ALL ".join(f"SELECT ORIGREC FROM {where} WHERE {p}" for p in data["predicates"])
    assert con.execute(f"SELECT count(*) FROM (SELECT ORIGREC FROM ({twice}) GROUP BY 1 HAVING count(*) > 1 "
                       "AND ORIGREC IS NOT NULL)").fetchone()[0] == 0
    # rows that come after the boundaries were counted belong to exactly one range
    for new in (-5, 500_000_000, 99_000_000_000):
        assert sum(con.execute(f"SELECT {new} >= 0 OR true WHERE {p.replace('ORIGREC', str(new))}").fetchone() is not None
                   for p in data["predicates"]) == 1
    assert extract.split_predicates("k", []) == extract.split_predicates("k", [7, 7]) == ["1 = 1"]


def test_staged_types_are_the_declared_ones(spark, tmp_path):
    """Integer order numbers and date-times survive staging under another time zone."""
    import pytest

    from assaybook import schemas
    from assaybook.sources.tables import read_staged, read_table
    day = dt.datetime(2025, 1, 31, 21, 0, 0, 123000)
    raw = spark.createDataFrame([(1, 7, 42, 300, "A", "F", "5", None, "N", "Released", day)],
                                "ORIGREC int, FOLDERNO int, ORDNO int, TESTCODE bigint, ANALYTE string, FINAL string, "
                                "NUMRES string, RN2 string, RN3 string, S string, DATEENTER timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        counts = extract.stage_all({"RESULTS": raw, "RESULTS_PENDING": raw.select("FOLDERNO", "S")}, str(tmp_path))
        row = read_table(spark, str(tmp_path), "RESULTS").first()
        zoned = raw.withColumn("DATEENTER", raw.DATEENTER.cast("timestamp"))
        with pytest.raises(TypeError):
            extract.stage(zoned, str(tmp_path / "z"), schemas.RESULTS)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert counts == {"RESULTS": 1, "RESULTS_PENDING": 1}
    assert (row.FOLDERNO, row.ORDNO, row.TESTCODE, row.DATEENTER) == (7, "42", 300, day)
    assert read_table(spark, str(tmp_path), "RESULTS_PENDING", extract.PENDING_SCHEMA).first() == (7, "Released")
    with pytest.raises(FileNotFoundError):
        read_staged(spark, str(tmp_path))
