import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_every_query_has_an_oracle():
    assert set(E._QUERIES) == set(E.O.queries()) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["BIRTH_DATE", "CLIENT_SAMPLE_ID", "DATE_COLLECTED"]
    assert "ZIP" in df.columns and "CANCEL_STATUS" in df.columns
