"""As-of version vs brute force on random version tables (ties, NULL starts,
rows exactly on a boundary), with and without broadcast."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assaybook.operators import asof

BASE = dt.datetime(1996, 1, 1)
day = st.integers(min_value=0, max_value=2000)
version = st.tuples(st.sampled_from(["PL1", "PL2", "pl1 "]), st.integers(1, 6),
                    st.one_of(st.none(), day))
row = st.tuples(st.sampled_from(["PL1", "PL2", "PL3", "Pl2"]), day, st.integers(0, 86399))


def brute(lists, rows):
    out = {}
    for i, (lid, d, secs) in enumerate(rows):
        t = BASE + dt.timedelta(days=d, seconds=secs)
        cands = [(BASE + dt.timedelta(days=s), v) for (l, v, s) in lists
                 if s is not None and l.rstrip().lower() == lid.rstrip().lower()
                 and BASE + dt.timedelta(days=s) <= t]
        out[i] = max(cands)[1] if cands else None
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(version, min_size=0, max_size=8, unique_by=lambda x: (x[0].rstrip().lower(), x[1])),
       st.lists(row, min_size=1, max_size=12), st.booleans())
def test_asof_matches_brute_force(spark, lists, rows, shuffled):
    ldf = spark.createDataFrame(
        [(l, v, None if s is None else BASE + dt.timedelta(days=s), "Released", None) for l, v, s in lists],
        "PRICELISTID string, PRICELISTVERSION int, STARTDDATE timestamp_ntz, STATUS string, EXPDATE timestamp_ntz")
    rdf = spark.createDataFrame(
        [(i, l, BASE + dt.timedelta(days=d, seconds=s)) for i, (l, d, s) in enumerate(rows)],
        "id int, PRICELISTID string, DATEENTER timestamp_ntz")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if shuffled:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = asof.asof_version(rdf, ldf)
        got = {r["id"]: r["PriceListVersion"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert out.count() == len(rows)
    assert got == brute(lists, rows)
