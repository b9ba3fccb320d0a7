"""The audit table: appends and compactions that stop anywhere lose or double no row."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from assaybook.sources import audit, files
from assaybook.sources.manifest import ConcurrentPublishError

MONTH = "2024-03"


def _append(spark, d, n, now=dt.datetime(2024, 3, 5, 12)):
    return audit.audit_append(spark, d, user="u", year=1998, month=1, action="view", version="RWP", filename="screen",
                              row_count=n, status="success", now=now)


def _many(d, n, start=0):
    """Single files as appends leave them."""
    folder = d / f"month={MONTH}"
    folder.mkdir(parents=True, exist_ok=True)
    for i in range(start, start + n):
        pq.write_table(pa.table({
            "RowKey": [f"{9000 - i:08d}_x"], "User": ["u"],
            "Timestamp_UTC": pa.array([dt.datetime(2024, 3, 1) + dt.timedelta(minutes=i)], pa.timestamp("us")),
            "ReportYear": pa.array([1998], pa.int32()), "ReportMonth": pa.array([1], pa.int32()), "Action": ["view"],
            "Version": ["RWP"], "FileName": ["screen"], "RowCount": [i], "Status": ["success"]}),
            folder / f"row-{i:06d}.parquet")


def _counts(spark, d):
    rows = audit.audit_query(audit.read_audit(spark, str(d), MONTH), MONTH).collect()
    assert [r.Timestamp_UTC for r in rows] == sorted((r.Timestamp_UTC for r in rows), reverse=True)
    whole = audit.audit_query(audit.read_audit(spark, str(d)), MONTH).count()
    assert whole == len(rows)
    return sorted(r.RowCount for r in rows)


def test_a_busy_month_is_read_from_few_files(spark, tmp_path):
    d = tmp_path / "audit"
    _many(d, 2000)
    assert len(audit.read_audit(spark, str(d), MONTH).inputFiles()) == 2000
    assert audit.audit_compact(spark, str(d), MONTH) == 2000
    assert len(audit.read_audit(spark, str(d), MONTH).inputFiles()) <= 8
    assert _counts(spark, d) == list(range(2000))


@pytest.mark.parametrize("stop", ["read", "base", "entry", "cut entry", "cleanup"])
def test_a_compaction_that_stops_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, stop):
    d = tmp_path / "audit"
    _many(d, 40)
    assert audit.audit_compact(spark, str(d), MONTH, grace_s=0) == 40
    _many(d, 40, start=40)

    def lost(*a, **k):
        raise OSError("lost")
    if stop == "cut entry":
        files.write_text(spark, f"{d}/_compactions/{2:012d}.json", '{"months": {"20')
    else:
        owner, name = {"read": (audit, "_read"), "base": (files, "entries"), "entry": (audit.Manifest, "append"),
                       "cleanup": (audit.Manifest, "trim")}[stop]
        with monkeypatch.context() as m:
            if stop == "base":  # the base is written, its entry is not
                real = files.entries
                calls = []

                def entries(spark_, path):
                    calls.append(path)
                    if (tmp_path / "audit" / "_base").exists() and len(list((tmp_path / "audit" / "_base").iterdir())) > 1:
                        lost()
                    return real(spark_, path)
                m.setattr(owner, name, entries)
            else:
                m.setattr(owner, name, lost)
            with pytest.raises(OSError):
                audit.audit_compact(spark, str(d), MONTH, grace_s=0)
    assert _counts(spark, d) == list(range(80))
    _many(d, 40, start=80)
    audit.audit_compact(spark, str(d), MONTH, grace_s=0)
    audit.audit_compact(spark, str(d), MONTH, grace_s=0)
    assert _counts(spark, d) == list(range(120))
    assert len(audit.read_audit(spark, str(d), MONTH).inputFiles()) <= 8


def test_appends_go_on_during_a_compaction(spark, tmp_path, monkeypatch):
    d = tmp_path / "audit"
    _many(d, 40)
    real = audit.Manifest.append

    def append(self, body, seen):  # a request between the listing and the switch
        assert _append(spark, str(d), 1000)
        return real(self, body, seen)
    with monkeypatch.context() as m:
        m.setattr(audit.Manifest, "append", append)
        audit.audit_compact(spark, str(d), MONTH)
    assert _counts(spark, d) == [*range(40), 1000]
    # and another compaction at the same time gives way
    _many(d, 40, start=40)

    def late(self, body, seen):
        real(self, {"months": {}} | body, seen)
        return real(self, body, seen)
    with monkeypatch.context() as m, pytest.raises(ConcurrentPublishError):
        m.setattr(audit.Manifest, "append", late)
        audit.audit_compact(spark, str(d), MONTH)


def test_requests_at_the_same_time_are_all_logged(spark, tmp_path):
    d = str(tmp_path / "audit")
    with ThreadPoolExecutor(8) as pool:
        assert all(pool.map(lambda i: _append(spark, d, i), range(16)))
    assert _counts(spark, tmp_path / "audit") == list(range(16))
    assert not list((tmp_path / "audit" / "_incoming").iterdir())


def test_a_job_compacts_and_folded_files_go_later(spark, tmp_path):
    d = tmp_path / "audit"
    _many(d, 50)
    _append(spark, str(d), 7, dt.datetime(2024, 4, 1))
    assert audit.audit_compact_all(spark, str(d)) == {MONTH: 50}
    left = lambda: len(list((d / f"month={MONTH}").glob("*.parquet")))
    assert left() == 50  # a reader of the state before may still need them
    assert audit.audit_compact_all(spark, str(d), grace_s=0) == {} and left() == 0
    assert _counts(spark, d) == list(range(50))
    with pytest.raises(ValueError):
        audit.audit_compact(spark, str(d), "2024-3")
    assert audit.read_audit(spark, str(tmp_path / "none")).collect() == []
