"""Staging: one consistent set of tables for readers, whatever a staging run does."""

import dataclasses
import datetime as dt

import pytest

from assaybook.plans import jobs
from assaybook.sources import extract, files, snapshots
from assaybook.sources.manifest import KEEP
from assaybook.sources.tables import as_dict, read_staged, read_table
from test_jobs import _src


def _altered(src):
    """The source a day later: every table has one row more."""
    more = {name: df.unionByName(df.limit(1)) for name, df in as_dict(src).items()}
    return dataclasses.replace(src, **dict(zip(
        [f.name for f in dataclasses.fields(src) if f.name != "origin"], more.values(), strict=True)))


def _rows(src):
    return {name: sorted(map(tuple, df.collect()), key=repr) for name, df in as_dict(src).items()}


TABLES = list(extract.EXTRACT_COLUMNS)


@pytest.mark.parametrize("stop", [*TABLES, "marker", "switch", "cut entry"])
def test_a_run_that_stops_anywhere_leaves_the_old_set(spark, tmp_path, monkeypatch, stop):
    src, d = _src(spark), str(tmp_path / "staging")
    first = extract.stage_snapshot(extract.extract_all(extract.fixture_reader(src)), d)
    before = _rows(read_staged(spark, d))
    later = extract.extract_all(extract.fixture_reader(_altered(src)))

    def lost(*a, **k):
        raise OSError("lost")
    if stop == "cut entry":
        files.write_text(spark, f"{d}/{snapshots.LOG}/{2:012d}.json", '{"version": "v-')
    else:
        with monkeypatch.context() as m:
            if stop == "marker":
                m.setattr(files, "write_text", lost)
            elif stop == "switch":
                m.setattr(snapshots.Manifest, "append", lost)
            else:  # the copies before this table are written
                real = extract.stage
                m.setattr(extract, "stage", lambda df, path, *a, **k: (
                    lost() if path.endswith(f"/{stop}") else real(df, path, *a, **k)))
            with pytest.raises(OSError):
                extract.stage_snapshot(later, d, parallel=1)
    assert snapshots.live_snapshot(spark, d) == first
    assert _rows(read_staged(spark, d)) == before
    second = extract.stage_snapshot(later, d)
    assert snapshots.live_snapshot(spark, d) == second
    assert {n: len(r) for n, r in _rows(read_staged(spark, d)).items()} == second.rows != first.rows


def test_readers_keep_their_set_while_staging_runs(spark, tmp_path, monkeypatch):
    src, d = _src(spark), str(tmp_path / "staging")
    staging, fact = d, str(tmp_path / "fact")
    jobs.nightly_build(spark, extract.fixture_reader(src), staging, fact, now=dt.date(1998, 6, 30))
    pinned = snapshots.live_snapshot(spark, staging)
    held = read_staged(spark, staging)
    before = _rows(held)
    answers = []
    real = extract.stage

    def stage(df, path, *a, **k):  # a report between any two copies
        n = real(df, path, *a, **k)
        answers.append(jobs.report_request(spark, fact, staging, "1998-01-01", "1998-12-31", "RWP", "json",
                                           str(tmp_path / f"rep{len(answers)}")))
        assert read_staged(spark, staging).origin == pinned.folder
        return n
    monkeypatch.setattr(extract, "stage", stage)
    extract.stage_snapshot(extract.extract_all(extract.fixture_reader(_altered(src))), staging, parallel=1)
    assert answers == [2] * len(TABLES)
    assert _rows(held) == before and _rows(read_staged(spark, staging, pinned)) == before
    assert _rows(read_staged(spark, staging)) != before


def test_old_sets_go_and_missing_tables_are_named(spark, tmp_path):
    d = str(tmp_path / "staging")
    lookup = {"METADATA_LOOKUP_VALUES": _src(spark).lookup}
    for _ in range(4):
        extract.stage_snapshot(lookup, d, grace_s=0)
    assert len(list((tmp_path / "staging").glob("v-*"))) == KEEP
    assert read_table(spark, d, "METADATA_LOOKUP_VALUES").count() == lookup["METADATA_LOOKUP_VALUES"].count()
    with pytest.raises(FileNotFoundError, match="RESULTS"):
        read_staged(spark, d)
    with pytest.raises(ValueError):
        extract.stage_snapshot({}, d)
    # a folder without snapshots holds the tables themselves
    lookup["METADATA_LOOKUP_VALUES"].write.parquet(str(tmp_path / "plain" / "METADATA_LOOKUP_VALUES"))
    assert read_table(spark, str(tmp_path / "plain"), "METADATA_LOOKUP_VALUES").count() > 0


def test_a_copy_is_tried_again_as_a_whole(spark, tmp_path):
    """The source fails in the middle of the first two copies; the third has all rows."""
    from pyspark.sql import functions as F
    marks = tmp_path / "marks"
    marks.mkdir()

    def flaky(batches, folder=str(marks)):
        import os
        for b in batches:
            yield b
        n = len(os.listdir(folder))
        if n < 2:
            open(f"{folder}/{n}", "w").close()
            raise OSError("connection reset")
    df = spark.range(0, 100, 1, 1).withColumn("x", F.lit("a")).mapInArrow(flaky, "id long, x string")
    assert extract.stage(df, str(tmp_path / "t"), wait_s=0) == 100
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100
    assert len(list(marks.iterdir())) == 2
    for f in marks.iterdir():
        f.unlink()
    with pytest.raises(Exception, match="connection reset"):
        extract.stage(df, str(tmp_path / "u"), wait_s=0, retries=0)
