"""The log of manifests: few reads a lookup, whole entries only, one publisher a number."""

import json

import pytest

from assaybook.sources import files
from assaybook.sources.manifest import ConcurrentPublishError, Manifest


@pytest.fixture
def reads(monkeypatch):
    """Paths that were opened."""
    seen, real = [], files.read_text

    def read(spark, path):
        seen.append(path)
        return real(spark, path)
    monkeypatch.setattr(files, "read_text", read)
    return seen


def _write_log(folder, n):
    folder.mkdir(parents=True, exist_ok=True)
    for i in range(1, n + 1):
        (folder / f"{i:012d}.json").write_text(json.dumps({"v": i, "token": str(i)}))


def test_a_lookup_opens_two_files_at_most_after_a_thousand_publishes(spark, tmp_path, reads):
    _write_log(tmp_path / "log", 1000)
    log = Manifest(spark, str(tmp_path / "log"), lambda e: e["v"])
    assert log.newest() == (1000, 1000) and len(reads) == 1
    (tmp_path / "log" / f"{1001:012d}.json").write_text('{"v": 10')  # its writer died
    reads.clear()
    assert log.newest() == (1000, 1000) and len(reads) == 2
    assert log.last_number() == 1001  # the number is taken all the same
    assert log.append({"v": 1002}, 1001) == 1002 and log.newest() == (1002, 1002)


def test_old_entries_go_and_what_they_name_is_reported(spark, tmp_path):
    _write_log(tmp_path / "log", 30)
    log = Manifest(spark, str(tmp_path / "log"), lambda e: e["v"])
    assert log.trim(keep=2) == ([30, 29], [])  # none is a day old
    kept, gone = log.trim(keep=2, grace_s=0)
    assert kept == [30, 29] and gone == list(range(1, 29))
    assert log.append({"v": 31}, log.last_number()) == 31
    assert len(list((tmp_path / "log").glob("*.json"))) == 3


def test_one_publisher_a_number(spark, tmp_path, monkeypatch):
    log = Manifest(spark, str(tmp_path / "log"), lambda e: e["v"])
    assert log.newest() is None
    log.append({"v": 1}, 0)
    with pytest.raises(ConcurrentPublishError):
        log.append({"v": 2}, 0)
    assert log.newest() == (1, 1)
    # a store that overwrites silently: the entry read back is another's
    real = files.write_text

    def replaced(spark_, path, text, *, replace=False):
        real(spark_, path, text, replace=True)
        real(spark_, path, json.dumps({"v": 9, "token": "another"}), replace=True)
    monkeypatch.setattr(files, "write_text", replaced)
    with pytest.raises(ConcurrentPublishError):
        log.append({"v": 2}, 1)


def test_an_entry_removed_after_the_listing_is_passed_over(spark, tmp_path, monkeypatch):
    _write_log(tmp_path / "log", 3)
    log = Manifest(spark, str(tmp_path / "log"), lambda e: e["v"])
    real = files.read_text
    monkeypatch.setattr(files, "read_text", lambda s, p: None if p.endswith("3.json") else real(s, p))
    assert log.newest() == (2, 2)
