"""Staged snapshots: the source tables of one extract as one consistent set.

Every staging run writes its tables to a new folder and publishes them together
with one manifest entry. A reader resolves the manifest once and reads all its
tables from that snapshot, so it never sees tables of two runs, and a run that
stops after any table leaves the last whole set live. Snapshots that the last
manifest entries do not name are removed once they are a day old; a reader that
takes longer than that pins its snapshot by name and raises the grace.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from assaybook.sources import files
from assaybook.sources.manifest import GRACE_S, Manifest

LOG = "_snapshots"


@dataclass(frozen=True)
class Snapshot:
    version: str             # name of the folder
    staging_dir: str
    rows: dict[str, int]     # table -> rows, as observed by the write

    @property
    def folder(self) -> str:
        return f"{self.staging_dir}/{self.version}"

    def path(self, table: str) -> str:
        if table not in self.rows:
            raise FileNotFoundError(f"snapshot {self.folder} has no {table}; it holds {sorted(self.rows)}")
        return f"{self.folder}/{table}"


def _log(spark: SparkSession, staging_dir: str) -> Manifest:
    return Manifest(spark, f"{staging_dir}/{LOG}", lambda e: Snapshot(
        e["version"], staging_dir, {t: int(n) for t, n in e["rows"].items()}))


def new_snapshot(staging_dir: str) -> str:
    """Folder name of a snapshot to be written."""
    return f"v-{uuid.uuid4().hex[:12]}"


def live_snapshot(spark: SparkSession, staging_dir: str) -> Snapshot | None:
    """The newest whole snapshot; None if nothing was published there."""
    found = _log(spark, staging_dir.rstrip("/")).newest()
    return found[1] if found else None


def last_number(spark: SparkSession, staging_dir: str) -> int:
    return _log(spark, staging_dir.rstrip("/")).last_number()


def publish_snapshot(spark: SparkSession, staging_dir: str, version: str, rows: dict[str, int], seen: int, *,
                     grace_s: float = GRACE_S) -> Snapshot:
    """Make the written folder ``version`` the live set (as the entry after number
    ``seen``, read before the copies began), then remove old sets."""
    staging_dir = staging_dir.rstrip("/")
    log = _log(spark, staging_dir)
    log.append({"version": version, "rows": rows,
                "at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")}, seen)
    kept, _ = log.trim(grace_s=grace_s)
    files.remove_unnamed(spark, staging_dir, "v-", {s.version for s in kept}, grace_s)
    return Snapshot(version, staging_dir, dict(rows))
