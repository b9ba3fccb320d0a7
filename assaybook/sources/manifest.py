"""Log of numbered manifests: the small files that say which data is live.

Data folders are written once and never changed. A publish ends with one small
JSON file, the next number of the log, which names every live folder (each entry
is complete, a checkpoint of its own). Readers list the log and take the newest
entry they can read, so a lookup opens one file, or two if the newest was cut
short, however many were ever published. Old entries are removed: the log's
listing stays short too.

The next number is created only if it is free, which Hadoop's own file systems
guarantee. A store whose connector overwrites silently is met by reading the
entry back: the publisher whose entry was replaced finds another's token and
fails. That leaves a gap of one round trip, so on such stores let one job publish
at a time, or turn on the connector's conditional create.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

from assaybook.sources import files

#: Entries that are always kept, and the age from which others go.
KEEP, GRACE_S = 2, 86_400


class ConcurrentPublishError(RuntimeError):
    """Another run published meanwhile; this one was discarded."""


class Manifest:
    """The log in ``folder``; ``parse`` turns an entry's JSON object into its
    value and raises ValueError, KeyError or TypeError on one that is not whole."""

    def __init__(self, spark: SparkSession, folder: str, parse: Callable = dict):
        self.spark, self.folder, self._parse = spark, folder, parse

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def _numbers(self) -> list[int]:
        """Numbers in the log, newest first: one listing."""
        stems = (name.split(".")[0] for name, _, _ in files.entries(self.spark, self.folder))
        return sorted((int(s) for s in stems if s.isdigit()), reverse=True)

    def last_number(self) -> int:
        return max([0, *self._numbers()])

    def readable(self) -> Iterator[tuple[int, object]]:
        """(number, value) of readable entries, newest first; each is opened only
        when it is asked for."""
        for n in self._numbers():
            try:
                yield n, self._parse(json.loads(files.read_text(self.spark, self._path(n))))
            except (ValueError, KeyError, TypeError):
                continue  # cut short, or removed since the listing: the one before it holds

    def newest(self) -> tuple[int, object] | None:
        return next(self.readable(), None)

    def append(self, body: dict, seen: int) -> int:
        """Publish ``body`` as the entry after number ``seen``; returns its number."""
        token, path = uuid.uuid4().hex, self._path(seen + 1)
        try:
            files.write_text(self.spark, path, json.dumps(body | {"token": token}))
        except Exception as e:
            if "already exists" in str(e).lower():
                raise ConcurrentPublishError(path) from e
            raise
        if json.loads(files.read_text(self.spark, path) or "{}").get("token") != token:
            raise ConcurrentPublishError(path)
        return seen + 1

    def trim(self, *, keep: int = KEEP, grace_s: float = GRACE_S) -> tuple[list, list[int]]:
        """Values of the ``keep`` newest readable entries, whose data must stay, and
        the numbers of the entries removed: older than those and than ``grace_s``."""
        kept = []
        for n, value in self.readable():
            kept.append((n, value))
            if len(kept) == keep:
                break
        gone = []
        if kept:
            for name, _, changed in files.entries(self.spark, self.folder):
                stem = name.split(".")[0]
                if (stem.isdigit() and int(stem) < kept[-1][0] and time.time() - changed / 1000 >= grace_s
                        and files.remove(self.spark, f"{self.folder}/{name}")):
                    gone.append(int(stem))
        return [value for _, value in kept], gone
