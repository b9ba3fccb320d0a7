"""Summarise a Spark event log (zstd or plain): job and slow-stage durations.

usage: python tools/eventlog.py <event log dir or file> [min_stage_ms]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def lines(path):
    files = [path] if os.path.isfile(path) else sorted(
        p for p in glob.glob(os.path.join(path, "**", "*"), recursive=True)
        if os.path.isfile(p) and not os.path.basename(p).startswith((".", "appstatus")))
    for p in files:
        raw = open(p, "rb").read()
        if p.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            if line.strip():
                yield json.loads(line)


def main():
    path = sys.argv[1]
    min_ms = int(sys.argv[2]) if len(sys.argv) > 2 else 200
    jobs, stages = {}, {}
    for e in lines(path):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, len(e["Stage Infos"]),
                                 [si["Stage ID"] for si in e["Stage Infos"]]]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Stage Name"][:70], si["Number of Tasks"],
                                      si.get("Completion Time", 0) - si.get("Submission Time", 0))
    if not jobs:
        return
    t0 = min(v[0] for v in jobs.values())
    for j, (s, en, n, ids) in sorted(jobs.items()):
        ran = [(stages[i][2], i, stages[i][1]) for i in ids if i in stages]
        slow = max(ran) if ran else (0, -1, 0)
        print(f"job {j:4d} at {(s - t0) / 1000:7.2f}s took {((en or s) - s) / 1000:6.2f}s "
              f"stages={n} ran={len(ran)} slowest=stage {slow[1]} ({slow[2]} tasks, {slow[0]}ms)")
    for k, v in sorted(stages.items()):
        if v[2] >= min_ms:
            print(f"  stage {k:4d} tasks={v[1]:4d} {v[2]:6d}ms {v[0]}")


if __name__ == "__main__":
    main()
