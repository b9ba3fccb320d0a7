"""Variable-capacity best-fit packing of token sequences.

Permitted capacities are optimised jointly: a piece goes to the open bin, of
whatever capacity, that it leaves with the least room; where none has room, a bin
of the least-cost capacity is opened. What a capacity would cost is tried out: the
bin is filled, longest first, with pieces still to come that no bin before it counts
on, and its cost after downsizing is taken per token held. So a capacity that the
remaining lengths cannot fill is not opened, and three pieces of 600 share a bin of
2048 rather than take three of 1024. Pieces come longest first. At the end every
bin shrinks to the smallest permitted capacity that holds its contents.

A bin of capacity c costs ``OVERHEAD + c + c * c / QUADRATIC``: what a sequence
costs whatever its length, its tokens, and attention's growth with the square.

Pieces are dealt evenly to groups of about ``GROUP_PIECES`` by a row number, not
by id, and each group packs its own bins; with tens of thousands of pieces a
group, the bins that stay part empty at a group's end are few beside the full
ones. Only ids and lengths are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm.common import stage, table, text_or_empty

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64
QUADRATIC = 8192
GROUP_PIECES = 50_000


def bin_cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / QUADRATIC


class _Ahead:
    """Lengths still to come that no open bin counts on: how many of each, and the
    next shorter one there is."""

    def __init__(self, lengths: list[int]):
        self.count = [0] * (max(lengths, default=0) + 1)
        self.spoken_for = [0] * len(self.count)
        for n in lengths:
            self.count[n] += 1
        self._down = list(range(len(self.count)))

    def arrives(self, n: int) -> None:
        """A piece of ``n`` is placed now."""
        left = self.spoken_for if self.spoken_for[n] else self.count
        left[n] -= 1

    def longest(self, most: int) -> int:
        """The longest free length from 1 to ``most``, or 0. Lengths only run
        out, so those passed over are skipped for good."""
        n = min(most, len(self.count) - 1)
        path = []
        while n > 0 and not self.count[n]:
            path.append(n)
            n = self._down[n] if self._down[n] < n else n - 1
        for p in path:
            self._down[p] = n
        return max(n, 0)

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(length, how many) that fit into ``room``, taken longest first."""
        out, n = [], room
        while room and (n := self.longest(min(n, room))):
            k = min(self.count[n], room // n)
            out.append((n, k))
            room, n = room - k * n, n - 1
        return out

    def speak_for(self, taken: list[tuple[int, int]]) -> None:
        for n, k in taken:
            self.count[n] -= k
            self.spoken_for[n] += k


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of every piece, and the capacities of the bins; pieces are
    taken longest first, ties in the given order, and none may exceed the largest
    capacity. Looking ahead is greedy, so the packing that opens the smallest size
    that holds a piece is made too, and the cheaper of the two is taken."""
    tried = [_pack(lengths, sorted(capacities), look_ahead) for look_ahead in (True, False)]
    return min(tried, key=lambda packed: sum(map(bin_cost, packed[1])))


def _pack(lengths: list[int], sizes: list[int], look_ahead: bool) -> tuple[list[tuple[int, int]], list[int]]:
    holds = lambda n: sizes[bisect_left(sizes, n)]
    ahead = _Ahead(lengths)

    def least_cost(n: int) -> int:
        """Capacity for a new bin that begins with a piece of ``n``; ties: the smallest."""
        if not look_ahead:
            return holds(n)
        best = None
        for c in sizes[bisect_left(sizes, n):]:
            taken = ahead.fill(c - n)
            held = n + sum(m * k for m, k in taken)
            cost = bin_cost(holds(held)) / max(held, 1)
            if best is None or cost < best[0]:
                best = (cost, c, taken)
        ahead.speak_for(best[2])
        return best[1]

    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    places = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        ahead.arrives(n)
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = least_cost(n), len(used)
            used.append(0)
        places[i] = (b, used[b])
        used[b] += n
        if left > n:
            insort(room, (left - n, b))
    return places, [holds(u) for u in used]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           longest: int = CAPACITIES[-1]) -> DataFrame:
    """(doc_id, piece, start, length) in words: whole texts, cut only where they
    exceed the largest capacity; a text without words is one piece of length 0."""
    words = F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("_n", F.lit(1)) - 1) / longest))
    return (docs.select(F.col(id_col).alias("doc_id"), words.alias("_n"))
            .select("doc_id", "_n", F.explode(cuts).alias("piece"))
            .select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"),
                    F.least(F.lit(longest).cast("long"), F.col("_n") - F.col("piece") * longest).alias("length")))


def _pack_group(capacities: tuple[int, ...]):
    def run(key, rows):
        rows = rows.sort_by([("_row", "ascending")])
        places, sizes = pack(rows["length"].to_pylist(), capacities)
        first = key[0].as_py() << 32
        return pa.table({
            **{c: rows[c] for c in ("doc_id", "piece", "start", "length")},
            "bin_id": pa.array([first + b for b, _ in places], pa.int64()),
            "capacity": pa.array([sizes[b] for b, _ in places], pa.int32()),
            "offset": pa.array([o for _, o in places], pa.int64())})
    return run


def pack_pieces(parts: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES,
                group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: its columns, bin_id, capacity (of the shrunk bin) and
    offset (where the piece begins in the bin).

    ``parts`` has doc_id, piece, start and length, none longer than the largest
    capacity; ids may be null or repeat. An empty table gives an empty result.
    """
    rows = stage(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
            .groupBy("_group").applyInArrow(
                _pack_group(tuple(capacities)),
                f"doc_id {kind}, piece int, start long, length long, bin_id long, capacity int, offset long"))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of every row of ``docs``, packed (see ``pieces`` and
    ``pack_pieces``). Null text counts as empty; repeated rows are packed each;
    other columns are not read."""
    return pack_pieces(pieces(docs, id_col=id_col, text_col=text_col, longest=max(capacities)),
                       capacities=capacities, group_pieces=group_pieces)


# ---------------------------------------------------------------- query
def op4_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_bin_packing": op4_bin_packing}
ORACLE: dict[str, str] = {}
