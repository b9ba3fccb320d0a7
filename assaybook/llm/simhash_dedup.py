"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, in tiles: a tile holds the distinct
fingerprints that share the population counts of the ``SEGMENTS`` 16-bit
segments. Two fingerprints within the radius differ by at most the radius in
the sum of these counts' differences, so every tile pair beyond it is skipped;
the pairs that remain go through numpy exclusive-or and bit counts.

Work is dealt out by (home tile, block): the fingerprints of a home tile are
split into blocks of about ``BLOCK`` rows, and the fingerprints of the
neighbouring tiles visit every block. Visitors stream through in bounded
batches. A task never emits all pairs of a clump: it unites linked
fingerprints as it goes and emits at most one link per fingerprint it saw,
which keeps the reachability and loses no link between components.

Components come from repeated contraction: every fingerprint hooks onto the
neighbour that is smallest under a new hash order each round, and the links are
rewritten between what is left, until no link is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import fresh, id_key, stage, table, text_or_empty

SHINGLE = 3
RADIUS = 3
#: Fixed value of the contract: the seed of XXH64.
SEED = 42
SEGMENTS = 4
_BITS = 64 // SEGMENTS
_BASE = _BITS + 1
#: Fingerprints of one home block, and pairs compared at once.
BLOCK = 8192
PAIRS_AT_ONCE = 1 << 20


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text as a signed integer (0 if it has no word)."""
    words = text.encode().lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h64 = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    h = np.fromiter((h64(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((fingerprint(t, shingle) for t in b.column("_text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), fp], ["_id", "_fp"])
    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(_id, _fp) per row; null text counts as empty."""
    d = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = T.StructType([d.schema["_id"], T.StructField("_fp", T.LongType())])
    return d.mapInArrow(_fingerprints(shingle), schema)


# ---------------------------------------------------------------- tiles
def _tile(fp):
    """Tile number: the segments' population counts as digits."""
    out = F.lit(0)
    for s in range(SEGMENTS):
        seg = F.shiftrightunsigned(fp, s * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))
        out = out * _BASE + F.bit_count(seg)
    return out.cast("int")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Half of the neighbouring tiles, as steps from a visitor's tile to a home
    tile: all count differences within the radius that come first in order."""
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=SEGMENTS)
            if sum(map(abs, d)) <= radius and d < (0,) * SEGMENTS]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flat union-find: ``parent`` points at roots before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        far = ra != rb
        if not far.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[far], np.minimum(ra, rb)[far])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


class _Home:
    """One home block: its fingerprints and what is united so far."""

    def __init__(self, radius: int):
        self.radius, self.parts, self.fp, self.parent = radius, [], None, None

    def add(self, fp: np.ndarray) -> None:
        self.parts.append(fp)

    def _ready(self) -> None:
        if self.fp is not None:
            return
        self.fp = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint64)
        self.parent = np.arange(len(self.fp))
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.fp)))
        for i in range(0, len(self.fp), step):
            a, b = np.nonzero(_near(self.fp[i:i + step], self.fp, self.radius))
            apart = a + i < b
            self.parent = _unite(self.parent, a[apart] + i, b[apart])

    def visit(self, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        self._ready()
        out = []
        if not len(self.fp):
            return out
        step = max(1, PAIRS_AT_ONCE // len(self.fp))
        for i in range(0, len(fp), step):
            v, h = np.nonzero(_near(fp[i:i + step], self.fp, self.radius))
            if len(v):
                one, at, inv = np.unique(v, return_index=True, return_inverse=True)
                first = h[at]
                self.parent = _unite(self.parent, first[inv], h)
                out.append((fp[i + one], self.fp[first]))
        return out

    def links(self) -> list[tuple[np.ndarray, np.ndarray]]:
        self._ready()
        own = np.nonzero(self.parent != np.arange(len(self.parent)))[0]
        return [(self.fp[own], self.fp[self.parent[own]])] if len(own) else []


def _compare(radius: int):
    """Rows come sorted by (tile, block, visitor): home rows of a block first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home = None, None

        def out(links):
            for a, b in links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["_a", "_b"])

        for batch in batches:
            tile, block, visitor, fp = (batch.column(c).to_numpy(zero_copy_only=False)
                                        for c in ("_tile", "_block", "_visitor", "_fp"))
            fp = fp.astype(np.int64).view(np.uint64)
            cut = np.nonzero((np.diff(tile) != 0) | (np.diff(block) != 0) | (np.diff(visitor) != 0))[0] + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(tile)], strict=True):
                if i == j:
                    continue
                if key != (tile[i], block[i]):
                    if home:
                        yield from out(home.links())
                    key, home = (tile[i], block[i]), _Home(radius)
                if visitor[i]:
                    yield from out(home.visit(fp[i:j]))
                else:
                    home.add(fp[i:j])
        if home:
            yield from out(home.links())
    return run


def links(fps: DataFrame, *, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (_a, _b) that connect what the pairs of distinct fingerprints
    (column _fp) within ``radius`` bits connect."""
    tiled = fps.withColumn("_t", _tile(F.col("_fp")))
    # at most 17^4 rows of two integers whatever the input: a proven bound for the broadcasts
    sizes = tiled.groupBy("_t").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    homes = (tiled.join(F.broadcast(sizes), "_t")
             .withColumn("_block", F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int")))
    home = homes.select(F.col("_t").alias("_tile"), "_block", F.lit(0).alias("_visitor"), "_fp")
    # a home row visits the earlier blocks of its own tile
    own = (homes.where("_block > 0")
           .select(F.col("_t").alias("_tile"),
                   F.explode(F.sequence(F.lit(0), F.col("_block") - 1)).alias("_block"),
                   F.lit(1).alias("_visitor"), "_fp"))
    digits = [F.floor(F.col("_t") / _BASE ** (SEGMENTS - 1 - s)).cast("int") % _BASE
              for s in range(SEGMENTS)]
    targets = []
    for step in _steps(radius):
        ok = F.lit(True)
        for s, d in enumerate(step):
            if d:
                ok = ok & (F.col(f"_d{s}") + d).between(0, _BITS)
        targets.append(F.when(ok, F.col("_t") + sum(
            d * _BASE ** (SEGMENTS - 1 - s) for s, d in enumerate(step))))
    to = (tiled.select("_fp", "_t", *[d.alias(f"_d{s}") for s, d in enumerate(digits)])
          .select("_fp", F.explode(F.array(*targets)).alias("_tile")).where("_tile is not null"))
    visitors = (to.join(F.broadcast(sizes.withColumnRenamed("_t", "_tile")), "_tile")
                .select("_tile", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"),
                        F.lit(1).alias("_visitor"), "_fp"))
    dealt = (home.unionByName(own).unionByName(visitors).repartition("_tile", "_block")
             .sortWithinPartitions("_tile", "_block", "_visitor"))
    return dealt.mapInArrow(_compare(radius), "_a long, _b long")


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(_node, _root) of every node of the links (_a, _b)."""
    edges = stage(edges.where("_a <> _b").distinct(), "links")
    maps = []
    while not edges.isEmpty():
        r = len(maps)
        both = edges.union(edges.select("_b", "_a"))
        order = F.struct(F.xxhash64("_b", F.lit(r)).alias("h"), F.col("_b").alias("v"))
        own = F.struct(F.xxhash64("_a", F.lit(r)).alias("h"), F.col("_a").alias("v"))
        hook = (both.groupBy("_a").agg(F.min(order).alias("_m"))
                .select(F.col("_a").alias("_node"), F.least("_m", own)["v"].alias("_root")))
        hook = stage(hook, f"hook{r}")
        jump = hook.select(F.col("_node").alias("_root"), F.col("_root").alias("_up"))
        hook = stage(hook.join(jump, "_root").select("_node", F.col("_up").alias("_root")), f"jump{r}")
        maps.append(hook)
        a = hook.select(F.col("_node").alias("_a"), F.col("_root").alias("_ra"))
        b = hook.select(F.col("_node").alias("_b"), F.col("_root").alias("_rb"))
        edges = stage(edges.join(a, "_a").join(b, "_b").where("_ra <> _rb")
                      .select(F.least("_ra", "_rb").alias("_a"), F.greatest("_ra", "_rb").alias("_b"))
                      .distinct(), f"links{r}")
    if not maps:
        return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))
    out = maps[0]
    for m in maps[1:]:
        m = m.select(F.col("_node").alias("_root"), F.col("_root").alias("_up"))
        out = out.join(m, "_root", "left").select("_node", F.coalesce("_up", "_root").alias("_root"))
    return out


def _placed(rows: DataFrame, radius: int) -> DataFrame:
    """(_fp, _root, _rep) of every distinct fingerprint of ``rows`` (_id, _fp): its
    component's root and the smallest id that has the fingerprint."""
    reps = stage(rows.groupBy("_fp").agg(F.min("_id").alias("_rep")), "distinct-fingerprints")
    roots = components(links(reps.select("_fp"), radius=radius))
    return (reps.join(roots.withColumnRenamed("_node", "_fp"), "_fp", "left")
            .select("_fp", F.coalesce("_root", "_fp").alias("_root"), "_rep"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id.

    Null and empty texts have fingerprint zero and link like any other; a text
    with fewer words than a shingle is one shingle. component_id is the smallest
    doc_id reachable over links of at most ``radius`` differing bits (a null id
    is never the smallest unless its component has no other). Rows that share an
    id are documents of their own: each has the component of its text, so an id may
    stand in several. Repeated rows share their fingerprint and component. An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = stage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    placed = _placed(rows, radius)
    least = placed.groupBy("_root").agg(F.min("_rep").alias("component_id"))
    placed = placed.join(least, "_root").select("_fp", "component_id")
    return (rows.join(placed, "_fp")
            .select(F.col("_id").alias("doc_id"),
                    F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"))


def _with_fingerprint(text_col: str, name: str, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((fingerprint(t or "", shingle) for t in b.column(text_col).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fp], [*b.schema.names, name])
    return run


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, all columns: the one with the
    smallest id (a null id comes last); of several with that id the one with the
    smallest fingerprint; of rows that are equal in both, any one."""
    rows = stage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    first = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_fp").alias("fp"))
    key, fp = fresh(docs, "_row_key"), fresh(docs, "_row_fp")
    keep = (rows.join(_placed(rows, radius), "_fp").groupBy("_root").agg(F.min(first).alias("_first"))
            .select(id_key(F.col("_first.id")).alias(key), F.col("_first.fp").alias(fp)))
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])
    own = docs.mapInArrow(_with_fingerprint(text_col, fp, shingle), schema).withColumn(key, id_key(F.col(id_col)))
    # one exchange of the rows serves the join and the duplicates
    return own.join(keep, [key, fp], "left_semi").dropDuplicates([key, fp]).select(*docs.columns)


# ---------------------------------------------------------------- query
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash_dedup": op6_simhash_dedup}
ORACLE: dict[str, str] = {}
