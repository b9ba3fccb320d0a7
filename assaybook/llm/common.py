"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.session import work_dir
from assaybook.sources import files

#: Fixed value of the contracts: a word is a run of other characters than these.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the cluster's shared folder and read it back:
    cuts the lineage, survives lost executors, and fixes the values of
    expressions that depend on the physical partition."""
    path = f"{work_dir(df.sparkSession)}/llm/{tag}-{uuid.uuid4().hex[:12]}"
    for block in _SCRATCH:
        block.written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Open scratch blocks.
_SCRATCH: list[Scratch] = []


class Scratch:
    """A block whose intermediate tables go at its end: all that ``stage`` wrote
    inside but for the table that ``keep`` staged (its folder is ``kept``)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.written, self.kept = spark, [], None

    def __enter__(self) -> Scratch:
        _SCRATCH.append(self)
        return self

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        out = stage(df, tag)
        self.kept = self.written[-1]
        return out

    def __exit__(self, *exc) -> None:
        _SCRATCH.remove(self)
        for path in self.written:
            if path != self.kept:
                files.remove(self.spark, path)


def remove_staged(spark: SparkSession) -> bool:
    """Remove what the operators wrote on the way (and WARC packages written by
    the query), once none of their results is read any more."""
    return files.remove(spark, f"{work_dir(spark)}/llm")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_key(col: Column) -> Column:
    """An id as a text that is never null and differs for a null id."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def first_by_hash(df: DataFrame, h: Column, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` that come first in the order of the 64-bit hash
    ``h``. Rows are counted first and only the share that is expected to hold
    twice as many is sorted, so tasks send about 2 ``n`` rows in all, however
    many tasks there are."""
    total = df.count()
    if total > 2 * n:
        df = df.where(h <= int(2 * n / total * (1 << 64)) - (1 << 63))
    return df.orderBy(h, *df.columns).limit(n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_bucket(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (the contracts' hold-out rule);
    a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n
