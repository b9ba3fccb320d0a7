"""Small files and folders on the cluster's file system (any scheme Hadoop knows)."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def entries(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, modification time) of a folder's own entries, by name."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, *, replace: bool = False) -> None:
    """Write a small file; without ``replace`` an existing one raises."""
    fs, p, _ = _fs(spark, path)
    stream = fs.create(p, replace)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file into a folder that may not exist yet; raises if it cannot be."""
    fs, source, _ = _fs(spark, path)
    _, target, _ = _fs(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{path} could not be moved to {to}")


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all it holds; False if there is none."""
    fs, p, _ = _fs(spark, path)
    return fs.delete(p, True)


def remove_unnamed(spark: SparkSession, folder: str, prefix: str, named: set[str], grace_s: float) -> list[str]:
    """Remove the folder's entries that begin with ``prefix``, are not ``named``
    and are older than ``grace_s`` (one still being written is younger)."""
    gone = []
    for name, _, changed in entries(spark, folder):
        if (name.startswith(prefix) and name not in named and time.time() - changed / 1000 >= grace_s
                and remove(spark, f"{folder}/{name}")):
            gone.append(name)
    return gone
