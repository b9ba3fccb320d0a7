"""Exact deduplication by a tree merge of sorted digest runs (DataFrame code only).

Level 0: every input partition (a *rank*) aggregates its own rows into a run,
one entry per digest, before anything is shuffled. Each binomial round joins
``FAN_IN`` neighbouring ranks: their runs are exchanged, sorted on (node,
digest) and merged, and per digest the best candidate and the number of rows
are retained. ``min`` over a struct has no hash form, so Spark plans every
round as a sort-based merge of the runs. The last round has one node, spread
over the digest space, so no task ever holds a whole run. The answer then walks
the same tree back down: the root entry goes to its at most ``FAN_IN`` child
entries per level and from the first level to the rows, so the rows of a hot
digest meet their answer in as many tasks as the digest has first-level nodes.

Entries merge only where the SHA-256 of the normalised text, its length and a
second, independent hash agree (the verification at every level).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm.common import WORD_GAP, fresh, id_key, stage, table, text_or_empty

#: Ranks that one node of the tree merges.
FAN_IN = 16

_KEY = ["_sha", "_len", "_check"]


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    norm = F.regexp_replace(text, WORD_GAP, "")
    return (docs.select(F.col(id_col).alias("_id"), F.length(text).alias("_points"),
                        norm.alias("_norm"))
            .select("_id", "_points", F.unhex(F.sha2("_norm", 256)).alias("_sha"),
                    F.length("_norm").alias("_len"), F.xxhash64("_norm").alias("_check"),
                    F.spark_partition_id().alias("_n0")))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 (of the text without white space).

    Null text counts as empty; empty texts form one group like any other. The
    row with the most code points in the original text stays, then the one with
    the smallest id; a null id comes after every other id. Rows that repeat an
    id within one group are all marked as the row that stays does. An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = stage(_digests(docs, id_col, text_col), "digest-runs")
    ranks = rows.agg(F.max("_n0")).first()[0]
    levels = 1
    while fan_in ** levels <= (ranks or 0):
        levels += 1

    # a candidate orders by: longest original text, then smallest non-null id
    best = F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("z"),
                    F.col("_id").alias("id"))
    runs, tree = rows.select(*_KEY, "_n0", best.alias("_best"), F.lit(1).cast("long").alias("_n")), []
    for lv in range(1, levels + 1):
        node = F.lit(0) if lv == levels else (F.col(f"_n{lv - 1}") / fan_in).cast("int")
        runs = (runs.withColumn(f"_n{lv}", node).groupBy(*_KEY, f"_n{lv}")
                .agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n")))
        tree.append(runs)

    def down(answer: DataFrame, level: int) -> DataFrame:
        """Answers of level ``level`` + 1 handed to the entries of ``level``."""
        child = tree[level - 1].select(*_KEY, f"_n{level}")
        up = F.lit(0) if level + 1 == levels else (F.col(f"_n{level}") / fan_in).cast("int")
        return (child.withColumn(f"_n{level + 1}", up)
                .join(answer, [*_KEY, f"_n{level + 1}"]).drop(f"_n{level + 1}"))

    answer = reduce(down, range(levels - 1, 0, -1), tree[-1])
    node = F.lit(0) if levels == 1 else (F.col("_n0") / fan_in).cast("int")
    return (rows.withColumn("_n1", node).join(answer, [*_KEY, "_n1"])
            .select(F.col("_id").alias("doc_id"), F.col("_best.id").alias("keep_id"),
                    F.col("_n").alias("group_size"),
                    F.col("_id").eqNullSafe(F.col("_best.id")).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies, all columns: one row of each group stays
    (of repeated rows with the id that stays, any one)."""
    key, sha = fresh(docs, "_row_key"), fresh(docs, "_row_sha")
    kept = exact_groups(docs, id_col=id_col, text_col=text_col).where("kept").select(
        id_key(F.col("doc_id")).alias(key), F.col("text_sha256").alias(sha)).distinct()
    own = docs.withColumns({key: id_key(F.col(id_col)),
                            sha: F.sha2(F.regexp_replace(text_or_empty(text_col), WORD_GAP, ""), 256)})
    # one exchange of the rows serves the join and the duplicates
    return own.join(kept, [key, sha], "left_semi").dropDuplicates([key, sha]).select(*docs.columns)


# ---------------------------------------------------------------- query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}

ORACLE = {"op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN k USING (text_sha256)
"""}
