"""Order/folder flags computed on raw results before any report filter
(A4, A5) and the NOT EXISTS filters they replace (J10, J11).

Both aggregate with a map-side partial aggregate, so a hot order or folder
is combined inside each task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.operators.filters import is_pending_status, ts


def latest_result(results: DataFrame, folders: DataFrame) -> DataFrame:
    """(ORDNO, LatestResultDate): latest entry over all results that have a
    folder. Three columns of the results meet the folders in one shuffle, in whose
    tasks (AQE can split a hot folder) an order's rows are reduced before they go
    by order; no pair of order and folder is shuffled by itself first."""
    with_folder = (results.select("FOLDERNO", "ORDNO", "DATEENTER")
                   .join(folders.select("FOLDERNO"), "FOLDERNO", "left_semi"))
    return with_folder.groupBy("ORDNO").agg(F.max("DATEENTER").alias("LatestResultDate"))


def pending_folders(results: DataFrame) -> DataFrame:
    """Distinct folders holding any Logged/Draft result."""
    return results.where(is_pending_status("S")).select("FOLDERNO").distinct()


def pending_flag(results: DataFrame, folders: DataFrame) -> DataFrame:
    """(FOLDERNO, HasPendingResults) for every folder."""
    p = pending_folders(results).withColumn("_pending", F.lit(True))
    return (folders.select("FOLDERNO").join(p, "FOLDERNO", "left")
            .select("FOLDERNO", F.coalesce("_pending", F.lit(False)).alias("HasPendingResults")))


def orders_with_later_results(results: DataFrame, folders: DataFrame, cal_end) -> DataFrame:
    """ORDNOs having a result (with a folder) entered after ``cal_end``."""
    # reduced to distinct (order, folder) pairs map-side before any shuffle:
    # for an old window "later" is most of the table
    later = (results.where(F.col("DATEENTER") > ts(cal_end))
             .select("ORDNO", "FOLDERNO").distinct())
    return (later.join(folders.select("FOLDERNO"), "FOLDERNO", "left_semi")
            .select("ORDNO").distinct())


def drop_orders_with_later_results(rows: DataFrame, results: DataFrame,
                                   folders: DataFrame, cal_end) -> DataFrame:
    return rows.join(orders_with_later_results(results, folders, cal_end), "ORDNO", "left_anti")


def drop_pending_folders(rows: DataFrame, results: DataFrame) -> DataFrame:
    return rows.join(pending_folders(results), "FOLDERNO", "left_anti")
