"""Incremental forms: running counts over arriving rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_patches(stream: DataFrame, key: str = "patch_id", time: str | None = None, late: str = "7 days") -> DataFrame:
    """Each id once.  With an event time, ids are forgotten ``late`` after the newest row, so the state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def running_confusion(stream: DataFrame, n_classes: int, ignore: int = 255) -> DataFrame:
    """Counts of (truth, pred) so far; write in update or complete mode."""
    inside = (F.col("truth") != ignore) & F.col("truth").between(0, n_classes - 1) & F.col("pred").between(0, n_classes - 1)
    return stream.where(inside).groupBy("truth", "pred").agg(F.count("*").alias("n"))


def running_moments(stream: DataFrame, band: str, *by: str) -> DataFrame:
    return stream.groupBy(*by).agg(F.count(band).alias("n"), F.avg(band).alias("mean"), F.stddev_samp(band).alias("std"), F.min(band).alias("least"), F.max(band).alias("most"))


def running_labels(stream: DataFrame) -> DataFrame:
    """Sound and rejected labels so far by season and year."""
    return stream.groupBy("season", "year").agg(F.count_if(F.col("mask_ok")).alias("n_valid"), F.count_if(~F.col("mask_ok")).alias("n_rejected"))


def area_series(stream: DataFrame, time: str, *by: str, every: str = "30 days", late: str = "7 days") -> DataFrame:
    """Rows per window of event time; what is later than ``late`` is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("span"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(result: DataFrame, path: str, mode: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a streaming result over what is there now; each batch's output goes to a folder of its own under ``path``.

    Complete and update modes keep the last state of a batch: ``shape`` may pick rows of a table with a ``batch`` column.
    """
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    rows = result.sparkSession.read.parquet(f"{path}/out")
    if shape:
        return shape(rows)
    newest = rows.agg(F.max("batch")).first()[0] if mode == "complete" else None
    return (rows.where(F.col("batch") == newest) if newest is not None else rows).drop("batch")
