"""Tables behind charts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seasonal_chart(seasonal: DataFrame, classes) -> DataFrame:
    """Per season the mean and deviation of each class's fraction; 0 where a class is missing."""
    wide = seasonal.groupBy("season").pivot("class_id", list(classes)).agg(F.first("mean_fraction").alias("mean"), F.first("std_fraction").alias("std"))
    return wide.fillna(0.0)


def change_chart(change: DataFrame, classes) -> DataFrame:
    """Per pair of dates the change of each class; 0 where a class is missing."""
    wide = change.groupBy("from_date", "to_date").pivot("class_id", list(classes)).agg(F.first("delta"))
    return wide.select("from_date", "to_date", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"delta_{k}") for k in classes])


def side_by_side(cells: DataFrame, key: str = "sample_id", value: str = "class_id") -> DataFrame:
    """Cells of the first two samples next to each other."""
    one = cells.agg(F.min(key).alias("one"))  # one row, like the next
    pair = cells.crossJoin(F.broadcast(one)).where(F.col(key) > F.col("one")).agg(F.min(key).alias("two")).crossJoin(one)
    both = cells.crossJoin(F.broadcast(pair)).where((F.col(key) == F.col("one")) | (F.col(key) == F.col("two")))
    left = F.max(F.when(F.col(key) == F.col("one"), F.col(value))).alias("left")
    return both.groupBy("r", "c").agg(left, F.max(F.when((F.col(key) == F.col("two")), F.col(value))).alias("right"))


def class_report(metrics: DataFrame, areas: DataFrame, order: str = "sample_id") -> DataFrame:
    """Metrics of each class with fraction and confidence of the first sample that has it."""
    first = areas.groupBy("class_id").agg(F.min_by(F.struct("fraction", "confidence"), order).alias("of"))
    return metrics.join(first, "class_id", "left").select(metrics["*"], "of.fraction", "of.confidence")
