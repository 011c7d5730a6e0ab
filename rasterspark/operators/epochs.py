"""Tables of training logs (run_id, epoch, train_loss, val_loss): best epochs, early stops, weighted losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_epochs(log: DataFrame, loss: str = "val_loss", run: str = "run_id") -> DataFrame:
    """Per run the first epoch of least loss above 0, and that loss; without one the first epoch and infinity."""
    value = F.when(F.col(loss) > 0, F.col(loss)).otherwise(float("inf"))
    return log.groupBy(run).agg(F.min_by("epoch", F.struct(value, F.col("epoch"))).alias("best_epoch"), F.min(value).alias("best_loss"))


def best_flags(log: DataFrame, loss: str = "val_loss", run: str = "run_id", mode: str = "min") -> DataFrame:
    """``log`` plus is_best: strictly better than every epoch before."""
    before = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    better = F.col(loss) < F.min(loss).over(before) if mode == "min" else F.col(loss) > F.max(loss).over(before)
    return log.withColumn("is_best", F.coalesce(better, F.col(loss).isNotNull()))


def early_stops(log: DataFrame, patience: int, min_delta: float = 0.0, mode: str = "min", loss: str = "val_loss", run: str = "run_id") -> DataFrame:
    """Per run the epoch at which training stops: ``patience`` epochs in a row without a gain of more than ``min_delta``; NULL if never (or patience is 0)."""
    sign = 1.0 if mode == "min" else -1.0
    steps = log.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col("epoch"), (F.col(loss) * sign).alias("loss")))).alias("steps"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(None).cast("long").alias("stopped"))

    def step(acc, x):
        better = x["loss"] < acc["best"] - min_delta
        waited = F.when(better, 0).otherwise(acc["waited"] + 1)
        stopped = F.when(acc["stopped"].isNotNull(), acc["stopped"]).when((waited >= patience) & F.lit(patience > 0), x["epoch"].cast("long"))
        return F.struct(F.when(better, x["loss"]).otherwise(acc["best"]).alias("best"), waited.alias("waited"), stopped.alias("stopped"))

    return steps.select(run, F.aggregate("steps", start, step, lambda acc: acc["stopped"]).alias("stopped_at"))


def weighted_losses(batches: DataFrame, loss: str = "loss", size: str = "size", run: str = "run_id") -> DataFrame:
    """Mean loss of each epoch, batches weighted by size; 0 without any."""
    total = F.sum(F.col(loss) * F.col(size))
    return batches.groupBy(run, "epoch").agg(F.coalesce(F.try_divide(total, F.sum(size)), F.lit(0.0)).alias("mean_loss"))
