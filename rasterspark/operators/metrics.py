"""Confusion matrix and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, n_classes: int, *by: str, ignore: int = 255) -> DataFrame:
    """(by, truth, pred, n), every cell present; ids outside the classes don't count."""
    inside = (F.col("truth") != ignore) & F.col("truth").between(0, n_classes - 1) & F.col("pred").between(0, n_classes - 1)
    counts = pairs.where(inside).groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    heads = counts.select(*by).distinct() if by else pairs.sparkSession.range(1).select()
    grid = heads.withColumn("truth", F.explode(classes)).withColumn("pred", F.explode(classes))
    return grid.join(counts, [*by, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def normalised(matrix: DataFrame, *by: str) -> DataFrame:
    """Rows of the matrix as shares; an empty row is 0."""
    rows = matrix.groupBy(*by, "truth").agg(F.sum("n").alias("support"))
    return matrix.join(rows, [*by, "truth"]).select(*by, "truth", "pred", F.coalesce(F.try_divide("n", "support"), F.lit(0.0)).alias("share"))


def per_class(matrix: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn, support and the metrics of each class (0 where undefined)."""
    one = matrix.select(*by, "n", "truth", "pred", F.explode(F.array_distinct(F.array("truth", "pred"))).alias("class_id"))
    hit = (F.col("truth") == F.col("class_id"), F.col("pred") == F.col("class_id"))
    total = matrix.groupBy(*by).agg(F.sum("n").alias("total"))
    own = one.groupBy(*by, "class_id").agg(
        F.sum(F.when(hit[0] & hit[1], F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit[0] & hit[1], F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit[0] & ~hit[1], F.col("n")).otherwise(0)).alias("fn"),
    )
    own = own.join(total, list(by)) if by else own.crossJoin(F.broadcast(total))  # one row
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return own.select(
        *by, "class_id", "tp", "fp", "fn", (F.col("total") - tp - fp - fn).alias("tn"), (tp + fn).alias("support"), "total",
        share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("iou"),
    )


#: Metric by name: an aggregate over the per-class table.
METRICS = {
    "pixel_accuracy": lambda: F.sum("tp") / F.max("total"),
    "mean_pixel_accuracy": lambda: F.avg(F.when(F.col("support") > 0, F.col("recall"))),
    "precision": lambda: F.avg(F.when(F.col("tp") + F.col("fp") > 0, F.col("precision"))),
    "recall": lambda: F.avg(F.when(F.col("support") > 0, F.col("recall"))),
    "f1": lambda: F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("f1"))),
    "dice": lambda: F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("f1"))),
    "mean_iou": lambda: F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("iou"))),
    "fw_iou": lambda: F.sum(F.col("support") * F.col("iou")) / F.max("total"),
    "balanced_accuracy": lambda: F.avg(F.when(F.col("support") > 0, F.col("recall"))),
    "kappa": lambda: _kappa(),
}


def _kappa():
    total = F.max("total").cast("double")
    seen, chance = F.sum("tp") / total, F.sum((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")).cast("double")) / (total * total)
    return F.coalesce(F.least(F.greatest(F.try_divide(seen - chance, 1 - chance), F.lit(-1.0)), F.lit(1.0)), F.lit(0.0))


def overall(matrix: DataFrame, *by: str, names=tuple(METRICS), extra=None) -> DataFrame:
    """The named metrics; unknown names are skipped, ``extra`` adds the user's own."""
    known = METRICS | (extra or {})
    return per_class(matrix, *by).groupBy(*by).agg(*[F.coalesce(known[m](), F.lit(0.0)).alias(m) for m in names if m in known])


def frequencies(matrix: DataFrame, *by: str) -> DataFrame:
    """True and predicted pixels of each class, and their shares of all (0 without any)."""
    own = per_class(matrix, *by)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    counts = own.select(*by, "class_id", F.col("support").alias("true_pixels"), (F.col("tp") + F.col("fp")).alias("pred_pixels"), "total")
    return counts.select(*by, "class_id", "true_pixels", "pred_pixels", share("true_pixels").alias("true_share"), share("pred_pixels").alias("pred_share"))


def evaluate(pairs: DataFrame, samples: DataFrame, n_classes: int, key: str = "sample_id", **options) -> DataFrame:
    """The metrics of each split: samples (key, split) joined with their cells (truth, pred)."""
    joined = pairs.join(samples.select(key, "split"), key)
    return overall(confusion(joined, n_classes, "split"), "split", **options)
