"""Losses of a table of logits against classes, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _log_probs(cells: DataFrame, logits: str, truth: str, ignore: int) -> DataFrame:
    most = F.array_max(logits)
    total = most + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - most)))
    inside = (F.col(truth) != ignore) & (F.col(truth) >= 0) & (F.col(truth) < F.size(logits))
    return cells.where(inside).withColumn("_lse", total).withColumn("_lp", F.transform(logits, lambda x: x - F.col("_lse")))


def cross_entropy(cells: DataFrame, *by: str, weights=None, smoothing: float = 0.0, logits: str = "logits", truth: str = "truth", ignore: int = 255) -> DataFrame:
    """Weighted mean over the rows whose class counts; nothing to count gives 0."""
    weight = F.array(*[F.lit(float(w)) for w in weights]) if weights is not None else F.transform(logits, lambda x: F.lit(1.0))
    rows = _log_probs(cells, logits, truth, ignore).withColumn("_w", weight)
    own = F.get("_w", F.col(truth))
    spread = F.aggregate(F.zip_with("_w", "_lp", lambda w, p: -w * p), F.lit(0.0), lambda s, x: s + x) / F.size("_lp")
    each = (1 - smoothing) * own * -F.get("_lp", F.col(truth)) + smoothing * spread
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(each), F.sum(own)), F.lit(0.0)).alias("loss"))


def focal(cells: DataFrame, *by: str, alpha: float = 0.25, gamma: float = 2.0, logits: str = "logits", truth: str = "truth", ignore: int = 255) -> DataFrame:
    rows = _log_probs(cells, logits, truth, ignore)
    p = F.get("_lp", F.col(truth))
    return rows.groupBy(*by).agg(F.coalesce(F.avg(alpha * F.pow(1 - F.exp(p), gamma) * -p), F.lit(0.0)).alias("loss"))


def dice(cells: DataFrame, *by: str, smooth: float = 1.0, logits: str = "logits", truth: str = "truth", ignore: int = 255) -> DataFrame:
    """1 - mean over classes of the soft overlap of all rows together."""
    each = _log_probs(cells, logits, truth, ignore).select(*by, truth, F.posexplode("_lp").alias("class_id", "lp"))
    hit, p = (F.col(truth) == F.col("class_id")).cast("double"), F.exp("lp")
    sums = each.groupBy(*by, "class_id").agg(((2 * F.sum(p * hit) + smooth) / (F.sum(p) + F.sum(hit) + smooth)).alias("overlap"))
    return sums.groupBy(*by).agg((1 - F.avg("overlap")).alias("loss"))


def combined(cells: DataFrame, *by: str, share: float = 0.5, weights=None, smoothing: float = 0.0) -> DataFrame:
    """``share`` of the cross-entropy and the rest of the Dice loss."""
    one = cross_entropy(cells, *by, weights=weights, smoothing=smoothing).withColumnRenamed("loss", "ce")
    two = dice(cells, *by).withColumnRenamed("loss", "dc")
    both = one.join(two, list(by)) if by else one.crossJoin(two)  # one row each
    return both.select(*by, (share * F.col("ce") + (1 - share) * F.col("dc")).alias("loss"))


def all_losses(cells: DataFrame, n_classes: int, *by: str, weights=None, smoothing: float = 0.0, alpha: float = 0.25, gamma: float = 2.0, smooth: float = 1.0, logits: str = "logits", truth: str = "truth", ignore: int = 255) -> DataFrame:
    """cross_entropy, focal and dice of tables with ``n_classes`` logits, in one aggregate."""
    weight = F.array(*[F.lit(float(w)) for w in (weights or [1.0] * n_classes)])
    rows = _log_probs(cells, logits, truth, ignore).withColumn("_w", weight)
    own, p = F.get("_w", F.col(truth)), F.get("_lp", F.col(truth))
    spread = F.aggregate(F.zip_with("_w", "_lp", lambda w, q: -w * q), F.lit(0.0), lambda s, x: s + x) / F.size("_lp")
    each = (1 - smoothing) * own * -p + smoothing * spread
    overlaps = []
    for k in range(n_classes):
        share, hit = F.exp(F.get("_lp", F.lit(k))), (F.col(truth) == k).cast("double")
        overlaps.append((2 * F.sum(share * hit) + smooth) / (F.sum(share) + F.sum(hit) + smooth))
    return rows.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(each), F.sum(own)), F.lit(0.0)).alias("cross_entropy"),
        F.coalesce(F.avg(alpha * F.pow(1 - F.exp(p), gamma) * -p), F.lit(0.0)).alias("focal"),
        (1 - sum(overlaps[1:], overlaps[0]) / n_classes).alias("dice"),
    )
