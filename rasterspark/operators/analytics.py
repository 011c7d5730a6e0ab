"""Change in time, seasons and space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import season
from .checks import prediction_issues


def by_date(metrics: DataFrame, *by: str) -> DataFrame:
    """One row per date and class: the mean of its samples, counts rounded half-even."""
    return metrics.groupBy(*by, "class_id", "acq_date").agg(F.bround(F.avg("pixels")).cast("long").alias("pixels"), F.avg("fraction").alias("fraction"))


def change(metrics: DataFrame, *by: str) -> DataFrame:
    """Each date against the one before it, per class; percent is 0 from nothing."""
    w = Window.partitionBy(*by, "class_id").orderBy("acq_date")
    steps = by_date(metrics, *by).select(
        *by, "class_id", F.lag("acq_date").over(w).alias("from_date"), F.col("acq_date").alias("to_date"), F.lag("pixels").over(w).alias("from_pixels"), F.col("pixels").alias("to_pixels"), (F.col("fraction") - F.lag("fraction").over(w)).alias("fraction_delta")
    ).where("from_date IS NOT NULL")
    delta = F.col("to_pixels") - F.col("from_pixels")
    return steps.withColumn("delta", delta).withColumn("percent", F.when(F.col("from_pixels") == 0, 0.0).otherwise(F.try_divide(delta * 100.0, F.col("from_pixels"))))


def seasonal(metrics: DataFrame, seasons=None) -> DataFrame:
    """Per season and class: samples, mean and population deviation of the fraction."""
    named = metrics.withColumn("season", season(F.month("acq_date"), seasons))
    return named.groupBy("season", "class_id").agg(F.count_distinct("sample_id").alias("n_samples"), F.avg("fraction").alias("mean_fraction"), F.stddev_pop("fraction").alias("std_fraction"))


def spatial(metrics: DataFrame, ids=("aoi_id", "river_name", "basin_id")) -> DataFrame:
    """Mean fraction per class by each kind of place, in one pass; empty ids are skipped."""
    places = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id")) for c in ids])
    each = metrics.withColumn("place", F.explode(F.filter(places, lambda p: p["id"].isNotNull() & (p["id"] != ""))))
    return each.groupBy(F.concat_ws(":", "place.kind", "place.id").alias("place"), "class_id").agg(F.count_distinct("sample_id").alias("n_samples"), F.avg("fraction").alias("mean_fraction"))


def uncertainty(cells: DataFrame, *by: str, low: float = 0.5) -> DataFrame:
    """Confidence: mean, population deviation, extremes, and how much is low."""
    c = F.col("confidence")
    return cells.groupBy(*by).agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c < low).alias("n_low"), F.avg((c < low).cast("double")).alias("share_low")
    )


def change_map(a: DataFrame, b: DataFrame, keys=("r", "c")) -> DataFrame:
    """Cells of two dates: class before and after, and whether it changed."""
    return a.select(*keys, F.col("class_id").alias("before")).join(b.select(*keys, F.col("class_id").alias("after")), list(keys)).withColumn("changed", F.col("before") != F.col("after"))


def first_samples(metrics: DataFrame, n: int = 0) -> DataFrame:
    """Samples in the order of their dates (then ids); the first ``n`` of them, or all for 0."""
    ordered = metrics.orderBy("acq_date", "sample_id")
    return ordered.limit(n) if n else ordered


def mean_fractions(metrics: DataFrame, *by: str) -> DataFrame:
    """Mean fraction of each class over samples."""
    return metrics.groupBy(*by, "class_id").agg(F.avg("fraction").alias("mean_fraction"))


def class_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fraction of each class in the second sample less that in the first; a class that one lacks counts 0 there."""
    both = a.select("class_id", F.col("fraction").alias("before")).join(b.select("class_id", F.col("fraction").alias("after")), "class_id", "full")
    return both.select("class_id", (F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).alias("difference"))


def sample_rows(shares: DataFrame, regions: DataFrame, doubts: DataFrame, names: dict[int, str], key: str = "sample_id") -> DataFrame:
    """One row per sample: total pixels, fraction of each class, regions and mean confidence.

    ``shares`` is from ``classify.shares``, ``regions`` from ``regions.region_metrics``, ``doubts`` from ``uncertainty``.
    """
    wide = shares.groupBy(key).agg(F.sum("pixels").alias("total_pixels"), *[F.sum(F.when(F.col("class_id") == k, F.col("fraction"))).alias(f"fraction_{v}") for k, v in names.items()])
    shapes = regions.groupBy(key).agg(F.sum("n_regions").alias("n_regions"), F.max("largest_px").alias("largest_px"))
    out = wide.join(shapes, key, "left").join(doubts.select(key, F.col("mean").alias("mean_confidence")), key, "left")
    return out.withColumns({"n_regions": F.coalesce("n_regions", F.lit(0)), "largest_px": F.coalesce("largest_px", F.lit(0))})


def dataset_row(samples: DataFrame, names) -> DataFrame:
    """One row over all samples of ``sample_rows``: their number, pixels, mean fractions and mean confidence (0 without samples)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return samples.agg(F.count("*").alias("n_samples"), F.coalesce(F.sum("total_pixels"), F.lit(0)).alias("total_pixels"), *[zero(F.avg(f"fraction_{v}")).alias(f"mean_{v}") for v in names], zero(F.avg("mean_confidence")).alias("mean_confidence"))


def mean_of_means(cells: DataFrame, key: str = "sample_id") -> DataFrame:
    """Mean over samples of their mean confidence, each sample counting once."""
    return cells.groupBy(key).agg(F.avg("confidence").alias("m")).agg(F.avg("m").alias("mean_confidence"))


def input_issues(samples: DataFrame, cells: DataFrame, low: float = 0.5, pixel_area: float = 900.0, key: str = "sample_id") -> DataFrame:
    """(subject, issue) of what analytics is given: settings, no samples, samples without a mask or with a confidence that is no number."""
    spark = samples.sparkSession
    settings = [("settings", "low confidence threshold outside 0 to 1")] * (not 0 <= low <= 1) + [("settings", "negative pixel area")] * (pixel_area < 0)
    told = spark.createDataFrame(settings, "subject string, issue string")
    none = samples.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("samples").alias("subject"), F.lit("no samples").alias("issue"))
    per_sample = prediction_issues(samples, cells, key).select(F.col(key).cast("string").alias("subject"), "issue")
    return told.unionByName(none).unionByName(per_sample)
