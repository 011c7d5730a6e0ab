"""Colours of class masks and pictures, as tables of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Colours of known classes, those for others in turn, and grey for what is no class.
COLOURS = {"background": (0.20, 0.20, 0.20), "water": (0.13, 0.47, 0.71), "sand": (0.95, 0.85, 0.55), "vegetation": (0.20, 0.63, 0.17)}
CYCLE = ((0.84, 0.15, 0.16), (0.58, 0.40, 0.74), (0.55, 0.34, 0.29), (0.89, 0.47, 0.76), (0.50, 0.50, 0.50), (0.74, 0.74, 0.13))
GREY, UNSURE = (0.5, 0.5, 0.5), (0.9, 0.1, 0.1)
CHANNELS = ("red", "green", "blue")


def palette(names, overrides=None, registered=None) -> list[tuple[float, float, float]]:
    """Colour of each class: an override, else a registered one, else its own, else one of the cycle."""
    found = COLOURS | (registered or {}) | (overrides or {})
    return [found.get(name, CYCLE[k % len(CYCLE)]) for k, name in enumerate(names)]


def coloured(cells: DataFrame, colours, class_col: str = "class_id") -> DataFrame:
    """``cells`` plus red, green and blue of their class."""
    def channel(k: int) -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(float(c[k])) for c in colours]), F.when(F.col(class_col) >= 0, F.col(class_col))), F.lit(GREY[k]))

    return cells.withColumns({name: channel(k) for k, name in enumerate(CHANNELS)})


def _within(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def background(cells: DataFrame, bands, *by: str) -> DataFrame:
    """Pictures as bg_red, bg_green, bg_blue: 0 to 255 becomes 0 to 1 where a sample has values above 1; one band stands for all three, further bands are left out."""
    bands = list(bands)
    bands = bands * 3 if len(bands) == 1 else bands[:3]
    most = F.max(F.greatest(*[F.col(b) for b in set(bands)], F.lit(0.0))).over(Window.partitionBy(*by))  # a picture is a bounded group
    scaled = cells.withColumn("_scale", F.when(most > 1, 255.0).otherwise(1.0))
    return scaled.withColumns({f"bg_{name}": _within(F.col(b) / F.col("_scale")) for name, b in zip(CHANNELS, bands, strict=True)}).drop("_scale")


def overlay(cells: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Class colours laid over the background (grey where there is none)."""
    under = lambda c: F.col(f"bg_{c}") if f"bg_{c}" in cells.columns else F.lit(GREY[0])
    return cells.withColumns({c: _within(under(c) * (1 - alpha) + F.col(c) * alpha) for c in CHANNELS})


def confidence_overlay(cells: DataFrame, threshold: float = 0.5, alpha: float = 0.5) -> DataFrame:
    """Class colours blended with red where confidence is below the threshold."""
    unsure = F.coalesce(F.col("confidence") < threshold, F.lit(False))
    return cells.withColumns({c: F.when(unsure, F.col(c) * (1 - alpha) + UNSURE[k] * alpha).otherwise(F.col(c)) for k, c in enumerate(CHANNELS)})


def binary_maps(cells: DataFrame, n_classes: int, threshold: float = 0.5) -> DataFrame:
    """``cells`` plus is_unsure, and is_0, is_1, ... for each class."""
    flags = {f"is_{k}": F.coalesce(F.col("class_id") == k, F.lit(False)).cast("int") for k in range(n_classes)}
    return cells.withColumns({"is_unsure": F.coalesce(F.col("confidence") < threshold, F.lit(False)).cast("int")} | flags)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def percentile_stretch(cells: DataFrame, bands, *by: str, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """Bands of each picture (a bounded group) from its low and high percentiles to 0..255; not finite is 0, infinity 255."""
    aggs = [F.percentile(_finite(F.col(b)), [low / 100, high / 100]).alias(f"ends_{b}") for b in bands]
    ends = cells.groupBy(*by).agg(*aggs)

    def one(b: str) -> Column:
        first, last, x = F.get(f"ends_{b}", F.lit(0)), F.get(f"ends_{b}", F.lit(1)), F.col(b)
        span = F.when(last <= first, 1.0).otherwise(last - first)
        return F.when(x.isNull() | F.isnan(x) | first.isNull(), 0).otherwise(F.floor(_within((x - first) / span) * 255)).cast("int")

    return cells.join(ends, list(by)).withColumns({b: one(b) for b in bands}).drop(*[f"ends_{b}" for b in bands])


def minmax_stretch(cells: DataFrame, bands, *by: str) -> DataFrame:
    """Bands of each scene from its least to its greatest value, over all bands together, to 0..255; missing counts as 0."""
    clean = {b: F.coalesce(F.nanvl(F.col(b), F.lit(0.0)), F.lit(0.0)) for b in bands}
    each = [F.col(b) for b in bands]
    least, most = (F.least(*each), F.greatest(*each)) if len(each) > 1 else (each[0], each[0])
    cells = cells.withColumns(clean)
    ends = cells.groupBy(*by).agg(F.min(least).alias("least"), F.max(most).alias("most"))  # a scene may be large: two scans, but no task gets all of it
    one = lambda b: F.floor(F.coalesce(F.try_divide(F.col(b) - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0)) * 255).cast("int")
    return cells.join(ends, list(by)).withColumns({b: one(b) for b in bands}).drop("least", "most")
