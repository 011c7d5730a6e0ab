"""One band schema for several sensor families: renaming, scaling, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral

# Common band names, and the source bands of each sensor family in the same order.
COMMON_BANDS = ("Blue", "Green", "Red", "NIR", "SWIR1", "SWIR2", "Thermal", "QA")
SOURCE_BANDS = {
    "OLI": ("SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "SR_B7", "ST_B10", "QA_PIXEL"),
    "TM": ("SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B7", "ST_B6", "QA_PIXEL"),
    "S2": ("B2", "B3", "B4", "B8", "B11", "B12", None, "SCL"),
}
OLI_CRAFT = ("LANDSAT_8", "LANDSAT_9")
S2_PATTERN = "^Sentinel-2.*"
S2_SCALE = 1e-4


def family(craft: Column) -> Column:
    """S2 by name, OLI by list, everything else (unknown too) TM."""
    return F.when(F.coalesce(craft.rlike(S2_PATTERN), F.lit(False)), "S2").when(craft.isin(*OLI_CRAFT), "OLI").otherwise("TM")


def harmonised(pixels: DataFrame, bands: str = "bands", craft: str = "spacecraft_id") -> DataFrame:
    """``pixels`` with the common bands as columns in place of the map ``bands`` of a sensor's own names.

    A band that a sensor's map lacks is NULL; Sentinel-2 has a thermal band of 0.
    """
    kind = family(F.col(craft))

    def value(k: int) -> Column:
        of = lambda f: F.lit(0.0) if SOURCE_BANDS[f][k] is None else F.try_element_at(F.col(bands), F.lit(SOURCE_BANDS[f][k]))
        return F.when(kind == "S2", of("S2")).when(kind == "OLI", of("OLI")).otherwise(of("TM"))

    rest = [F.col(c) for c in pixels.columns if c != bands]
    return pixels.select(*rest, *[value(k).alias(name) for k, name in enumerate(COMMON_BANDS)])


def missing_bands(table: DataFrame) -> list[str]:
    """Common bands that a table lacks; indices need all of them."""
    return [b for b in COMMON_BANDS if b not in table.columns]


def scaled(pixels: DataFrame, craft: str = "spacecraft_id") -> DataFrame:
    """Reflectance and temperature from integers, by sensor family."""
    is_s2 = family(F.col(craft)) == "S2"
    optical = {b: F.when(is_s2, spectral.clamp(F.col(b) * S2_SCALE)).otherwise(spectral.optical(F.col(b))) for b in spectral.OPTICAL}
    return pixels.withColumns(optical | {"Thermal": F.when(is_s2, F.col("Thermal")).otherwise(spectral.thermal(F.col("Thermal")))})


def masked(pixels: DataFrame, craft: str = "spacecraft_id", bits=("fill", "dilated_cloud", "cirrus", "cloud", "shadow")) -> DataFrame:
    """Pixels of which the family's quality band says no are missing in all bands; without ``bits`` nothing changes."""
    if not bits:
        return pixels
    qa = F.col("QA").cast("int")
    good = F.when(family(F.col(craft)) == "S2", spectral.usable_scene_class(qa)).otherwise(spectral.usable(qa, bits))
    return pixels.withColumns({b: F.when(good, F.col(b)) for b in COMMON_BANDS})


def preprocess(pixels: DataFrame, scale: bool = True, mask: bool = True, craft: str = "spacecraft_id", log: list | None = None) -> DataFrame:
    """Harmonise, scale and mask, each as the sensor's family needs; the names of the steps go to ``log``."""
    steps = [("harmonise", lambda df: harmonised(df, craft=craft))]
    steps += [("scale", lambda df: scaled(df, craft))] * scale + [("mask", lambda df: masked(df, craft))] * mask
    for name, step in steps:
        pixels = step(pixels)
        if log is not None:
            log.append(name)
    return pixels


def features(table: DataFrame, *keys: str, names=tuple(spectral.INDICES)) -> DataFrame:
    """Keys, optical bands and indices of a harmonised table; an error if a band is missing."""
    if lacking := missing_bands(table):
        raise ValueError(f"not harmonised: {', '.join(lacking)} missing")
    return table.select(*keys, *spectral.feature_columns(names))
