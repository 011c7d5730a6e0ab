"""Scaling, quality masks and spectral indices.  Missing is NULL everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale and offset of surface reflectance and temperature, quality bits.
OPTICAL_SCALE, OPTICAL_OFFSET = 2.75e-5, -0.2
THERMAL_SCALE, THERMAL_OFFSET = 0.00341802, 149.0
QA_BITS = {"fill": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "shadow": 4, "snow": 5, "clear": 6, "water": 7}
SCENE_CLASSES_MASKED = (3, 8, 9, 10, 11)

OPTICAL = ("Blue", "Green", "Red", "NIR", "SWIR1", "SWIR2")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; NULL stays NULL (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def optical(x: Column) -> Column:
    return clamp(x * OPTICAL_SCALE + OPTICAL_OFFSET)


def thermal(x: Column) -> Column:
    return x * THERMAL_SCALE + THERMAL_OFFSET


def has_bit(qa: Column, bit: str) -> Column:
    return qa.bitwiseAND(1 << QA_BITS[bit]) != 0


def usable(qa: Column, masked=("fill", "dilated_cloud", "cirrus", "cloud", "shadow")) -> Column:
    """No masked bit is set: one AND with a constant.  A missing QA is not usable."""
    bits = sum(1 << QA_BITS[b] for b in masked)
    return F.coalesce(qa.bitwiseAND(bits) == 0, F.lit(False)) if bits else F.lit(True)


def usable_scene_class(scl: Column) -> Column:
    return F.coalesce(~scl.isin(*SCENE_CLASSES_MASKED), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where either is missing or b is 0."""
    return F.try_divide(a, b)


def difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def _bare(b):
    bright, dark = b["SWIR1"] + b["Red"], b["NIR"] + b["Blue"]
    return difference(bright, dark)


#: Index by name: a function of the bands.
INDICES = {
    "NDWI": lambda b: difference(b["Green"], b["NIR"]),
    "MNDWI": lambda b: difference(b["Green"], b["SWIR1"]),
    "AWEI_sh": lambda b: b["Blue"] + 2.5 * b["Green"] - 1.5 * (b["NIR"] + b["SWIR1"]) - 0.25 * b["SWIR2"],
    "AWEI_nsh": lambda b: 4.0 * (b["Green"] - b["SWIR1"]) - (0.25 * b["NIR"] + 2.75 * b["SWIR2"]),
    "NDVI": lambda b: difference(b["NIR"], b["Red"]),
    "SAVI": lambda b: soil_adjusted(b["NIR"], b["Red"]),
    "BSI": _bare,
    "NDMI": lambda b: difference(b["NIR"], b["SWIR1"]),
    "NDBI": lambda b: difference(b["SWIR1"], b["NIR"]),
}


def soil_adjusted(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return ratio(nir - red, nir + red + soil) * (1 + soil)


def feature_columns(names=tuple(INDICES)) -> list[Column]:
    """The six optical bands, then the indices, in a fixed order."""
    bands = {b: F.col(b) for b in OPTICAL}
    return [F.col(b) for b in OPTICAL] + [INDICES[n](bands).alias(n) for n in names]
