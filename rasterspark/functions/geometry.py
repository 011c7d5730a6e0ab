"""Places of rasters: affine transforms (a..f as a struct), window bounds, pixel sizes, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_000.0


def patch_id(scene: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_r%03d_c%03d", scene, row, col)


def shifted(transform: Column, row_off: Column, col_off: Column) -> Column:
    """The transform of a window that starts at an offset."""
    return transform.withField("c", transform["c"] + transform["a"] * col_off).withField("f", transform["f"] + transform["e"] * row_off)


def bounds(transform: Column, width: Column, height: Column) -> Column:
    """Box of a window from two of its corners."""
    x0, y0 = transform["c"], transform["f"]
    x1, y1 = x0 + transform["a"] * width, y0 + transform["e"] * height
    return F.struct(F.least(x0, x1).alias("min_lon"), F.least(y0, y1).alias("min_lat"), F.greatest(x0, x1).alias("max_lon"), F.greatest(y0, y1).alias("max_lat"))


def pixel_size(box: Column, metres: float) -> Column:
    """(width, height) in pixels of a box in degrees, at least 1."""
    shrink = F.cos(F.radians((box["min_lat"] + box["max_lat"]) / 2))
    side = lambda degrees: F.greatest(F.lit(1), F.bround(degrees * METRES_PER_DEGREE / metres).cast("int"))
    return F.struct(side((box["max_lon"] - box["min_lon"]) * shrink).alias("width"), side(box["max_lat"] - box["min_lat"]).alias("height"))


def offset(tile: Column, whole: Column) -> Column:
    """(col, row) of a tile's corner in the grid of a whole raster, as the tile lies below or above it."""
    return F.struct(F.bround((tile["c"] - whole["c"]) / whole["a"]).cast("int").alias("col"), F.bround((tile["f"] - whole["f"]) / F.abs(whole["e"])).cast("int").alias("row"))
