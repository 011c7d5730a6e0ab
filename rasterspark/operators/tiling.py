"""Windows of rasters, pixels in windows, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import patch_id


def offsets(dim: Column, size: int, stride: int, flush: bool = False) -> Column:
    """Window offsets along one axis; ``flush`` adds a last one that ends with the raster."""
    last = dim - size
    found = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_union(found, F.array(F.greatest(last, F.lit(0))))) if flush else found


def windows(rasters: DataFrame, size: int, stride: int, flush: bool = False) -> DataFrame:
    """Row-major windows of each raster (width, height)."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride are at least 1")
    rows = rasters.select("*", F.posexplode(offsets(F.col("height"), size, stride, flush)).alias("row_index", "row_off"))
    return rows.select("*", F.posexplode(offsets(F.col("width"), size, stride, flush)).alias("col_index", "col_off"))


def in_windows(pixels: DataFrame, size: int, stride: int, height: Column, width: Column) -> DataFrame:
    """Each pixel with every whole window that covers it, by computed indexes and no join."""
    def covering(at: Column, dim: Column):
        low = F.greatest(F.ceil((at - size + 1) / stride), F.lit(0)).cast("int")
        high = F.least(F.floor(at / stride), F.floor((dim - size) / stride)).cast("int")
        return F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    out = pixels.withColumn("row_index", F.explode(covering(F.col("row"), height))).withColumn("col_index", F.explode(covering(F.col("col"), width)))
    return out.withColumns({"r": F.col("row") - F.col("row_index") * stride, "c": F.col("col") - F.col("col_index") * stride})


def valid_ratio(cells: DataFrame, bands, *by: str, nodata: float = -9999.0, least: float = 0.7) -> DataFrame:
    """Share of cells with no missing band, and whether it suffices."""
    bad = F.lit(False)
    for b in bands:
        bad = bad | F.col(b).isNull() | F.isnan(b) | F.coalesce(F.abs(F.col(b) - nodata) < 1e-6, F.lit(False))
    return cells.groupBy(*by).agg(F.avg((~bad).cast("double")).alias("valid_ratio")).withColumn("is_valid", F.col("valid_ratio") >= least)


def mosaic(cells: DataFrame, keys=("row", "col"), order=("row_index", "col_index")) -> DataFrame:
    """Overlapping tiles: the last in row-major order wins."""
    return cells.groupBy(*keys).agg(F.max_by("class_id", F.struct(*order)).alias("class_id"))


def stitch(cells: DataFrame, *by: str) -> DataFrame:
    """Places (row, col) in the whole raster of cells (r, c) of tiles; tile row 0 is the southern edge and so comes last.

    A tile row is as high as its highest tile, a tile column as wide as its widest.
    """
    def starts(index: str, at: str, out: str, order: Column):
        sizes = cells.groupBy(*by, index).agg((F.max(at) + 1).alias("_size"))
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one row per row or column of tiles
        return sizes.select(*by, index, F.coalesce(F.sum("_size").over(w), F.lit(0)).cast("int").alias(out))

    placed = cells.join(starts("row_index", "r", "_top", F.desc("row_index")), [*by, "row_index"]).join(starts("col_index", "c", "_left", F.asc("col_index")), [*by, "col_index"])
    return placed.withColumns({"row": F.col("_top") + F.col("r"), "col": F.col("_left") + F.col("c")}).drop("_top", "_left")


def named_bands(values: DataFrame, *by: str, nodata: float = -9999.0) -> DataFrame:
    """Values (by, band_index, description, value) with a band name, ``band_{i}`` where it has no description, and nodata as NULL."""
    name = F.coalesce(F.when(F.trim("description") != "", F.col("description")), F.concat(F.lit("band_"), F.col("band_index").cast("string")))
    x = F.when(~F.isnan("value") & (F.abs(F.col("value") - nodata) >= 1e-6), F.col("value"))
    return values.select(*by, name.alias("band"), x.alias("value"))


def padded(cells: DataFrame, bands, size: int, *by: str) -> DataFrame:
    """A dense ``size`` by ``size`` grid of each tile; what the raster lacks is 0."""
    grid = cells.select(*by).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return grid.join(cells, [*by, "r", "c"], "left").withColumns({b: F.coalesce(F.col(b), F.lit(0.0)) for b in bands})


def in_flush_windows(pixels: DataFrame, size: int, stride: int, height: Column, width: Column) -> DataFrame:
    """Each pixel with every window that covers it, the last one ending with the raster."""
    def covering(at: Column, dim: Column):
        starts = offsets(dim, size, stride, flush=True)
        return F.filter(F.transform(starts, lambda o, i: F.struct(i.cast("int").alias("index"), o.cast("int").alias("off"))), lambda w: (w["off"] <= at) & (at < w["off"] + size))

    out = pixels.withColumn("row_window", F.explode(covering(F.col("row"), height))).withColumn("col_window", F.explode(covering(F.col("col"), width)))
    named = {"row_index": F.col("row_window.index"), "col_index": F.col("col_window.index"), "r": F.col("row") - F.col("row_window.off"), "c": F.col("col") - F.col("col_window.off")}
    return out.withColumns(named).drop("row_window", "col_window")


def predicted_scene(tiles: DataFrame, *by: str, logits: str = "logits") -> DataFrame:
    """Classes of whole scenes from scored tiles: best class of each cell, the last tile in row-major order."""
    scored = tiles.withColumn("class_id", (F.array_position(logits, F.array_max(logits)) - 1).cast("int"))
    return mosaic(scored, (*by, "row", "col"))


def cut_patches(cells: DataFrame, windows: DataFrame, bands, scene: str = "scene_id", least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, counts) of patches: cells (scene, row_index, col_index, bands) checked against ``least``.

    A row has its id, place, valid share and verdict; counts are of windows in all, patches that are valid, and those skipped.
    """
    checked = valid_ratio(cells, bands, scene, "row_index", "col_index", least=least)
    rows = windows.join(checked, [scene, "row_index", "col_index"], "left").withColumns({"valid_ratio": F.coalesce("valid_ratio", F.lit(0.0)), "is_valid": F.coalesce("is_valid", F.lit(False))})
    rows = rows.withColumn("patch_id", patch_id(F.col(scene).cast("string"), F.col("row_index"), F.col("col_index")))
    counts = rows.groupBy(scene).agg(F.count("*").alias("total"), F.count_if("is_valid").alias("generated"), F.count_if(~F.col("is_valid")).alias("skipped"))
    return rows, counts
