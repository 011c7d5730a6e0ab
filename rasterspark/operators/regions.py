"""Connected regions of class masks and their geometry."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import masks, stacks


def label(cells: DataFrame, patch: str = "patch_id", four=(1,), background: int = 0) -> DataFrame:
    """``cells`` of other classes than the background plus ``region_id``, numbered per patch and class.

    Classes in ``four`` join along edges, the others also across corners.
    """

    def run(table: pa.Table) -> pa.Table:
        group = stacks.group_numbers(table, [patch])
        r, c, classes = (table[x].to_numpy().astype(np.int64) for x in ("r", "c", "class_id"))
        out = np.zeros(len(group), np.int64)
        for rows, places, shape in stacks.stacks(group, r, c, *stacks.ends(group, r, c)):
            for k in np.unique(classes[rows]):
                own = classes[rows] == k
                mask = np.zeros(shape, bool)
                mask.reshape(-1)[places[own]] = True
                named = masks.components(mask, eight=k not in four).reshape(len(mask), -1)
                before = np.maximum.accumulate(np.r_[0, named.max(axis=1)[:-1]])  # numbers run on through the stack
                out[rows[own]] = (named - before[:, None]).reshape(-1)[places[own]]
        return table.append_column("region_id", pa.array(out))

    kept = cells.where((F.col("class_id") != background) & F.col("r").isNotNull() & F.col("c").isNotNull())
    return stacks.per_table(kept, [patch], run, StructType([*cells.schema.fields, StructField("region_id", LongType())]))


def regions(labelled: DataFrame, *by: str, least: int = 4, pixel_area: float = 900.0) -> DataFrame:
    """One row per region of ``least`` cells or more: area, half-open box, perimeter and shape.

    An edge is exposed unless two cells of the region share it.
    """
    keys = [*by, "class_id", "region_id"]
    place = F.col("r").cast("long") * (1 << 32) + F.col("c")
    beside = lambda step: F.size(F.array_intersect("_places", F.transform("_places", lambda x: x + step)))
    found = labelled.groupBy(*keys).agg(
        F.count("*").alias("area_px"), F.min("r").alias("row_min"), (F.max("r") + 1).alias("row_max"), F.min("c").alias("col_min"), (F.max("c") + 1).alias("col_max"),
        F.collect_list(place).alias("_places"), F.avg("confidence").alias("mean_confidence"),
    ).where(F.col("area_px") >= least)
    n_rows = F.size(F.array_distinct(F.transform("_places", lambda x: F.shiftright(x, 32))))
    found = found.withColumns({"perimeter": 4 * F.col("area_px") - 2 * (beside(1) + beside(1 << 32)).cast("long"), "row_width": F.col("area_px") / n_rows})
    order = [*keys, "area_px", "row_min", "row_max", "col_min", "col_max", "perimeter", "mean_confidence", "row_width"]
    return with_shape(found.select(*order), pixel_area)


def with_shape(found: DataFrame, pixel_area: float) -> DataFrame:
    """Regions with what follows from their box, area and perimeter."""
    height, width = F.col("row_max") - F.col("row_min"), F.col("col_max") - F.col("col_min")
    return found.withColumns({
        "area_m2": F.col("area_px") * pixel_area,
        "aspect": width / height,
        "compactness": F.coalesce(F.try_divide(4 * math.pi * F.col("area_px"), F.col("perimeter") * F.col("perimeter")), F.lit(0.0)),
        "elongation": 1 - F.least(height, width) / F.greatest(height, width),
    })


def region_metrics(labelled: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """Per class: regions, largest, mean and population deviation, fragmentation, width of the largest."""
    pixels = labelled.groupBy(*by, "class_id").agg(F.count("*").alias("class_px"))
    sizes = found.groupBy(*by, "class_id").agg(
        F.count("*").alias("n_regions"), F.max("area_px").alias("largest_px"), F.avg("area_px").alias("mean_px"), F.stddev_pop("area_px").alias("std_px"), F.max_by("row_width", F.struct("area_px", -F.col("region_id"))).alias("width_px")
    )
    joined = pixels.join(sizes, [*by, "class_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(joined.schema[c].dataType)) for c in ("n_regions", "largest_px", "mean_px", "std_px", "width_px")}
    return joined.withColumns(zero).withColumn("fragmentation", F.col("n_regions") / F.col("class_px"))


def ranked(found: DataFrame, *by: str) -> DataFrame:
    """Regions with their rank by area within a class, largest first; of equal ones the lesser region_id."""
    w = Window.partitionBy(*by, "class_id").orderBy(F.desc("area_px"), "region_id")
    return found.withColumn("rank", F.row_number().over(w))
