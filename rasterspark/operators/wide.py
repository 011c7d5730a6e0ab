"""Scenes that are cut into tiles: cleaning with a rim of neighbours, and regions across tile borders.

A scene is a table of cells (scene_id, row, col, class_id) of any size.  Tasks
see one tile at a time:

* ``clean`` gives each tile the cells around it as far as its step can reach, by
  one shuffle of the cells and copies of those near borders; what the step makes
  of the rim is thrown away, as the tile next door sees that whole.
* ``regions`` finds the parts of regions in each tile with their figures, joins
  parts that touch across a border, and adds up figures; cells move once.

Rows without place or class belong to no region and stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, stacks
from ..sources.manifests import kept
from . import cleaning
from .regions import with_shape

#: Side of a tile in cells.
TILE = 512
#: A cell's number within its scene: row * WIDE + col.
WIDE = 1 << 31

PART = "scene_id {kind}, class_id int, part long, area_px long, row_min long, row_max long, col_min long, col_max long, bare long, confidence double, rows array<long>, rim array<long>"


def dropped(*tables: DataFrame) -> None:
    """Delete what ``kept`` has written, once nothing reads it."""
    for table in tables:
        for file in table.inputFiles():  # all lie in one folder
            _delete(table.sparkSession, file.rsplit("/", 1)[0])
            break


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(own, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id that an edge (a, b) names; ``root`` is the least id of its component.

    Alternating stars: each id points its larger neighbours to its least one,
    then itself and its smaller neighbours to the least of them, until every edge points
    to a root.  Rounds grow with the logarithm of the longest chain, squared at worst.
    """
    signature = lambda stars: stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = signature(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = kept(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "stars")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("low")), "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b")))
        new = kept(small.where("a <> b").distinct(), "stars")
        after = signature(new)
        dropped(now, large)
        now = new
        if after == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = after


# Regions


def parts(cells: DataFrame, tile: int = TILE, four=(1,), background: int = 0) -> DataFrame:
    """One row for each part of a region within a tile.

    ``part`` is the number of its first cell, ``bare`` counts edges without a
    neighbour of its class in the tile, ``rim`` lists its cells on the tile's border.
    """
    kind = cells.schema["scene_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row, col = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
        top, left = int(row.min() // tile * tile), int(col.min() // tile * tile)
        class_id, names, bare = frame["class_id"].to_numpy(), np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for k in np.unique(class_id):
            own = np.flatnonzero(class_id == k)
            mask, at = np.zeros((tile, tile), bool), (row[own] - top, col[own] - left)
            mask[at] = True
            names[own] = names.max() + masks.components(mask, eight=k not in four)[at]
            bare[own] = 4 - sum((mask & masks.shift(mask, i, j, False)).astype(np.int64) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))[at]
        cell, order = row * WIDE + col, np.lexsort((col, row, names))
        first = np.flatnonzero(np.r_[True, np.diff(names[order]) > 0])
        over = lambda op, x: op.reduceat(x[order], first)
        rim = np.isin(row % tile, (0, tile - 1)) | np.isin(col % tile, (0, tile - 1))
        new_row = np.r_[True, (np.diff(names[order]) != 0) | (np.diff(row[order]) != 0)]
        listed = lambda x, chosen: np.split(x[order][chosen], np.searchsorted(np.flatnonzero(chosen), first)[1:])
        confidence = frame["confidence"].to_numpy(float) if "confidence" in frame else np.full(len(frame), np.nan)
        return pd.DataFrame({
            "scene_id": frame["scene_id"].iat[0], "class_id": class_id[order][first], "part": over(np.minimum, cell), "area_px": np.diff(np.r_[first, len(order)]),
            "row_min": over(np.minimum, row), "row_max": over(np.maximum, row) + 1, "col_min": over(np.minimum, col), "col_max": over(np.maximum, col) + 1,
            "bare": over(np.add, bare), "confidence": over(np.add, confidence), "rows": listed(row, new_row), "rim": listed(cell, rim[order]),
        })

    inside = cells.where((F.col("class_id") != background) & F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("scene_id").isNotNull())
    return inside.groupBy("scene_id", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)).applyInPandas(run, PART.format(kind=kind))


def joined(found: DataFrame, tile: int = TILE, four=(1,)) -> tuple[DataFrame, DataFrame]:
    """(parts with ``region_id``, the least of their cells' numbers; shared edges across borders by region)."""
    rim = found.select("scene_id", "class_id", "part", F.explode("rim").alias("cell"))
    place = rim.withColumns({"row": F.floor(F.col("cell") / WIDE), "col": F.col("cell") % WIDE})
    steps = F.when(F.col("class_id").isin(*four), F.array(*_steps(((0, 1), (1, 0))))).otherwise(F.array(*_steps(((0, 1), (1, 0), (1, 1), (1, -1)))))
    there = place.withColumn("step", F.explode(steps)).withColumns({"to_row": F.col("row") + F.col("step.i"), "to_col": F.col("col") + F.col("step.j")})
    apart = (F.floor(F.col("to_row") / tile) != F.floor(F.col("row") / tile)) | (F.floor(F.col("to_col") / tile) != F.floor(F.col("col") / tile))
    there = there.where(apart & (F.col("to_col") >= 0)).select("scene_id", "class_id", F.col("part").alias("from"), (F.col("to_row") * WIDE + F.col("to_col")).alias("cell"), ((F.col("step.i") == 0) | (F.col("step.j") == 0)).alias("straight"))
    touch = kept(there.join(rim, ["scene_id", "class_id", "cell"]).groupBy("scene_id", "class_id", "from", "part").agg(F.count_if("straight").alias("n")), "touching")
    node = lambda c: F.struct("scene_id", "class_id", F.col(c).alias("part"))
    roots = components(touch.select(node("from").alias("a"), node("part").alias("b"))).select("id.*", F.col("root.part").alias("root"))
    whole = found.join(roots, ["scene_id", "class_id", "part"], "left").withColumn("region_id", F.coalesce("root", "part")).drop("root")
    edges = touch.join(roots.withColumnRenamed("part", "from"), ["scene_id", "class_id", "from"]).groupBy("scene_id", "class_id", F.col("root").alias("region_id")).agg(F.sum("n").alias("across"))
    return whole, edges


def _steps(pairs) -> list:
    return [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs]


def regions(cells: DataFrame, tile: int = TILE, four=(1,), background: int = 0, least: int = 4, pixel_area: float = 900.0) -> DataFrame:
    """One row per region of ``least`` cells or more, with the columns of ``operators.regions.regions``.

    ``region_id`` is row * 2**31 + col of the region's first cell.  Classes in
    ``four`` join along edges, the others also across corners.
    """
    whole, edges = joined(kept(parts(cells, tile, four, background), "parts"), tile, four)
    whole = kept(whole, "joined")
    keys = ["scene_id", "class_id", "region_id"]
    rows = whole.select(*keys, F.explode("rows").alias("row")).distinct().groupBy(*keys).agg(F.count("*").alias("n_rows"))
    sums = whole.groupBy(*keys).agg(
        F.sum("area_px").alias("area_px"), F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max"),
        F.sum("bare").alias("bare"), F.sum("confidence").alias("confidence"),
    )
    found = sums.where(F.col("area_px") >= least).join(rows, keys).join(edges, keys, "left")
    figures = {"perimeter": F.col("bare") - 2 * F.coalesce("across", F.lit(0)), "mean_confidence": F.col("confidence") / F.col("area_px"), "row_width": F.col("area_px") / F.col("n_rows")}
    return with_shape(found.withColumns(figures).drop("bare", "across", "confidence", "n_rows"), pixel_area)


def metrics(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Per scene and class: regions, the largest, mean and population deviation, fragmentation, width of the largest."""
    pixels = cells.where("class_id <> 0").groupBy("scene_id", "class_id").agg(F.count("*").alias("class_px"))
    sizes = found.groupBy("scene_id", "class_id").agg(
        F.count("*").alias("n_regions"), F.max("area_px").alias("largest_px"), F.avg("area_px").alias("mean_px"), F.stddev_pop("area_px").alias("std_px"), F.max_by("row_width", F.struct("area_px", -F.col("region_id"))).alias("width_px")
    )
    told = pixels.join(sizes, ["scene_id", "class_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(told.schema[c].dataType)) for c in ("n_regions", "largest_px", "mean_px", "std_px", "width_px")}
    return told.withColumns(zero).withColumn("fragmentation", F.col("n_regions") / F.col("class_px"))


# Cleaning


def reach(step, classes: int = 1) -> int:
    """How far from a cell a step looks, in cells.

    A component of fewer than n cells lies within n cells of each of its own, so
    sizes bound the reach of the steps that look at components.
    """
    if isinstance(step, cleaning.Cleaning):
        own = [step, *step.overrides.values()]
        return classes * max(2 * s.opening + 2 * s.closing + s.least_object + s.least_hole for s in own)
    found = getattr(step, "reach", None)
    if found is None:
        raise ValueError("a step must tell its reach: it may look at the whole scene")
    return found


def clean(cells: DataFrame, *steps, classes: int = 4, tile: int = TILE, rim: int | None = None) -> DataFrame:
    """``cells`` with the classes that the steps give each scene, as if it were one grid.

    ``classes`` is how many there are: a class sees what those before it have
    changed, so the reach adds up.  ``rim`` overrides the sum of reaches, for steps that tell none.
    """
    far = sum(reach(s, classes) for s in steps) if rim is None else rim
    placed = cells.where("scene_id IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")
    ends = placed.groupBy("scene_id").agg((F.max("row") + 1).alias("_height"), (F.max("col") + 1).alias("_width"))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - far) / tile), F.floor((F.col(c) + far) / tile)))
    near = placed.join(ends, "scene_id").withColumn("_tr", span("row")).withColumn("_tc", span("col"))
    near = near.where("_tr >= 0 AND _tc >= 0 AND _tr * {0} < _height AND _tc * {0} < _width".format(tile))
    keys = ["scene_id", "_tr", "_tc"]

    names = cells.columns

    def run(table: pa.Table) -> pa.Table:
        group = stacks.group_numbers(table, keys)
        row, col, tr, tc, height, width = (table[x].to_numpy().astype(np.int64) for x in ("row", "col", "_tr", "_tc", "_height", "_width"))
        top, left = np.maximum(0, tr * tile - far), np.maximum(0, tc * tile - far)
        first = np.flatnonzero(np.r_[True, np.diff(group) > 0])
        height = (np.minimum(height, (tr + 1) * tile + far) - top)[first]
        width = (np.minimum(width, (tc + 1) * tile + far) - left)[first]
        done = cleaning.with_classes(table, "class_id", steps, group, row - top, col - left, height, width)
        return done.filter(pa.array((row // tile == tr) & (col // tile == tc))).select(names)

    done = stacks.per_table(near, keys, run, cells.schema)
    return done.unionByName(cells.where("scene_id IS NULL OR row IS NULL OR col IS NULL"))


def fill_holes(cells: DataFrame, classes=(0, 1, 2, 3), tile: int = TILE) -> DataFrame:
    """Every hole of any size that a class encloses takes that class; judged on the input, later classes overwrite.

    For each class the cells of other classes are the parts; a region of theirs
    that meets no border of the scene is a hole.  A place without a row parts regions.
    """
    placed = kept(cells.where("scene_id IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL"), "filled")
    ends = placed.groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    others = F.filter(F.array(*map(F.lit, classes)), lambda k: F.col("class_id").isNull() | (k != F.col("class_id")))
    rest = placed.select("scene_id", "row", "col", F.explode(others).alias("class_id"))
    whole, _ = joined(kept(parts(rest, tile, classes, -1), "outside"), tile, classes)
    keys = ["scene_id", "class_id", "region_id"]
    boxes = whole.groupBy(*keys).agg(*[f(c).alias(c) for f, c in ((F.min, "row_min"), (F.min, "col_min"), (F.max, "row_max"), (F.max, "col_max"))])
    holes = boxes.join(ends, "scene_id").where("row_min > 0 AND col_min > 0 AND row_max < height AND col_max < width").select(*keys)
    holes = whole.join(holes, keys, "left_semi").select("scene_id", "class_id", "part")
    last = _part_cells(rest, tile, classes).join(holes, ["scene_id", "class_id", "part"]).groupBy("scene_id", "row", "col").agg(F.max_by("class_id", F.array_position(F.array(*map(F.lit, classes)), F.col("class_id"))).alias("_k"))
    done = placed.join(last, ["scene_id", "row", "col"], "left").withColumn("class_id", F.when(F.col("class_id").isNotNull(), F.coalesce(F.col("_k").cast(cells.schema["class_id"].dataType), F.col("class_id")))).select(*cells.columns)
    return done.unionByName(cells.where("scene_id IS NULL OR row IS NULL OR col IS NULL"))


def _part_cells(cells: DataFrame, tile: int, four) -> DataFrame:
    """(scene_id, class_id, part, row, col): the part of each cell, as ``parts`` names it."""
    kind = cells.schema["scene_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row, col, class_id = (frame[c].to_numpy(np.int64) for c in ("row", "col", "class_id"))
        top, left, names = int(row.min() // tile * tile), int(col.min() // tile * tile), np.zeros(len(frame), np.int64)
        for k in np.unique(class_id):
            own = class_id == k
            mask, at = np.zeros((tile, tile), bool), (row[own] - top, col[own] - left)
            mask[at] = True
            names[own] = names.max() + masks.components(mask, eight=k not in four)[at]
        first = pd.Series(row * WIDE + col).groupby(names).transform("min")
        return pd.DataFrame({"scene_id": frame["scene_id"].to_numpy(), "class_id": class_id, "part": first.to_numpy(), "row": row, "col": col})

    return cells.groupBy("scene_id", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)).applyInPandas(run, f"scene_id {kind}, class_id int, part long, row long, col long")
