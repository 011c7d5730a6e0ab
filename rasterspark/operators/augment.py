"""Augmented samples as tables; every choice follows from a hash of sample, seed and epoch, so reruns agree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import stacks
from ..sources.manifests import kept


def chance(*parts) -> Column:
    """A number in [0, 1): the first 52 bits of the MD5 of the parts, joined by ``|``, as any engine can compute it."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def flip(cells: DataFrame, size: int, axis: str, when: Column) -> DataFrame:
    """Mirrors column ("c") or row ("r") places of the patches that ``when`` holds for."""
    return cells.withColumn(axis, F.when(when, size - 1 - F.col(axis)).otherwise(F.col(axis)))


def rotate(cells: DataFrame, size: int, turns: Column) -> DataFrame:
    """Square patches turned by 90 degrees, ``turns`` times: (r, c) goes to (size - 1 - c, r)."""
    k, r, c = F.pmod(turns, F.lit(4)), F.col("r"), F.col("c")
    far = lambda x: size - 1 - x
    return cells.withColumns({"r": F.when(k == 1, far(c)).when(k == 2, far(r)).when(k == 3, c).otherwise(r), "c": F.when(k == 1, r).when(k == 2, far(c)).when(k == 3, far(r)).otherwise(c)})


def contrast(cells: DataFrame, bands, factor: Column, *by: str) -> DataFrame:
    """Values moved from the mean of all bands of the patch by ``factor``."""
    sums = sum((F.coalesce(b, F.lit(0.0)) for b in bands), F.lit(0.0))
    known = sum((F.col(b).isNotNull().cast("int") for b in bands), F.lit(0))
    whole = Window.partitionBy(*by)  # a patch is a bounded group
    return cells.withColumn("_mean", F.sum(sums).over(whole) / F.sum(known).over(whole)).withColumns({b: (F.col(b) - F.col("_mean")) * factor + F.col("_mean") for b in bands}).drop("_mean")


def noise(cells: DataFrame, bands, sigma: float, *parts) -> DataFrame:
    """Gaussian noise from two hashes per value."""
    def normal(b):
        return F.sqrt(-2 * F.log(1 - chance(*parts, F.lit(f"{b}-a")))) * F.cos(2 * math.pi * chance(*parts, F.lit(f"{b}-b")))

    return cells.withColumns({b: F.col(b) + sigma * normal(b) for b in bands})


def crop(cells: DataFrame, top: Column, left: Column, size: int) -> DataFrame:
    """The cells of a window, counted from its corner."""
    inside = F.col("r").between(top, top + size - 1) & F.col("c").between(left, left + size - 1)
    return cells.where(inside).withColumns({"r": F.col("r") - top, "c": F.col("c") - left})


def stacked(samples: DataFrame, *by: str, value: str = "fraction", order: str = "class_id") -> DataFrame:
    """Bars of a stacked chart: each class from where the one before it ends."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("bottom", F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def area_tiles(areas: DataFrame, most: int) -> DataFrame:
    """Boxes of areas (width, height in pixels) in equal steps such that none has more than about ``most`` pixels."""
    side = math.isqrt(most)
    small = F.col("width") * F.col("height") <= most
    n = lambda c: F.when(small, 1).otherwise(F.ceil(F.col(c) / side)).cast("int")
    grid = areas.withColumn("n_rows", n("height")).withColumn("n_cols", n("width"))
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    lon, lat = (F.col("max_lon") - F.col("min_lon")) / F.col("n_cols"), (F.col("max_lat") - F.col("min_lat")) / F.col("n_rows")
    return grid.withColumns({
        "tile_min_lon": F.col("min_lon") + F.col("column") * lon, "tile_max_lon": F.least(F.col("max_lon"), F.col("min_lon") + (F.col("column") + 1) * lon),
        "tile_min_lat": F.col("min_lat") + F.col("row") * lat, "tile_max_lat": F.least(F.col("max_lat"), F.col("min_lat") + (F.col("row") + 1) * lat),
    })


def weighted_draws(samples: DataFrame, n: int, weight: str = "weight", key: str = "sample_id", seed: int = 42, per_slot: int = 1000, per_task: int = 200_000) -> DataFrame:
    """(draw, key): ``n`` draws with replacement, each sample as likely as its share of all weight.

    Samples lie one after another, by key, on a line of their weights, and draw
    k falls on it at ``chance(seed, k)``.  Keys are cut into ranges of about
    ``per_task``; sums within each, and before each, give every sample its part
    of the line.  A range is cut further where it is heavy, into slots of about
    ``per_slot`` draws, so no task gets more than a range and a slot.  Weights
    count relative to the largest, in doubles; those of 0 or less, or null, and
    null keys are never drawn.  Rows of one key add up.
    """
    spark = samples.sparkSession
    known = samples.select(F.col(key).alias("_key"), F.col(weight).cast("double").alias("_w")).where("_w > 0 AND _key IS NOT NULL")
    most, n_keys = known.agg(F.max("_w"), F.count("*")).first()
    if not n_keys:
        return known.select(F.lit(0).cast("long").alias("draw"), F.col("_key").alias(key)).where("false")
    units = known.groupBy("_key").agg((F.sum(F.col("_w") / most)).alias("_w"))
    units = kept(units.repartitionByRange(max(1, math.ceil(n_keys / per_task)), "_key").withColumn("_range", F.spark_partition_id()), "line")
    sums = sorted((r["_range"], r["w"]) for r in units.groupBy("_range").agg(F.sum("_w").alias("w")).collect())  # one row for each range
    starts, total = [], 0.0
    for _, w in sums:
        starts.append(total)
        total += w
    places = spark.createDataFrame([(k, at, total, max(1, math.ceil(n * w / total / per_slot)), w) for (k, w), at in zip(sums, starts, strict=True)], "_range int, _start double, _total double, _slots int, _in double")
    within = Window.partitionBy("_range").orderBy("_key")
    line = units.withColumn("_upto", F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("_from", F.coalesce(F.lag("_upto").over(within), F.lit(0.0))).join(F.broadcast(places), "_range")
    slot = lambda x: F.least(F.floor(x / F.col("_in") * F.col("_slots")), F.col("_slots") - 1).cast("int")
    line = line.withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_upto")))))
    line = line.select("_range", "_slot", F.col("_from").alias("_at"), "_key", F.lit(None).cast("long").alias("draw"))

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(ranges[np.searchsorted(starts_, x.to_numpy(), side="right") - 1])

    ranges, starts_ = np.array([k for k, _ in sums], np.int32), np.array(starts)
    draws = spark.range(n).select(F.col("id").alias("draw"), (chance(seed, F.col("id")) * total).alias("_x"))
    draws = draws.withColumn("_range", range_of("_x")).join(F.broadcast(places), "_range").withColumn("_at", F.col("_x") - F.col("_start"))
    draws = draws.select("_range", slot(F.col("_at")).alias("_slot"), "_at", F.lit(None).cast(line.schema["_key"].dataType).alias("_key"), "draw")
    holder = F.last("_key", ignorenulls=True).over(Window.partitionBy("_range", "_slot").orderBy("_at", F.col("draw").asc_nulls_first(), "_key").rowsBetween(Window.unboundedPreceding, 0))
    return line.unionByName(draws).withColumn(key, holder).where("draw IS NOT NULL").select("draw", key)


def brightness(cells: DataFrame, bands, delta: Column) -> DataFrame:
    """Values of all bands moved by ``delta``."""
    return cells.withColumns({b: F.col(b) + delta for b in bands})


#: Steps by name, for ``chain_of``: functions of cells, size, bands and a setting.  Users may add their own.
STEPS = {
    "horizontal_flip": lambda cells, size, bands, seed, p: flip(cells, size, "c", chance(F.col("patch_id"), seed, "h") < p),
    "vertical_flip": lambda cells, size, bands, seed, p: flip(cells, size, "r", chance(F.col("patch_id"), seed, "v") < p),
    "rotate90": lambda cells, size, bands, seed, p: rotate(cells, size, F.when(chance(F.col("patch_id"), seed, "r") < p, F.floor(chance(F.col("patch_id"), seed, "k") * 4)).otherwise(0).cast("int")),
    "brightness": lambda cells, size, bands, seed, most: brightness(cells, bands, (chance(F.col("patch_id"), seed, "b") * 2 - 1) * most),
    "contrast": lambda cells, size, bands, seed, most: contrast(cells, bands, 1 + (chance(F.col("patch_id"), seed, "c") * 2 - 1) * most, "patch_id"),
    "noise": lambda cells, size, bands, seed, sigma: noise(cells, bands, sigma, F.col("patch_id"), F.col("r"), F.col("c"), seed),
}


def chain_of(settings: dict, size: int, bands, seed: int = 0) -> list:
    """Steps of a configuration {name: setting}, in the order of ``STEPS``; an unknown name is an error."""
    if unknown := set(settings) - set(STEPS):
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    return [lambda cells, name=name, value=value: STEPS[name](cells, size, bands, seed, value) for name in STEPS if (value := settings.get(name)) is not None]


def rescale(cells: DataFrame, bands, size: int, scale: Column, *by: str, class_col: str | None = None) -> DataFrame:
    """Square patches on a grid ``scale`` times as fine, corners kept: bands bilinear, classes from the nearest cell.

    ``scale`` is one value for each patch.  Cells that are missing or null have
    no part in a sum; a place of which all corners are missing has no row.
    """
    bands, by = list(bands), list(by)
    kept_classes = [class_col] if class_col else []
    inside = F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)
    for k in by:
        inside = inside & F.col(k).isNotNull()
    fine = F.greatest(F.lit(1), F.rint(size * scale).cast("int"))
    own = cells.where(inside).select(*by, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *[F.col(b).cast("double").alias(b) for b in bands], *kept_classes, fine.alias("_n"))

    def run(table: pa.Table) -> pa.Table:
        group = stacks.group_numbers(table, by)
        first = np.flatnonzero(np.r_[True, np.diff(group) > 0])
        r, c, fines = table["r"].to_numpy(), table["c"].to_numpy(), table["_n"].to_numpy()[first]
        values = [(x.fill_null(0.0).to_numpy(), x.is_valid().to_numpy()) for x in (table[b] for b in bands)]
        made = []
        for n in np.unique(fines):
            of_size = np.flatnonzero((fines == n)[group])
            names = np.unique(group[of_size])
            most = max(1, stacks.CELLS // max(size * size, int(n) * int(n)))
            for low in range(0, len(names), most):
                some = of_size[slice(*np.searchsorted(group[of_size], (names[low], names[min(low + most, len(names)) - 1] + 1)))]
                made.append(_finer(table, some, first[names[low : low + most]], np.searchsorted(names, group[some]) - low, r, c, values, int(n)))
        return pa.concat_tables(made)

    def _finer(table, rows, firsts, number, r, c, values, n):
        at = np.minimum(np.arange(n) * ((size - 1) / max(n - 1, 1)), size - 1)
        low = np.floor(at).astype(np.int64)
        near, high, nearest = at - low, np.minimum(low + 1, size - 1), np.floor(at + 0.5).astype(np.int64)
        sides = ((low, 1 - near), (high, near))
        corners = [(y, x, sy[:, None] * sx[None, :]) for y, sy in sides for x, sx in sides]
        shape, place = (len(firsts), size, size), (number, r[rows], c[rows])

        def spread(weights):
            return np.bincount(np.ravel_multi_index(place, shape), weights, len(firsts) * size * size).reshape(shape)

        def summed(grid, shares=True):
            return sum(np.where(share > 0, grid[:, y[:, None], x[None, :]] * (share if shares else 1), 0) for y, x, share in corners).reshape(-1)

        there = np.flatnonzero(summed(spread(np.ones(len(rows))), False) > 0)
        patch, within = np.divmod(there, n * n)
        columns = [table[k].take(pa.array(firsts[patch])) for k in by]
        columns += [pa.array(x.astype(np.int32)) for x in (within // n, within % n)]
        for x, known in values:
            some = np.where(known[rows], x[rows], 0.0)
            counted = summed(spread(known[rows].astype(float)), False)
            columns.append(pa.array(summed(spread(some))[there], mask=(counted == 0)[there]))
        if class_col:
            last = np.full(shape, -1)
            last[place] = rows  # rows of one place come by class, null first, so the greatest stays
            index = last[:, nearest[:, None], nearest[None, :]].reshape(-1)[there]
            columns.append(table[class_col].take(pa.array(index, mask=index < 0)))
        return pa.table(columns, schema=arrow)

    out = own.select(*by, "r", "c", *bands, *kept_classes).schema
    arrow = to_arrow_schema(out)
    return stacks.per_table(own, by, run, out, *kept_classes)


def chain(cells: DataFrame, steps, bands, stats: dict, train: bool = True) -> DataFrame:
    """Training: each step in turn, then normalised bands; otherwise only the latter.  ``stats``: (mean, std) by band."""
    for step in steps if train else ():
        cells = step(cells)
    return cells.withColumns({b: (F.col(b) - stats[b][0]) / max(stats[b][1], 1e-8) for b in bands})
