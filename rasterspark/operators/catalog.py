"""Scene catalogs: filters, sensor choice, metadata."""

from __future__ import annotations

import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stacks import below
from ..sources.manifests import kept


def _date(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def between(scenes: DataFrame, start: str, end: str, date: str = "acq_date") -> DataFrame:
    """Half-open [start, end)."""
    if _date(start) >= _date(end):
        raise ValueError("start must lie before end")
    return scenes.where((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))


def clear_enough(scenes: DataFrame, most: float = 20.0, cover: str = "cloud_cover") -> DataFrame:
    """Cloud cover of at most ``most``; a scene without the property is dropped."""
    if not 0 <= most <= 100:
        raise ValueError("cloud cover lies between 0 and 100")
    return scenes.where(F.coalesce(F.col(cover) <= most, F.lit(False)))


def of_sensors(scenes: DataFrame, sensors: list[str], sensor: str = "sensor") -> DataFrame:
    if not sensors:
        raise ValueError("no sensor named")
    return scenes.where(F.col(sensor).isin(*sensors))


#: Levels of the grid of boxes: its cells halve from one level to the next, from 360 degrees down to 360 / 2**16.
LEVELS, WORLD = 17, 360.0
#: Cells of levels below this are few, so rows beneath them are salted so many ways.
COARSE, SALTS = 7, 32


def touching(scenes: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs of scenes and areas whose boxes meet (touching edges count).

    A box lies on the level of the quadtree whose cells are just as large as it,
    so it covers four of them at most, whatever its size.  Of a pair the smaller
    box looks up the cells above its own on the larger one's level; the pair
    counts in the one cell there that holds the lower corner of the overlap.
    Rows per box are bounded by four for each level that the other side uses.
    """
    def placed(df, prefix):
        side = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
        level = F.when(side <= 0, LEVELS - 1).otherwise(F.least(F.greatest(F.floor(F.log2(WORLD / side)), F.lit(0)), F.lit(LEVELS - 1))).cast("int")
        return df.where(side.isNotNull()).select(F.struct("*").alias(prefix), level.alias("level"), *[F.col(k).alias(f"{prefix}_{k}") for k in ("min_lon", "max_lon", "min_lat", "max_lat")])

    def cells(df, levels, prefix):
        """A row for each cell of the given levels that the box touches."""
        size = F.lit(WORLD) / F.pow(F.lit(2.0), F.col("at_level"))
        over = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
        rows = df.withColumn("at_level", F.explode(levels))
        return rows.withColumn("gx", over(f"{prefix}_min_lon", f"{prefix}_max_lon")).withColumn("gy", over(f"{prefix}_min_lat", f"{prefix}_max_lat"))

    def one_way(large, small, name_large, name_small, equal: bool):
        """Pairs whose ``large`` box lies on a coarser level (or, with ``equal``, on the same)."""
        used = F.array(*[F.lit(r[0]) for r in large.select("level").distinct().orderBy("level").collect()]).cast("array<int>")  # LEVELS values at most
        above = F.filter(used, lambda k: (k <= F.col("level")) if equal else (k < F.col("level")))
        salt = lambda rows, every: rows.withColumn("salt", F.when(F.col("at_level") < COARSE, every).otherwise(0) if isinstance(every, Column) else F.explode(F.when(F.col("at_level") < COARSE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        own = salt(cells(large, F.array("level"), name_large), None).drop("level")
        low = salt(cells(small, above, name_small), F.pmod(F.xxhash64(name_small), F.lit(SALTS)).cast("int")).drop("level")
        pairs = own.join(low, ["at_level", "gx", "gy", "salt"])
        s, a = (lambda k: F.col(f"scene_{k}")), (lambda k: F.col(f"area_{k}"))
        meets = (s("min_lon") <= a("max_lon")) & (s("max_lon") >= a("min_lon")) & (s("min_lat") <= a("max_lat")) & (s("max_lat") >= a("min_lat"))
        size = F.lit(WORLD) / F.pow(F.lit(2.0), F.col("at_level"))
        corner = (F.floor(F.greatest(s("min_lon"), a("min_lon")) / size) == F.col("gx")) & (F.floor(F.greatest(s("min_lat"), a("min_lat")) / size) == F.col("gy"))
        return pairs.where(meets & corner).select("scene", "area")

    left, right = placed(scenes, "scene"), placed(areas, "area")
    return one_way(left, right, "scene", "area", True).unionByName(one_way(right, left, "area", "scene", False))


#: Edges of a box, and parts that the edges of either side are cut into for counting.
EDGES, CUTS = ("min_lon", "max_lon", "min_lat", "max_lat"), 256


def touch_counts(scenes: DataFrame, areas: DataFrame, sums: tuple[str, ...] = (), count: str = "n_scenes") -> DataFrame:
    """``areas`` plus the number of scenes whose box meets theirs and sums of integer columns of these; areas that none meets are left out.

    The same pairs as ``touching``, but none is made.  A box needs all its edges,
    the lower ones not beyond the upper.  Along an axis, the scenes that meet an
    area are those that begin before its end less those that end before its
    beginning; both axes give four sums over corners that lie below a point.  Each
    is cut at quantiles of the edges: cells wholly below a point, the rest of its
    column, and the rest of its row are groups of their own, and a value that is
    a cut has a column of its own, which needs no rest.  Rows grow with scenes
    plus areas; a column or row holds about 1 / ``CUTS`` of either's boxes that
    differ, and the cells are a million at most for each of the four sums.
    """
    whole = lambda df: df.where(" AND ".join([*[f"{e} IS NOT NULL AND NOT isnan({e})" for e in EDGES], "min_lon <= max_lon AND min_lat <= max_lat"]))
    as_double = lambda df: df.withColumns({e: F.col(e).cast("double") for e in EDGES})
    totals = [f"_t{k}" for k in range(len(sums) + 1)]
    boxes = kept(whole(as_double(scenes)).groupBy(*EDGES).agg(F.count("*").alias("_t0"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(t) for c, t in zip(sums, totals[1:], strict=True)]), "boxes")
    asked = kept(whole(as_double(areas)).select(*EDGES).distinct(), "areas")
    cuts = [[F.percentile_approx(e, [k / CUTS for k in range(CUTS + 1)]).alias(e) for e in EDGES]] * 2
    of_boxes, of_areas = (df.agg(*c).first() for df, c in zip((boxes, asked), cuts, strict=True))
    # a scene's lower edge is held against an area's upper one (up to it), its upper edge against the lower one (below it)
    pairs = [(("min_lon", "max_lon"), ("max_lon", "min_lon")), (("min_lat", "max_lat"), ("max_lat", "min_lat"))]
    at = [[np.unique(np.array([*(of_boxes[own] or []), *(of_areas[other] or [])], float)) for own, other in axis] for axis in pairs]

    def parts(side: int, carried):
        """Rows (part, x, y, carried) of the corners of scenes (``side`` 0) or of the points that areas ask for (1)."""
        def code(v, cut, strict):
            """Even between two cuts, odd on one; and whether the rest of the column counts: for areas, the last code wholly below."""
            found = np.searchsorted(cut, v, "left") + np.searchsorted(cut, v, "right")
            return (found, found, found % 2 == 0) if not side else (found, np.where(found % 2 == 1, found - int(strict), found - 1), found % 2 == 0)

        def run(batches):
            for batch in batches:
                edge = {e: batch.column(e).to_numpy(zero_copy_only=False) for e in EDGES}
                for kind in range(4):
                    (x, (cx, wx, rx)), (y, (cy, wy, ry)) = [(v := edge[pairs[axis][h][side]], code(v, at[axis][h], h)) for axis, h in ((0, kind % 2), (1, kind // 2))]
                    every = np.ones(len(x), bool)
                    for which, (keep, strip, u, w) in enumerate(((every, 0 * cx, wx, wy), (rx, cx, x, y), (ry, cy, wx, y))):
                        rows = np.flatnonzero(keep)
                        own = [pa.array(((kind * 3 + which) * 8192 + strip[rows]).astype(np.int32)), pa.array(u[rows].astype(float)), pa.array(w[rows].astype(float))]
                        yield pa.RecordBatch.from_arrays([*own, *[batch.column(c).take(pa.array(rows)) for c in carried]], ["part", "x", "y", *carried])

        kinds = ", ".join(f"{c} {'double' if c in EDGES else 'long'}" for c in carried)
        return (asked if side else boxes).mapInArrow(run, f"part int, x double, y double, {kinds}")

    corners = parts(0, totals).groupBy("part", "x", "y").agg(*[F.sum(t).alias(t) for t in totals])
    points = parts(1, EDGES)

    def summed(table: pa.Table) -> pa.Table:
        part, x, y, own = (table[c].to_numpy() for c in ("part", "x", "y", "_own"))
        kind, which = divmod(int(part[0]) // 8192, 3)
        ask = own == 0
        weights = np.stack([table[t].to_numpy()[~ask] for t in totals], axis=1)
        found = below(x[~ask], y[~ask], weights, x[ask], y[ask], which == 1 and bool(kind % 2), which > 0 and bool(kind // 2))
        return pa.table({"part": part[ask], "x": x[ask], "y": y[ask]} | {t: found[:, k] * (-1) ** (kind % 2 + kind // 2) for k, t in enumerate(totals)})

    both = corners.withColumn("_own", F.lit(1)).unionByName(points.select("part", "x", "y").distinct().select("*", *[F.lit(0).cast("long").alias(t) for t in totals], F.lit(0).alias("_own")))
    found = both.groupBy("part").applyInArrow(summed, f"part int, x double, y double, {', '.join(f'{t} long' for t in totals)}")
    told = points.join(found, ["part", "x", "y"]).groupBy(*EDGES).agg(*[F.sum(t).cast("long").alias(t) for t in totals]).where("_t0 > 0")
    keys = {f"_{e}": F.col(e).cast("double") for e in EDGES}
    joined = areas.withColumns(keys).join(told.withColumnsRenamed({e: f"_{e}" for e in EDGES}), [*keys]).drop(*keys)
    return joined.withColumnsRenamed(dict(zip(totals, (count, *[f"sum_{c}" for c in sums]), strict=True)))


def operating(sensors: DataFrame, start: str, end: str) -> DataFrame:
    """Sensors whose period (inclusive, may be open) overlaps [start, end]."""
    return sensors.where((F.coalesce("op_end", F.lit("9999-12-31").cast("date")) >= F.lit(start).cast("date")) & (F.col("op_start") <= F.lit(end).cast("date")))


def merged(collections: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), collections)


def mixes_families(scenes: DataFrame, family_of: dict[str, str], sensor: str = "sensor") -> DataFrame:
    """Per area, whether sensors of more than one family occur."""
    family = F.create_map(*[F.lit(x) for pair in family_of.items() for x in pair])
    return scenes.groupBy("aoi_id").agg((F.count_distinct(F.try_element_at(family, F.col(sensor))) > 1).alias("mixed"))


def summary(scenes: DataFrame, *by: str) -> DataFrame:
    """Image count, coverage in time, and the sensors that occur."""
    return scenes.groupBy(*by).agg(
        F.count("*").alias("n_images"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"), F.array_join(F.array_sort(F.collect_set("sensor")), ",").alias("sensors")
    )


def collection(scenes: DataFrame, collection_id: str, column: str = "collection_id") -> DataFrame:
    """The scenes of one collection; a blank id is an error."""
    if not collection_id or not collection_id.strip():
        raise ValueError("collection id is blank")
    return scenes.where(F.col(column) == collection_id)


def chosen_sensors(sensors: DataFrame, start: str, end: str, s2_only: bool = False, s2: str = "S2") -> DataFrame:
    """Sensors to use: all in operation but Sentinel-2, or that alone."""
    return sensors.where(F.col("sensor") == s2) if s2_only else operating(sensors, start, end).where(F.col("sensor") != s2)


def sensors_of(sensors: DataFrame, wanted: DataFrame, column: str = "collection_id") -> DataFrame:
    """Sensors of the wanted collection ids; an unknown id is an error."""
    unknown = [r[0] for r in wanted.select(column).distinct().join(sensors, column, "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown collections: {', '.join(map(str, unknown))}")
    return sensors.join(wanted.select(column).distinct(), column)


def filtered(scenes: DataFrame, start: str, end: str, most_cloud: float = 20.0, area: tuple | None = None, sensors: list[str] | None = None, cover: str = "cloud_cover") -> tuple[DataFrame, list[str]]:
    """Scenes by date, box (min_lon, min_lat, max_lon, max_lat), cloud and sensor, and the tags of what was applied."""
    found, tags = between(scenes, start, end), [f"date:{start}/{end}"]
    if area:
        found = found.where((F.col("min_lon") <= area[2]) & (F.col("max_lon") >= area[0]) & (F.col("min_lat") <= area[3]) & (F.col("max_lat") >= area[1]))
        tags.append("bounds")
    found, tags = clear_enough(found, most_cloud, cover), [*tags, f"cloud:{most_cloud:g}"]
    if sensors:
        found, tags = of_sensors(found, sensors), [*tags, f"sensors:{','.join(sensors)}"]
    return found, tags


def metadata(scenes: DataFrame, *by: str, order: str = "scene_id") -> DataFrame:
    """All metadata of collections in one row each: count, dates, sensors, and bands, reference system and scale of the first image."""
    first = lambda c, default: F.coalesce(F.min_by(c, order), default) if c in scenes.columns else default
    return scenes.groupBy(*by).agg(
        F.count("*").alias("n_images"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"), F.array_sort(F.collect_set("sensor")).alias("sensors"),
        first("band_names", F.expr("CAST(array() AS array<string>)")).alias("band_names"), first("crs", F.lit(None).cast("string")).alias("crs"), first("scale", F.lit(None).cast("double")).alias("scale"),
    )


def images(scenes: DataFrame, *columns: str) -> DataFrame:
    """Id, date and sensor of every image, in the order of their ids within a place."""
    return scenes.select("scene_id", "acq_date", "sensor", *columns)
