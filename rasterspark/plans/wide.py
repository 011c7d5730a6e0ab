"""Registered queries over whole scenes, stored products and arriving dates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, wide
from ..sources import commitlog, documents, manifests, views
from ..streaming import change, running
from .further import _DISC, _PATCH_MANIFEST, _PLUS, _near, _patch_manifest
from .queries import _BUCKET, _CELLS, _rounded

#: Scenes of 32 by 32 cells are cut into four tiles, so that many regions cross borders.
SMALL = 16


# Scenes cut into tiles


def scene_regions(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(wide.regions(views.scene_cells(spark, folder), SMALL))


def scene_region_metrics(spark: SparkSession, folder: str) -> DataFrame:
    cells = views.scene_cells(spark, folder)
    return _rounded(wide.metrics(wide.regions(cells, SMALL, least=3), cells).drop("std_px"))


def _cleaned(spark, folder, *steps) -> DataFrame:
    return wide.clean(views.scene_cells(spark, folder), *steps, tile=SMALL).select("scene_id", "row", "col", "class_id")


def scene_opened(spark, folder):
    return _cleaned(spark, folder, cleaning.Cleaning(opening=1, closing=2))


def scene_without_small_objects(spark, folder):
    return _cleaned(spark, folder, cleaning.Cleaning(opening=0, closing=0, least_object=3))


def scene_majority(spark, folder):
    return _cleaned(spark, folder, cleaning.majority(3))


def scene_replaced_small(spark, folder):
    return _cleaned(spark, folder, cleaning.replace_small(3))


def scene_filled_holes(spark, folder):
    return wide.fill_holes(views.scene_cells(spark, folder), tile=SMALL).select("scene_id", "row", "col", "class_id")


# patch_id is the scene here, as the shared fragments name it
_SCENE = f"""{_CELLS}, masks AS (SELECT patch_id // 16 AS patch_id, patch_id % 16 // 4 * 8 + r AS r, patch_id % 4 * 8 + c AS c, {_BUCKET.format('v0')} AS class_id, least(abs(v0) * 2, 1) AS confidence FROM cells)"""
_OUT = "SELECT patch_id AS scene_id, r::BIGINT AS row, c::BIGINT AS col"
_REACH = f"""{_SCENE.replace('WITH', 'WITH RECURSIVE', 1)},
reach(patch_id, class_id, r, c, first) AS (SELECT patch_id, class_id, r, c, r * 2147483648 + c FROM masks WHERE class_id > 0
  UNION SELECT m.patch_id, m.class_id, m.r, m.c, first FROM reach x JOIN masks m ON m.patch_id = x.patch_id AND m.class_id = x.class_id
  AND m.r BETWEEN x.r - 1 AND x.r + 1 AND m.c BETWEEN x.c - 1 AND x.c + 1 AND (m.class_id <> 1 OR m.r = x.r OR m.c = x.c)),
part AS (SELECT patch_id, class_id, r, c, min(first) AS region_id FROM reach GROUP BY ALL),
beside AS (SELECT m.patch_id, m.r, m.c, count(*) AS n FROM masks m JOIN masks o ON o.patch_id = m.patch_id AND o.class_id = m.class_id AND abs(o.r - m.r) + abs(o.c - m.c) = 1 GROUP BY ALL),
labelled AS (SELECT part.*, m.confidence, 4 - coalesce(n, 0) AS bare FROM part JOIN masks m USING (patch_id, r, c) LEFT JOIN beside USING (patch_id, r, c)),
regions AS (SELECT patch_id AS scene_id, class_id, region_id, count(*) AS area_px, min(r) AS row_min, max(r) + 1 AS row_max, min(c) AS col_min, max(c) + 1 AS col_max,
  sum(bare)::BIGINT AS perimeter, avg(confidence) AS mean_confidence, count(*) / count(DISTINCT r) AS row_width FROM labelled GROUP BY ALL)"""
_BY_FOUR = f"""{_SCENE.replace('WITH', 'WITH RECURSIVE', 1)},
reach(patch_id, class_id, r, c, k) AS (SELECT patch_id, class_id, r, c, r * 100 + c FROM masks
  UNION SELECT m.patch_id, m.class_id, m.r, m.c, k FROM reach x JOIN masks m ON m.patch_id = x.patch_id AND m.class_id = x.class_id AND abs(m.r - x.r) + abs(m.c - x.c) = 1),
part AS (SELECT patch_id, class_id, r, c, min(k) AS region FROM reach GROUP BY ALL),
sized AS (SELECT *, count(*) OVER (PARTITION BY patch_id, class_id, region) AS area FROM part)"""


def _opened_scene_sql() -> str:
    rows, last = [f"{_SCENE}, g0 AS (SELECT patch_id, r, c, class_id FROM masks)"], "g0"
    for k in range(4):
        rows.append(f"m{k}a AS MATERIALIZED (SELECT patch_id, r, c, class_id, class_id = {k} AS f FROM {last})")
        for step, before, offsets, every, outside in (("b", "a", _PLUS, True, "true"), ("c", "b", _PLUS, False, "false"), ("d", "c", _DISC, False, "false"), ("e", "d", _DISC, True, "true")):
            rows.append(f"m{k}{step} AS MATERIALIZED (SELECT patch_id, r, c, class_id, {_near(f'm{k}{before}', 'f', offsets, every, outside)} AS f FROM m{k}{before} m)")
        last = f"g{k + 1}"
        rows.append(f"{last} AS MATERIALIZED (SELECT patch_id, r, c, CASE WHEN f THEN {k} WHEN class_id = {k} THEN 0 ELSE class_id END AS class_id FROM m{k}e)")
    return ",\n".join(rows) + f" {_OUT}, class_id FROM {last}"


# Stored products


def manifest_commits(spark, folder):
    """Four appends, of which the later ones repeat ids, to a manifest as a log; each id stays as it came first."""
    log = commitlog.ManifestLog(spark, manifests.scratch(spark, "manifest-log"), "patch_id")
    rows = views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("patch_id"), F.month("o_orderdate").alias("month"))
    left_out = [log.append_new(rows.where(F.col("month").between(low, high)).withColumn("batch", F.lit(k))) for k, (low, high) in enumerate(((1, 6), (4, 9), (7, 12), (1, 12)))]
    told = F.get(F.array(*map(F.lit, left_out)), F.col("batch")).cast("long")
    every = spark.range(4).select(F.col("id").cast("int").alias("batch"))
    found = every.join(log.snapshot().groupBy("batch").agg(F.count("*").alias("n")), "batch", "left")
    return found.select("batch", F.coalesce("n", F.lit(0)).alias("n_new"), told.alias("n_left_out"))


def manifest_document(spark, folder):
    """A manifest written as one JSON document by many tasks, and its head beside what was read back."""
    path = manifests.scratch(spark, "document")
    documents.write(_patch_manifest(spark, folder).repartition(5), path, "1.0")
    told = documents.head(spark, path)
    rows = documents.read(spark, path, manifests.PATCH).groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("file_size_bytes").alias("bytes"), F.max("patch_id").alias("last_patch"))
    return rows.withColumns({"version": F.lit(told["version"]), "entry_count": F.lit(told["entry_count"]).cast("long")})


# Arriving dates


def stream_late_change(spark, folder):
    """Change per event type and user group against the day before; each day's rows come in three files, days in no order."""
    path = manifests.scratch(spark, "arriving")
    rows = views.table(spark, folder, "events").select("event_type", (F.col("user_id") % 5).alias("aoi"), F.col("ts").cast("timestamp").cast("date").alias("acq_date"), F.floor("value").cast("long").alias("pixels"), (F.col("event_id") % 3).alias("third"))
    for k in (2, 0, 1):
        rows.where(F.col("third") == k).drop("third").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.drop("third").schema).option("maxFilesPerTrigger", 1).parquet(path)
    with change.rocks(spark):
        found = running.run_once(change.running_change(stream, "event_type", "aoi", late="400 days"), manifests.scratch(spark, "stream"), "update", lambda out: change.newest(out, "event_type", "aoi"))
    return found.select("event_type", "aoi", *change.FIELDS)


#: Query by name, with its SQL.
REGISTERED = {
    "scene_regions": (scene_regions, f"""{_REACH} SELECT scene_id, class_id::INT AS class_id, region_id::BIGINT AS region_id, area_px, row_min, row_max, col_min, col_max, round(row_width, 6) AS row_width, perimeter, round(mean_confidence, 6) AS mean_confidence, area_px * 900.0::DOUBLE AS area_m2,
 round((col_max - col_min) / (row_max - row_min), 6) AS aspect, round(coalesce(4 * pi() * area_px / nullif(perimeter * perimeter, 0), 0), 6) AS compactness, round(1 - least(row_max - row_min, col_max - col_min) / greatest(row_max - row_min, col_max - col_min), 6) AS elongation FROM regions WHERE area_px >= 4"""),
    "scene_region_metrics": (scene_region_metrics, f"""{_REACH}, big AS (SELECT * FROM regions WHERE area_px >= 3), px AS (SELECT patch_id AS scene_id, class_id, count(*) AS class_px FROM masks WHERE class_id > 0 GROUP BY ALL),
 s AS (SELECT scene_id, class_id, count(*) AS n, max(area_px) AS most, avg(area_px) AS mean, arg_max(row_width, (area_px, -region_id)) AS width FROM big GROUP BY ALL)
 SELECT px.scene_id, px.class_id::INT AS class_id, class_px, coalesce(n, 0)::BIGINT AS n_regions, coalesce(most, 0)::BIGINT AS largest_px, round(coalesce(mean, 0), 6) AS mean_px, round(coalesce(width, 0), 6) AS width_px, round(coalesce(n, 0) / class_px, 6) AS fragmentation FROM px LEFT JOIN s USING (scene_id, class_id)"""),
    "scene_opened": (scene_opened, _opened_scene_sql()),
    "scene_without_small_objects": (scene_without_small_objects, f"{_BY_FOUR} {_OUT}, CASE WHEN area < 3 THEN 0 ELSE class_id END AS class_id FROM sized"),
    "scene_majority": (scene_majority, f"""{_SCENE}, ends AS (SELECT patch_id, max(r) AS h, max(c) AS w FROM masks GROUP BY patch_id),
 near AS (SELECT m.patch_id, m.r, m.c, least(greatest(m.r + i, 0), h) AS nr, least(greatest(m.c + j, 0), w) AS nc FROM masks m JOIN ends USING (patch_id), range(-1, 2) a(i), range(-1, 2) b(j)),
 votes AS (SELECT x.patch_id, x.r, x.c, n.class_id, count(*) AS v FROM near x JOIN masks n ON n.patch_id = x.patch_id AND n.r = nr AND n.c = nc GROUP BY ALL)
 {_OUT}, arg_max(class_id, (v, -class_id)) AS class_id FROM votes GROUP BY patch_id, r, c"""),
    "scene_replaced_small": (scene_replaced_small, f"""{_BY_FOUR},
 near AS (SELECT DISTINCT s.patch_id, s.class_id AS own, s.region, o.r, o.c, o.class_id FROM sized s JOIN masks o ON o.patch_id = s.patch_id AND o.class_id <> s.class_id AND abs(o.r - s.r) + abs(o.c - s.c) <= 2 WHERE s.area < 3),
 votes AS (SELECT patch_id, own, region, class_id, count(*) AS v FROM near GROUP BY ALL), best AS (SELECT patch_id, own, region, arg_max(class_id, (v, -class_id)) AS k FROM votes GROUP BY ALL)
 SELECT s.patch_id AS scene_id, s.r::BIGINT AS row, s.c::BIGINT AS col, coalesce(k, class_id) AS class_id FROM sized s LEFT JOIN best b ON b.patch_id = s.patch_id AND b.own = s.class_id AND b.region = s.region"""),
    "scene_filled_holes": (scene_filled_holes, f"""{_SCENE.replace('WITH', 'WITH RECURSIVE', 1)}, ends AS (SELECT patch_id, max(r) AS h, max(c) AS w FROM masks GROUP BY patch_id),
 open(patch_id, k, r, c) AS (SELECT m.patch_id, k, m.r, m.c FROM masks m JOIN ends USING (patch_id), range(4) t(k) WHERE class_id <> k AND (m.r IN (0, h) OR m.c IN (0, w))
  UNION SELECT m.patch_id, x.k, m.r, m.c FROM open x JOIN masks m ON m.patch_id = x.patch_id AND m.class_id <> x.k AND abs(m.r - x.r) + abs(m.c - x.c) = 1),
 holes AS (SELECT m.patch_id, m.r, m.c, max(k) AS k FROM masks m, range(4) t(k) WHERE class_id <> k AND NOT EXISTS (SELECT 1 FROM open o WHERE o.patch_id = m.patch_id AND o.k = t.k AND o.r = m.r AND o.c = m.c) GROUP BY ALL)
 SELECT m.patch_id AS scene_id, m.r::BIGINT AS row, m.c::BIGINT AS col, coalesce(h.k, class_id)::INT AS class_id FROM masks m LEFT JOIN holes h USING (patch_id, r, c)"""),
    "manifest_commits": (manifest_commits, """WITH o AS (SELECT month(o_orderdate::DATE) AS m FROM orders), b(batch, low, high, before) AS (VALUES (0, 1, 6, 0), (1, 4, 9, 6), (2, 7, 12, 9), (3, 1, 12, 12))
 SELECT batch, count(*) FILTER (m > before) AS n_new, count(*) FILTER (m <= before) AS n_left_out FROM b JOIN o ON m BETWEEN low AND high GROUP BY batch"""),
    "manifest_document": (manifest_document, f"WITH p AS ({_PATCH_MANIFEST}) SELECT scene_id, count(*) AS n, sum(file_size_bytes)::BIGINT AS bytes, max(patch_id) AS last_patch, '1.0' AS version, (SELECT count(*) FROM orders) AS entry_count FROM p GROUP BY scene_id"),
    "stream_late_change": (stream_late_change, """WITH d AS (SELECT event_type, user_id % 5 AS aoi, ts::DATE AS to_date, sum(floor(value))::BIGINT AS to_value FROM events GROUP BY ALL),
 w AS (SELECT *, lag(to_date) OVER k AS from_date, lag(to_value) OVER k AS from_value FROM d WINDOW k AS (PARTITION BY event_type, aoi ORDER BY to_date))
 SELECT event_type, aoi, from_date, to_date, from_value, to_value, to_value - from_value AS delta FROM w WHERE from_date IS NOT NULL"""),
}

QUERIES = {name: query for name, (query, _) in REGISTERED.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in REGISTERED.items() if sql}
