"""Registered queries over the raster views, each with its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, probability, spectral
from ..operators import analytics, augment, catalog, checks, classify, cleaning, composite, dataset, figures, losses, metrics, regions, tiling
from ..sources import views

INDEX_NAMES = ("NDWI", "MNDWI", "AWEI_sh", "AWEI_nsh", "NDVI", "SAVI", "BSI", "NDMI", "NDBI")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for comparing sums that add up in another order."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _clear(spark, folder, observed=views.observations):
    return observed(spark, folder).where(spectral.usable(F.col("QA")))


def _indexed(spark, folder, observed=views.observations):
    middle = composite.median(_clear(spark, folder, observed))
    return middle.select("aoi_id", "row", "col", *spectral.feature_columns())


def area_shares(spark: SparkSession, folder: str, observed=views.observations) -> DataFrame:
    """Share of water, sand, vegetation and background per area, from masked median composites."""
    return _rounded(classify.shares(classify.classify(_indexed(spark, folder, observed)), "aoi_id"))


def composite_of(method: str, **options):
    def run(spark, folder, observed=views.observations):
        return _rounded(composite.composite(_clear(spark, folder, observed), method, **options), 9)

    return run


def mosaic_latest(spark, folder, observed=views.observations):
    return composite.mosaic(_clear(spark, folder, observed))


def medoid_composite(spark, folder, observed=views.observations):
    return composite.medoid(_clear(spark, folder, observed)).select(*composite.PIXEL, *spectral.OPTICAL)


def spectral_indices(spark, folder):
    return _rounded(views.observations(spark, folder).select("scene_id", "row", "col", "acq_date", *spectral.feature_columns(INDEX_NAMES)[6:]), 10)


def scaled_bands(spark, folder):
    raw = views.observations(spark, folder)
    return _rounded(raw.select("row", "col", "scene_id", spectral.optical(F.col("NIR") * 40000).alias("nir"), spectral.thermal(F.col("Red") * 50000).alias("thermal"), spectral.has_bit(F.col("QA"), "cloud").alias("cloudy"), spectral.usable(F.col("QA")).alias("usable")), 10)


def scene_catalog(spark, folder):
    found = catalog.between(views.scenes(spark, folder), "2024-01-05", "2024-01-25")
    return catalog.summary(catalog.clear_enough(found, 20.0), "aoi_id")


def scenes_in_areas(spark, folder):
    areas = views.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("area_id"), (F.col("n_nationkey") % 38).cast("double").alias("min_lon"), (F.col("n_nationkey") % 38 + 3).cast("double").alias("max_lon"),
        (F.col("n_nationkey") % 20).cast("double").alias("min_lat"), (F.col("n_nationkey") % 20 + 2).cast("double").alias("max_lat"),
    )
    pairs = catalog.touching(views.scenes(spark, folder), areas)
    return pairs.groupBy(F.col("area.area_id").alias("area_id")).agg(F.count("*").alias("n_scenes"), F.sum("scene.scene_id").alias("sum_ids"))


def mixed_families(spark, folder):
    return catalog.mixes_families(views.scenes(spark, folder), {"view": "TM", "click": "TM", "signup": "OLI", "error": "OLI"})


def confusion_matrix(spark, folder):
    return metrics.confusion(views.pred_truth(spark, folder), 4)


def normalised_confusion(spark, folder):
    return _rounded(metrics.normalised(confusion_matrix(spark, folder)))


def class_metrics(spark, folder):
    return _rounded(metrics.per_class(confusion_matrix(spark, folder)))


def overall_metrics(spark, folder):
    return _rounded(metrics.overall(confusion_matrix(spark, folder)))


def _sample_metrics(spark, folder):
    return views.samples(spark, folder).withColumn("fraction", F.col("pixels") / 1000)


def temporal_change(spark, folder):
    return _rounded(analytics.change(_sample_metrics(spark, folder)))


def seasonal_summary(spark, folder):
    return _rounded(analytics.seasonal(_sample_metrics(spark, folder)))


def spatial_summary(spark, folder):
    return _rounded(analytics.spatial(_sample_metrics(spark, folder)))


def confidence_summary(spark, folder):
    return _rounded(analytics.uncertainty(views.pred_truth(spark, folder), "sample_id"))


def split_by(strategy):
    def run(spark, folder):
        return dataset.split(views.samples(spark, folder), strategy).select("sample_id", "scene_id", "aoi_id", "split")

    return run


def split_leakage(spark, folder):
    return dataset.leakage(dataset.split(views.samples(spark, folder), "temporal"), "scene_id", "aoi_id")


def split_statistics(spark, folder):
    return _rounded(dataset.split_statistics(dataset.split(views.samples(spark, folder), "random")))


def class_weights(spark, folder):
    counts = views.samples(spark, folder).groupBy("class_id").agg(F.sum("pixels").alias("pixels"))
    return _rounded(dataset.class_weights(counts))


def band_statistics(spark, folder):
    return _rounded(dataset.band_statistics(views.observations(spark, folder), spectral.OPTICAL, robust=True))


def hydrology(spark, folder):
    d = F.col("acq_date")
    return views.samples(spark, folder).select("sample_id", calendar.season(F.month(d)).alias("season"), calendar.hydrological_year(d).cast("long").alias("hydro_year"), calendar.midpoint(d, F.date_add(d, 31)).alias("midpoint"))


def class_probabilities(spark, folder):
    logits = views.patch_cells(spark, folder).select("patch_id", "r", "c", F.array(*[F.col(f"v{k}") * 10 for k in range(4)]).alias("logits"))
    p = logits.withColumn("probs", probability.softmax(F.col("logits")))
    return _rounded(p.select("patch_id", "r", "c", probability.winner(F.col("logits")).cast("long").alias("pred"), probability.largest(F.col("probs")).alias("confidence"), probability.certainty(F.col("probs")).alias("certainty")))


def patch_validity(spark, folder):
    cells = views.patch_cells(spark, folder).withColumn("v0", F.when(F.abs("v0") > 0.01, F.col("v0")))
    return _rounded(tiling.valid_ratio(cells, ["v0", "v1"], "patch_id"))


def tiled_pixels(spark, folder):
    cells = views.patch_cells(spark, folder).select("patch_id", F.col("r").alias("row"), F.col("c").alias("col"), "v0")
    tiles = tiling.in_windows(cells, 4, 2, F.lit(8), F.lit(8))
    return _rounded(tiles.groupBy("patch_id", "row_index", "col_index").agg(F.count("*").alias("n"), F.avg("v0").alias("mean")))


def _masks(spark, folder):
    return views.pred_truth(spark, folder).select(F.col("sample_id").alias("patch_id"), "r", "c", F.col("pred").alias("class_id"), "confidence")


def _labelled(spark, folder):
    return regions.label(_masks(spark, folder))


def region_rows(spark, folder):
    return _rounded(regions.regions(_labelled(spark, folder), "patch_id", least=1).drop("region_id"))


def region_metrics(spark, folder):
    labelled = _labelled(spark, folder)
    return _rounded(regions.region_metrics(labelled, regions.regions(labelled, "patch_id"), "patch_id"))


def majority_masks(spark, folder):
    return cleaning.per_patch(_masks(spark, folder), cleaning.majority(3)).select("patch_id", "r", "c", "class_id")


def cleaned_masks(spark, folder):
    chain = cleaning.Cleaning(least_object=3, least_hole=3), cleaning.fill_holes, cleaning.replace_small(3), cleaning.square_pass("close")
    return cleaning.per_patch(_masks(spark, folder), *chain).select("patch_id", "r", "c", "class_id")


def label_quality(spark, folder):
    cells = _masks(spark, folder).withColumn("class_id", F.when(F.col("confidence") < 0.1, 255).otherwise(F.col("class_id")))
    return _rounded(checks.label_quality(cells, "patch_id").withColumn("issues", F.array_join("issues", "; ")))


def patch_losses(spark, folder):
    cells = views.patch_cells(spark, folder).select("patch_id", "r", "c", F.array(*[F.col(f"v{k}") * 10 for k in range(4)]).alias("logits"))
    truth = views.pred_truth(spark, folder).select(F.col("sample_id").alias("patch_id"), "r", "c", "truth")
    rows = cells.join(truth, ["patch_id", "r", "c"])
    return _rounded(losses.all_losses(rows, 4, "patch_id", weights=(1, 2, 3, 4), smoothing=0.1))


def turned_masks(spark, folder):
    return augment.rotate(_masks(spark, folder), 8, (F.col("patch_id") % 4).cast("int")).select("patch_id", "r", "c", "class_id")


def stitched_tiles(spark, folder):
    cells = views.patch_cells(spark, folder).select("patch_id", F.floor(F.col("r") / 3).cast("int").alias("row_index"), F.floor(F.col("c") / 3).cast("int").alias("col_index"), (F.col("r") % 3).alias("r"), (F.col("c") % 3).alias("c"), "v0")
    return tiling.stitch(cells, "patch_id").select("patch_id", "row", "col", "v0")


def rescaled_patches(spark, folder):
    cells = views.patch_cells(spark, folder).select("patch_id", "r", "c", "v0")
    return _rounded(augment.rescale(cells, ["v0"], 8, F.lit(1.25), "patch_id"))


def dataset_issues(spark, folder):
    samples = dataset.split(views.samples(spark, folder), "random")
    return _rounded(checks.quality_issues(samples, dataset.split_statistics(samples), dataset.leakage(samples, "scene_id", "aoi_id"), least=10000, most_imbalance=1.0))


def weighted_draws(spark, folder):
    """As many draws as there are samples, by valid share."""
    samples = dataset.valid_weights(views.samples(spark, folder))
    return augment.weighted_draws(samples, samples.count())


def change_chart(spark, folder):
    return figures.change_chart(analytics.change(_sample_metrics(spark, folder)), range(1, 6))


def class_report(spark, folder):
    pairs = views.pred_truth(spark, folder)
    size = pairs.groupBy("sample_id").agg(F.count("*").alias("total"))
    areas = pairs.groupBy("sample_id", F.col("pred").alias("class_id")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")).join(size, "sample_id").withColumn("fraction", F.col("n") / F.col("total"))
    return _rounded(figures.class_report(class_metrics(spark, folder).select("class_id", "precision", "recall", "f1", "iou"), areas))


_OBS = """WITH obs AS (
  SELECT l_orderkey // 1000 AS aoi_id, l_orderkey AS row, l_linenumber::BIGINT AS col, l_shipdate::DATE AS acq_date,
         concat(l_partkey, '-', l_suppkey, '-', l_linenumber) AS scene_id, l_discount AS Blue, l_tax AS Green, l_quantity / 50 AS Red,
         l_extendedprice / 100000 AS NIR, (l_partkey % 1000) / 1000 AS SWIR1, (l_suppkey % 100) / 100 AS SWIR2, (l_partkey % 256)::INT AS QA FROM lineitem),
clear AS (SELECT * FROM obs WHERE QA & 31 = 0)"""
_BANDS = spectral.OPTICAL


def _each(make: str, places: int | None = 9) -> str:
    one = (lambda b: f"round({make.format(b)}, {places}) AS {b}") if places else (lambda b: f"{make.format(b)} AS {b}")
    return f"{_OBS} SELECT aoi_id, row, col, {', '.join(one(b) for b in _BANDS)} FROM clear GROUP BY ALL"


def _nd(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


_INDEX_SQL = {
    "NDWI": _nd("Green", "NIR"), "MNDWI": _nd("Green", "SWIR1"), "AWEI_sh": "Blue + 2.5 * Green - 1.5 * (NIR + SWIR1) - 0.25 * SWIR2",
    "AWEI_nsh": "4 * (Green - SWIR1) - (0.25 * NIR + 2.75 * SWIR2)", "NDVI": _nd("NIR", "Red"), "SAVI": "(NIR - Red) / nullif(NIR + Red + 0.5, 0) * 1.5",
    "BSI": "((SWIR1 + Red) - (NIR + Blue)) / nullif((SWIR1 + Red) + (NIR + Blue), 0)", "NDMI": _nd("NIR", "SWIR1"), "NDBI": _nd("SWIR1", "NIR"),
}


def _soft(x: str, t: float, scale: float, above: bool = True) -> str:
    z = f"{1.25 / scale!r} * ({x} - {t})" if above else f"-({1.25 / scale!r} * ({x} - {t}))"
    return f"coalesce(1 / (1 + exp(-least(greatest({z}, -88), 88))), 0)"


_CLASSES = f"""{_OBS},
middle AS (SELECT aoi_id, row, col, {', '.join(f'median({b}) AS {b}' for b in _BANDS)} FROM clear GROUP BY ALL),
indexed AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _INDEX_SQL.items())} FROM middle),
scored AS (SELECT *,
  {_soft('MNDWI', 0.2, 0.3)} * 0.4 + {_soft('NDWI', 0.0, 0.3)} * 0.2 + {_soft('AWEI_nsh', 0.0, 0.3)} * 0.15 + {_soft('AWEI_sh', 0.0, 0.3)} * 0.05 + {_soft('NDVI', 0.05, 0.3, False)} * 0.2 AS w,
  {_soft('MNDWI', 0.0, 0.3, False)} * 0.3 + {_soft('BSI', 0.0, 0.3)} * 0.35 + {_soft('NDVI', 0.25, 0.3, False)} * 0.25 + {_soft('NDWI', 0.0, 0.3, False)} * 0.1 AS s,
  {_soft('NDVI', 0.2, 0.25)} * 0.5 + {_soft('SAVI', 0.1, 0.25)} * 0.3 + {_soft('NDMI', 0.0, 0.25)} * 0.2 AS v FROM indexed),
won AS (SELECT *, CASE WHEN w >= 0.4 THEN w ELSE -1 END AS cw, CASE WHEN s >= 0.3 AND NOT coalesce(MNDWI > 0, false) THEN s ELSE -1 END AS cs,
  CASE WHEN v >= 0.35 AND coalesce(NDVI >= 0.2, false) THEN v ELSE -1 END AS cv FROM scored),
classed AS (SELECT aoi_id, greatest(cw, cs, cv, 0.1) AS confidence,
  CASE WHEN cw >= greatest(cs, cv, 0.1) THEN 1 WHEN cs >= greatest(cv, 0.1) THEN 2 WHEN cv >= 0.1 THEN 3 ELSE 0 END AS class_id FROM won)"""

_CELLS = """WITH cells AS (
  SELECT vec_id AS patch_id, p // 8 AS r, p % 8 AS c, v[p + 1] AS v0, v[(p + 1) % len(v) + 1] AS v1, v[(p + 2) % len(v) + 1] AS v2, v[(p + 3) % len(v) + 1] AS v3
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(len(embedding))) AS p FROM embeddings))"""
_BUCKET = "CASE WHEN {0} < -0.1 THEN 0 WHEN {0} < 0 THEN 1 WHEN {0} < 0.1 THEN 2 ELSE 3 END"
_MATRIX = f"""{_CELLS},
pairs AS (SELECT patch_id AS sample_id, {_BUCKET.format('v0')} AS pred, {_BUCKET.format('v1')} AS truth, least(abs(v0) * 2, 1) AS confidence FROM cells),
matrix AS (SELECT t.k AS truth, p.k AS pred, count(pairs.pred) AS n FROM range(4) t(k) CROSS JOIN range(4) p(k) LEFT JOIN pairs ON pairs.truth = t.k AND pairs.pred = p.k GROUP BY ALL)"""
_PER_CLASS = f"""{_MATRIX},
counts AS (SELECT k AS class_id, sum(n) FILTER (truth = k AND pred = k) AS tp, sum(n) FILTER (truth <> k AND pred = k) AS fp, sum(n) FILTER (truth = k AND pred <> k) AS fn, sum(n) AS total
  FROM matrix, range(4) t(k) GROUP BY k),
each AS (SELECT class_id, tp, fp, fn, total - tp - fp - fn AS tn, tp + fn AS support, total, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou FROM counts)"""
_SAMPLES = """WITH samples AS (
  SELECT o_orderkey AS sample_id, o_custkey AS scene_id, n_name AS aoi_id, c_mktsegment AS river_name, r_name AS basin_id, o_orderdate::DATE AS acq_date,
         substr(o_orderpriority, 1, 1)::INT AS class_id, floor(o_totalprice)::BIGINT % 1000 AS pixels, (floor(o_totalprice)::BIGINT % 1000) / 1000 AS fraction
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_SEASON = "CASE WHEN month(acq_date) IN (3, 4, 5) THEN 'pre_monsoon' WHEN month(acq_date) IN (6, 7, 8, 9) THEN 'monsoon' WHEN month(acq_date) IN (10, 11) THEN 'post_monsoon' ELSE 'winter' END"


def _split_sql(group: str, mark: str, corrected: bool) -> str:
    fix = "CASE WHEN n >= 3 AND n - tr - va <= 0 THEN greatest(0, n - tr - 1) ELSE va END" if corrected else "va"
    return f"""{_SAMPLES},
groups AS (SELECT {group} AS g, {mark} AS mark FROM samples GROUP BY {group}),
placed AS (SELECT g, row_number() OVER (ORDER BY mark, g) AS place, count(*) OVER () AS n FROM groups),
cuts AS (SELECT *, greatest(1, floor(n * 0.70::DOUBLE)) AS tr, CASE WHEN n = 1 THEN 0 ELSE greatest(1, floor(n * 0.15::DOUBLE)) END AS va FROM placed),
chosen AS (SELECT g, CASE WHEN place <= tr THEN 'train' WHEN place <= tr + {fix} THEN 'validation' ELSE 'test' END AS split FROM cuts),
dealt AS (SELECT samples.*, split FROM samples JOIN chosen ON g = {group})"""


_TEMPORAL = _split_sql("scene_id", "min(acq_date)::VARCHAR", True)
_RANDOM = _split_sql("scene_id", "any_value(md5('42:' || scene_id))", True)
_SPATIAL = _split_sql("aoi_id", "any_value(md5('42:' || aoi_id))", False)
_DEALT = " SELECT sample_id, scene_id, aoi_id, split FROM dealt"
_SCENES = """WITH scenes AS (
  SELECT event_id AS scene_id, event_type AS sensor, ts::DATE AS acq_date, least(value, 100) AS cloud_cover, user_id AS aoi_id,
         event_id % 40 AS min_lon, event_id % 40 + 2 AS max_lon, event_id % 25 AS min_lat, event_id % 25 + 1 AS max_lat FROM events)"""

_MASKS = f"{_CELLS}, masks AS (SELECT patch_id, r, c, {_BUCKET.format('v0')} AS class_id, least(abs(v0) * 2, 1) AS confidence FROM cells)"
_REGIONS = f"""{_MASKS.replace('WITH', 'WITH RECURSIVE', 1)},
reach(patch_id, class_id, r, c, r0, c0) AS (SELECT patch_id, class_id, r, c, r, c FROM masks WHERE class_id > 0
  UNION SELECT m.patch_id, m.class_id, m.r, m.c, r0, c0 FROM reach x JOIN masks m ON m.patch_id = x.patch_id AND m.class_id = x.class_id
  AND abs(m.r - x.r) <= 1 AND abs(m.c - x.c) <= 1 AND (m.class_id <> 1 OR abs(m.r - x.r) + abs(m.c - x.c) = 1)),
labelled AS (SELECT patch_id, class_id, r, c, min(r0 * 8 + c0) AS region, any_value(confidence) AS confidence,
  4 - (SELECT count(*) FROM masks n WHERE n.patch_id = x.patch_id AND n.class_id = x.class_id AND abs(n.r - x.r) + abs(n.c - x.c) = 1) AS bare FROM reach x JOIN masks USING (patch_id, class_id, r, c) GROUP BY ALL),
regions AS (SELECT patch_id, class_id, region, count(*) AS area_px, min(r)::INT AS row_min, (max(r) + 1)::INT AS row_max, min(c)::INT AS col_min, (max(c) + 1)::INT AS col_max, sum(bare)::BIGINT AS perimeter,
  avg(confidence) AS mean_confidence, count(*) / count(DISTINCT r) AS row_width FROM labelled GROUP BY ALL)"""
_LOSSES = f"""{_CELLS},
logs AS (SELECT patch_id, {_BUCKET.format('v1')} AS truth, list_transform([v0, v1, v2, v3], lambda x: x * 10 - ln(exp(v0 * 10) + exp(v1 * 10) + exp(v2 * 10) + exp(v3 * 10))) AS lp FROM cells),
own AS (SELECT *, lp[truth + 1] AS p, truth + 1 AS w, -(lp[1] + 2 * lp[2] + 3 * lp[3] + 4 * lp[4]) / 4 AS spread FROM logs),
plain AS (SELECT patch_id, sum(0.9::DOUBLE * w * -p + 0.1::DOUBLE * spread) / sum(w) AS cross_entropy, avg(0.25::DOUBLE * (1 - exp(p)) * (1 - exp(p)) * -p) AS focal FROM own GROUP BY patch_id),
soft AS (SELECT patch_id, (2 * coalesce(sum(exp(lp[k + 1])) FILTER (truth = k), 0) + 1) / (sum(exp(lp[k + 1])) + count(*) FILTER (truth = k) + 1) AS o FROM logs, range(4) t(k) GROUP BY patch_id, k)"""

#: Query by name, with its SQL.
REGISTERED = {
    "area_shares": (area_shares, f"""{_CLASSES}
SELECT t.aoi_id, k::INT AS class_id, count(c.class_id) AS pixels, round(count(c.class_id) / any_value(t.total), 6) AS fraction, round(count(c.class_id) * 900.0::DOUBLE, 6) AS area_m2,
  round(coalesce(avg(c.confidence), 0), 6) AS mean_confidence, count(c.class_id) FILTER (c.confidence < 0.5) AS low_pixels, round(coalesce(sum(c.confidence), 0) * 900, 6) AS weighted_area_m2
FROM (SELECT aoi_id, count(*) AS total FROM classed GROUP BY aoi_id) t CROSS JOIN range(4) g(k) LEFT JOIN classed c ON c.aoi_id = t.aoi_id AND c.class_id = k GROUP BY t.aoi_id, k"""),
    "composite_median": (composite_of("median"), _each("median({0})")),
    "composite_mean": (composite_of("mean"), _each("avg({0})")),
    "composite_percentile": (composite_of("percentile", p=25), _each("quantile_cont({0}, 0.25)")),
    "composite_mosaic": (mosaic_latest, _each("arg_max({0}, (acq_date, scene_id))", None)),
    "composite_medoid": (medoid_composite, f"""{_OBS},
middle AS (SELECT aoi_id, row, col, {', '.join(f'median({b}) AS m{b}' for b in _BANDS)} FROM clear GROUP BY ALL),
far AS (SELECT clear.*, round({' + '.join(f'({b} - m{b}) * ({b} - m{b})' for b in _BANDS)}, 12) AS d FROM clear JOIN middle USING (aoi_id, row, col))
SELECT aoi_id, row, col, {', '.join(_BANDS)} FROM far QUALIFY row_number() OVER (PARTITION BY aoi_id, row, col ORDER BY d, acq_date, scene_id) = 1"""),
    "spectral_indices": (spectral_indices, f"{_OBS} SELECT scene_id, row, col, acq_date, {', '.join(f'round({e}, 10) AS {n}' for n, e in _INDEX_SQL.items())} FROM obs"),
    "scaled_bands": (scaled_bands, f"{_OBS} SELECT row, col, scene_id, round(least(greatest(NIR * 40000 * 2.75e-5 - 0.2, 0), 1), 10) AS nir, round(Red * 50000 * 0.00341802 + 149.0, 10) AS thermal, QA & 8 <> 0 AS cloudy, QA & 31 = 0 AS usable FROM obs"),
    "scene_catalog": (scene_catalog, f"{_SCENES} SELECT aoi_id, count(*) AS n_images, min(acq_date) AS first_date, max(acq_date) AS last_date, string_agg(DISTINCT sensor, ',' ORDER BY sensor) AS sensors FROM scenes WHERE acq_date >= '2024-01-05' AND acq_date < '2024-01-25' AND cloud_cover <= 20 GROUP BY aoi_id"),
    "scenes_in_areas": (scenes_in_areas, f"""{_SCENES} SELECT n_nationkey::BIGINT AS area_id, count(*) AS n_scenes, sum(scene_id)::BIGINT AS sum_ids FROM scenes JOIN nation
ON min_lon <= n_nationkey % 38 + 3 AND max_lon >= n_nationkey % 38 AND min_lat <= n_nationkey % 20 + 2 AND max_lat >= n_nationkey % 20 GROUP BY n_nationkey"""),
    "mixed_families": (mixed_families, f"{_SCENES} SELECT aoi_id, count(DISTINCT CASE WHEN sensor IN ('view', 'click') THEN 'TM' WHEN sensor IN ('signup', 'error') THEN 'OLI' END) > 1 AS mixed FROM scenes GROUP BY aoi_id"),
    "confusion_matrix": (confusion_matrix, f"{_MATRIX} SELECT truth::INT AS truth, pred::INT AS pred, n FROM matrix"),
    "normalised_confusion": (normalised_confusion, f"{_MATRIX} SELECT truth::INT AS truth, pred::INT AS pred, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) AS share FROM matrix"),
    "class_metrics": (class_metrics, f"{_PER_CLASS} SELECT class_id::INT AS class_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, support::BIGINT AS support, total::BIGINT AS total, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou FROM each"),
    "overall_metrics": (overall_metrics, f"""{_PER_CLASS} SELECT round(sum(tp) / max(total), 6) AS pixel_accuracy, round(avg(recall) FILTER (support > 0), 6) AS mean_pixel_accuracy, round(avg(precision) FILTER (tp + fp > 0), 6) AS precision, round(avg(recall) FILTER (support > 0), 6) AS recall,
round(avg(f1) FILTER (tp + fp + fn > 0), 6) AS f1, round(avg(f1) FILTER (tp + fp + fn > 0), 6) AS dice, round(avg(iou) FILTER (tp + fp + fn > 0), 6) AS mean_iou, round(sum(support * iou) / max(total), 6) AS fw_iou,
round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy,
round((sum(tp)::DOUBLE / max(total) - sum((tp + fn)::DOUBLE * (tp + fp)) / (max(total)::DOUBLE * max(total))) / (1 - sum((tp + fn)::DOUBLE * (tp + fp)) / (max(total)::DOUBLE * max(total))), 6) AS kappa FROM each"""),
    "temporal_change": (temporal_change, f"""{_SAMPLES},
dates AS (SELECT class_id, acq_date, round_even(avg(pixels), 0)::BIGINT AS pixels, avg(fraction) AS fraction FROM samples GROUP BY ALL),
steps AS (SELECT class_id, lag(acq_date) OVER w AS from_date, acq_date AS to_date, lag(pixels) OVER w AS from_pixels, pixels AS to_pixels, fraction - lag(fraction) OVER w AS fraction_delta FROM dates WINDOW w AS (PARTITION BY class_id ORDER BY acq_date))
SELECT class_id, from_date, to_date, from_pixels, to_pixels, round(fraction_delta, 6) AS fraction_delta, to_pixels - from_pixels AS delta, round(CASE WHEN from_pixels = 0 THEN 0 ELSE (to_pixels - from_pixels) * 100.0::DOUBLE / from_pixels END, 6) AS percent FROM steps WHERE from_date IS NOT NULL"""),
    "seasonal_summary": (seasonal_summary, f"{_SAMPLES} SELECT {_SEASON} AS season, class_id, count(DISTINCT sample_id) AS n_samples, round(avg(fraction), 6) AS mean_fraction, round(stddev_pop(fraction), 6) AS std_fraction FROM samples GROUP BY ALL"),
    "spatial_summary": (spatial_summary, f"""{_SAMPLES}, places AS (SELECT 'aoi_id:' || aoi_id AS place, * FROM samples UNION ALL SELECT 'river_name:' || river_name, * FROM samples UNION ALL SELECT 'basin_id:' || basin_id, * FROM samples)
SELECT place, class_id, count(DISTINCT sample_id) AS n_samples, round(avg(fraction), 6) AS mean_fraction FROM places GROUP BY ALL"""),
    "confidence_summary": (confidence_summary, f"{_MATRIX} SELECT sample_id, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, count(*) FILTER (confidence < 0.5) AS n_low, round(avg((confidence < 0.5)::INT), 6) AS share_low FROM pairs GROUP BY sample_id"),
    "split_temporal": (split_by("temporal"), _TEMPORAL + _DEALT),
    "split_random": (split_by("random"), _RANDOM + _DEALT),
    "split_spatial": (split_by("spatial"), _SPATIAL + _DEALT),
    "split_leakage": (split_leakage, f"""{_TEMPORAL}, ids AS (SELECT 'scene_id' AS kind, scene_id::VARCHAR AS id, split FROM dealt UNION ALL SELECT 'aoi_id', aoi_id, split FROM dealt)
SELECT kind, id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM ids GROUP BY kind, id HAVING count(DISTINCT split) > 1"""),
    "split_statistics": (split_statistics, f"""{_RANDOM},
counts AS (SELECT split, class_id, count(DISTINCT sample_id) AS n_samples, sum(pixels)::BIGINT AS pixels FROM dealt GROUP BY ALL UNION ALL SELECT 'overall', class_id, count(DISTINCT sample_id), sum(pixels)::BIGINT FROM dealt GROUP BY class_id)
SELECT split, class_id, n_samples, pixels, round(pixels / sum(pixels) OVER w, 6) AS share, round(max(nullif(pixels, 0)) OVER w / min(nullif(pixels, 0)) OVER w, 6) AS imbalance FROM counts WINDOW w AS (PARTITION BY split)"""),
    "class_weights": (class_weights, f"""{_SAMPLES}, counts AS (SELECT class_id, sum(pixels)::BIGINT AS pixels FROM samples GROUP BY class_id), shares AS (SELECT *, pixels / sum(pixels) OVER () AS share FROM counts)
SELECT class_id, pixels, round(share, 6) AS share, round(count(*) OVER () / share / sum(1 / share) OVER (), 6) AS weight FROM shares"""),
    "band_statistics": (band_statistics, f"""{_OBS}, long AS (UNPIVOT (SELECT {', '.join(_BANDS)} FROM obs) ON {', '.join(_BANDS)} INTO NAME band VALUE x)
SELECT band, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS most, round(quantile_cont(x, 0.02), 6) AS p2, round(quantile_cont(x, 0.98), 6) AS p98 FROM long GROUP BY band"""),
    "hydrology": (hydrology, f"{_SAMPLES} SELECT sample_id, {_SEASON} AS season, year(acq_date) - CASE WHEN month(acq_date) < 6 THEN 1 ELSE 0 END AS hydro_year, acq_date + 15 AS midpoint FROM samples"),
    "class_probabilities": (class_probabilities, f"""{_CELLS}, raised AS (SELECT *, [exp(v0 * 10 - m), exp(v1 * 10 - m), exp(v2 * 10 - m), exp(v3 * 10 - m)] AS e FROM (SELECT *, greatest(v0, v1, v2, v3) * 10 AS m FROM cells)),
probs AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM raised)
SELECT patch_id, r::INT AS r, c::INT AS c, list_position(p, list_max(p)) - 1 AS pred, round(list_max(p), 6) AS confidence, round(least(greatest(1 + list_sum(list_transform(p, lambda x: least(greatest(x, 1e-10), 1) * ln(least(greatest(x, 1e-10), 1)))) / ln(4), 0), 1), 6) AS certainty FROM probs"""),
    "patch_validity": (patch_validity, f"{_CELLS} SELECT patch_id, round(avg((abs(v0) > 0.01)::INT), 6) AS valid_ratio, avg((abs(v0) > 0.01)::INT) >= 0.7 AS is_valid FROM cells GROUP BY patch_id"),
    "tiled_pixels": (tiled_pixels, f"{_CELLS} SELECT patch_id, a.k::INT AS row_index, b.k::INT AS col_index, count(*) AS n, round(avg(v0), 6) AS mean FROM cells JOIN range(3) a(k) ON r BETWEEN a.k * 2 AND a.k * 2 + 3 JOIN range(3) b(k) ON c BETWEEN b.k * 2 AND b.k * 2 + 3 GROUP BY ALL"),
    "region_rows": (region_rows, f"""{_REGIONS} SELECT patch_id, class_id, area_px, row_min, row_max, col_min, col_max, perimeter, round(mean_confidence, 6) AS mean_confidence, round(row_width, 6) AS row_width, round(area_px * 900.0::DOUBLE, 6) AS area_m2,
round((col_max - col_min) / (row_max - row_min), 6) AS aspect, round(4 * pi() * area_px / (perimeter * perimeter), 6) AS compactness, round(1 - least(row_max - row_min, col_max - col_min) / greatest(row_max - row_min, col_max - col_min), 6) AS elongation FROM regions"""),
    "region_metrics": (region_metrics, f"""{_REGIONS}, big AS (SELECT * FROM regions WHERE area_px >= 4)
SELECT p.patch_id, p.class_id, p.class_px, count(big.region) AS n_regions, coalesce(max(area_px), 0) AS largest_px, round(coalesce(avg(area_px), 0), 6) AS mean_px, round(coalesce(stddev_pop(area_px), 0), 6) AS std_px, round(count(big.region) / p.class_px, 6) AS fragmentation, round(coalesce(arg_max(row_width, (area_px, -region)), 0), 6) AS width_px
FROM (SELECT patch_id, class_id, count(*) AS class_px FROM labelled GROUP BY ALL) p LEFT JOIN big USING (patch_id, class_id) GROUP BY p.patch_id, p.class_id, p.class_px"""),
    "majority_masks": (majority_masks, f"""{_MASKS}, votes AS (SELECT m.patch_id, m.r, m.c, n.class_id, count(*) AS n FROM masks m, range(-1, 2) i(dr), range(-1, 2) j(dc), masks n
WHERE n.patch_id = m.patch_id AND n.r = greatest(0, least(7, m.r + dr)) AND n.c = greatest(0, least(7, m.c + dc)) GROUP BY ALL)
SELECT patch_id, r::INT AS r, c::INT AS c, arg_max(class_id, (n, -class_id)) AS class_id FROM votes GROUP BY ALL"""),
    "cleaned_masks": (cleaned_masks, None),
    "label_quality": (label_quality, f"""{_MASKS}, q AS (SELECT patch_id, avg((confidence >= 0.1)::INT) AS valid_ratio, avg((confidence < 0.1)::INT) AS open_ratio,
{' + '.join(f'(count(*) FILTER (confidence >= 0.1 AND class_id = {k}) >= 5)::INT' for k in range(4))} AS n_classes FROM masks GROUP BY patch_id),
s AS (SELECT *, round(printf('%.20f', least(0.5::DOUBLE * least(valid_ratio / 0.7::DOUBLE, 1) + 0.3::DOUBLE * greatest(1 - open_ratio / 0.5::DOUBLE, 0) + 0.2::DOUBLE * n_classes / 4, 1))::DECIMAL(38, 20), 4)::DOUBLE AS score,
concat_ws('; ', CASE WHEN valid_ratio < 0.7 THEN 'too few valid pixels' END, CASE WHEN open_ratio > 0.5 THEN 'too many unclassified pixels' END, CASE WHEN n_classes = 0 THEN 'no class covers enough pixels' END) AS issues FROM q)
SELECT patch_id, round(valid_ratio, 6) AS valid_ratio, round(open_ratio, 6) AS open_ratio, n_classes, score, issues, issues = '' AND score >= 0.5 AS acceptable FROM s"""),
    "patch_losses": (patch_losses, f"{_LOSSES} SELECT patch_id, round(cross_entropy, 6) AS cross_entropy, round(focal, 6) AS focal, round(dice, 6) AS dice FROM plain JOIN (SELECT patch_id, 1 - avg(o) AS dice FROM soft GROUP BY patch_id) USING (patch_id)"),
    "turned_masks": (turned_masks, f"""{_MASKS} SELECT patch_id, (CASE patch_id % 4 WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r WHEN 3 THEN c ELSE r END)::INT AS r, (CASE patch_id % 4 WHEN 1 THEN r WHEN 2 THEN 7 - c WHEN 3 THEN 7 - r ELSE c END)::INT AS c, class_id FROM masks"""),
    "stitched_tiles": (stitched_tiles, f"{_CELLS} SELECT patch_id, (CASE r // 3 WHEN 2 THEN 0 WHEN 1 THEN 2 ELSE 5 END + r % 3)::INT AS row, c::INT AS col, v0 FROM cells"),
    "rescaled_patches": (rescaled_patches, f"""{_CELLS}, grid AS (SELECT i.k AS r, j.k AS c, i.k * 7 / 9 AS y, j.k * 7 / 9 AS x FROM range(10) i(k), range(10) j(k))
SELECT patch_id, g.r::INT AS r, g.c::INT AS c, round(sum(v0 * (1 - abs(cells.r - y)) * (1 - abs(cells.c - x))), 6) AS v0 FROM grid g JOIN cells ON abs(cells.r - y) < 1 AND abs(cells.c - x) < 1 GROUP BY ALL"""),
    "dataset_issues": (dataset_issues, f"""{_RANDOM},
leaks AS (SELECT aoi_id FROM dealt GROUP BY aoi_id HAVING count(DISTINCT split) > 1), sums AS (SELECT split, class_id, sum(pixels) AS p FROM dealt GROUP BY ALL)
SELECT 'ERROR' AS severity, 'leakage' AS category, 'aoi_id' AS subject, count(*)::DOUBLE AS value FROM leaks HAVING count(*) > 0
UNION ALL SELECT 'WARN', 'split_size', split, count(*)::DOUBLE FROM dealt GROUP BY split HAVING count(*) < 10000
UNION ALL SELECT 'WARN', 'class_balance', split, round(max(p) / min(p), 6) FROM sums WHERE p > 0 AND split <> 'test' GROUP BY split HAVING max(p) > min(p)"""),
    "weighted_draws": (weighted_draws, None),
    "change_chart": (change_chart, f"""{_SAMPLES},
dates AS (SELECT class_id, acq_date, round_even(avg(pixels), 0)::BIGINT AS pixels FROM samples GROUP BY ALL),
steps AS (SELECT class_id, lag(acq_date) OVER w AS from_date, acq_date AS to_date, pixels - lag(pixels) OVER w AS delta FROM dates WINDOW w AS (PARTITION BY class_id ORDER BY acq_date))
SELECT from_date, to_date, {', '.join(f'coalesce(max(delta) FILTER (class_id = {k}), 0)::BIGINT AS delta_{k}' for k in range(1, 6))} FROM steps WHERE from_date IS NOT NULL GROUP BY from_date, to_date"""),
    "class_report": (class_report, f"""{_PER_CLASS}, areas AS (SELECT sample_id, pred AS class_id, count(*) / any_value(t) AS fraction, avg(confidence) AS confidence FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS t FROM pairs) GROUP BY sample_id, pred)
SELECT e.class_id::INT AS class_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou, round(arg_min(a.fraction, sample_id), 6) AS fraction, round(arg_min(a.confidence, sample_id), 6) AS confidence
FROM each e LEFT JOIN areas a USING (class_id) GROUP BY ALL"""),
}

#: The same over observations of which most are usable; those above see the few whose part number has five low bits of 0.
_BRIGHT = _OBS.replace("(l_partkey % 256)::INT AS QA", "CASE WHEN l_discount > 0.095 THEN 8 WHEN l_tax > 0.075 THEN 4 ELSE 64 END AS QA")
_MASKED = ("area_shares", "composite_median", "composite_mean", "composite_percentile", "composite_mosaic", "composite_medoid")
REGISTERED |= {f"{name}_bright": (partial(run, observed=views.bright_masked), sql.replace(_OBS, _BRIGHT)) for name in _MASKED for run, sql in [REGISTERED[name]]}

QUERIES = {name: run for name, (run, _) in REGISTERED.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in REGISTERED.items() if sql}
