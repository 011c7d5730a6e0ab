"""Registered queries over harmonised bands, labels, data sets, pictures, logs, manifests and streams, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, geometry, probability, spectral
from ..operators import analytics, assembly, augment, catalog, checks, classify, cleaning, composite, dataset, epochs, figures, harmonise, labels, losses, metrics, overlays, regions, reports, tiling
from ..sources import commitlog, manifests, views
from ..streaming import change, running
from .queries import _BUCKET, _CELLS, _LOSSES, _MASKS, _MATRIX, _OBS, _PER_CLASS, _RANDOM, _REGIONS, _SAMPLES, _SCENES, _SEASON, _TEMPORAL, _labelled, _masks, _rounded, _sample_metrics, _soft

FIRST = ["v0", "v1", "v2"]
COVER = {"MNDWI": "v0", "NDWI": "v1", "AWEI_nsh": "v2", "AWEI_sh": "v3", "NDVI": "v4", "SAVI": "v5", "BSI": "v6", "NDMI": "v7"}


# Sensors

def harmonised_bands(spark, folder):
    return _rounded(harmonise.harmonised(views.raw_scenes(spark, folder)), 9)


def preprocessed_bands(spark, folder):
    return _rounded(harmonise.preprocess(views.raw_scenes(spark, folder)), 9)


def harmonised_indices(spark, folder):
    """Indices of harmonised, scaled and masked pixels, their mean by spacecraft."""
    pixels = harmonise.features(harmonise.preprocess(views.raw_scenes(spark, folder)), "spacecraft_id", names=("NDVI", "MNDWI", "BSI"))
    return _rounded(pixels.groupBy("spacecraft_id").agg(F.count("*").alias("n"), F.count("NDVI").alias("n_clear"), *[F.avg(c).alias(c) for c in ("NDVI", "MNDWI", "BSI")]))


_RAW = """WITH named AS (
  SELECT l_orderkey AS row, l_linenumber::BIGINT AS col, l_partkey AS part, l_suppkey AS supp,
    CASE l_suppkey % 5 WHEN 0 THEN 'LANDSAT_5' WHEN 1 THEN 'LANDSAT_7' WHEN 2 THEN 'LANDSAT_8' WHEN 3 THEN 'LANDSAT_9' ELSE 'Sentinel-2A' END AS spacecraft_id,
    l_quantity * 800 AS Blue, l_extendedprice / 3 AS Green, l_discount * 300000 AS Red, l_tax * 400000 AS NIR, (l_partkey % 1000) * 40.0::DOUBLE AS SWIR1, (l_suppkey % 100) * 400.0::DOUBLE AS SWIR2,
    CASE WHEN l_suppkey % 5 = 4 THEN 0 ELSE l_linenumber * 5000.0::DOUBLE END AS Thermal,
    (CASE WHEN l_suppkey % 5 = 4 THEN day(l_shipdate::DATE) % 12 ELSE 1 << (day(l_shipdate::DATE) % 8)::INT END)::DOUBLE AS QA FROM lineitem)"""
_SCALED = f"""{_RAW},
flagged AS (SELECT *, spacecraft_id = 'Sentinel-2A' AS s2, CASE WHEN spacecraft_id = 'Sentinel-2A' THEN QA NOT IN (3, 8, 9, 10, 11) ELSE (QA::INT & 31) = 0 END AS ok FROM named),
clean AS (SELECT row, col, part, supp, spacecraft_id, {', '.join(f'CASE WHEN ok THEN least(greatest(CASE WHEN s2 THEN {b} * 1e-4 ELSE {b} * 2.75e-5 - 0.2 END, 0), 1) END AS {b}' for b in spectral.OPTICAL)},
  CASE WHEN ok THEN CASE WHEN s2 THEN Thermal ELSE Thermal * 0.00341802 + 149.0 END END AS Thermal, CASE WHEN ok THEN QA END AS QA FROM flagged)"""
_ALL_BANDS = (*spectral.OPTICAL, "Thermal", "QA")


def _bands_sql(source: str) -> str:
    return f"SELECT row, col, part, supp, spacecraft_id, {', '.join(f'round({b}, 9) AS {b}' for b in _ALL_BANDS)} FROM {source}"


# Catalogs

def _collections(spark, folder):
    kinds = F.when(F.col("sensor").isin("view", "click"), F.array(F.lit("B1"), F.lit("B2"))).otherwise(F.array(F.lit("B2"), F.lit("B3"), F.lit("B4")))
    return views.scenes(spark, folder).select("*", F.col("sensor").alias("collection_id"), kinds.alias("band_names"), F.concat(F.lit("EPSG:"), F.col("aoi_id").cast("string")).alias("crs"), F.lit(30.0).alias("scale"))


def collection_metadata(spark, folder):
    found = catalog.metadata(_collections(spark, folder), "collection_id")
    return found.withColumns({c: F.array_join(c, ",") for c in ("sensors", "band_names")})


def one_collection(spark, folder):
    return catalog.images(catalog.collection(_collections(spark, folder), "view"), "crs")


def filtered_scenes(spark, folder):
    found, tags = catalog.filtered(views.scenes(spark, folder), "2024-01-05", "2024-01-25", 30.0, (5.0, 4.0, 20.0, 15.0), ["view", "click"])
    return found.groupBy("aoi_id").agg(F.count("*").alias("n_images"), F.sum("scene_id").alias("sum_ids")).withColumn("tags", F.lit(";".join(tags)))


def _periods(spark, folder):
    own = views.scenes(spark, folder).groupBy("sensor", F.col("aoi_id").alias("collection_id")).agg(F.min("acq_date").alias("op_start"), F.max("acq_date").alias("op_end"))
    return own.withColumn("op_end", F.when(F.col("sensor") != "view", F.col("op_end")))


def operating_sensors(spark, folder):
    return catalog.operating(_periods(spark, folder), "2024-01-10", "2024-01-12").select("sensor", "collection_id", "op_start")


def chosen_sensors(spark, folder):
    return catalog.chosen_sensors(_periods(spark, folder), "2024-01-10", "2024-01-12", s2="click").select("sensor", "collection_id")


def sensors_of_collections(spark, folder):
    wanted = views.scenes(spark, folder).where("cloud_cover > 90").select(F.col("aoi_id").alias("collection_id"))
    return catalog.sensors_of(_periods(spark, folder), wanted).select("sensor", "collection_id")


def merged_catalog(spark, folder):
    scenes = views.scenes(spark, folder)
    both = catalog.merged([catalog.of_sensors(scenes, ["view"]), catalog.of_sensors(scenes, ["click", "error"]).drop("cloud_cover")])
    return _rounded(both.groupBy("aoi_id").agg(F.count("*").alias("n"), F.count("cloud_cover").alias("n_cover"), F.avg("cloud_cover").alias("mean_cover")))


_PERIODS = f"{_SCENES}, periods AS (SELECT sensor, aoi_id AS collection_id, min(acq_date) AS op_start, CASE WHEN sensor <> 'view' THEN max(acq_date) END AS op_end FROM scenes GROUP BY sensor, aoi_id)"
_IN_OPERATION = "coalesce(op_end, DATE '9999-12-31') >= DATE '2024-01-10' AND op_start <= DATE '2024-01-12'"


# Places and dates

def temporal_metadata(spark, folder):
    rows = views.samples(spark, folder)
    hydro = calendar.hydrological_year(F.col("acq_date")) + F.when(F.col("valid_ratio") < 0.1, 1).otherwise(0)
    told = rows.select("sample_id", *calendar.temporal_columns(F.col("acq_date"), F.date_add("acq_date", 31), F.array("river_name", "basin_id"), F.when(F.col("valid_ratio") > 0.5, F.col("valid_ratio"))), F.array_join(calendar.date_issues(F.col("acq_date"), F.lit("winter"), hydro, F.col("valid_ratio") * 1.5), ",").alias("issues"))
    return _rounded(told)


def patch_geometry(spark, folder):
    rows = views.table(spark, folder, "events").select("event_id", (F.col("user_id") % 3 + 1).cast("int").alias("k"), (F.col("event_id") % 50).cast("int").alias("row"), (F.col("event_id") % 37).cast("int").alias("col"), "event_type")
    size = F.col("k") * 0.001
    affine = F.struct(size.alias("a"), F.lit(0.0).alias("b"), (F.col("event_id") % 40).cast("double").alias("c"), F.lit(0.0).alias("d"), (-size).alias("e"), (F.col("event_id") % 25).cast("double").alias("f"))
    zero = F.struct(size.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"), (-size).alias("e"), F.lit(0.0).alias("f"))
    rows = rows.withColumn("at", geometry.shifted(affine, F.col("row") * 64, F.col("col") * 64)).withColumn("box", geometry.bounds(F.col("at"), F.lit(64), F.lit(64)))
    rows = rows.withColumn("size", geometry.pixel_size(F.col("box"), 30.0)).withColumn("offset", geometry.offset(F.col("at"), zero))
    return _rounded(rows.select("event_id", geometry.patch_id(F.col("event_type"), F.col("row"), F.col("col")).alias("patch_id"), "at.c", "at.f", "box.*", F.col("size.width").alias("width"), F.col("size.height").alias("height"), F.col("offset.col").alias("col_off"), F.col("offset.row").alias("row_off")))


# Rules and labels

def _cover(spark, folder):
    return views.patch_cells(spark, folder).select("patch_id", "r", "c", *[(F.col(v) * 3).alias(k) for k, v in COVER.items()])


WET = classify.Rule("wet", 1, (classify.Term("NDWI", 0.1, 1.0),), 0.3, 0.5)


def generated_labels(spark, folder):
    found = labels.generate(_cover(spark, folder), "patch_id")
    return _rounded(found.withColumn("issues", F.array_join("issues", "; ")))


def rule_agreement(spark, folder):
    rules = (*classify.STANDARD_RULES, WET)
    cells = classify.with_nodata(classify.classify(_cover(spark, folder), rules))
    return labels.agreement(cells, "patch_id", rules=rules).join(labels.confidence(cells, "patch_id"), "patch_id")


def priority_classes(spark, folder):
    found = classify.classify(_cover(spark, folder), strategy="priority_order", priority={3: 1, 1: 2, 2: 3, 0: 4})
    return _rounded(labels.with_class_names(classify.with_nodata(found)).select("patch_id", "r", "c", "class_id", "confidence", "class_name"))


def bright_sand(spark, folder):
    """Share of sand with two optional terms, over raw pixels with a brightness."""
    pixels = harmonise.preprocess(views.raw_scenes(spark, folder)).withColumns({n: spectral.INDICES[n]({b: F.col(b) for b in spectral.OPTICAL}) for n in ("MNDWI", "NDWI", "BSI", "NDVI", "NDBI")})
    pixels = pixels.withColumn("brightness", labels.brightness(pixels.columns))
    sand = labels.with_terms(classify.STANDARD_RULES[1], classify.Term("NDBI", 0.0, 0.2), classify.Term("brightness", 0.4, 0.3))
    scored = classify.classify(pixels, (sand, *labels.enabled(names=("background",))))
    return _rounded(scored.groupBy("spacecraft_id").agg(F.avg((F.col("class_id") == 2).cast("double")).alias("share"), F.avg("confidence").alias("confidence"), F.avg("brightness").alias("brightness")))


def label_validity(spark, folder):
    rows = views.samples(spark, folder)
    mask = F.array_compact(F.array(F.when(F.col("valid_ratio") < 0.2, "too much nodata")))
    dates = calendar.date_issues(F.col("acq_date"), calendar.season(F.month("acq_date")), calendar.hydrological_year(F.col("acq_date")) + F.when(F.col("pixels") > 900, 1).otherwise(0), F.lit(0.5))
    own = F.array_compact(F.array(F.when(F.col("pixels") < 100, "low confidence")))
    found = labels.with_validity(rows, mask, dates, own, F.col("pixels") >= 100)
    return found.select("sample_id", "is_valid", F.array_join("validation_issues", "; ").alias("validation_issues"))


def label_statistics(spark, folder):
    month = (F.col("label") + 1).cast("int")
    own = views.table(spark, folder, "embeddings").select(F.col("vec_id").alias("patch_id"), (F.col("label") != 3).alias("mask_ok"), calendar.season(month).alias("season"), (F.col("label") % 4 + 2000).cast("int").alias("year"))
    return _rounded(labels.statistics(own, _masks(spark, folder)))


_COVER = f"""WITH wide AS (SELECT vec_id AS patch_id, p // 8 AS r, p % 8 AS c, {', '.join(f'v[(p + {k}) % len(v) + 1] * 3 AS {n}' for k, n in enumerate(COVER))}
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(len(embedding))) AS p FROM embeddings)),
scored AS (SELECT *,
  {_soft('MNDWI', 0.2, 0.3)} * 0.4 + {_soft('NDWI', 0.0, 0.3)} * 0.2 + {_soft('AWEI_nsh', 0.0, 0.3)} * 0.15 + {_soft('AWEI_sh', 0.0, 0.3)} * 0.05 + {_soft('NDVI', 0.05, 0.3, False)} * 0.2 AS w,
  {_soft('MNDWI', 0.0, 0.3, False)} * 0.3 + {_soft('BSI', 0.0, 0.3)} * 0.35 + {_soft('NDVI', 0.25, 0.3, False)} * 0.25 + {_soft('NDWI', 0.0, 0.3, False)} * 0.1 AS s,
  {_soft('NDVI', 0.2, 0.25)} * 0.5 + {_soft('SAVI', 0.1, 0.25)} * 0.3 + {_soft('NDMI', 0.0, 0.25)} * 0.2 AS v, {_soft('NDWI', 0.1, 0.3)} AS x FROM wide),
won AS (SELECT *, CASE WHEN w >= 0.4 THEN w ELSE -1 END AS cw, CASE WHEN s >= 0.3 AND NOT MNDWI > 0 THEN s ELSE -1 END AS cs, CASE WHEN v >= 0.35 AND NDVI >= 0.2 THEN v ELSE -1 END AS cv, CASE WHEN x >= 0.5 THEN x ELSE -1 END AS cx FROM scored)"""
_SCORE = "round(printf('%.20f', least(0.5::DOUBLE * least(valid_ratio / 0.7::DOUBLE, 1) + 0.3::DOUBLE * greatest(1 - open_ratio / 0.5::DOUBLE, 0) + 0.2::DOUBLE * n_classes / 4, 1))::DECIMAL(38, 20), 4)::DOUBLE"


# Data sets

def _patches(spark, folder):
    return views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("patch_id"), F.col("o_custkey").alias("scene_id"))


def _patch_labels(spark, folder):
    return views.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("patch_id"), (F.col("l_discount") > 0.02).alias("is_valid"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_tax").alias("tax"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordinal"),
    )


def assembled_samples(spark, folder):
    return dataset.labelled(_patches(spark, folder), _patch_labels(spark, folder)).select("patch_id", "scene_id", "line", "tax")


def unlabelled_patches(spark, folder):
    return dataset.unlabelled(_patches(spark, folder), _patch_labels(spark, folder))


def duplicate_labels(spark, folder):
    return dataset.duplicates(_patch_labels(spark, folder), "patch_id")


def split_ratios(spark, folder):
    split = dataset.split(views.samples(spark, folder), "temporal")
    return _rounded(dataset.actual_ratios(split))


def test_samples(spark, folder):
    return dataset.of_split(dataset.split(views.samples(spark, folder), "random"), "test").select("sample_id", "scene_id")


def sample_issues(spark, folder):
    rows = views.samples(spark, folder).withColumns({"sample_id": F.col("scene_id"), "patch_path": F.concat(F.lit("patch/"), "scene_id"), "mask_path": F.concat(F.lit("mask/"), F.col("scene_id") % 97), "crs": F.concat(F.lit("EPSG:"), "river_name")})
    files = rows.where("valid_ratio > 0.2").select(F.explode(F.array("patch_path", F.concat(F.lit("mask/"), F.col("scene_id") % 89))).alias("path"))
    found = checks.sample_issues(rows, crs="crs", expected_crs="EPSG:BUILDING", least_ratio=0.3).unionByName(checks.file_issues(rows, files))
    return found.groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("n_samples"))


def data_quality(spark, folder):
    """Quality score, share of low ratios and what is too few, of all samples."""
    rows = dataset.split(views.samples(spark, folder), "random")
    imbalance = dataset.split_statistics(rows).where("split = 'overall'").agg(F.max("imbalance").alias("imbalance"))
    leaks = dataset.leakage(rows, "scene_id", "aoi_id").agg(F.count("*").alias("leaks"))
    one = rows.agg(F.avg((F.col("valid_ratio") >= 0.5).cast("double")).alias("valid")).crossJoin(imbalance).crossJoin(leaks)  # one row each
    score = dataset.quality_score(F.col("valid"), (F.col("leaks") == 0).cast("double"), F.col("imbalance"), F.lit(1.0))
    return _rounded(checks.low_ratios(rows).crossJoin(one.select(score.alias("score"))))


def recommendations(spark, folder):
    rows = dataset.split(views.samples(spark, folder), "random").withColumn("crs", F.concat(F.lit("EPSG:"), "basin_id"))
    found = checks.quality_issues(rows, dataset.split_statistics(rows), dataset.leakage(rows, "aoi_id"), least=10000, most_imbalance=1.0)
    return _rounded(checks.recommendations(found.unionByName(checks.crs_issues(rows))))


def mask_checks(spark, folder):
    cells = _masks(spark, folder).withColumn("class_id", F.when(F.col("confidence") < 0.15, 255).when(F.col("confidence") > 0.6, 9).otherwise(F.col("class_id")))
    return _rounded(checks.mask_issues(cells, "patch_id", most_nodata=0.3, reject_single=True))


def grid_checks(spark, folder):
    own = views.table(spark, folder, "embeddings").select("vec_id", "label")
    place = lambda shift: F.struct((F.col("vec_id") * 0.5 + shift).alias("c"), F.lit(1.0).alias("a"))
    patches = own.select(F.col("vec_id").alias("patch_id"), F.lit("EPSG:4326").alias("crs"), place(F.lit(0.0)).alias("transform"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    masks = own.select(F.col("vec_id").alias("patch_id"), F.when(F.col("label") == 1, "EPSG:32645").otherwise("EPSG:4326").alias("crs"), place(F.when(F.col("label") == 2, 1e-3).when(F.col("label") == 3, 1e-7).otherwise(0.0)).alias("transform"), F.lit(8).alias("width"), F.when(F.col("label") == 4, 7).otherwise(8).alias("height"))
    return checks.grid_issues(masks, patches)


def band_checks(spark, folder):
    own = views.table(spark, folder, "embeddings").select(F.col("vec_id").alias("raster_id"), F.explode(F.transform(F.sequence(F.lit(0), F.col("label").cast("int")), lambda k: F.concat(F.lit("b"), k))).alias("band"))
    expected = own.select("band").distinct().where("band < 'b6'")
    return checks.band_issues(own, expected)


def prediction_checks(spark, folder):
    cells = views.pred_truth(spark, folder).withColumn("confidence", F.when(F.col("confidence") > 0.9, float("nan")).otherwise(F.col("confidence")))
    rows = views.table(spark, folder, "embeddings").select(F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 1_000_000)).alias("sample_id"), "label")
    wide = checks.cell_issues(cells.withColumn("class_id", F.when(F.col("confidence") > 0.7, 8).otherwise(F.col("pred"))), ["confidence"], "sample_id").select(F.col("sample_id").cast("string").alias("subject"), F.concat_ws(": ", "issue", F.col("n").cast("string")).alias("issue"))
    return analytics.input_issues(rows, cells, low=1.5, pixel_area=-1.0).unionByName(wide)


def prepared_checks(spark, folder):
    rows = dataset.split(views.samples(spark, folder), "random").where("split <> 'train'")
    stats = dataset.band_statistics(views.observations(spark, folder), spectral.OPTICAL).withColumn("std", F.when(F.col("band") == "Red", 0.0).otherwise(F.col("std")))
    return checks.prepared_issues(rows, stats, 7)


def band_report(spark, folder):
    cells = views.patch_cells(spark, folder).select("patch_id", *[F.when(F.abs(v) > 0.02, F.col(v)).otherwise(float("nan")).alias(v) for v in FIRST])
    return _rounded(checks.band_report(cells, FIRST, "patch_id"))


def sampling_weights(spark, folder):
    rows = views.samples(spark, folder).withColumn("season", calendar.season(F.month("acq_date")))
    seasonal = dataset.season_weights(rows).select("sample_id", "weight")
    return _rounded(seasonal.join(dataset.valid_weights(rows).select("sample_id", F.col("weight").alias("valid_weight")), "sample_id"), 12)


def assembled_dataset(spark, folder):
    """Samples and scenes of each split of an assembled data set, with its issues and score."""
    patches = views.samples(spark, folder).withColumnRenamed("sample_id", "patch_id").drop("class_id", "pixels")
    made = assembly.assemble(patches, _patch_labels(spark, folder).select("patch_id", "is_valid", F.col("line").alias("class_id"), F.lit(1).alias("pixels"), "ordinal"))
    issues = made.issues.groupBy("issue").agg(F.count("*").alias("n")).select(F.col("issue").alias("name"), "n", F.lit(None).cast("double").alias("score"))
    splits = made.samples.groupBy("split").agg(F.count("*").alias("n")).select(F.col("split").alias("name"), "n", F.lit(None).cast("double").alias("score"))
    return _rounded(splits.unionByName(issues).unionByName(made.quality.select(F.lit("quality").alias("name"), F.col("n_samples").alias("n"), "score")))


def split_dates(spark, folder):
    rows = dataset.split(views.samples(spark, folder), "random").withColumn("season", calendar.season(F.month("acq_date")))
    return assembly.split_dates(rows)


# Preparing cells

def training_rows(spark, folder):
    cells = views.patch_cells(spark, folder).select(F.col("patch_id").alias("sample_id"), "r", "c", *FIRST, F.when(F.abs("v0") < 0.02, 255).otherwise(1).alias("class_id")).withColumn("v1", F.when(F.col("v1") > 0.3, float("inf")).otherwise(F.col("v1")))
    rows = views.table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("season"))
    ready = dataset.training_rows(cells, rows, dataset.statistics_for(cells, FIRST), FIRST)
    return _rounded(ready.withColumn("back", dataset.denormalise(F.col("v0"), F.lit(0.5), F.lit(2.0))))


def minmax_statistics(spark, folder):
    cells = views.patch_cells(spark, folder)
    both = dataset.statistics_for(cells, FIRST, "min_max").unionByName(dataset.statistics_for(cells, FIRST, "none").withColumn("band", F.concat("band", F.lit(" none"))))
    return _rounded(both)


def moved_patches(spark, folder):
    """Flipped, cropped, brighter and with more contrast; each patch by its own number."""
    cells = views.patch_cells(spark, folder).select("patch_id", "r", "c", "v0", "v1")
    cells = augment.flip(augment.flip(cells, 8, "c", F.col("patch_id") % 2 == 0), 8, "r", F.col("patch_id") % 3 == 0)
    cells = augment.crop(cells, (F.col("patch_id") % 4).cast("int"), F.lit(1), 5)
    return _rounded(augment.contrast(augment.brightness(cells, ["v0"], F.lit(0.1)), ["v0", "v1"], F.lit(1.5), "patch_id"))


def user_step_masks(spark, folder):
    """A step of the user's, between built-in ones and one that fails."""
    def failing(grid):
        raise ValueError

    return cleaning.per_patch(_masks(spark, folder), failing, lambda grid: np.where(grid == 3, 0, grid), skip_failing=True).select("patch_id", "r", "c", "class_id")


def user_confidence(spark, folder):
    """Sigmoids, and a confidence of the user's: the best score less the next."""
    logits = views.patch_cells(spark, folder).select("patch_id", "r", "c", F.array(*[F.col(f"v{k}") * 10 for k in range(4)]).alias("logits"))
    margin = lambda p: F.element_at(F.array_sort(p), -1) - F.element_at(F.array_sort(p), -2)
    p = logits.withColumn("probs", probability.sigmoid(F.col("logits")))
    return _rounded(p.select("patch_id", "r", "c", probability.confidence(F.col("probs"), margin).alias("margin"), probability.confidence(F.col("probs")).alias("most")))


# Windows and scenes

def window_grid(spark, folder):
    rasters = views.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("raster_id"), (F.col("s_suppkey") % 41 + 8).cast("int").alias("width"), (F.col("s_suppkey") % 29 + 6).cast("int").alias("height"))
    both = [tiling.windows(rasters, 16, 8, flush).withColumn("flush", F.lit(flush)) for flush in (False, True)]
    return both[0].unionByName(both[1])


def cut_patches(spark, folder):
    cells = views.patch_cells(spark, folder).select(F.col("patch_id").alias("scene_id"), F.col("r").alias("row"), F.col("c").alias("col"), F.when(F.abs("v0") > 0.04, F.col("v0")).alias("v0"))
    placed = tiling.in_windows(cells, 4, 2, F.lit(8), F.lit(8))
    grid = tiling.windows(cells.select("scene_id").distinct().withColumns({"width": F.lit(8), "height": F.lit(8)}), 4, 2)
    return _rounded(tiling.cut_patches(placed, grid, ["v0"], least=0.8)[0].select("patch_id", "scene_id", "row_index", "col_index", "row_off", "col_off", "valid_ratio", "is_valid"))


def cut_counts(spark, folder):
    cells = views.patch_cells(spark, folder).select(F.col("patch_id").alias("scene_id"), F.col("r").alias("row"), F.col("c").alias("col"), F.when(F.abs("v0") > 0.04, F.col("v0")).alias("v0"))
    grid = tiling.windows(cells.select("scene_id").distinct().withColumns({"width": F.lit(8), "height": F.lit(8)}), 4, 2)
    return tiling.cut_patches(tiling.in_windows(cells, 4, 2, F.lit(8), F.lit(8)), grid, ["v0"], least=0.8)[1]


def predicted_scenes(spark, folder):
    """Overlapping tiles scored alike but for their place; the last tile decides."""
    cells = views.patch_cells(spark, folder).select(F.col("patch_id").alias("scene_id"), F.col("r").alias("row"), F.col("c").alias("col"), *FIRST)
    tiles = tiling.in_flush_windows(cells, 4, 3, F.lit(8), F.lit(8))
    tiles = tiles.withColumn("logits", F.array("v0", F.col("v1") + F.col("row_index") * 0.05, F.col("v2") - F.col("col_index") * 0.05))
    return tiling.predicted_scene(tiles, "scene_id").select("scene_id", "row", "col", "class_id")


def padded_tiles(spark, folder):
    cells = views.patch_cells(spark, folder).where("r < 3 AND c < 7").select("patch_id", "r", "c", "v0")
    return _rounded(tiling.padded(cells, ["v0"], 8, "patch_id"))


def named_values(spark, folder):
    values = views.patch_cells(spark, folder).select("patch_id", (F.col("r") * 8 + F.col("c")).alias("band_index"), F.when(F.col("r") > 3, F.concat(F.lit("B"), "c")).when(F.col("r") == 2, "").alias("description"), F.when(F.col("v0") > 0.3, -9999.0).otherwise(F.col("v0")).alias("value"))
    return _rounded(tiling.named_bands(values, "patch_id", "band_index"))


def overviews(spark, folder):
    return _rounded(composite.overview(views.observations(spark, folder), 4))


def area_tiles(spark, folder):
    areas = views.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("area_id"), (F.col("s_suppkey") % 90 + 10).cast("int").alias("width"), (F.col("s_suppkey") % 70 + 5).cast("int").alias("height"), (F.col("s_suppkey") % 30).cast("double").alias("min_lon"), (F.col("s_suppkey") % 30 + 2).cast("double").alias("max_lon"), (F.col("s_suppkey") % 20).cast("double").alias("min_lat"), (F.col("s_suppkey") % 20 + 1).cast("double").alias("max_lat"))
    return _rounded(augment.area_tiles(areas, 900).select("area_id", F.col("row").alias("tile_row"), F.col("column").alias("tile_col"), "tile_min_lon", "tile_max_lon", "tile_min_lat", "tile_max_lat"))


# Cleaning, step by step

def opened_masks(spark, folder):
    return cleaning.per_patch(_masks(spark, folder), cleaning.Cleaning(opening=1, closing=2)).select("patch_id", "r", "c", "class_id")


def without_small_objects(spark, folder):
    return cleaning.per_patch(_masks(spark, folder), cleaning.Cleaning(opening=0, closing=0, least_object=3)).select("patch_id", "r", "c", "class_id")


def filled_small_holes(spark, folder):
    own = cleaning.Cleaning(opening=0, closing=0, overrides={2: cleaning.Cleaning(opening=0, closing=0, least_hole=3)})
    return cleaning.per_patch(_masks(spark, folder), own).select("patch_id", "r", "c", "class_id")


def filled_holes(spark, folder):
    return cleaning.per_patch(_masks(spark, folder), cleaning.fill_holes).select("patch_id", "r", "c", "class_id")


def replaced_small(spark, folder):
    return cleaning.per_patch(_masks(spark, folder), cleaning.replace_small(3)).select("patch_id", "r", "c", "class_id")


def closed_masks(spark, folder):
    return cleaning.per_patch(_masks(spark, folder), cleaning.square_pass("open"), cleaning.square_pass("close")).select("patch_id", "r", "c", "class_id")


def _near(source: str, flag: str, offsets, every: bool, outside: str) -> str:
    """SQL of a mask column over offsets: all of them (erosion) or any (dilation)."""
    n = len(offsets)
    values = ", ".join(f"({i}, {j})" for i, j in offsets)
    count = f"(SELECT count(*) FROM (VALUES {values}) o(i, j) LEFT JOIN {source} n ON n.patch_id = m.patch_id AND n.r = m.r + o.i AND n.c = m.c + o.j WHERE coalesce(n.{flag}, {outside}))"
    return f"{count} = {n}" if every else f"{count} > 0"


_PLUS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
_DISC = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) < 2 or j == 0]


def _opened_sql() -> str:
    parts, last = [f"{_CELLS}, g0 AS (SELECT patch_id, r, c, {_BUCKET.format('v0')} AS class_id FROM cells)"], "g0"
    for k in range(4):
        parts.append(f"m{k}a AS MATERIALIZED (SELECT patch_id, r, c, class_id, class_id = {k} AS f FROM {last})")
        for step, before, offsets, every, outside in (("b", "a", _PLUS, True, "true"), ("c", "b", _PLUS, False, "false"), ("d", "c", _DISC, False, "false"), ("e", "d", _DISC, True, "true")):
            parts.append(f"m{k}{step} AS MATERIALIZED (SELECT patch_id, r, c, class_id, {_near(f'm{k}{before}', 'f', offsets, every, outside)} AS f FROM m{k}{before} m)")
        last = f"g{k + 1}"
        parts.append(f"{last} AS MATERIALIZED (SELECT patch_id, r, c, CASE WHEN f THEN {k} WHEN class_id = {k} THEN 0 ELSE class_id END AS class_id FROM m{k}e)")
    return ",\n".join(parts) + f" SELECT patch_id, r::INT AS r, c::INT AS c, class_id FROM {last}"


_FOUR = f"""{_MASKS.replace('WITH', 'WITH RECURSIVE', 1)},
reach(patch_id, class_id, r, c, k) AS (SELECT patch_id, class_id, r, c, r * 8 + c FROM masks
  UNION SELECT m.patch_id, m.class_id, m.r, m.c, k FROM reach x JOIN masks m ON m.patch_id = x.patch_id AND m.class_id = x.class_id AND abs(m.r - x.r) + abs(m.c - x.c) = 1),
part AS (SELECT patch_id, class_id, r, c, min(k) AS region FROM reach GROUP BY ALL),
sized AS (SELECT *, count(*) OVER (PARTITION BY patch_id, class_id, region) AS area FROM part)"""


def _outside_sql(classes: str) -> str:
    """Cells that are not of a class, by the part (4-connected) they lie in, and whether it touches the border."""
    return f"""{_MASKS.replace('WITH', 'WITH RECURSIVE', 1)},
kinds AS (SELECT k FROM {classes} t(k)),
rest AS (SELECT patch_id, k, r, c FROM masks, kinds WHERE class_id <> k AND EXISTS (SELECT 1 FROM masks o WHERE o.patch_id = masks.patch_id AND o.class_id = k)),
reach(patch_id, k, r, c, first) AS (SELECT patch_id, k, r, c, r * 8 + c FROM rest
  UNION SELECT m.patch_id, m.k, m.r, m.c, first FROM reach x JOIN rest m ON m.patch_id = x.patch_id AND m.k = x.k AND abs(m.r - x.r) + abs(m.c - x.c) = 1),
part AS (SELECT patch_id, k, r, c, min(first) AS region FROM reach GROUP BY ALL),
holes AS (SELECT *, count(*) OVER w AS area, bool_or(r IN (0, 7) OR c IN (0, 7)) OVER w AS open FROM part WINDOW w AS (PARTITION BY patch_id, k, region))"""


# Pictures

def coloured_masks(spark, folder):
    """Palette with a colour of the user's, over pictures, uncertain cells in red, and maps of each class."""
    cells = views.patch_cells(spark, folder).select("patch_id", "r", "c", *[(F.abs(v) * F.when(F.col("patch_id") % 2 == 0, 255).otherwise(1)).alias(v) for v in FIRST])
    cells = overlays.background(cells, FIRST, "patch_id").drop(*FIRST).join(_masks(spark, folder), ["patch_id", "r", "c"])
    cells = overlays.coloured(cells, overlays.palette(("background", "water", "sand", "forest"), {"sand": (0.1, 0.2, 0.3)}))
    return _rounded(overlays.binary_maps(overlays.confidence_overlay(overlays.overlay(cells, 0.4), 0.3, 0.5), 4, 0.3).drop("bg_red", "bg_green", "bg_blue"))


def stretched_patches(spark, folder):
    return overlays.percentile_stretch(views.patch_cells(spark, folder).select("patch_id", "r", "c", *FIRST), FIRST, "patch_id")


def minmax_patches(spark, folder):
    return overlays.minmax_stretch(views.patch_cells(spark, folder).select("patch_id", "r", "c", *FIRST), FIRST, "patch_id")


# Logs of training

def best_epochs(spark, folder):
    return _rounded(epochs.best_epochs(views.epoch_log(spark, folder)))


def best_epoch_flags(spark, folder):
    return epochs.best_flags(views.epoch_log(spark, folder)).select("run_id", "epoch", "is_best")


def early_stops(spark, folder):
    return epochs.early_stops(views.epoch_log(spark, folder), patience=6, min_delta=0.5)


def weighted_losses(spark, folder):
    log = views.epoch_log(spark, folder).withColumn("epoch", F.floor((F.col("epoch") - 1) / 10))
    return _rounded(epochs.weighted_losses(log))


_LOG = "WITH RECURSIVE log AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value - 2 AS val_loss, value AS loss, event_id % 7 + 1 AS size FROM events)"


# Analytics

def changed_cells(spark, folder):
    keys = ("sample_id", "r", "c")
    pairs = views.pred_truth(spark, folder)
    return analytics.change_map(pairs.select(*keys, F.col("truth").alias("class_id")), pairs.select(*keys, F.col("pred").alias("class_id")), keys)


def basin_difference(spark, folder):
    means = analytics.mean_fractions(_sample_metrics(spark, folder).where("class_id < 5 OR basin_id <> 'ASIA'"), "basin_id").withColumnRenamed("mean_fraction", "fraction")
    return _rounded(analytics.class_difference(means.where("basin_id = 'ASIA'"), means.where("basin_id = 'EUROPE'")))


def class_means(spark, folder):
    return _rounded(analytics.mean_fractions(_sample_metrics(spark, folder)))


def first_samples(spark, folder):
    return analytics.first_samples(views.samples(spark, folder), 25).select("sample_id", "acq_date", "class_id")


def _sample_rows(spark, folder):
    cells = _masks(spark, folder)
    labelled = _labelled(spark, folder)
    shapes = regions.region_metrics(labelled, regions.regions(labelled, "patch_id"), "patch_id")
    return analytics.sample_rows(classify.shares(cells, "patch_id"), shapes, analytics.uncertainty(cells, "patch_id"), labels.CLASS_NAMES, "patch_id")


def sample_analysis(spark, folder):
    return _rounded(_sample_rows(spark, folder))


def analysis_summary(spark, folder):
    return _rounded(analytics.dataset_row(_sample_rows(spark, folder), ("water", "sand", "vegetation")))


def class_shares(spark, folder):
    return _rounded(classify.shares(_masks(spark, folder), "patch_id"))


def region_widths(spark, folder):
    labelled = _labelled(spark, folder)
    return _rounded(regions.region_metrics(labelled, regions.regions(labelled, "patch_id"), "patch_id").select("patch_id", "class_id", "width_px"))


def ranked_regions(spark, folder):
    found = regions.ranked(regions.regions(_labelled(spark, folder), "patch_id", least=1), "patch_id")
    return found.select("patch_id", "class_id", "rank", "area_px")


def stacked_fractions(spark, folder):
    return _rounded(augment.stacked(classify.shares(_masks(spark, folder), "patch_id").select("patch_id", "class_id", "fraction"), "patch_id"))


def seasonal_chart(spark, folder):
    wide = figures.seasonal_chart(analytics.seasonal(_sample_metrics(spark, folder)), range(1, 7))
    return _rounded(wide.select("season", *[F.col(f"`{k}_{x}`").alias(f"{x}_{k}") for k in range(1, 7) for x in ("mean", "std")]))


def side_by_side(spark, folder):
    return figures.side_by_side(views.pred_truth(spark, folder), value="pred")


def class_frequencies(spark, folder):
    return _rounded(metrics.frequencies(metrics.confusion(views.pred_truth(spark, folder), 4)))


def split_metrics(spark, folder):
    """Metrics of each split, with one of the user's."""
    rows = views.table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") < 7, "train").otherwise("test").alias("split"))
    own = {"worst_recall": lambda: F.min("recall")}
    return _rounded(metrics.evaluate(views.pred_truth(spark, folder), rows, 4, names=("pixel_accuracy", "mean_pixel_accuracy", "mean_iou", "worst_recall", "unknown"), extra=own))


def combined_losses(spark, folder):
    cells = views.patch_cells(spark, folder).select("patch_id", "r", "c", F.array(*[F.col(f"v{k}") * 10 for k in range(4)]).alias("logits"))
    truth = views.pred_truth(spark, folder).select(F.col("sample_id").alias("patch_id"), "r", "c", "truth")
    return _rounded(losses.combined(cells.join(truth, ["patch_id", "r", "c"]), "patch_id", share=0.7, weights=(1, 2, 3, 4), smoothing=0.1))


# Reports and manifests

def report_sections(spark, folder):
    pairs = views.pred_truth(spark, folder)
    scores = metrics.overall(metrics.confusion(pairs, 4), names=("pixel_accuracy", "mean_iou", "kappa"))
    return reports.sections(evaluation=scores, inference=analytics.mean_of_means(pairs), morphology=analytics.dataset_row(_sample_rows(spark, folder), ("water", "sand")))


def _registry(spark, folder):
    pages = views.table(spark, folder, "pages")
    paths = pages.select(F.when(F.length("url") % 2 == 0, "figure").otherwise("prediction").alias("artifact_type"), F.col("url").alias("path"), F.col("page_id").alias("ordinal"))
    return reports.artifacts(paths, pages.where(F.length("html") > 1000).select(F.col("url").alias("path"), F.length("html").alias("length")), "run1")


def artifact_registry(spark, folder):
    return _registry(spark, folder)


def artifact_totals(spark, folder):
    return reports.artifact_totals(_registry(spark, folder))


def _patch_manifest(spark, folder):
    o = views.table(spark, folder, "orders")
    k = lambda m: (F.col("o_orderkey") % m).cast("int")
    return o.select(
        F.format_string("s%d_r%03d_c%03d", "o_custkey", k(9), k(7)).alias("patch_id"), F.concat(F.lit("s"), "o_custkey").alias("scene_id"), F.lit("a.tif").alias("source_image_path"), F.concat(F.lit("p/"), "o_orderkey").alias("patch_path"),
        k(9).alias("row_index"), k(7).alias("col_index"), (k(9) * 64).alias("row_off"), (k(7) * 64).alias("col_off"), F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(11).alias("num_bands"), F.lit("EPSG:4326").alias("crs"),
        (k(101) / 100).alias("valid_pixel_ratio"), (F.col("o_orderkey") * 10).alias("file_size_bytes"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
    )


def manifest_csv(spark, folder):
    path = manifests.scratch(spark, "manifest-csv")
    manifests.write_csv(_patch_manifest(spark, folder), path)
    return manifests.read_csv(spark, path, "patch")


def manifest_json(spark, folder):
    path = manifests.scratch(spark, "manifest-json")
    manifests.write_json(_patch_manifest(spark, folder), path)
    return manifests.read_json(spark, path, "patch")


def label_manifest_defaults(spark, folder):
    """A label manifest of an older version: without its last field, and with booleans in capitals."""
    path = manifests.scratch(spark, "manifest-label")
    fields = [f.split(" ") for f in manifests.LABEL.split(", ")][:-1]
    own = {"patch_id": F.col("o_orderkey").cast("string"), "is_valid": F.when(F.col("o_orderkey") % 2 == 0, "TRUE").otherwise("False"), "confidence": F.lit(0.5), "season": F.lit("winter")}
    rows = views.table(spark, folder, "orders").select(*[own.get(n, F.lit(1) if kind in ("int", "double") else F.lit("x")).alias(n) for n, kind in fields])
    manifests.write_csv(rows, path)
    return manifests.read_csv(spark, path, "label").select("patch_id", "is_valid", "confidence", "season", "year", "generation_strategy")


def split_manifests(spark, folder):
    path = manifests.scratch(spark, "manifest-split")
    rows = dataset.split(views.samples(spark, folder), "temporal").where("split <> 'validation'").select("sample_id", "scene_id", "split")
    manifests.write_by_split(rows, path)
    return spark.read.option("header", True).schema("sample_id long, scene_id long, split string").csv(f"{path}/by_split")


def appended_manifest(spark, folder):
    """Three batches of which the later ones repeat ids; each id stays as it came first."""
    path = manifests.scratch(spark, "manifest-append")
    rows = views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("patch_id"), F.month("o_orderdate").alias("month"))
    log = commitlog.ManifestLog(spark, path, "patch_id")
    for low, high in ((1, 6), (4, 9), (7, 12)):
        log.append_new(rows.where(F.col("month").between(low, high)))
    return log.snapshot().groupBy("month").agg(F.count("*").alias("n"))


def label_masks(spark, folder):
    path = manifests.scratch(spark, "masks")
    cells = _masks(spark, folder).select((F.col("patch_id") % 20).alias("scene_id"), "r", "c", F.when(F.col("confidence") > 0.05, F.col("class_id")).alias("class_id"))
    manifests.write_labels(cells, path, "scene_id")
    return spark.read.parquet(path).groupBy("scene_id", "class_id").agg(F.count("*").alias("n")).select(F.col("scene_id").cast("long").alias("scene_id"), F.col("class_id").cast("int").alias("class_id"), "n")


def prediction_product(spark, folder):
    cells = views.patch_cells(spark, folder).select(F.col("patch_id").alias("sample_id"), "r", "c", probability.softmax(F.array(*[F.col(f"v{k}") * 10 for k in range(2)])).alias("probs"))
    cells = cells.withColumns({"pred": probability.winner(F.col("probs")), "confidence": probability.largest(F.col("probs"))})
    return _rounded(manifests.product(cells, views.table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), "label"), ("water", "other")))


def clashing_ids(spark, folder):
    return manifests.clashing_ids(views.table(spark, folder, "customer").select(F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "/").otherwise(":"), F.col("c_nationkey")).alias("sample_id")))


def evaluation_report(spark, folder):
    path = manifests.scratch(spark, "report")
    matrix = metrics.confusion(views.pred_truth(spark, folder), 4)
    manifests.write_report(metrics.overall(matrix, names=("pixel_accuracy", "kappa")), metrics.per_class(matrix), path)
    classes = spark.read.option("header", True).schema("class_id int, tp long, fp long, fn long, tn long, support long, total long, precision double, recall double, f1 double, iou double").csv(f"{path}/classes")
    return classes.crossJoin(spark.read.schema("pixel_accuracy double, kappa double").json(f"{path}/metrics"))  # one row


def statistics_files(spark, folder):
    """Band statistics written as one JSON document and read back."""
    path = manifests.scratch(spark, "statistics")
    found = _rounded(dataset.band_statistics(views.observations(spark, folder), spectral.OPTICAL))
    arrays = found.agg(F.array_sort(F.collect_list(F.struct("band", "mean", "std", "least", "most"))).alias("x"))
    arrays.select(F.col("x.band").alias("band_names"), F.col("x.mean").alias("mean"), F.col("x.std").alias("std"), F.col("x.least").alias("min"), F.col("x.most").alias("max")).coalesce(1).write.json(path)
    return manifests.read_statistics(spark, path)


# Streams

#: Micro-batches of a stream, at least.
BATCHES = 4


def _stream(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table (or ``columns`` of it) as a stream of several micro-batches; a table of few files is dealt out to new ones first, more of them where it is larger."""
    path, rows = f"{folder}/{name}.parquet", views.table(spark, folder, name).select(*(columns or ["*"]))
    n_files = len(rows.inputFiles())
    if n_files < BATCHES:
        path, n_files = manifests.scratch(spark, "arriving"), BATCHES * rows.rdd.getNumPartitions()
        rows.repartition(n_files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-n_files // BATCHES)).parquet(path)


def stream_confusion(spark, folder):
    pairs = _stream(spark, folder, "labels").select(F.col("quality").cast("int").alias("truth"), F.col("toxic").cast("int").alias("pred"))
    return running.run_once(running.running_confusion(pairs, 2), manifests.scratch(spark, "stream"), "complete")


def stream_moments(spark, folder):
    return _rounded(running.run_once(running.running_moments(_stream(spark, folder, "events"), "value", "event_type"), manifests.scratch(spark, "stream"), "complete"))


def stream_labels(spark, folder):
    rows = _stream(spark, folder, "orders").select(calendar.season(F.month("o_orderdate")).alias("season"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 100000).alias("mask_ok"))
    return running.run_once(running.running_labels(rows), manifests.scratch(spark, "stream"), "complete")


def stream_new_patches(spark, folder):
    ids = _stream(spark, folder, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("patch_id"))
    return running.run_once(running.new_patches(ids), manifests.scratch(spark, "stream"), "append")


def stream_areas(spark, folder):
    rows = _stream(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    found = running.run_once(running.area_series(rows, "at", "event_type", every="5 days", late="400 days"), manifests.scratch(spark, "stream"), "complete")
    return _rounded(found.select(F.date_format("span.start", "yyyy-MM-dd").alias("start"), "event_type", "n", "total"), 4)


def stream_change(spark, folder):
    """Change per event type and user group against the day before, as days arrive; every file holds rows of all days."""
    rows = _stream(spark, folder, "events").select("event_type", (F.col("user_id") % 5).alias("aoi"), F.col("ts").cast("timestamp").cast("date").alias("acq_date"), F.floor("value").cast("long").alias("pixels"))
    with change.rocks(spark):
        return running.run_once(change.running_change(rows, "event_type", "aoi", late="400 days"), manifests.scratch(spark, "stream"), "update", lambda out: change.newest(out, "event_type", "aoi"))


_SAMPLE_ROWS = f"""{_REGIONS},
shares AS (SELECT patch_id, count(*) AS total_pixels, {', '.join(f'avg((class_id = {k})::INT) AS fraction_{v}' for k, v in labels.CLASS_NAMES.items())}, avg(confidence) AS mean_confidence FROM masks GROUP BY patch_id),
big AS (SELECT patch_id, count(*) AS n_regions, max(area_px) AS largest_px FROM regions WHERE area_px >= 4 GROUP BY patch_id),
analysed AS (SELECT s.patch_id, total_pixels, {', '.join(f'fraction_{v}' for v in labels.CLASS_NAMES.values())}, coalesce(n_regions, 0)::BIGINT AS n_regions, coalesce(largest_px, 0)::BIGINT AS largest_px, mean_confidence FROM shares s LEFT JOIN big USING (patch_id))"""
_PATCH_MANIFEST = """SELECT printf('s%d_r%03d_c%03d', o_custkey, o_orderkey % 9, o_orderkey % 7) AS patch_id, 's' || o_custkey AS scene_id, 'a.tif' AS source_image_path, 'p/' || o_orderkey AS patch_path,
 (o_orderkey % 9)::INT AS row_index, (o_orderkey % 7)::INT AS col_index, (o_orderkey % 9 * 64)::INT AS row_off, (o_orderkey % 7 * 64)::INT AS col_off, 64 AS height, 64 AS width, 11 AS num_bands, 'EPSG:4326' AS crs,
 (o_orderkey % 101) / 100 AS valid_pixel_ratio, o_orderkey * 10 AS file_size_bytes, strftime(o_orderdate::DATE, '%Y-%m-%d') AS created_at FROM orders"""
_CELL_OUT = "SELECT patch_id, r::INT AS r, c::INT AS c"
_ISSUES = "concat_ws(',', CASE WHEN {season} THEN 'season' END, CASE WHEN {hydro} THEN 'hydrological_year' END, CASE WHEN {confidence} THEN 'confidence' END)"

#: Query by name, with its SQL.
REGISTERED = {
    "harmonised_bands": (harmonised_bands, f"{_RAW} {_bands_sql('named')}"),
    "preprocessed_bands": (preprocessed_bands, f"{_SCALED} {_bands_sql('clean')}"),
    "harmonised_indices": (harmonised_indices, f"""{_SCALED} SELECT spacecraft_id, count(*) AS n, count((NIR - Red) / nullif(NIR + Red, 0)) AS n_clear, round(avg((NIR - Red) / nullif(NIR + Red, 0)), 6) AS NDVI, round(avg((Green - SWIR1) / nullif(Green + SWIR1, 0)), 6) AS MNDWI,
  round(avg(((SWIR1 + Red) - (NIR + Blue)) / nullif((SWIR1 + Red) + (NIR + Blue), 0)), 6) AS BSI FROM clean GROUP BY spacecraft_id"""),
    "collection_metadata": (collection_metadata, f"""{_SCENES} SELECT sensor AS collection_id, count(*) AS n_images, min(acq_date) AS first_date, max(acq_date) AS last_date, sensor AS sensors,
  CASE WHEN sensor IN ('view', 'click') THEN 'B1,B2' ELSE 'B2,B3,B4' END AS band_names, 'EPSG:' || arg_min(aoi_id, scene_id) AS crs, 30.0::DOUBLE AS scale FROM scenes GROUP BY sensor"""),
    "one_collection": (one_collection, f"{_SCENES} SELECT scene_id, acq_date, sensor, 'EPSG:' || aoi_id AS crs FROM scenes WHERE sensor = 'view'"),
    "filtered_scenes": (filtered_scenes, f"""{_SCENES} SELECT aoi_id, count(*) AS n_images, sum(scene_id)::BIGINT AS sum_ids, 'date:2024-01-05/2024-01-25;bounds;cloud:30;sensors:view,click' AS tags FROM scenes
WHERE acq_date >= '2024-01-05' AND acq_date < '2024-01-25' AND cloud_cover <= 30 AND min_lon <= 20 AND max_lon >= 5 AND min_lat <= 15 AND max_lat >= 4 AND sensor IN ('view', 'click') GROUP BY aoi_id"""),
    "operating_sensors": (operating_sensors, f"{_PERIODS} SELECT sensor, collection_id, op_start FROM periods WHERE {_IN_OPERATION}"),
    "chosen_sensors": (chosen_sensors, f"{_PERIODS} SELECT sensor, collection_id FROM periods WHERE {_IN_OPERATION} AND sensor <> 'click'"),
    "sensors_of_collections": (sensors_of_collections, f"{_PERIODS} SELECT sensor, collection_id FROM periods WHERE collection_id IN (SELECT aoi_id FROM scenes WHERE cloud_cover > 90)"),
    "merged_catalog": (merged_catalog, f"{_SCENES} SELECT aoi_id, count(*) AS n, count(*) FILTER (sensor = 'view') AS n_cover, round(avg(cloud_cover) FILTER (sensor = 'view'), 6) AS mean_cover FROM scenes WHERE sensor IN ('view', 'click', 'error') GROUP BY aoi_id"),
    "temporal_metadata": (temporal_metadata, f"""{_SAMPLES.replace('class_id,', 'class_id, (o_orderkey % 101) / 100 AS valid_ratio,')},
middle AS (SELECT sample_id, river_name, basin_id, valid_ratio, acq_date AS day, acq_date + 15 AS acq_date FROM samples)
SELECT sample_id, acq_date AS acquisition_date, year(acq_date)::INT AS year, month(acq_date)::INT AS month, {_SEASON} AS season, (year(acq_date) - CASE WHEN month(acq_date) < 6 THEN 1 ELSE 0 END)::INT AS hydrological_year, river_name || ',' || basin_id AS sensor,
 '1.0' AS label_version, 'unknown' AS annotator, round(CASE WHEN valid_ratio > 0.5 THEN valid_ratio ELSE 1.0::DOUBLE END, 6) AS confidence, 'manual' AS confidence_source,
 {_ISSUES.format(season="month(day) NOT IN (12, 1, 2)", hydro="valid_ratio < 0.1", confidence="valid_ratio * 1.5::DOUBLE > 1")} AS issues FROM middle"""),
    "patch_geometry": (patch_geometry, """WITH base AS (SELECT event_id, event_type, event_id % 50 AS row, event_id % 37 AS col, (user_id % 3 + 1) * 0.001::DOUBLE AS a, (event_id % 40)::DOUBLE AS c0, (event_id % 25)::DOUBLE AS f0 FROM events),
placed AS (SELECT *, c0 + a * (col * 64) AS c, f0 - a * (row * 64) AS f FROM base), box AS (SELECT *, c AS min_lon, c + a * 64 AS max_lon, f - a * 64 AS min_lat, f AS max_lat FROM placed)
SELECT event_id, printf('%s_r%03d_c%03d', event_type, row, col) AS patch_id, round(c, 6) AS c, round(f, 6) AS f, round(min_lon, 6) AS min_lon, round(min_lat, 6) AS min_lat, round(max_lon, 6) AS max_lon, round(max_lat, 6) AS max_lat,
 greatest(1, round_even((max_lon - min_lon) * cos(radians((min_lat + max_lat) / 2)) * 111000 / 30, 0))::INT AS width, greatest(1, round_even((max_lat - min_lat) * 111000 / 30, 0))::INT AS height,
 round_even(c / a, 0)::INT AS col_off, round_even(f / a, 0)::INT AS row_off FROM box"""),
    "generated_labels": (generated_labels, f"""{_COVER},
classed AS (SELECT patch_id, greatest(cw, cs, cv, 0.1::DOUBLE) AS confidence, CASE WHEN cw >= greatest(cs, cv, 0.1) THEN 1 WHEN cs >= greatest(cv, 0.1) THEN 2 WHEN cv >= 0.1 THEN 3 ELSE 0 END AS class_id FROM won),
q AS (SELECT patch_id, 1.0::DOUBLE AS valid_ratio, 0.0::DOUBLE AS open_ratio, {' + '.join(f'(count(*) FILTER (class_id = {k}) >= 5)::INT' for k in range(4))} AS n_classes, round(avg(confidence), 4) AS mask_confidence FROM classed GROUP BY patch_id),
s AS (SELECT *, {_SCORE} AS score, CASE WHEN n_classes = 0 THEN 'no class covers enough pixels' ELSE '' END AS issues FROM q)
SELECT patch_id, valid_ratio, open_ratio, n_classes, score, issues, issues = '' AND score >= 0.5 AND mask_confidence >= 0.3 AS acceptable, mask_confidence FROM s"""),
    "rule_agreement": (rule_agreement, f"""{_COVER},
classed AS (SELECT patch_id, greatest(cw, cs, cv, cx, 0.1::DOUBLE) AS confidence, cw >= greatest(cs, cv, cx, 0.1) OR (cx > greatest(cw, cs, cv, 0.1)) AS water FROM won)
SELECT patch_id, round(avg(water::INT), 4) AS agreement_score, round(avg(confidence), 4) AS mask_confidence FROM classed GROUP BY patch_id"""),
    "priority_classes": (priority_classes, f"""{_COVER},
classed AS (SELECT patch_id, r::INT AS r, c::INT AS c, CASE WHEN cv >= 0 THEN 3 WHEN cw >= 0 THEN 1 WHEN cs >= 0 THEN 2 ELSE 0 END AS class_id, cw, cs, cv FROM won)
SELECT patch_id, r, c, class_id, round(CASE class_id WHEN 3 THEN cv WHEN 1 THEN cw WHEN 2 THEN cs ELSE 0.1::DOUBLE END, 6) AS confidence, CASE class_id WHEN 3 THEN 'vegetation' WHEN 1 THEN 'water' WHEN 2 THEN 'sand' ELSE 'background' END AS class_name FROM classed"""),
    "bright_sand": (bright_sand, f"""{_SCALED},
ix AS (SELECT spacecraft_id, (Green - SWIR1) / nullif(Green + SWIR1, 0) AS MNDWI, (Green - NIR) / nullif(Green + NIR, 0) AS NDWI, ((SWIR1 + Red) - (NIR + Blue)) / nullif((SWIR1 + Red) + (NIR + Blue), 0) AS BSI, (NIR - Red) / nullif(NIR + Red, 0) AS NDVI, (SWIR1 - NIR) / nullif(SWIR1 + NIR, 0) AS NDBI, (Blue + Green + Red + NIR) / 4 AS brightness FROM clean),
e AS (SELECT *, ({_soft('MNDWI', 0.0, 0.3, False)} * 0.3 + {_soft('BSI', 0.0, 0.3)} * 0.35 + {_soft('NDVI', 0.25, 0.3, False)} * 0.25 + {_soft('NDWI', 0.0, 0.3, False)} * 0.1 + {_soft('NDBI', 0.0, 0.3)} * 0.2 + {_soft('brightness', 0.4, 0.3)} * 0.3) / 1.5 AS s FROM ix),
w AS (SELECT *, s >= 0.3 AND NOT coalesce(MNDWI > 0, false) AND s >= 0.1 AS sand FROM e)
SELECT spacecraft_id, round(avg(sand::INT), 6) AS share, round(avg(CASE WHEN sand THEN s ELSE 0.1::DOUBLE END), 6) AS confidence, round(avg(brightness), 6) AS brightness FROM w GROUP BY spacecraft_id"""),
    "label_validity": (label_validity, f"""{_SAMPLES.replace('class_id,', 'class_id, (o_orderkey % 101) / 100 AS valid_ratio,')}
SELECT sample_id, valid_ratio >= 0.2 AND pixels <= 900 AND pixels >= 100 AS is_valid, concat_ws('; ', CASE WHEN valid_ratio < 0.2 THEN 'too much nodata' END, CASE WHEN pixels > 900 THEN 'hydrological_year' END, CASE WHEN pixels < 100 THEN 'low confidence' END) AS validation_issues FROM samples"""),
    "label_statistics": (label_statistics, f"""{_MASKS},
own AS (SELECT vec_id AS patch_id, label <> 3 AS ok, CASE WHEN label + 1 IN (3, 4, 5) THEN 'pre_monsoon' WHEN label + 1 IN (6, 7, 8, 9) THEN 'monsoon' WHEN label + 1 IN (10, 11) THEN 'post_monsoon' ELSE 'winter' END AS season, label % 4 + 2000 AS year FROM embeddings),
n AS (SELECT {', '.join(f'count(*) FILTER (class_id = {k}) AS n{k}' for k in range(4))} FROM masks WHERE patch_id IN (SELECT patch_id FROM own WHERE ok)),
told AS (SELECT 'labels' AS kind, 'total' AS name, count(*)::DOUBLE AS value FROM own UNION ALL SELECT 'labels', 'valid', count(*) FROM own WHERE ok UNION ALL SELECT 'labels', 'rejected', count(*) FROM own WHERE NOT ok
UNION ALL SELECT 'season', season, count(*) FROM own WHERE ok GROUP BY season UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM own WHERE ok GROUP BY year
{''.join(f"UNION ALL SELECT 'classes', 'pixels:{v}', n{k} FROM n UNION ALL SELECT 'classes', 'percent:{v}', n{k} * 100.0::DOUBLE / (n0 + n1 + n2 + n3) FROM n " for k, v in labels.CLASS_NAMES.items())}
UNION ALL SELECT 'classes', 'imbalance', greatest(n0, n1, n2, n3) / least(n0, n1, n2, n3) FROM n UNION ALL SELECT 'classes', 'water_sand_ratio', n1 / n2 FROM n UNION ALL SELECT 'classes', 'vegetation_sand_ratio', n3 / n2 FROM n
UNION ALL SELECT 'classes', 'bare_sediment', n2 / (n1 + n2 + n3) FROM n) SELECT kind, name, round(value, 6) AS value FROM told"""),
    "assembled_samples": (assembled_samples, """WITH last AS (SELECT l_orderkey AS patch_id, arg_max({'line': l_linenumber::BIGINT, 'tax': l_tax}, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS x FROM lineitem WHERE l_discount > 0.02 GROUP BY l_orderkey)
SELECT o_orderkey AS patch_id, o_custkey AS scene_id, x.line AS line, x.tax AS tax FROM orders JOIN last ON patch_id = o_orderkey"""),
    "unlabelled_patches": (unlabelled_patches, "SELECT o_orderkey AS patch_id, o_custkey AS scene_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.02)"),
    "duplicate_labels": (duplicate_labels, "SELECT l_orderkey AS patch_id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"),
    "split_ratios": (split_ratios, f"{_TEMPORAL} SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM dealt GROUP BY split"),
    "test_samples": (test_samples, f"{_RANDOM} SELECT sample_id, scene_id FROM dealt WHERE split = 'test'"),
    "sample_issues": (sample_issues, f"""{_SAMPLES.replace('class_id,', 'class_id, (o_orderkey % 101) / 100 AS valid_ratio,')},
files AS (SELECT 'patch/' || scene_id AS path FROM samples WHERE valid_ratio > 0.2 UNION SELECT 'mask/' || (scene_id % 89) FROM samples WHERE valid_ratio > 0.2),
found AS (SELECT scene_id, 'repeated id' AS issue FROM samples GROUP BY scene_id HAVING count(*) > 1 UNION ALL SELECT scene_id, 'too few valid pixels' FROM samples WHERE valid_ratio < 0.3
UNION ALL SELECT scene_id, 'other reference system' FROM samples WHERE river_name <> 'BUILDING' UNION ALL SELECT scene_id, 'missing patch file' FROM samples WHERE 'patch/' || scene_id NOT IN (SELECT path FROM files)
UNION ALL SELECT scene_id, 'missing mask file' FROM samples WHERE 'mask/' || (scene_id % 97) NOT IN (SELECT path FROM files)) SELECT issue, count(*) AS n, count(DISTINCT scene_id) AS n_samples FROM found GROUP BY issue"""),
    "data_quality": (data_quality, f"""{_RANDOM.replace('class_id,', 'class_id, (o_orderkey % 101) / 100 AS valid_ratio,')},
sums AS (SELECT class_id, sum(pixels) AS p FROM dealt GROUP BY class_id), i AS (SELECT max(p) / min(p) AS imbalance FROM sums WHERE p > 0),
l AS (SELECT count(*) AS leaks FROM (SELECT aoi_id FROM dealt GROUP BY aoi_id HAVING count(DISTINCT split) > 1)), v AS (SELECT avg((valid_ratio >= 0.5)::INT) AS valid, count(*) FILTER (valid_ratio < 0.5) AS n_low, avg((valid_ratio < 0.5)::INT) AS share_low FROM dealt)
SELECT n_low, round(share_low, 6) AS share_low, round(least(1, 0.4::DOUBLE * valid + CASE WHEN leaks = 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE * greatest(0, 1 - (imbalance - 1) / 20) + 0.1::DOUBLE), 4) AS score FROM v, i, l"""),
    "recommendations": (recommendations, f"""{_RANDOM},
leaks AS (SELECT aoi_id FROM dealt GROUP BY aoi_id HAVING count(DISTINCT split) > 1), sums AS (SELECT split, class_id, sum(pixels) AS p FROM dealt GROUP BY ALL)
SELECT 'ERROR' AS severity, 'leakage' AS category, 'aoi_id' AS subject, count(*)::DOUBLE AS value, 'split by scene or area' AS advice FROM leaks HAVING count(*) > 0
UNION ALL SELECT 'WARN', 'split_size', split, count(*)::DOUBLE, 'gather more samples' FROM dealt GROUP BY split HAVING count(*) < 10000
UNION ALL SELECT 'WARN', 'class_balance', split, round(max(p) / min(p), 6), 'weight classes or sample rare ones' FROM sums WHERE p > 0 AND split <> 'test' GROUP BY split HAVING max(p) > min(p)
UNION ALL SELECT 'ERROR', 'crs', string_agg(DISTINCT 'EPSG:' || basin_id, ',' ORDER BY 'EPSG:' || basin_id), count(DISTINCT basin_id)::DOUBLE, 'bring all patches to one reference system' FROM dealt HAVING count(DISTINCT basin_id) > 1"""),
    "mask_checks": (mask_checks, f"""{_MASKS}, m AS (SELECT patch_id, CASE WHEN confidence < 0.15 THEN 255 WHEN confidence > 0.6 THEN 9 ELSE class_id END AS class_id FROM masks),
q AS (SELECT patch_id, count(*) FILTER (class_id = 9)::DOUBLE AS bad, avg((class_id = 255)::INT) AS nodata, count(DISTINCT class_id) FILTER (class_id < 4)::DOUBLE AS kinds FROM m GROUP BY patch_id)
SELECT patch_id, 'invalid id' AS issue, round(bad, 6) AS value FROM q WHERE bad > 0 UNION ALL SELECT patch_id, 'too much nodata', round(nodata, 6) FROM q WHERE nodata > 0.3 UNION ALL SELECT patch_id, 'single class', kinds FROM q WHERE kinds = 1"""),
    "grid_checks": (grid_checks, "SELECT vec_id AS patch_id, CASE label WHEN 1 THEN 'other reference system' WHEN 2 THEN 'other transform' ELSE 'other size' END AS issue FROM embeddings WHERE label IN (1, 2, 4)"),
    "band_checks": (band_checks, """WITH have AS (SELECT vec_id AS raster_id, 'b' || unnest(range(label + 1)) AS band FROM embeddings), expected AS (SELECT DISTINCT band FROM have WHERE band < 'b6')
SELECT vec_id AS raster_id, band, 'missing band' AS issue FROM embeddings, expected WHERE (vec_id, band) NOT IN (SELECT raster_id, band FROM have) UNION ALL SELECT raster_id, band, 'unexpected band' FROM have WHERE band NOT IN (SELECT band FROM expected)"""),
    "prediction_checks": (prediction_checks, f"""{_MATRIX.split('matrix AS')[0].rstrip().rstrip(',')}
SELECT 'settings' AS subject, 'low confidence threshold outside 0 to 1' AS issue UNION ALL SELECT 'settings', 'negative pixel area' UNION ALL SELECT (vec_id + 1000000)::VARCHAR, 'no mask' FROM embeddings
UNION ALL SELECT DISTINCT sample_id::VARCHAR, 'confidence is not a number' FROM pairs WHERE confidence > 0.9 UNION ALL SELECT sample_id::VARCHAR, 'not finite: ' || count(*) FROM pairs WHERE confidence > 0.9 GROUP BY sample_id
UNION ALL SELECT sample_id::VARCHAR, 'id outside the classes: ' || count(*) FROM pairs WHERE confidence > 0.7 GROUP BY sample_id"""),
    "prepared_checks": (prepared_checks, "SELECT 'no training sample' AS issue, 0::BIGINT AS value UNION ALL SELECT 'other number of bands', 6 UNION ALL SELECT 'deviation not above 0', count(*) FROM (SELECT 1 FROM lineitem LIMIT 1)"),
    "band_report": (band_report, f"""{_CELLS}, long AS (SELECT patch_id, unnest(['v0', 'v1', 'v2']) AS band, unnest([v0, v1, v2]) AS x FROM cells)
SELECT patch_id, band, round(avg((abs(x) > 0.02)::INT), 6) AS valid_share, round(min(x) FILTER (abs(x) > 0.02), 6) AS least, round(max(x) FILTER (abs(x) > 0.02), 6) AS most, count(*) FILTER (NOT abs(x) > 0.02) AS n_missing FROM long GROUP BY ALL"""),
    "assembled_dataset": (assembled_dataset, f"""{_TEMPORAL.replace('class_id,', 'class_id, (o_orderkey % 101) / 100 AS valid_ratio,').replace('FROM orders JOIN', 'FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.02) ON l_orderkey = o_orderkey JOIN')},
last AS (SELECT l_orderkey, arg_max(l_linenumber, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS line FROM lineitem WHERE l_discount > 0.02 GROUP BY l_orderkey),
sums AS (SELECT line, count(*) AS n FROM dealt JOIN last ON l_orderkey = sample_id GROUP BY line), q AS (SELECT count(*) AS n, avg((valid_ratio >= 0.5)::INT) AS valid FROM dealt)
SELECT split AS name, count(*) AS n, NULL::DOUBLE AS score FROM dealt GROUP BY split UNION ALL SELECT 'too few valid pixels', count(*), NULL FROM dealt WHERE valid_ratio < 0.5
UNION ALL SELECT 'quality', n, round(least(1, 0.4::DOUBLE * valid + 0.3::DOUBLE + 0.2::DOUBLE * greatest(0, 1 - ((SELECT max(n) / min(n) FROM sums) - 1) / 20) + 0.1::DOUBLE), 4) FROM q"""),
    "split_dates": (split_dates, f"""{_RANDOM}, d AS (SELECT split, {_SEASON} AS season, year(acq_date)::VARCHAR AS year FROM dealt), x AS (SELECT split, 'season' AS kind, season AS name FROM d UNION ALL SELECT split, 'year', year FROM d)
SELECT split, kind, name, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'overall', kind, name, count(*) FROM x GROUP BY kind, name"""),
    "sampling_weights": (sampling_weights, f"""{_SAMPLES.replace('class_id,', 'class_id, (o_orderkey % 101) / 100 AS valid_ratio,')}, s AS (SELECT *, {_SEASON} AS season, 1 / least(greatest(valid_ratio, 0.01), 1) AS raw FROM samples)
SELECT sample_id, round(1 / ((SELECT count(DISTINCT season) FROM s) * count(*) OVER (PARTITION BY season)), 12) AS weight, round(raw / sum(raw) OVER (), 12) AS valid_weight FROM s"""),
    "training_rows": (training_rows, f"""{_CELLS}, x AS (SELECT patch_id, r, c, v0, CASE WHEN v1 > 0.3 THEN NULL ELSE v1 END AS v1, v2, CASE WHEN abs(v0) < 0.02 THEN -1 ELSE 1 END AS class_id FROM cells),
s AS (SELECT {', '.join(f'avg({v}) AS m{v}, stddev_samp({v}) AS s{v}' for v in FIRST)} FROM x)
SELECT patch_id AS sample_id, r::INT AS r, c::INT AS c, {', '.join(f'round(coalesce(({v} - m{v}) / s{v}, 0), 6) AS {v}' for v in FIRST)}, class_id, label AS season, round((v0 - mv0) / sv0 * 2 + 0.5, 6) AS back FROM x, s, embeddings WHERE vec_id = patch_id"""),
    "minmax_statistics": (minmax_statistics, f"""{_CELLS}, long AS (SELECT unnest(['v0', 'v1', 'v2']) AS band, unnest([v0, v1, v2]) AS x FROM cells)
SELECT band, round(quantile_cont(x, 0.02), 6) AS mean, round(quantile_cont(x, 0.98) - quantile_cont(x, 0.02), 6) AS std FROM long GROUP BY band UNION ALL SELECT unnest(['v0 none', 'v1 none', 'v2 none']), 0, 1"""),
    "moved_patches": (moved_patches, f"""{_CELLS}, f AS (SELECT patch_id, CASE WHEN patch_id % 3 = 0 THEN 7 - r ELSE r END - patch_id % 4 AS r, CASE WHEN patch_id % 2 = 0 THEN 7 - c ELSE c END - 1 AS c, v0 + 0.1::DOUBLE AS v0, v1 FROM cells),
k AS (SELECT * FROM f WHERE r BETWEEN 0 AND 4 AND c BETWEEN 0 AND 4), m AS (SELECT patch_id, sum(v0 + v1) / (2 * count(*)) AS mean FROM k GROUP BY patch_id)
SELECT patch_id, r::INT AS r, c::INT AS c, round((v0 - mean) * 1.5::DOUBLE + mean, 6) AS v0, round((v1 - mean) * 1.5::DOUBLE + mean, 6) AS v1 FROM k JOIN m USING (patch_id)"""),
    "user_step_masks": (user_step_masks, f"{_MASKS} {_CELL_OUT}, CASE class_id WHEN 3 THEN 0 ELSE class_id END AS class_id FROM masks"),
    "user_confidence": (user_confidence, f"""{_CELLS}, p AS (SELECT patch_id, r, c, list_sort([1 / (1 + exp(-v0 * 10)), 1 / (1 + exp(-v1 * 10)), 1 / (1 + exp(-v2 * 10)), 1 / (1 + exp(-v3 * 10))]) AS p FROM cells)
SELECT patch_id, r::INT AS r, c::INT AS c, round(p[4] - p[3], 6) AS margin, round(p[4], 6) AS most FROM p"""),
    "window_grid": (window_grid, """WITH rasters AS (SELECT s_suppkey AS raster_id, (s_suppkey % 41 + 8)::INT AS width, (s_suppkey % 29 + 6)::INT AS height FROM supplier),
plain AS (SELECT *, false AS flush, CASE WHEN height >= 16 THEN range(0, height - 15, 8) ELSE [] END AS rows, CASE WHEN width >= 16 THEN range(0, width - 15, 8) ELSE [] END AS cols FROM rasters),
every AS (SELECT * FROM plain UNION ALL SELECT raster_id, width, height, true, list_sort(list_distinct(list_append(rows, greatest(height - 16, 0)))), list_sort(list_distinct(list_append(cols, greatest(width - 16, 0)))) FROM plain),
r AS (SELECT *, unnest(range(len(rows))) AS i FROM every), k AS (SELECT *, unnest(range(len(cols))) AS j FROM r)
SELECT raster_id, width, height, flush, i::INT AS row_index, rows[i + 1]::INT AS row_off, j::INT AS col_index, cols[j + 1]::INT AS col_off FROM k"""),
    "cut_patches": (cut_patches, f"""{_CELLS}, w AS (SELECT patch_id AS scene_id, a.k AS i, b.k AS j, avg((abs(v0) > 0.04)::INT) AS ratio FROM cells JOIN range(3) a(k) ON r BETWEEN a.k * 2 AND a.k * 2 + 3 JOIN range(3) b(k) ON c BETWEEN b.k * 2 AND b.k * 2 + 3 GROUP BY ALL)
SELECT printf('%d_r%03d_c%03d', scene_id, i, j) AS patch_id, scene_id, i::INT AS row_index, j::INT AS col_index, (i * 2)::INT AS row_off, (j * 2)::INT AS col_off, round(ratio, 6) AS valid_ratio, ratio >= 0.8 AS is_valid FROM w"""),
    "cut_counts": (cut_counts, f"""{_CELLS}, w AS (SELECT patch_id AS scene_id, a.k AS i, b.k AS j, avg((abs(v0) > 0.04)::INT) AS ratio FROM cells JOIN range(3) a(k) ON r BETWEEN a.k * 2 AND a.k * 2 + 3 JOIN range(3) b(k) ON c BETWEEN b.k * 2 AND b.k * 2 + 3 GROUP BY ALL)
SELECT scene_id, count(*) AS total, count(*) FILTER (ratio >= 0.8) AS generated, count(*) FILTER (ratio < 0.8) AS skipped FROM w GROUP BY scene_id"""),
    "predicted_scenes": (predicted_scenes, f"""{_CELLS}, w(i, o) AS (VALUES (0, 0), (1, 3), (2, 4)),
t AS (SELECT patch_id AS scene_id, r AS row, c AS col, a.i AS i, b.i AS j, [v0, v1 + a.i * 0.05::DOUBLE, v2 - b.i * 0.05::DOUBLE] AS p FROM cells JOIN w a ON r BETWEEN a.o AND a.o + 3 JOIN w b ON c BETWEEN b.o AND b.o + 3)
SELECT scene_id, row::INT AS row, col::INT AS col, arg_max(list_position(p, list_max(p)) - 1, (i, j))::INT AS class_id FROM t GROUP BY ALL"""),
    "padded_tiles": (padded_tiles, f"{_CELLS} SELECT patch_id, r::INT AS r, c::INT AS c, round(CASE WHEN r < 3 AND c < 7 THEN v0 ELSE 0 END, 6) AS v0 FROM cells"),
    "named_values": (named_values, f"{_CELLS} SELECT patch_id, (r * 8 + c)::INT AS band_index, CASE WHEN r > 3 THEN 'B' || c ELSE 'band_' || (r * 8 + c) END AS band, round(CASE WHEN v0 <= 0.3 THEN v0 END, 6) AS value FROM cells"),
    "overviews": (overviews, f"{_OBS} SELECT aoi_id, row // 4 AS row, col // 4 AS col, {', '.join(f'round(avg({b}), 6) AS {b}' for b in spectral.OPTICAL)} FROM obs GROUP BY aoi_id, row // 4, col // 4"),
    "area_tiles": (area_tiles, """WITH a AS (SELECT s_suppkey AS area_id, s_suppkey % 90 + 10 AS w, s_suppkey % 70 + 5 AS h, (s_suppkey % 30)::DOUBLE AS x0, (s_suppkey % 20)::DOUBLE AS y0 FROM supplier),
n AS (SELECT *, CASE WHEN w * h <= 900 THEN 1 ELSE ceil(h / 30)::INT END AS nr, CASE WHEN w * h <= 900 THEN 1 ELSE ceil(w / 30)::INT END AS nc FROM a), r AS (SELECT *, unnest(range(nr)) AS i FROM n), c AS (SELECT *, unnest(range(nc)) AS j FROM r)
SELECT area_id, i::INT AS tile_row, j::INT AS tile_col, round(x0 + j * (2 / nc), 6) AS tile_min_lon, round(least(x0 + 2, x0 + (j + 1) * (2 / nc)), 6) AS tile_max_lon, round(y0 + i * (1 / nr), 6) AS tile_min_lat, round(least(y0 + 1, y0 + (i + 1) * (1 / nr)), 6) AS tile_max_lat FROM c"""),
    "opened_masks": (opened_masks, _opened_sql()),
    "without_small_objects": (without_small_objects, f"{_FOUR} {_CELL_OUT}, CASE WHEN area < 3 THEN 0 ELSE class_id END AS class_id FROM sized"),
    "filled_small_holes": (filled_small_holes, f"{_outside_sql('(VALUES (2))')} {_CELL_OUT}, CASE WHEN EXISTS (SELECT 1 FROM holes h WHERE h.patch_id = masks.patch_id AND h.r = masks.r AND h.c = masks.c AND NOT open AND area < 3) THEN 2 ELSE class_id END AS class_id FROM masks"),
    "filled_holes": (filled_holes, f"{_outside_sql('range(4)')}, most AS (SELECT patch_id, r, c, max(k)::INT AS k FROM holes WHERE NOT open GROUP BY ALL) {_CELL_OUT}, coalesce(k, class_id) AS class_id FROM masks LEFT JOIN most USING (patch_id, r, c)"),
    "replaced_small": (replaced_small, f"""{_FOUR},
near AS (SELECT DISTINCT s.patch_id, s.class_id, s.region, m.r, m.c, m.class_id AS other FROM sized s JOIN masks m ON m.patch_id = s.patch_id AND abs(m.r - s.r) + abs(m.c - s.c) <= 2 AND m.class_id <> s.class_id WHERE s.area < 3),
votes AS (SELECT patch_id, class_id, region, other, count(*) AS n FROM near GROUP BY ALL), best AS (SELECT patch_id, class_id, region, arg_max(other, (n, -other)) AS other FROM votes GROUP BY ALL)
SELECT s.patch_id, s.r::INT AS r, s.c::INT AS c, coalesce(other, s.class_id) AS class_id FROM sized s LEFT JOIN best b ON b.patch_id = s.patch_id AND b.class_id = s.class_id AND b.region = s.region AND s.area < 3"""),
    "closed_masks": (closed_masks, f"""{_MASKS}, wide AS (SELECT DISTINCT m.patch_id, n.class_id AS k, m.r, m.c FROM masks m JOIN masks n ON n.patch_id = m.patch_id AND abs(n.r - m.r) <= 1 AND abs(n.c - m.c) <= 1),
shut AS (SELECT w.patch_id, w.k, w.r, w.c FROM wide w JOIN wide o ON o.patch_id = w.patch_id AND o.k = w.k AND abs(o.r - w.r) <= 1 AND abs(o.c - w.c) <= 1 GROUP BY ALL HAVING count(*) = 9), last AS (SELECT patch_id, r, c, max(k) AS k FROM shut GROUP BY ALL)
{_CELL_OUT}, coalesce(k, class_id) AS class_id FROM masks LEFT JOIN last USING (patch_id, r, c)"""),
    "coloured_masks": (coloured_masks, f"""{_MASKS}, b AS (SELECT patch_id, r, c, v0, v1, v2, abs(v0) * s AS b0, abs(v1) * s AS b1, abs(v2) * s AS b2, max(greatest(abs(v0), abs(v1), abs(v2)) * s) OVER (PARTITION BY patch_id) AS most FROM (SELECT *, CASE WHEN patch_id % 2 = 0 THEN 255 ELSE 1 END AS s FROM cells)),
bg AS (SELECT patch_id, r, c, {', '.join(f'least(greatest(b{k} / CASE WHEN most > 1 THEN 255.0::DOUBLE ELSE 1 END, 0), 1) AS g{k}' for k in range(3))} FROM b),
o AS (SELECT m.*, {', '.join(f'least(greatest(g{k} * 0.6::DOUBLE + (CASE class_id WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN {(0.13, 0.47, 0.71)[k]}::DOUBLE WHEN 2 THEN {(0.1, 0.2, 0.3)[k]}::DOUBLE ELSE {(0.89, 0.47, 0.76)[k]}::DOUBLE END) * 0.4::DOUBLE, 0), 1) AS o{k}' for k in range(3))} FROM masks m JOIN bg USING (patch_id, r, c))
SELECT patch_id, r::INT AS r, c::INT AS c, class_id, round(confidence, 6) AS confidence, {', '.join(f'round(CASE WHEN confidence < 0.3 THEN o{k} * 0.5::DOUBLE + {(0.9, 0.1, 0.1)[k]}::DOUBLE * 0.5::DOUBLE ELSE o{k} END, 6) AS {n}' for k, n in enumerate(overlays.CHANNELS))},
 (confidence < 0.3)::INT AS is_unsure, {', '.join(f'(class_id = {k})::INT AS is_{k}' for k in range(4))} FROM o"""),
    "stretched_patches": (stretched_patches, f"""{_CELLS}, e AS (SELECT patch_id, {', '.join(f'quantile_cont({v}, 0.02) AS l{v}, quantile_cont({v}, 0.98) AS h{v}' for v in FIRST)} FROM cells GROUP BY patch_id)
SELECT patch_id, r::INT AS r, c::INT AS c, {', '.join(f'floor(least(greatest(({v} - l{v}) / CASE WHEN h{v} <= l{v} THEN 1 ELSE h{v} - l{v} END, 0), 1) * 255)::INT AS {v}' for v in FIRST)} FROM cells JOIN e USING (patch_id)"""),
    "minmax_patches": (minmax_patches, f"""{_CELLS}, e AS (SELECT patch_id, min(least(v0, v1, v2)) AS l, max(greatest(v0, v1, v2)) AS h FROM cells GROUP BY patch_id)
SELECT patch_id, r::INT AS r, c::INT AS c, {', '.join(f'floor(({v} - l) / (h - l) * 255)::INT AS {v}' for v in FIRST)} FROM cells JOIN e USING (patch_id)"""),
    "best_epochs": (best_epochs, f"{_LOG}, k AS (SELECT *, CASE WHEN val_loss > 0 THEN val_loss ELSE 'infinity'::DOUBLE END AS v FROM log) SELECT run_id, arg_min(epoch, (v, epoch)) AS best_epoch, round(min(v), 6) AS best_loss FROM k GROUP BY run_id"),
    "best_epoch_flags": (best_epoch_flags, f"{_LOG} SELECT run_id, epoch, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM log"),
    "early_stops": (early_stops, f"""{_LOG},
fold(run_id, epoch, best, waited, stopped) AS (SELECT run_id, 0::BIGINT, 'infinity'::DOUBLE, 0, NULL::BIGINT FROM (SELECT DISTINCT run_id FROM log)
  UNION ALL SELECT l.run_id, l.epoch, CASE WHEN val_loss < best - 0.5 THEN val_loss ELSE best END, CASE WHEN val_loss < best - 0.5 THEN 0 ELSE waited + 1 END,
   CASE WHEN stopped IS NOT NULL THEN stopped WHEN NOT val_loss < best - 0.5 AND waited + 1 >= 6 THEN l.epoch END FROM fold f JOIN log l ON l.run_id = f.run_id AND l.epoch = f.epoch + 1)
SELECT run_id, min(stopped) AS stopped_at FROM fold GROUP BY run_id"""),
    "weighted_losses": (weighted_losses, f"{_LOG} SELECT run_id, (epoch - 1) // 10 AS epoch, round(sum(loss * size) / sum(size), 6) AS mean_loss FROM log GROUP BY run_id, (epoch - 1) // 10"),
    "changed_cells": (changed_cells, f"{_MATRIX} SELECT p.sample_id, c.r::INT AS r, c.c::INT AS c, {_BUCKET.format('v1')} AS before, {_BUCKET.format('v0')} AS after, {_BUCKET.format('v1')} <> {_BUCKET.format('v0')} AS changed FROM cells c JOIN (SELECT DISTINCT sample_id FROM pairs) p ON p.sample_id = c.patch_id"),
    "basin_difference": (basin_difference, f"""{_SAMPLES}, m AS (SELECT basin_id, class_id, avg(fraction) AS f FROM samples WHERE class_id < 5 OR basin_id <> 'ASIA' GROUP BY ALL)
SELECT class_id, round(coalesce(e.f, 0) - coalesce(a.f, 0), 6) AS difference FROM (SELECT * FROM m WHERE basin_id = 'ASIA') a FULL JOIN (SELECT * FROM m WHERE basin_id = 'EUROPE') e USING (class_id)"""),
    "class_means": (class_means, f"{_SAMPLES} SELECT class_id, round(avg(fraction), 6) AS mean_fraction FROM samples GROUP BY class_id"),
    "first_samples": (first_samples, f"{_SAMPLES} SELECT sample_id, acq_date, class_id FROM samples ORDER BY acq_date, sample_id LIMIT 25"),
    "sample_analysis": (sample_analysis, f"{_SAMPLE_ROWS} SELECT patch_id, total_pixels, {', '.join(f'round(fraction_{v}, 6) AS fraction_{v}' for v in labels.CLASS_NAMES.values())}, n_regions, largest_px, round(mean_confidence, 6) AS mean_confidence FROM analysed"),
    "analysis_summary": (analysis_summary, f"{_SAMPLE_ROWS} SELECT count(*) AS n_samples, sum(total_pixels)::BIGINT AS total_pixels, {', '.join(f'round(avg(fraction_{v}), 6) AS mean_{v}' for v in ('water', 'sand', 'vegetation'))}, round(avg(mean_confidence), 6) AS mean_confidence FROM analysed"),
    "class_shares": (class_shares, f"""{_MASKS} SELECT p.patch_id, k::INT AS class_id, count(m.class_id) AS pixels, round(count(m.class_id) / 64, 6) AS fraction, round(count(m.class_id) * 900.0::DOUBLE, 6) AS area_m2, round(coalesce(avg(m.confidence), 0), 6) AS mean_confidence,
 count(*) FILTER (m.confidence < 0.5) AS low_pixels, round(coalesce(sum(m.confidence), 0) * 900, 6) AS weighted_area_m2 FROM (SELECT DISTINCT patch_id FROM masks) p CROSS JOIN range(4) g(k) LEFT JOIN masks m ON m.patch_id = p.patch_id AND m.class_id = k GROUP BY p.patch_id, k"""),
    "region_widths": (region_widths, f"""{_REGIONS}, best AS (SELECT patch_id, class_id, arg_max(row_width, (area_px, -region)) AS width FROM regions WHERE area_px >= 4 GROUP BY ALL)
SELECT p.patch_id, p.class_id, round(coalesce(width, 0), 6) AS width_px FROM (SELECT DISTINCT patch_id, class_id FROM labelled) p LEFT JOIN best USING (patch_id, class_id)"""),
    "ranked_regions": (ranked_regions, f"{_REGIONS} SELECT patch_id, class_id, row_number() OVER (PARTITION BY patch_id, class_id ORDER BY area_px DESC, region)::INT AS rank, area_px FROM regions"),
    "stacked_fractions": (stacked_fractions, f"""{_MASKS}, f AS (SELECT p.patch_id, k::INT AS class_id, count(m.class_id) / 64 AS fraction FROM (SELECT DISTINCT patch_id FROM masks) p CROSS JOIN range(4) g(k) LEFT JOIN masks m ON m.patch_id = p.patch_id AND m.class_id = k GROUP BY p.patch_id, k)
SELECT patch_id, class_id, round(fraction, 6) AS fraction, round(coalesce(sum(fraction) OVER (PARTITION BY patch_id ORDER BY class_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS bottom FROM f"""),
    "seasonal_chart": (seasonal_chart, f"{_SAMPLES} SELECT {_SEASON} AS season, {', '.join(f'round(coalesce(avg(fraction) FILTER (class_id = {k}), 0), 6) AS mean_{k}, round(coalesce(stddev_pop(fraction) FILTER (class_id = {k}), 0), 6) AS std_{k}' for k in range(1, 7))} FROM samples GROUP BY 1"),
    "side_by_side": (side_by_side, f"{_CELLS}, i AS (SELECT min(vec_id) AS a, (SELECT min(vec_id) FROM embeddings WHERE vec_id > (SELECT min(vec_id) FROM embeddings)) AS b FROM embeddings) SELECT r::INT AS r, c::INT AS c, max({_BUCKET.format('v0')}) FILTER (patch_id = a) AS left, max({_BUCKET.format('v0')}) FILTER (patch_id = b) AS right FROM cells, i GROUP BY r, c"),
    "class_frequencies": (class_frequencies, f"{_PER_CLASS} SELECT class_id::INT AS class_id, support::BIGINT AS true_pixels, (tp + fp)::BIGINT AS pred_pixels, round(support / total, 6) AS true_share, round((tp + fp) / total, 6) AS pred_share FROM each"),
    "split_metrics": (split_metrics, f"""{_MATRIX}, s AS (SELECT CASE WHEN label < 7 THEN 'train' ELSE 'test' END AS split, pred, truth FROM pairs JOIN embeddings ON vec_id = sample_id),
e AS (SELECT split, k, count(*) FILTER (truth = k AND pred = k) AS tp, count(*) FILTER (truth <> k AND pred = k) AS fp, count(*) FILTER (truth = k AND pred <> k) AS fn, count(*) AS total FROM s, range(4) t(k) GROUP BY split, k)
SELECT split, round(sum(tp) / max(total), 6) AS pixel_accuracy, round(avg(tp / nullif(tp + fn, 0)), 6) AS mean_pixel_accuracy, round(avg(tp / nullif(tp + fp + fn, 0)), 6) AS mean_iou, round(min(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS worst_recall FROM e GROUP BY split"""),
    "combined_losses": (combined_losses, f"{_LOSSES} SELECT patch_id, round(0.7::DOUBLE * cross_entropy + (1 - 0.7::DOUBLE) * dice, 6) AS loss FROM plain JOIN (SELECT patch_id, 1 - avg(o) AS dice FROM soft GROUP BY patch_id) USING (patch_id)"),
    "report_sections": (report_sections, f"""{_SAMPLE_ROWS},
pairs AS (SELECT patch_id AS sample_id, {_BUCKET.format('v0')} AS pred, {_BUCKET.format('v1')} AS truth, least(abs(v0) * 2, 1) AS confidence FROM cells),
e AS (SELECT k, count(*) FILTER (truth = k AND pred = k)::DOUBLE AS tp, count(*) FILTER (truth <> k AND pred = k)::DOUBLE AS fp, count(*) FILTER (truth = k AND pred <> k)::DOUBLE AS fn, count(*)::DOUBLE AS total FROM pairs, range(4) t(k) GROUP BY k),
s AS (SELECT sum(tp) / max(total) AS acc, avg(tp / nullif(tp + fp + fn, 0)) AS iou, sum((tp + fn) * (tp + fp)) / (max(total) * max(total)) AS chance FROM e), d AS (SELECT count(*)::DOUBLE AS n, sum(total_pixels)::DOUBLE AS px, avg(fraction_water) AS w, avg(fraction_sand) AS sa, avg(mean_confidence) AS mc FROM analysed),
told AS (SELECT 'evaluation' AS section, 'pixel_accuracy' AS name, acc AS value FROM s UNION ALL SELECT 'evaluation', 'mean_iou', iou FROM s UNION ALL SELECT 'evaluation', 'kappa', (acc - chance) / (1 - chance) FROM s UNION ALL SELECT 'inference', 'mean_confidence', mc FROM d
UNION ALL SELECT 'morphology', 'n_samples', n FROM d UNION ALL SELECT 'morphology', 'total_pixels', px FROM d UNION ALL SELECT 'morphology', 'mean_water', w FROM d UNION ALL SELECT 'morphology', 'mean_sand', sa FROM d UNION ALL SELECT 'morphology', 'mean_confidence', mc FROM d)
SELECT section, name, round(value, 6) AS value FROM told"""),
    "artifact_registry": (artifact_registry, """WITH n AS (SELECT *, CASE WHEN length(url) % 2 = 0 THEN 'figure' ELSE 'prediction' END AS kind, row_number() OVER (ORDER BY page_id, url) AS k FROM pages), s AS (SELECT url, max(length(html)) AS size FROM pages WHERE length(html) > 1000 GROUP BY url)
SELECT printf('run1_%s_%04d', kind, k) AS artifact_id, kind AS artifact_type, n.url AS path, coalesce(size, -1)::BIGINT AS size_bytes FROM n LEFT JOIN s ON s.url = n.url"""),
    "artifact_totals": (artifact_totals, """WITH s AS (SELECT url, max(length(html)) AS size FROM pages WHERE length(html) > 1000 GROUP BY url) SELECT count(*) AS n_artifacts, coalesce(sum(size), 0)::BIGINT AS total_bytes FROM pages LEFT JOIN s USING (url)"""),
    "manifest_csv": (manifest_csv, _PATCH_MANIFEST),
    "manifest_json": (manifest_json, _PATCH_MANIFEST),
    "label_manifest_defaults": (label_manifest_defaults, "SELECT o_orderkey::VARCHAR AS patch_id, o_orderkey % 2 = 0 AS is_valid, 0.5::DOUBLE AS confidence, 'winter' AS season, 1 AS year, 'spectral_rules' AS generation_strategy FROM orders"),
    "split_manifests": (split_manifests, f"{_TEMPORAL} SELECT sample_id, scene_id, split FROM dealt WHERE split <> 'validation'"),
    "appended_manifest": (appended_manifest, "SELECT month(o_orderdate::DATE)::INT AS month, count(*) AS n FROM orders GROUP BY 1"),
    "label_masks": (label_masks, f"{_MASKS} SELECT patch_id % 20 AS scene_id, CASE WHEN confidence > 0.05 THEN class_id ELSE 255 END AS class_id, count(*) AS n FROM masks GROUP BY ALL"),
    "prediction_product": (prediction_product, f"""{_CELLS}, p AS (SELECT patch_id AS sample_id, r, c, 1 / (1 + exp((v1 - v0) * 10)) AS a, 1 / (1 + exp((v0 - v1) * 10)) AS b FROM cells)
SELECT sample_id, r::INT AS r, c::INT AS c, (b > a)::INT AS pred, round(a, 6) AS prob_water, round(b, 6) AS prob_other, round(greatest(a, b), 6) AS confidence, label FROM p JOIN embeddings ON vec_id = sample_id"""),
    "clashing_ids": (clashing_ids, "SELECT c_mktsegment || '_' || c_nationkey AS file_id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1"),
    "evaluation_report": (evaluation_report, f"""{_PER_CLASS} SELECT class_id::INT AS class_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, support::BIGINT AS support, total::BIGINT AS total, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou,
 (SELECT round(sum(tp) / max(total), 6) FROM each) AS pixel_accuracy, (SELECT round((sum(tp)::DOUBLE / max(total) - sum((tp + fn)::DOUBLE * (tp + fp)) / (max(total)::DOUBLE * max(total))) / (1 - sum((tp + fn)::DOUBLE * (tp + fp)) / (max(total)::DOUBLE * max(total))), 6) FROM each) AS kappa FROM each"""),
    "statistics_files": (statistics_files, f"""{_OBS}, long AS (UNPIVOT (SELECT {', '.join(spectral.OPTICAL)} FROM obs) ON {', '.join(spectral.OPTICAL)} INTO NAME band VALUE x)
SELECT band, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM long GROUP BY band"""),
    "stream_confusion": (stream_confusion, "SELECT quality::INT AS truth, toxic::INT AS pred, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL"),
    "stream_moments": (stream_moments, "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type"),
    "stream_labels": (stream_labels, f"""WITH s AS (SELECT o_orderdate::DATE AS acq_date, o_totalprice > 100000 AS ok FROM orders) SELECT {_SEASON} AS season, year(acq_date)::INT AS year, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_rejected FROM s GROUP BY ALL"""),
    "stream_new_patches": (stream_new_patches, "SELECT DISTINCT l_orderkey AS patch_id FROM lineitem"),
    "stream_areas": (stream_areas, "SELECT strftime(DATE '1970-01-01' + ((date_diff('day', DATE '1970-01-01', ts::DATE) // 5) * 5)::INT, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stream_change": (stream_change, """WITH d AS (SELECT event_type, user_id % 5 AS aoi, ts::DATE AS to_date, sum(floor(value))::BIGINT AS to_value FROM events GROUP BY ALL),
l AS (SELECT event_type, aoi, lag(to_date) OVER w AS from_date, to_date, lag(to_value) OVER w AS from_value, to_value FROM d WINDOW w AS (PARTITION BY event_type, aoi ORDER BY to_date)) SELECT *, to_value - from_value AS delta FROM l WHERE from_date IS NOT NULL"""),
}

QUERIES = {name: run for name, (run, _) in REGISTERED.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in REGISTERED.items() if sql}
