"""Manifests and products: fixed schemas, CSV and JSON tables, rasters and masks as partitioned Parquet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import documents

# The fields of each kind of manifest, in order.
SCENE = "scene_id string, image_path string, metadata_path string, export_timestamp string, num_bands int, width int, height int, crs string, start_date string, end_date string, sensors string, composite_method string, cloud_cover_limit double, num_spectral_indices int, file_size_bytes long, is_valid boolean"
PATCH = "patch_id string, scene_id string, source_image_path string, patch_path string, row_index int, col_index int, row_off int, col_off int, height int, width int, num_bands int, crs string, valid_pixel_ratio double, file_size_bytes long, created_at string"
LABEL = "patch_id string, scene_id string, patch_path string, mask_path string, crs string, width int, height int, is_valid boolean, validation_issues string, num_classes_present int, valid_pixel_ratio double, source_type string, acquisition_date string, year int, month int, season string, hydrological_year int, sensor string, river_name string, reach_id string, basin_id string, aoi_id string, label_version string, annotator string, confidence double, confidence_source string, processing_history string, created_at string, generation_strategy string"
DATASET = "sample_id string, patch_id string, scene_id string, patch_path string, mask_path string, split string, crs string, width int, height int, num_bands int, row_index int, col_index int, patch_valid_pixel_ratio double, label_valid_pixel_ratio double, num_classes_present int, acquisition_date string, year int, month int, season string, hydrological_year int, sensor string, river_name string, reach_id string, basin_id string, aoi_id string, label_version string, annotator string, confidence double, confidence_source string"
BOX = "min_lon: double, min_lat: double, max_lon: double, max_lat: double"
AFFINE = "a: double, b: double, c: double, d: double, e: double, f: double"
METADATA = f"schema_version string, scene_id string, export_timestamp string, aoi struct<{BOX}>, crs string, transform struct<{AFFINE}>, width int, height int, resolution_meters double, num_bands int, band_names array<string>, composite_bands array<string>, spectral_indices array<string>, composite_method string, sensors array<string>, start_date string, end_date string, cloud_cover_limit double, operations_applied array<string>, num_tiles int"
STATISTICS = "band_names array<string>, mean array<double>, std array<double>, min array<double>, max array<double>"
SCHEMAS = {"scene": SCENE, "patch": PATCH, "label": LABEL, "dataset": DATASET}
VERSIONS = {"scene": "1.0", "patch": "1.0", "label": "1.1", "dataset": "1.0"}
DEFAULTS = {"label": {"generation_strategy": "spectral_rules"}}


def own_folder(spark: SparkSession) -> str:
    """This application's folder within the one that driver and executors share; only a local session may do without ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}"
    return f"{found.rstrip('/')}/rasterspark-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in this application's own; ``close`` deletes them all."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def close(spark: SparkSession) -> None:
    """Delete what this application has kept in the shared folder; nothing may read it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts the lineage, so a lost executor costs a read only."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _schema(kind) -> StructType:
    return kind if isinstance(kind, StructType) else StructType.fromDDL(SCHEMAS[kind])


def _complete(rows: DataFrame, kind) -> DataFrame:
    """Missing values that have a default get it."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.get(kind, {}).items()}) if isinstance(kind, str) else rows


def read_csv(spark: SparkSession, path: str, kind) -> DataFrame:
    """A manifest of a kind (or of any schema); columns go by place, those that an older file lacks at its end are NULL or have their default.

    Booleans are read in any case; what does not fit its type is an error.
    """
    schema = _schema(kind)
    text = StructType([StructField(f.name, StringType()) for f in schema])
    raw = spark.read.csv(path, schema=text, header=True, enforceSchema=True)
    return _complete(raw.select(*[F.lower(F.trim(f.name)).cast("boolean").alias(f.name) if f.dataType.simpleString() == "boolean" else F.col(f.name).cast(f.dataType) for f in schema]), kind)


def read_json(spark: SparkSession, path: str, kind) -> DataFrame:
    """Rows of the ``entries`` of {version, entry_count, entries}: a document in parts, or one file."""
    if documents.is_document(spark, path):
        return _complete(documents.read(spark, path, _schema(kind)), kind)
    whole = StructType([StructField("version", StringType()), StructField("entry_count", LongType()), StructField("entries", ArrayType(_schema(kind)))])
    return _complete(spark.read.json(path, schema=whole, multiLine=True).select(F.inline("entries")), kind)


def read_metadata(spark: SparkSession, path: str, any_depth: bool = False) -> DataFrame:
    """Nested scene metadata, one row per file; with ``any_depth`` from folders below ``path`` too, whose names give no columns."""
    return spark.read.json(path, schema=METADATA, multiLine=True, recursiveFileLookup=any_depth)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(band, mean, std, min, max) of a file that holds one array for each."""
    whole = spark.read.json(path, schema=STATISTICS, multiLine=True)
    return whole.select(F.inline(F.arrays_zip("band_names", "mean", "std", "min", "max"))).withColumnRenamed("band_names", "band")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, version: str = "1.0") -> None:
    """One document {version, entry_count, entries}, in parts that their tasks write."""
    documents.write(rows, path, version)


def write_by_split(rows: DataFrame, path: str) -> None:
    """The full manifest, and one folder per split that has rows."""
    write_csv(rows, f"{path}/all")
    rows.write.partitionBy("split").option("header", True).csv(f"{path}/by_split")


def write_pixels(pixels: DataFrame, path: str, by: str = "scene_id", rows_a_file: int = 10_000_000) -> None:
    """Rasters, masks or predictions as Parquet, a folder for each scene or sample, files of ``rows_a_file`` rows at most."""
    pixels.withColumn("_salt", F.pmod(F.xxhash64("r", "c"), F.lit(64)) if {"r", "c"} <= set(pixels.columns) else F.lit(0)).repartition(by, "_salt").drop("_salt").write.option("maxRecordsPerFile", rows_a_file).partitionBy(by).parquet(path)


def write_labels(cells: DataFrame, path: str, by: str = "patch_id", nodata: int = 255) -> None:
    """Label masks: the class as a small number, the nodata code where there is none."""
    write_pixels(cells.select(by, "r", "c", F.coalesce(F.col("class_id"), F.lit(nodata)).cast("short").alias("class_id")), path, by)


def write_scenes(pixels: DataFrame, scenes: DataFrame, path: str, bands, key: str = "scene_id") -> None:
    """Georeferenced rasters: ``pixels`` (key, row, col, bands) below ``path``/pixels, a folder a scene, and ``path``/headers.

    ``scenes`` has (key, crs, transform), ``transform`` a struct of the six
    numbers of AFFINE.  Headers, one row a scene, hold these, the names of the
    bands in order, and width, height and valid share of what was written; a
    scene without a header in ``scenes`` is an error.
    """
    own = pixels.select(key, F.col("row").alias("r"), F.col("col").alias("c"), *bands)
    sizes = own.groupBy(key).agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), *[F.count(b).alias(f"n_{k}") for k, b in enumerate(bands)], F.count("*").alias("n"))
    valid = F.array(*[F.col(f"n_{k}") / F.col("n") for k in range(len(bands))])
    headers = kept(sizes.join(scenes.select(key, "crs", "transform"), key, "left").select(key, "crs", "transform", "width", "height", F.array(*map(F.lit, bands)).alias("band_names"), valid.alias("valid_shares")), "headers")
    if bare := headers.where("crs IS NULL OR transform IS NULL").limit(1).count():
        raise ValueError(f"{bare} scene or more without reference system or transform")
    write_pixels(own, f"{path}/pixels", key)
    headers.write.parquet(f"{path}/headers")


def read_scenes(spark: SparkSession, path: str, key: str = "scene_id") -> DataFrame:
    """Pixels of ``write_scenes`` with the place of their centre: (key, r, c, bands, crs, x, y)."""
    pixels, headers = spark.read.parquet(f"{path}/pixels"), spark.read.parquet(f"{path}/headers").select(key, "crs", "transform")
    at = lambda a, b, c: F.col(f"transform.{a}") * (F.col("c") + 0.5) + F.col(f"transform.{b}") * (F.col("r") + 0.5) + F.col(f"transform.{c}")
    return pixels.join(headers, key).withColumns({"x": at("a", "b", "c"), "y": at("d", "e", "f")}).drop("transform")


def product(cells: DataFrame, samples: DataFrame, classes, key: str = "sample_id") -> DataFrame:
    """Prediction product: predicted class, a probability band for each class, confidence, and the sample's columns."""
    bands = [F.get("probs", F.lit(k)).alias(f"prob_{name}") for k, name in enumerate(classes)]
    return cells.select(key, "r", "c", "pred", *bands, "confidence").join(samples, key)


def sanitised(ident: Column) -> Column:
    """An id as a file name: anything but letters, digits, - _ and . becomes _."""
    return F.regexp_replace(ident.cast("string"), r"[^\p{L}\p{N}\-_.]", "_")


def clashing_ids(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """(file_id, n): ids that would be written to one file; an export with any must not start."""
    return samples.groupBy(sanitised(F.col(key)).alias("file_id")).agg(F.count("*").alias("n")).where("n > 1")


def rounded(table: DataFrame, places: int = 6) -> DataFrame:
    """Doubles as reports give them."""
    return table.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in table.dtypes])


def write_report(metrics: DataFrame, per_class: DataFrame, path: str) -> None:
    """Evaluation as JSON and its classes as CSV, values to 6 places."""
    rounded(metrics).coalesce(1).write.json(f"{path}/metrics")
    write_csv(rounded(per_class).coalesce(1), f"{path}/classes")


def write_split_statistics(statistics: DataFrame, path: str) -> None:
    """One JSON line for each split."""
    rows = statistics.groupBy("split").agg(F.array_sort(F.collect_list(F.struct(*[c for c in statistics.columns if c != "split"]))).alias("classes"))
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def quality_report(score: DataFrame, issues: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row: the score's columns, issues (a row each) and splits (split, class_id, n_samples, pixels, share, imbalance) as sorted arrays.

    Issues are one for each kind and split, statistics one for each class and split, so all of it fits a row.
    """
    told = issues.agg(F.array_sort(F.collect_list(F.struct(*sorted(issues.columns)))).alias("issues"), F.count("*").alias("n_issues"))
    splits = statistics.agg(F.array_sort(F.collect_list(F.struct("split", "class_id", "n_samples", "pixels", "share", "imbalance"))).alias("splits"))
    return rounded(score).crossJoin(F.broadcast(told)).crossJoin(F.broadcast(splits))


def write_quality_report(report: DataFrame, path: str) -> None:
    """The report of ``quality_report`` as one JSON object."""
    report.coalesce(1).write.json(path)


def of_type(rows: DataFrame, value: str, column: str = "artifact_type") -> DataFrame:
    """Figures or artifacts of a type, in any case; no such type gives no rows."""
    return rows.where(F.lower(F.trim(column)) == value.strip().lower())
