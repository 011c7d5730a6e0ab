"""Raster views of plain tables: observations, scenes, patches, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as pixels: a repeated (row, col) is the time series of a pixel."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, folder, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).cast("long").alias("aoi_id"),
        F.col("l_orderkey").alias("row"),
        F.col("l_linenumber").cast("long").alias("col"),
        F.col("l_shipdate").cast("date").alias("acq_date"),
        F.concat_ws("-", part, supp, F.col("l_linenumber")).alias("scene_id"),
        F.col("l_discount").alias("Blue"),
        F.col("l_tax").alias("Green"),
        (F.col("l_quantity") / 50).alias("Red"),
        (F.col("l_extendedprice") / 100000).alias("NIR"),
        (part % 1000 / 1000).alias("SWIR1"),
        (supp % 100 / 100).alias("SWIR2"),
        (part % 256).cast("int").alias("QA"),
    )


def bright_masked(spark: SparkSession, folder: str) -> DataFrame:
    """The observations with a mask as clouds make it: cloud where Blue, cirrus where Green is brightest, clear elsewhere."""
    qa = F.when(F.col("Blue") > 0.095, 8).when(F.col("Green") > 0.075, 4).otherwise(64)
    return observations(spark, folder).withColumn("QA", qa)


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scenes; the event type stands for the sensor, the user for the area."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("scene_id"),
        F.col("event_type").alias("sensor"),
        F.col("ts").cast("timestamp").cast("date").alias("acq_date"),
        F.least("value", F.lit(100.0)).alias("cloud_cover"),
        F.col("user_id").alias("aoi_id"),
        (F.col("event_id") % 40).cast("double").alias("min_lon"),
        (F.col("event_id") % 40 + 2).cast("double").alias("max_lon"),
        (F.col("event_id") % 25).cast("double").alias("min_lat"),
        (F.col("event_id") % 25 + 1).cast("double").alias("max_lat"),
    )


def patch_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as patches eight cells wide, with the value at the next places as further bands."""
    cells = table(spark, folder, "embeddings").select(F.col("vec_id").alias("patch_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    cells = cells.select("patch_id", "v", F.posexplode("v").alias("pos", "value"))
    at = lambda k: F.get("v", (F.col("pos") + k) % F.size("v"))
    return cells.select("patch_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).cast("int").alias("c"), *[at(k).alias(f"v{k}") for k in range(8)])


def scene_cells(spark: SparkSession, folder: str, side: int = 4) -> DataFrame:
    """Class masks of the patches, ``side`` times ``side`` of them laid out as one scene."""
    v, n = F.col("patch_id"), side * side
    bucket = F.when(F.col("v0") < -0.1, 0).when(F.col("v0") < 0, 1).when(F.col("v0") < 0.1, 2).otherwise(3)
    place = {"row": F.floor(v % n / side) * 8 + F.col("r"), "col": v % side * 8 + F.col("c")}
    return patch_cells(spark, folder).select(F.floor(v / n).alias("scene_id"), *[x.cast("long").alias(k) for k, x in place.items()], bucket.alias("class_id"), F.least(F.abs("v0") * 2, F.lit(1.0)).alias("confidence"))


def pred_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Class of a cell by its value, against the class of the next cell's value."""
    bucket = lambda c: F.when(F.col(c) < -0.1, 0).when(F.col(c) < 0, 1).when(F.col(c) < 0.1, 2).otherwise(3)
    return patch_cells(spark, folder).select(F.col("patch_id").alias("sample_id"), "r", "c", bucket("v0").alias("pred"), bucket("v1").alias("truth"), F.least(F.abs("v0") * 2, F.lit(1.0)).alias("confidence"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as samples: customer = scene, nation = area, segment = river, region = basin."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("scene_id"),
        F.col("n_name").alias("aoi_id"),
        F.col("c_mktsegment").alias("river_name"),
        F.col("r_name").alias("basin_id"),
        F.col("o_orderdate").cast("date").alias("acq_date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("class_id"),
        (F.col("o_orderkey") % 101 / 100).alias("valid_ratio"),
        (F.floor(F.col("o_totalprice")) % 1000).cast("long").alias("pixels"),
    )


CRAFT = ("LANDSAT_5", "LANDSAT_7", "LANDSAT_8", "LANDSAT_9", "Sentinel-2A")


def raw_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as pixels of five spacecraft, with integers under each sensor's own band names; quality follows the day of the month."""
    craft = F.get(F.array(*[F.lit(x) for x in CRAFT]), (F.col("l_suppkey") % 5).cast("int"))
    values = [F.col("l_quantity") * 800, F.col("l_extendedprice") / 3, F.col("l_discount") * 300000, F.col("l_tax") * 400000, F.col("l_partkey") % 1000 * 40.0, F.col("l_suppkey") % 100 * 400.0, F.col("l_linenumber") * 5000.0]
    day = F.dayofmonth(F.col("l_shipdate").cast("date"))
    quality = F.when(craft == "Sentinel-2A", day % 12).otherwise(F.expr("shiftleft(1, CAST(dayofmonth(CAST(l_shipdate AS date)) % 8 AS int))")).cast("double")
    named = lambda names: F.create_map(*[x for n, v in zip(names, [*values, quality], strict=True) if n for x in (F.lit(n), v)])
    oli, tm = ("SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "SR_B7", "ST_B10", "QA_PIXEL"), ("SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B7", "ST_B6", "QA_PIXEL")
    s2 = ("B2", "B3", "B4", "B8", "B11", "B12", None, "SCL")
    bands = F.when(craft == "Sentinel-2A", named(s2)).when(craft.isin("LANDSAT_8", "LANDSAT_9"), named(oli)).otherwise(named(tm))
    keys = [F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("col"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")]
    return table(spark, folder, "lineitem").select(*keys, craft.alias("spacecraft_id"), bands.alias("bands"))


def epoch_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as epochs of a user's training run, in the order of their ids."""
    from pyspark.sql import Window

    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, folder, "events").select(F.col("user_id").alias("run_id"), epoch.cast("long").alias("epoch"), (F.col("value") - 2).alias("val_loss"), F.col("value").alias("loss"), (F.col("event_id") % 7 + 1).alias("size"))
