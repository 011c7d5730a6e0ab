"""Sections of a report, and the registry of what a run wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(**tables: DataFrame) -> DataFrame:
    """(section, name, value) out of one-row tables of figures, to 6 places."""
    def one(section: str, table: DataFrame) -> DataFrame:
        names = [c for c, kind in table.dtypes if kind not in ("string", "boolean")]
        wide = table.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in names])
        return wide.unpivot([], names, "name", "value").select(F.lit(section).alias("section"), "name", "value")

    return reduce(DataFrame.unionByName, [one(s, t) for s, t in tables.items()])


def artifacts(paths: DataFrame, listing: DataFrame, run: str) -> DataFrame:
    """``paths`` (artifact_type, path, ordinal) with an id and the size of the file, -1 where ``listing`` (path, length) has none.

    Ids count the artifacts of the whole run; a count per block of ordinals
    finds each place, so no task numbers them all.
    """
    block = F.floor(F.col("ordinal") / 100_000)
    blocks = paths.groupBy(block.alias("block")).agg(F.count("*").alias("in_block"))
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per hundred thousand
    before = blocks.select("block", F.coalesce(F.sum("in_block").over(w), F.lit(0)).alias("before"))
    placed = paths.withColumn("block", block).join(before, "block")
    number = F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("ordinal", "path"))
    sizes = listing.groupBy("path").agg(F.max("length").alias("length"))
    return placed.withColumn("number", number).join(sizes, "path", "left").select(
        F.format_string("%s_%s_%04d", F.lit(run), "artifact_type", "number").alias("artifact_id"), "artifact_type", "path", F.coalesce("length", F.lit(-1)).cast("long").alias("size_bytes")
    )


def artifact_totals(registry: DataFrame) -> DataFrame:
    """Number of artifacts, and their size as far as known."""
    return registry.agg(F.count("*").alias("n_artifacts"), F.coalesce(F.sum(F.when(F.col("size_bytes") >= 0, F.col("size_bytes"))), F.lit(0)).alias("total_bytes"))
