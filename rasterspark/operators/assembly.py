"""From patches and labels to a split, checked and counted data set."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks, dataset


@dataclass(frozen=True)
class AreaResult:
    """What the stages of one area gave; None where a stage gave nothing.  ``failed`` holds the error that ended them, if one did."""

    aoi_id: str
    patches: DataFrame | None = None
    labels: DataFrame | None = None
    failed: str | None = None


def united(areas: list[AreaResult], key: str = "patch_id") -> tuple[DataFrame | None, DataFrame | None, str]:
    """(patches, labels, area that stands for all: the first) of all areas, for the stages that see them together.

    Rows keep their area in ``aoi_id`` and their place in ``area_order``, so
    labels of one patch id in two areas stay apart and later ones win as they
    came.  Columns that one area lacks are NULL there; an area without patches or labels
    adds none.  After a failed area nothing is united: an error names it.
    """
    if not areas:
        raise ValueError("no area")
    if failed := next((a for a in areas if a.failed), None):
        raise RuntimeError(f"area {failed.aoi_id}: {failed.failed}")

    def together(name: str) -> DataFrame | None:
        own = [(k, a.aoi_id, getattr(a, name)) for k, a in enumerate(areas)]
        own = [df.withColumns({"aoi_id": F.lit(aoi), "area_order": F.lit(k), key: F.concat_ws("/", F.lit(aoi), F.col(key))}) for k, aoi, df in own if df is not None]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own) if own else None

    return together("patches"), together("labels"), areas[0].aoi_id


@dataclass(frozen=True)
class Assembly:
    samples: DataFrame
    unlabelled: DataFrame
    issues: DataFrame
    leaks: DataFrame
    statistics: DataFrame
    quality: DataFrame


def assemble(patches: DataFrame, labels: DataFrame, order: str = "ordinal", key: str = "patch_id", strategy: str = "temporal", least_ratio: float = 0.5, ids=("sample_id", "scene_id"), **options) -> Assembly:
    """Join, check, split, look for leaks, count and rate; each table is lazy.

    A sample below the least valid share is reported but stays in the data set.
    """
    samples = dataset.labelled(patches, labels, order, key).withColumn("sample_id", F.col(key))
    issues = checks.sample_issues(samples, least_ratio=least_ratio)
    dealt = dataset.split(samples, strategy, **options)
    leaks = dataset.leakage(dealt, *ids)
    statistics = dataset.split_statistics(dealt)
    one = dealt.agg(F.count("*").alias("n_samples"), F.avg((F.coalesce(F.col("valid_ratio") >= least_ratio, F.lit(False))).cast("double")).alias("valid"))
    one = one.crossJoin(leaks.agg(F.count("*").alias("n_leaks"))).crossJoin(statistics.where("split = 'overall'").agg(F.max("imbalance").alias("imbalance"))).crossJoin(issues.agg(F.count_if(F.col("issue") == "repeated id").alias("n_errors")))  # one row each
    score = dataset.quality_score(F.col("valid"), (F.col("n_leaks") == 0).cast("double"), F.col("imbalance"), (F.col("n_errors") == 0).cast("double"))
    return Assembly(dealt, dataset.unlabelled(patches, labels, key), issues, leaks, statistics, one.withColumn("score", score))


def split_dates(samples: DataFrame, season: str = "season", date: str = "acq_date") -> DataFrame:
    """(split, kind, name, n): samples of each split, and over all, by season and by year."""
    named = samples.select("split", F.explode(F.array(F.struct(F.lit("season").alias("kind"), F.col(season).alias("name")), F.struct(F.lit("year").alias("kind"), F.year(date).cast("string").alias("name")))).alias("x"))
    counts = named.select("split", "x.*").rollup("kind", "name", "split").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return counts.where("level <= 1").select(F.coalesce("split", F.lit("overall")).alias("split"), "kind", "name", "n")
