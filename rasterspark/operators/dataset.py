"""Samples: joins, splits, leakage, quality, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def labelled(patches: DataFrame, labels: DataFrame, order: str = "ordinal", key: str = "patch_id") -> DataFrame:
    """Patches with their last valid label; those without one are left out."""
    last = labels.where("is_valid").groupBy(key).agg(F.max_by(F.struct(*[c for c in labels.columns if c not in (key, "is_valid")]), order).alias("label"))
    return patches.join(last, key).select(patches["*"], "label.*")


def unlabelled(patches: DataFrame, labels: DataFrame, key: str = "patch_id") -> DataFrame:
    return patches.join(labels.where("is_valid"), key, "left_anti")


def check_ratios(ratios) -> None:
    if not 0.99 <= sum(ratios) <= 1.01:
        raise ValueError("ratios must add up to 1")


def _cut(place: Column, n: Column, ratios, corrected: bool) -> Column:
    """Split by place (from 1) in an ordered list of n."""
    train = F.greatest(F.lit(1), F.floor(n * ratios[0]))
    val = F.when(n == 1, 0).otherwise(F.greatest(F.lit(1), F.floor(n * ratios[1])))
    if corrected:
        val = F.when((n >= 3) & (n - train - val <= 0), F.greatest(F.lit(0), n - train - 1)).otherwise(val)
    return F.when(place <= train, SPLITS[0]).when(place <= train + val, SPLITS[1]).otherwise(SPLITS[2])


def split(samples: DataFrame, strategy: str = "temporal", ratios=(0.70, 0.15, 0.15), seed: int = 42, scene: str = "scene_id", area: str = "aoi_id", date: str = "acq_date") -> DataFrame:
    """``samples`` plus ``split``; all samples of a scene (or area) share one.

    temporal: scenes by first date.  random: scenes by a seeded hash.  spatial:
    areas by a seeded hash.  Places in the order of all groups come from counts
    per date or hash prefix, so no single task sorts them all.
    """
    check_ratios(ratios)
    if strategy == "temporal":
        group, mark = scene, F.min(date).cast("string")
    elif strategy in ("random", "spatial"):
        group = scene if strategy == "random" else area
        mark = F.first(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    else:
        raise ValueError("strategy is temporal, random or spatial")
    groups = samples.groupBy(group).agg(mark.alias("mark"))
    coarse = F.substring("mark", 1, 10) if strategy == "temporal" else F.substring("mark", 1, 3)
    groups = groups.withColumn("bin", coarse)
    bins = groups.groupBy("bin").agg(F.count("*").alias("in_bin"))  # one row per date, or 4096 at most
    bins = bins.select("bin", (F.sum("in_bin").over(Window.orderBy("bin")) - F.col("in_bin")).alias("before"), F.sum("in_bin").over(Window.partitionBy()).alias("n"))
    placed = groups.join(bins, "bin").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("mark", group)))
    chosen = placed.select(group, _cut(F.col("place"), F.col("n"), ratios, strategy != "spatial").alias("split"))
    return samples.join(chosen, group)


def leakage(samples: DataFrame, *ids: str) -> DataFrame:
    """Ids that occur in more than one split."""
    each = samples.select("split", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(i).cast("string").alias("id")) for i in ids])).alias("x"))
    return each.groupBy("x.kind", "x.id").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n")).where("n > 1").drop("n")


def duplicates(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    return samples.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def split_statistics(samples: DataFrame) -> DataFrame:
    """Per split, and over all: samples and pixels of each class, share and imbalance."""
    counts = samples.rollup("class_id", "split").agg(F.count_distinct("sample_id").alias("n_samples"), F.sum("pixels").alias("pixels"))
    counts = counts.where("class_id IS NOT NULL").withColumn("split", F.coalesce("split", F.lit("overall")))
    w = Window.partitionBy("split")
    some = F.when(F.col("pixels") > 0, F.col("pixels"))
    return counts.select("split", "class_id", "n_samples", "pixels", F.coalesce(F.try_divide("pixels", F.sum("pixels").over(w)), F.lit(0.0)).alias("share"), F.coalesce(F.try_divide(F.max(some).over(w), F.min(some).over(w)), F.lit(1.0)).cast("double").alias("imbalance"))


def quality_score(valid: Column, no_leak: Column, imbalance: Column, no_error: Column) -> Column:
    balance = F.greatest(F.lit(0.0), 1 - (imbalance - 1) / 20)
    return F.round(F.least(F.lit(1.0), 0.4 * valid + 0.3 * no_leak + 0.2 * balance + 0.1 * no_error), 4)


def class_weights(counts: DataFrame, n: str = "pixels", strategy: str = "inverse", manual: dict | None = None) -> DataFrame:
    """inverse: C * (1 / f) / sum(1 / f), f being the class share, at least 1e-8.  none: 1.  manual: by class id."""
    if strategy == "none":
        return counts.withColumn("weight", F.lit(1.0))
    if strategy == "manual":
        return counts.withColumn("weight", F.try_element_at(F.create_map(*[F.lit(x) for k, v in manual.items() for x in (k, float(v))]), F.col("class_id")))
    if strategy != "inverse":
        raise ValueError("strategy is inverse, none or manual")
    w = Window.partitionBy()  # one row per class
    share = F.greatest(F.col(n) / F.sum(n).over(w), F.lit(1e-8))
    return counts.withColumn("share", share).withColumn("weight", F.count("*").over(w) / F.col("share") / F.sum(1 / F.col("share")).over(w))


def season_weights(samples: DataFrame, season: str = "season") -> DataFrame:
    """1 / (seasons * samples of the season)."""
    counts = samples.groupBy(season).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("weight", 1 / (F.count("*").over(Window.partitionBy()) * F.col("_n")))
    return samples.join(F.broadcast(counts.drop("_n")), season)  # one row per season of the calendar


def valid_weights(samples: DataFrame, ratio: str = "valid_ratio") -> DataFrame:
    """1 / valid share (within 0.01 and 1), scaled to sum 1."""
    raw = 1 / F.least(F.greatest(F.col(ratio), F.lit(0.01)), F.lit(1.0))
    total = samples.agg(F.sum(raw).alias("_total"))
    return samples.crossJoin(F.broadcast(total)).withColumn("weight", raw / F.col("_total")).drop("_total")  # one row


def band_statistics(cells: DataFrame, bands, nodata: float = 255.0, robust: bool = False) -> DataFrame:
    """Per band mean, sample deviation (1 if undefined), least and most, over finite values other than nodata."""
    long = cells.unpivot([], list(bands), "band", "x")
    x = F.when(~F.isnan("x") & (F.abs("x") < float("inf")) & (F.col("x") != nodata), F.col("x"))
    std = F.stddev_samp(x)
    found = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.when(std > 1e-10, std).otherwise(1.0).alias("std"), F.min(x).alias("least"), F.max(x).alias("most")]
    plain = long.groupBy("band").agg(*found)
    if not robust:
        return plain
    return plain.join(band_percentiles(long.select("band", x.alias("x")), (0.02, 0.98)), "band").withColumnsRenamed({"q0": "p2", "q1": "p98"})


def band_percentiles(values: DataFrame, shares, bins: int = 4096) -> DataFrame:
    """Exact percentiles (q0, q1, ...) of x per band, no task holding all values of a band.

    Values are counted in ``bins`` equal ranges between a band's ends; the two
    values around each wanted place are then looked for in their own range only,
    by counts of distinct values.
    """
    known = values.where("x IS NOT NULL")
    ends = known.groupBy("band").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))  # one row per band
    place = F.coalesce(F.least(F.floor(F.try_divide((F.col("x") - F.col("low")) * bins, F.col("high") - F.col("low"))), F.lit(bins - 1)), F.lit(0))
    ranged = known.join(F.broadcast(ends), "band").withColumn("bin", place)
    counts = ranged.groupBy("band", "bin").agg(F.count("*").alias("in_bin"))
    w = Window.partitionBy("band").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("in_bin").over(w), F.lit(0)))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor((F.col("n") - 1) * s).alias("lower"), ((F.col("n") - 1) * s - F.floor((F.col("n") - 1) * s)).alias("part")) for k, s in enumerate(shares)])).alias("w")
    wanted = ends.select("band", "n", at).select("band", "w.*", F.explode(F.array_distinct(F.array("w.lower", F.least(F.col("w.lower") + 1, F.col("n") - 1)))).alias("rank"))
    wanted = wanted.join(counts, "band").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("in_bin")))
    held = ranged.join(F.broadcast(wanted.select("band", "bin").distinct()), ["band", "bin"], "left_semi").groupBy("band", "bin", "x").agg(F.count("*").alias("times"))  # two ranges per share and band
    upto = F.sum("times").over(Window.partitionBy("band", "bin").orderBy("x"))
    held = held.withColumn("upto", upto)
    found = wanted.join(held, ["band", "bin"]).where(F.col("rank") - F.col("before") < F.col("upto")).groupBy("band", "k", "rank", "lower", "part").agg(F.min("x").alias("x"))
    lower, upper = F.max(F.when(F.col("rank") == F.col("lower"), F.col("x"))), F.max("x")
    both = found.groupBy("band", "k").agg((lower + (upper - lower) * F.max("part")).alias("q"))
    return both.groupBy("band").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(shares))])


def normalise(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.greatest(std, F.lit(1e-8))


def denormalise(x: Column, mean: Column, std: Column) -> Column:
    return x * F.greatest(std, F.lit(1e-8)) + mean


def statistics_for(cells: DataFrame, bands, strategy: str = "mean_std") -> DataFrame:
    """(band, mean, std) to normalise with: mean and deviation, percentiles 2 to 98 as 0 to 1 (min_max), or nothing (none)."""
    if strategy == "none":
        return cells.sparkSession.createDataFrame([(b, 0.0, 1.0) for b in bands], "band string, mean double, std double")
    found = band_statistics(cells, bands, robust=strategy == "min_max")
    if strategy == "min_max":
        span = F.col("p98") - F.col("p2")
        return found.select("band", F.col("p2").alias("mean"), F.when(span > 1e-10, span).otherwise(1.0).alias("std"))
    if strategy != "mean_std":
        raise ValueError("strategy is mean_std, min_max or none")
    return found.select("band", "mean", "std")


def training_rows(cells: DataFrame, samples: DataFrame, stats: DataFrame, bands, key: str = "sample_id", nodata: int = 255, ignore: int = -1) -> DataFrame:
    """Cells ready to train on: normalised finite bands, the ignore index where the mask has no data, and their sample's columns."""
    wide = stats.groupBy().pivot("band", list(bands)).agg(F.first("mean").alias("m"), F.first("std").alias("s"))  # one row
    clean = lambda b: F.when(~F.isnan(b) & (F.abs(b) < float("inf")), F.col(b))
    rows = cells.join(samples, key).crossJoin(F.broadcast(wide))
    value = {b: F.coalesce(normalise(clean(b), F.col(f"{b}_m"), F.col(f"{b}_s")), F.lit(0.0)) for b in bands}
    rows = rows.withColumns(value | {"class_id": F.when(F.coalesce(F.col("class_id"), F.lit(nodata)) == nodata, ignore).otherwise(F.col("class_id"))})
    return rows.drop(*[f"{b}_{x}" for b in bands for x in "ms"])


def of_split(samples: DataFrame, split: str) -> DataFrame:
    return samples.where(F.col("split") == split)


def actual_ratios(samples: DataFrame) -> DataFrame:
    """Samples of each split and their share of all."""
    counts = samples.groupBy("split").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per split
